"""Dependency graphs as DataFrames: cycle groups and load levels.

Edges are ``edges(src, dst)`` with src loaded before dst. Long unbranched runs are
contracted by pointer doubling, so a chain of n nodes takes about log2(n) joins rather than
n; no transitive closure is built. State is checkpointed every round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowloom.session import forget, materialize, materialize_counted


def reference_edges(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges parent -> child from foreign keys; parents that are not listed are ignored."""
    known = tables.select(F.col("table_name").alias("parent"))
    return (
        fks.join(known, "parent", "left_semi")
        .select(F.col("parent").alias("src"), F.col("table_name").alias("dst"))
        .distinct()
    )


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))


def _degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree per node; counted before the shuffle, so hubs cost nothing extra."""
    out = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("node").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"))


@dataclass(frozen=True)
class _Runs:
    """Unbranched runs taken out of a graph.

    ``nodes`` (node, head, steps, base, first): the branching node before the run and the distance from it, the level
    the run alone guarantees, and the run's first node, which names it. ``ends`` (first, head, tail, w, offer): the
    branching nodes around a run, their distance, and the level the run alone guarantees to the tail. ``rings``
    (node, ring): rings that have no branch at all, with their smallest member. ``edges``: each run is one edge.
    """

    nodes: DataFrame
    ends: DataFrame
    rings: DataFrame
    edges: DataFrame


def _runs(edges: DataFrame, linear: DataFrame) -> _Runs | None:
    """Contract the runs of the ``linear`` nodes (node, base), those with one edge in and one out.

    Pointers are followed backwards only: the last node of a run then knows all that its tail needs.
    """
    linear, count = materialize_counted(linear)
    if count == 0:
        return None
    leaving = linear.select(F.col("node").alias("src"), F.lit(True).alias("leaves"))
    entering = linear.select(F.col("node").alias("dst"), "base", F.lit(True).alias("enters"))
    flagged = materialize(edges.join(leaving, "src", "left").join(entering, "dst", "left").select(
        "src", "dst", "w", "base", F.coalesce("leaves", F.lit(False)).alias("leaves"), F.coalesce("enters", F.lit(False)).alias("enters")
    ))
    hops = flagged.where("enters").select(
        F.col("dst").alias("node"), F.col("src").alias("at"), F.col("w").alias("steps"), "base", F.col("leaves").alias("inner"),
        F.col("src").alias("low"), F.col("dst").alias("first"),
    )
    done, circling = _follow(hops, count)
    last = flagged.where("leaves and not enters").select(F.col("src").alias("node"), F.col("dst").alias("tail"), "w")
    ends = materialize(last.join(done, "node").select(
        "first", "head", "tail", (F.col("steps") + F.col("w")).alias("w"), (F.col("base") + F.col("w")).alias("offer")
    ))
    kept = flagged.where("not leaves and not enters").select("src", "dst", "w")
    bridges = ends.select(F.col("head").alias("src"), F.col("tail").alias("dst"), "w")
    contracted = materialize(_heaviest(kept.unionByName(bridges)))
    for table in (linear, flagged):
        forget(table)
    return _Runs(done, ends, circling.select("node", F.least("node", "low").alias("ring")), contracted)


def _follow(hops: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Follow pointers, doubling the distance each round, until they leave the linear nodes; those that never do.

    A round writes only the pointers that were still inside.
    """
    now, going = _pointers(hops)
    done = [now.where("not inner")]
    for _ in range(ceil(log2(count + 1)) + 1):
        if going == 0:
            break
        # A linear node has one neighbour behind it, so targets are distinct.
        onward = reduce(DataFrame.unionByName, done, now.where("inner")).select(
            F.col("node").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("base").alias("base2"),
            F.col("inner").alias("inner2"), F.col("low").alias("low2"), F.col("first").alias("first2"),
        )
        now, going = _pointers(now.where("inner").join(onward, "at").select(
            "node", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"),
            F.greatest(F.col("base"), F.col("base2") + F.col("steps")).alias("base"),
            F.col("inner2").alias("inner"), F.least("low", "low2").alias("low"), F.col("first2").alias("first"),
        ))
        done.append(now.where("not inner"))
    left = reduce(DataFrame.unionByName, done).select("node", F.col("at").alias("head"), "steps", "base", "first")
    return left, now.where("inner")


def _pointers(rows: DataFrame) -> tuple[DataFrame, int]:
    """The pointers as a table, and how many are still inside."""
    seen = Observation()
    table = materialize(rows.observe(seen, F.count_if(F.col("inner")).alias("going")))
    return table, seen.get["going"]


def _heaviest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.max("w").alias("w"))


def component_ids(edges: DataFrame) -> DataFrame:
    """(node, component): nodes in a common cycle share the component id, their smallest member.

    Each round drops nodes without predecessors or successors (alone in their component) and
    contracts runs; when neither applies, one round of colouring finds the components whose
    smallest node reaches all others, and removes them.
    """
    all_nodes = materialize(_ends(edges).distinct())
    left, size = materialize_counted(edges.where("src <> dst").select("src", "dst", F.lit(1).cast("bigint").alias("w")).distinct())
    found: list[DataFrame] = []
    expansions: list[DataFrame] = []
    while size:
        keep = _degrees(left).where("ins > 0 and outs > 0").select("node")
        left, inner_size = materialize_counted(
            left.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(
                keep.withColumnRenamed("node", "dst"), "dst", "left_semi"
            )
        )
        shrunk, size = inner_size < size, inner_size
        linear = _degrees(left).where("ins = 1 and outs = 1").select("node", F.lit(0).cast("bigint").alias("base"))
        runs = _runs(left, linear) if size else None
        if runs is not None:
            found.append(runs.rings.select("node", F.col("ring").alias("component")))
            expansions.append(runs.nodes.select("node", "head", "first").join(runs.ends.select("first", "tail"), "first"))
            left, size = materialize_counted(runs.edges.where("src <> dst"))
        elif size and not shrunk:
            members = _colour(left)
            found.append(members)
            gone = members.select("node")
            left, size = materialize_counted(
                left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(
                    gone.withColumnRenamed("node", "dst"), "dst", "left_anti"
                )
            )
    known = reduce(DataFrame.unionByName, found) if found else None
    ids = all_nodes.select("node", F.col("node").alias("component"))
    if known is not None:
        known = materialize(known.groupBy("node").agg(F.min("component").alias("component")))
        ids = materialize(all_nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    # A run belongs to a component when the nodes on both its sides do (or are the same node).
    for runs in reversed(expansions):
        sides = (
            runs.join(ids.select(F.col("node").alias("head"), F.col("component").alias("head_id")), "head")
            .join(ids.select(F.col("node").alias("tail"), F.col("component").alias("tail_id")), "tail")
            .where("head_id = tail_id").select("node", F.col("head_id").alias("merged"))
        )
        ids = materialize(ids.join(sides, "node", "left").select("node", F.coalesce("merged", "component").alias("component")))
    smallest = ids.groupBy("component").agg(F.min("node").alias("first"))
    return ids.join(smallest, "component").select("node", F.col("first").alias("component"))


def _colour(edges: DataFrame) -> DataFrame:
    """Members of the components found from the smallest node that reaches each node."""
    colours = _spread(edges, _ends(edges).distinct().select("node", F.col("node").alias("label")))
    same = (
        edges.join(colours.select(F.col("node").alias("src"), F.col("label").alias("a")), "src")
        .join(colours.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        .where("a = b").select("src", "dst", "a")
    )
    backwards = materialize(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    reached, size = materialize_counted(colours.where("node = label").select("node", F.col("label").alias("component")))
    frontier = reached
    while size:
        nxt = backwards.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "component").distinct()
        frontier, size = materialize_counted(nxt.join(reached, "node", "left_anti"))
        reached = materialize(reached.unionByName(frontier))
    return reached


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Send the smallest label along the edges until nothing changes."""
    labels, size = materialize_counted(labels)
    changed = labels
    while size:
        offers = (
            edges.join(changed.withColumnRenamed("node", "src"), "src")
            .groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        )
        both = materialize(labels.join(offers, "node", "left"))
        better = F.col("offer") < F.col("label")
        changed, size = materialize_counted(both.where(better).select("node", F.col("offer").alias("label")))
        labels = materialize(both.select("node", F.when(better, F.col("offer")).otherwise(F.col("label")).alias("label")))
    return labels


def cycle_groups(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(component, node) for the components with more than one node, and for nodes that refer to themselves.

    ``ids`` are component ids already at hand, from ``component_ids`` or ``load_levels``.
    """
    ids = component_ids(edges) if ids is None else ids.select("node", "component")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    grouped = ids.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    big = ids.join(grouped, "component", "left_semi")
    alone = ids.join(loops, "node", "left_semi").join(grouped, "component", "left_anti")
    return big.select("component", "node").unionByName(alone.select("component", "node"))


def load_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component, level): parents always on a lower level than children of other components.

    The level is the longest path over the condensed graph. A graph without cycles is its own
    condensation; components are looked for only when removing sources gets stuck.
    """
    one = F.lit(1).cast("bigint").alias("w")
    pairs = materialize(edges.select("src", "dst", one).distinct())
    alone = [] if nodes is None else [nodes.select("node")]
    levels = _longest_paths(pairs, reduce(DataFrame.unionByName, alone, _ends(pairs.where("src = dst"))))
    if levels is not None:
        return levels.select("node", F.col("node").alias("component"), "level")
    ids = component_ids(edges)
    if nodes is not None:
        alone = nodes.select("node").distinct().join(ids, "node", "left_anti")
        ids = ids.unionByName(alone.select("node", F.col("node").alias("component")))
    ids = materialize(ids)
    condensed = (
        edges.join(ids.select(F.col("node").alias("src"), F.col("component").alias("a")), "src")
        .join(ids.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
        .where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), one).distinct()
    )
    levels = _longest_paths(materialize(condensed), ids.select(F.col("component").alias("node")).distinct())
    return ids.join(levels.withColumnRenamed("node", "component"), "component").select("node", "component", "level")


def _state(parts: list[DataFrame], edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, level, outs, ins) of the nodes of ``parts`` (node, level, gone) and of the edges, without those that are
    gone; the level is the highest one offered. Counted before the one shuffle, so hubs cost nothing extra."""
    zero, none, no = F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(False).alias("gone")
    ground = F.lit(0).cast("bigint").alias("level")
    out = edges.select(F.col("src").alias("node"), ground, F.lit(1).alias("o"), none, no)
    into = edges.select(F.col("dst").alias("node"), ground, zero, F.lit(1).alias("i"), no)
    every = reduce(DataFrame.unionByName, [p.select("node", "level", zero, none, "gone") for p in parts], out.unionByName(into))
    return materialize_counted(
        every.groupBy("node").agg(F.max("level").alias("level"), F.sum("o").alias("outs"), F.sum("i").alias("ins"), F.max("gone").alias("gone"))
        .where("not gone").drop("gone")
    )


def _part(rows: DataFrame, level: str = "level", gone: bool = False) -> DataFrame:
    return rows.select("node", F.col(level).alias("level"), F.lit(gone).alias("gone"))


def _longest_paths(edges: DataFrame, others: DataFrame) -> DataFrame | None:
    """(node, level) of the nodes of ``edges`` and of ``others`` by removing sources round by round, or None when a cycle is
    left. Edges from a node to itself are left out.

    Between compactions the edges and the waiting nodes stay as they are: a round writes only the nodes that became
    sources and those that some of their predecessors have reached, with the number of those. Compactions, after
    1, 2, 4, ... rounds, drop what is done, and contract runs, so depth alone does not cost rounds.
    """
    stored, left = edges, edges.where("src <> dst")
    zero = F.lit(0).cast("bigint")
    state, waiting = _state([_part(others.select("node", zero.alias("level")))], left)
    final: list[DataFrame] = []
    expansions: list[DataFrame] = []
    rounds = 1
    while waiting:
        # Looking for runs costs joins, so it is tried at compactions only, and not at the start.
        linear = state.where("ins = 1 and outs = 1").select("node", F.col("level").alias("base"))
        runs = _runs(left, linear) if rounds > 1 else None
        if runs is not None:
            old = (stored, state)
            stored = left = runs.edges
            # Rings, and runs that return to their own head, are cycles.
            if not runs.rings.isEmpty() or not left.where("src = dst").isEmpty():
                return None
            expansions.append(runs.nodes.select("node", "head", "steps", "base"))
            state, _ = _state([_part(state.where("ins <> 1 or outs <> 1")), _part(runs.ends.withColumnRenamed("tail", "node"), "offer")], left)
            for table in old:
                forget(table)
        needed = state.where("ins > 0").select("node", "level", F.col("ins").alias("needed"))
        sources = state.where("ins = 0").select("node", "level")
        reached, done = None, []
        for _ in range(rounds):
            sources, ready = materialize_counted(sources)
            if ready == 0:
                break
            done.append(sources)
            sent = left.join(sources.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(
                F.max(F.col("level") + F.col("w")).alias("offer"), F.count("*").alias("arrived")
            )
            both = sent if reached is None else sent.unionByName(reached).groupBy("node").agg(
                F.max("offer").alias("offer"), F.sum("arrived").alias("arrived")
            )
            touched = materialize(both.join(needed, "node").select("node", F.greatest("level", "offer").alias("offer"), "arrived", "needed"))
            sources = touched.where("arrived = needed").select("node", F.col("offer").alias("level"))
            reached = touched.where("arrived < needed").select("node", "offer", "arrived")
        if not done:
            return None
        final += done
        gone = reduce(DataFrame.unionByName, done)
        old = (stored, state)
        stored = left = materialize(left.join(gone.select(F.col("node").alias("src")), "src", "left_anti"))
        parts = [_part(state), _part(gone, gone=True), _part(sources)]
        parts += [] if reached is None else [_part(reached, "offer")]
        state, waiting = _state(parts, left)
        for table in old:
            forget(table)
        rounds *= 2
    known = reduce(DataFrame.unionByName, final) if final else state.select("node", "level")
    for runs in reversed(expansions):
        known = materialize(known)
        heads = known.select(F.col("node").alias("head"), "level")
        inner = runs.join(heads, "head").select("node", F.greatest(F.col("base"), F.col("level") + F.col("steps")).alias("level"))
        known = known.unionByName(inner)
    return materialize(known)


def load_order(levels: DataFrame) -> DataFrame:
    """Parents before children, ties by component and name."""
    return levels.orderBy("level", "component", "node")


def deferral_needed(cycles: DataFrame, fks: DataFrame, columns: DataFrame) -> DataFrame:
    """Per cycle group: whether a NOT NULL foreign key stays inside it.

    ``fks(table_name, column_name, parent)`` has one row per foreign-key column,
    ``columns(table_name, column_name, nullable)`` one per column.
    """
    inside = (
        fks.join(cycles.select(F.col("node").alias("table_name"), "component"), "table_name")
        .join(cycles.select(F.col("node").alias("parent"), F.col("component").alias("parent_component")), "parent")
        .where("component = parent_component")
        .join(columns, ["table_name", "column_name"], "left")
    )
    required = F.max(F.when(~F.coalesce("nullable", F.lit(True)), 1).otherwise(0)) == 1
    needed = inside.groupBy("component").agg(required.alias("deferred"))
    groups = cycles.select("component").distinct()
    return groups.join(needed, "component", "left").select("component", F.coalesce("deferred", F.lit(False)).alias("deferred"))
