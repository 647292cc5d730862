"""Foreign-key assignment.

A generated parent's key is a function of its position, so the child computes it with no
join. An existing parent is numbered densely once; the child draws a position and finds the
key by an equi-join on it, which is uniform and therefore free of skew.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws, permute
from rowloom.operators.indexing import IndexedRows, dense_index, numbers_below, running_total
from rowloom.operators.joins import lookup
from rowloom.session import materialize

CLOSE_CYCLE, NULL_FK = "CLOSE_CYCLE", "NULL_FK"
DEFAULT_CHAIN_DEPTH = 3
# Codes of unique combinations stay below 2^62 when multiplied in 64 bits.
MAX_COMBINATIONS = 1 << 60


class MissingParents(ValueError):
    """A NOT NULL foreign key cannot be filled from the parent rows there are."""


@dataclass(frozen=True)
class Parent:
    """Parent keys of an existing table, numbered 0..count-1."""

    rows: IndexedRows
    keys: tuple[str, ...]

    @property
    def count(self) -> int:
        return self.rows.count


def parent_of(df: DataFrame, keys: Sequence[str]) -> Parent:
    return Parent(dense_index(df.select(*keys), list(keys)), tuple(keys))


# --- positions -------------------------------------------------------------------------------


def random_position(draws: Draws, fk: str, row: Column, parents: int) -> Column:
    """A uniform parent position; null when there are no parents."""
    if parents == 0:
        return F.lit(None).cast("bigint")
    return draws.at(fk, row).below(parents)


def one_to_one_position(position: Column, parents: int, shift: int = 0) -> Column:
    """Every parent at most once; null for the rows beyond the parents."""
    if parents == 0:
        return F.lit(None).cast("bigint")
    return F.when(position < parents, permute(position, parents, shift))


def combination_positions(position: Column, parents: Sequence[int], shift: int = 0) -> list[Column]:
    """Distinct tuples of parent positions: the digits of one permuted code; null beyond the product.

    Where the product passes 2^60, the code runs over fewer places of the largest parents. Places that are equal
    modulo that number then share a digit, and each row draws one of them, so every parent stays in reach.
    """
    if prod(parents) == 0:
        return [F.lit(None).cast("bigint") for _ in parents]
    coded = list(parents)
    while prod(coded) > MAX_COMBINATIONS:
        largest = coded.index(max(coded))
        coded[largest] //= 2
    space = prod(coded)
    code = F.when(position < space, permute(position, space, shift))
    out = []
    for number, (size, digits) in enumerate(zip(parents, coded, strict=True)):
        place = F.pmod(code, F.lit(digits))
        if digits < size:
            alike = F.call_function("div", F.lit(size - 1) - place, F.lit(digits)) + 1
            place = place + F.lit(digits) * F.pmod(F.xxhash64(position, F.lit(number), F.lit(shift)), alike)
        out.append(place)
        code = F.call_function("div", code, F.lit(digits))
    return out


def chain_position(position: Column, rows: int, depth: int = DEFAULT_CHAIN_DEPTH, termination: str = CLOSE_CYCLE) -> Column:
    """Row i refers to row i+1 within blocks of ``depth``; the last refers to the block's first, or to none."""
    depth = depth if depth > 0 else DEFAULT_CHAIN_DEPTH
    start = position - F.pmod(position, F.lit(depth))
    end = F.least(start + (depth - 1), F.lit(rows - 1))
    closing = F.lit(None).cast("bigint") if termination == NULL_FK else start
    return F.when(position == end, closing).otherwise(position + 1)


# --- assignment from existing parents ---------------------------------------------------------


def attach_keys(child: DataFrame, parent: Parent, position: Column, mapping: dict[str, str], even: bool = True) -> DataFrame:
    """Add FK columns ``{child column: parent column}`` from the parent at ``position``.

    All columns of a composite key come from the same parent row. ``even`` tells that the
    positions are spread over the parents, as drawn and permuted ones are.
    """
    pick = "_parent_pos"
    keys = parent.rows.df.select(
        F.col(parent.rows.position).alias(pick), *[F.col(p).alias(c) for c, p in mapping.items()]
    )
    dropped = [c for c in mapping if c in child.columns]
    picked = child.drop(*dropped).withColumn(pick, position)
    return lookup(picked, keys, [pick], right_rows=parent.count, even=even).drop(pick)


def require_parents(parents: int, nullable: bool, fk: str) -> None:
    if parents == 0 and not nullable:
        raise MissingParents(
            f"{fk}: the parent table has no rows; add rows to it or make the foreign key nullable"
        )


def assign_random(
    child: DataFrame, parent: Parent, mapping: dict[str, str], draws: Draws, row: str, fk: str, nullable: bool = True
) -> DataFrame:
    require_parents(parent.count, nullable, fk)
    return attach_keys(child, parent, random_position(draws, fk, F.col(row), parent.count), mapping)


def assign_one_to_one(
    child: DataFrame, children: int, parent: Parent, mapping: dict[str, str], position: str, fk: str,
    nullable: bool = True, shift: int = 0,
) -> DataFrame:
    require_parents(parent.count, nullable, fk)
    if children > parent.count and not nullable:
        raise MissingParents(f"{fk}: {children} rows need a parent of their own, there are {parent.count}")
    return attach_keys(child, parent, one_to_one_position(F.col(position), parent.count, shift), mapping)


def assign_combinations(
    child: DataFrame, parents: Sequence[tuple[Parent, dict[str, str]]], position: str, shift: int = 0
) -> DataFrame:
    """Fill several foreign keys so that no two rows share the same tuple of parents.

    Keys that share child columns take tuples of parents that agree in them; rows beyond all tuples stay empty.
    """
    columns = [c for _, mapping in parents for c in mapping]
    shared = [c for c in dict.fromkeys(columns) if columns.count(c) > 1]
    if shared:
        return _agreeing_combinations(child, parents, shared, position)
    places = combination_positions(F.col(position), [p.count for p, _ in parents], shift)
    names = [f"_place{i}" for i in range(len(places))]
    out = child.select("*", *[p.alias(n) for p, n in zip(places, names)])
    for (parent, mapping), name in zip(parents, names):
        out = attach_keys(out, parent, F.col(name), mapping)
    return out.drop(*names)


def _agreeing_combinations(child: DataFrame, parents: Sequence[tuple[Parent, dict[str, str]]], shared: list[str], position: str) -> DataFrame:
    """Different tuples of parents that agree in the shared columns, spread over all groups of equal values.

    A group of values with n1, n2, ... parents has n1 * n2 * ... tuples. Running totals over the groups give
    each group its share of the rows and its first row; inside a group, tuples are the digits of evenly
    spaced codes. Only as many tuples are made as there are rows.
    """
    if any(not set(shared) <= set(mapping) for _, mapping in parents):
        raise ValueError(f"keys that share columns must all have {', '.join(shared)}")
    indexed, groups = [], None
    for number, (parent, mapping) in enumerate(parents):
        keys = parent.rows.df.select(*[F.col(p).alias(c) for c, p in mapping.items()])
        rows = dense_index(keys, [*shared, *[c for c in mapping if c not in shared]], f"_place{number}")
        sizes = rows.df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in shared])).groupBy(*shared).agg(
            F.min(rows.position).alias(f"_start{number}"), F.count("*").alias(f"_size{number}")
        )
        indexed.append(rows)
        groups = sizes if groups is None else groups.join(sizes, shared)
    wide = "decimal(38,0)"
    tuples = reduce(lambda a, b: (a * b).cast(wide), [F.col(f"_size{i}").cast("decimal(19,0)") for i in range(len(parents))])
    running = running_total(groups.withColumn("_tuples", tuples), shared, "_tuples", "_before")
    total, wanted = running.total, child.count()
    names = [f"_place{i}" for i in range(len(parents))]
    if not total:
        return reduce(lambda df, c: df.withColumn(c, F.lit(None).cast(dict(indexed_types(indexed))[c])), dict.fromkeys(c for _, m in parents for c in m), child)
    taken = min(total, wanted)
    share = lambda before: F.floor((before * F.lit(taken).cast("decimal(19,0)")).cast(wide) / F.lit(total).cast(wide)).cast("bigint")
    allotted = running.df.withColumn("_first", share(F.col("_before"))).withColumn("_rows", share((F.col("_before") + F.col("_tuples")).cast(wide)) - F.col("_first"))
    codes = numbers_below(allotted.where("_rows > 0"), "_rows", "_code")
    spaced = F.floor((F.col("_code").cast("decimal(19,0)") * F.col("_tuples")).cast(wide) / F.col("_rows")).cast(wide)
    rest, places = spaced, []
    for number, name in enumerate(names):
        size = F.col(f"_size{number}").cast(wide)
        places.append((F.col(f"_start{number}") + F.pmod(rest, size)).cast("bigint").alias(name))
        rest = F.floor(rest / size).cast(wide)
    tuples_made = codes.select((F.col("_first") + F.col("_code")).alias(position), *places)
    out = child.drop(*dict.fromkeys(c for _, m in parents for c in m)).join(tuples_made, position, "left")
    done: set[str] = set()
    for number, (rows, (_, mapping)) in enumerate(zip(indexed, parents, strict=True)):
        own = [c for c in mapping if c not in done]
        done |= set(own)
        out = attach_keys(out, Parent(rows, tuple(mapping)), F.col(names[number]), {c: c for c in own})
    return out.drop(*names)


def indexed_types(indexed: Sequence[IndexedRows]) -> list[tuple[str, str]]:
    return [pair for rows in indexed for pair in rows.df.dtypes]


def assign_matching(
    child: DataFrame, parent: DataFrame, shared: dict[str, str], mapping: dict[str, str], draws: Draws, row: str, fk: str
) -> DataFrame:
    """Draw a parent among those that agree with columns the child already has.

    For a second foreign key that shares a column with the first: the shared value stays.
    Parents are numbered in the order (shared columns, key); a group is then a range of
    positions, so a group of any size is never gathered in one place.
    """
    wanted = list(dict.fromkeys([*shared.values(), *mapping.values()]))
    indexed = dense_index(parent.select(*wanted), wanted)
    groups = indexed.df.groupBy(*[F.col(p).alias(c) for c, p in shared.items()]).agg(
        F.min(indexed.position).alias("_start"), F.count("*").alias("_size")
    )
    ranged = lookup(child, groups, list(shared), right_rows=indexed.count)
    place = F.col("_start") + F.pmod(draws.at(fk, F.col(row)).value, F.col("_size"))
    rows = IndexedRows(indexed.df, indexed.count, indexed.position)
    # A group may be one parent with very many children, so these positions are not even.
    return attach_keys(ranged, Parent(rows, tuple(wanted)), place, mapping, even=False).drop("_start", "_size")


@dataclass(frozen=True)
class Shared:
    """Children whose foreign keys all hold, and per foreign key the parents that no child can refer to."""

    rows: DataFrame
    unmatched: dict[str, int]


def assign_shared(
    child: DataFrame, parents: Sequence[tuple[str, DataFrame]], draws: Draws, row: str, nullable: Collection[str] = ()
) -> Shared:
    """Fill several foreign keys that share columns, so that every row agrees with a parent of each.

    ``parents``: (foreign key, parent keys under the child's column names); keys with a null refer to nothing.
    Parents without a counterpart in the others are set aside first and counted. Then the first parent is
    drawn among all that are left, and each further one within the range of positions that agrees with the
    columns already set, so no group of equal values is gathered. Where a key meets columns that come from
    different earlier keys (three keys in a ring), a parent of each need not make a triple: those keys are
    joined into their common combinations first, and one of these is drawn.

    Where nothing agrees, the first key is filled and the own columns of the others are null; a column that may
    not be null raises MissingParents.
    """
    order = _connected(parents)
    frames = {name: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])).distinct() for name, df in order}
    totals = {name: df.count() for name, df in frames.items()}
    kept = {name: materialize(df) for name, df in _agreeing(order, frames).items()}
    left = {name: df.count() for name, df in kept.items()}
    unmatched = {name: totals[name] - left[name] for name in frames}
    dropped = [c for c in dict.fromkeys(c for _, df in order for c in df.columns) if c in child.columns]
    rows = child.drop(*dropped)
    first = order[0][0]
    if not left[first]:
        return Shared(_only_first(rows, frames, order, totals, draws, row, nullable), unmatched)
    if _in_a_ring(order):
        whole = reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns]), [kept[name] for name, _ in order])
        whole = materialize(whole)
        reached = {name: whole.select(*df.columns).distinct().count() for name, df in order}
        unmatched = {name: totals[name] - reached[name] for name in frames}
        count = whole.count()
        if not count:
            return Shared(_only_first(rows, frames, order, totals, draws, row, nullable), unmatched)
        parent = Parent(dense_index(whole, whole.columns), tuple(whole.columns))
        return Shared(attach_keys(rows, parent, random_position(draws, first, F.col(row), count), {c: c for c in whole.columns}), unmatched)
    parent = Parent(dense_index(kept[first], kept[first].columns), tuple(kept[first].columns))
    rows = attach_keys(rows, parent, random_position(draws, first, F.col(row), parent.count), {c: c for c in parent.keys})
    for name, df in order[1:]:
        known = {c: c for c in df.columns if c in rows.columns}
        own = {c: c for c in df.columns if c not in rows.columns}
        if own:  # else the columns set so far are one of its keys
            rows = assign_matching(rows, kept[name], known, own, draws, row, name)
    return Shared(rows, unmatched)


def _connected(parents: Sequence[tuple[str, DataFrame]]) -> list[tuple[str, DataFrame]]:
    """Each foreign key after one that shares a column with it, as far as there is one."""
    order, rest = [parents[0]], list(parents[1:])
    while rest:
        known = {c for _, df in order for c in df.columns}
        following = next((p for p in rest if known & set(p[1].columns)), rest[0])
        order.append(following)
        rest.remove(following)
    return order


def _in_a_ring(order: Sequence[tuple[str, DataFrame]]) -> bool:
    """Whether a key shares columns with the earlier ones that no single earlier key holds."""
    for number, (_, df) in enumerate(order):
        known = {c for _, earlier in order[:number] for c in earlier.columns} & set(df.columns)
        if known and not any(known <= set(earlier.columns) for _, earlier in order[:number]):
            return True
    return False


def _agreeing(order: Sequence[tuple[str, DataFrame]], frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Parents that agree with some parent of every other key, by semi-joins forth and back along the order."""
    kept = dict(frames)
    names = [name for name, _ in order]
    for these in (names[::-1], names):
        for number, name in enumerate(these):
            for other in these[:number]:
                both = [c for c in kept[name].columns if c in kept[other].columns]
                if both:
                    kept[name] = kept[name].join(kept[other].select(*both).distinct(), both, "left_semi")
    return kept


def _only_first(
    rows: DataFrame, frames: dict[str, DataFrame], order: Sequence[tuple[str, DataFrame]], totals: dict[str, int], draws: Draws, row: str,
    nullable: Collection[str],
) -> DataFrame:
    first, df = order[0]
    rest = list(dict.fromkeys(c for _, other in order[1:] for c in other.columns if c not in df.columns))
    missing = [c for c in (rest if totals[first] else [*df.columns, *rest]) if c not in nullable]
    inside = [name for name, other in order[1:] if set(other.columns) <= set(df.columns)]
    if missing or (inside and not set(df.columns) & set(nullable)):
        raise MissingParents(f"{', '.join(name for name, _ in order)}: no parents agree in the columns they share")
    parent = Parent(dense_index(frames[first], frames[first].columns), tuple(frames[first].columns))
    filled = attach_keys(rows, parent, random_position(draws, first, F.col(row), parent.count), {c: c for c in parent.keys})
    kinds = {f.name: f.dataType for _, other in order[1:] for f in other.schema.fields}
    return filled.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])


def assign_chain(
    df: DataFrame, key: str, fk_column: str, depth: int = DEFAULT_CHAIN_DEPTH, termination: str = CLOSE_CYCLE,
    nullable: bool = True,
) -> DataFrame:
    """Self-reference chains over an existing table, in key order.

    One window per block of ``depth`` rows; blocks are as small as the depth.
    """
    if termination == NULL_FK and not nullable:
        raise MissingParents(f"{fk_column}: a NOT NULL column cannot end a chain with null")
    depth = depth if depth > 0 else DEFAULT_CHAIN_DEPTH
    indexed = dense_index(df, [key])
    block = F.call_function("div", F.col(indexed.position), F.lit(depth))
    window = Window.partitionBy(block).orderBy(indexed.position)
    following = F.lead(key).over(window)
    if termination != NULL_FK:
        following = F.coalesce(following, F.first(key).over(window))
    return indexed.df.withColumn(fk_column, following).drop(indexed.position)


# --- generated parents ------------------------------------------------------------------------


def generated_key(parent_key: Callable[[Column], Column], position: Column) -> Column:
    """A generated parent's key at a position, computed without a join; null stays null."""
    return F.when(position.isNotNull(), parent_key(position))


# --- deferred references ----------------------------------------------------------------------


@dataclass(frozen=True)
class Deferred:
    """Rows to insert first, with empty foreign keys, and the updates to run afterwards."""

    inserts: DataFrame
    updates: DataFrame


def defer(df: DataFrame, primary_key: Sequence[str], fk_columns: Sequence[str]) -> Deferred:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cleared = [F.lit(None).cast(kinds[c]).alias(c) if c in fk_columns else F.col(c) for c in df.columns]
    # Rows whose references are all null need no update.
    pending = df.select(*primary_key, *fk_columns).where(F.coalesce(*[F.col(c).cast("string") for c in fk_columns]).isNotNull())
    return Deferred(df.select(*cleared), pending)


def apply_updates(inserts: DataFrame, updates: DataFrame, primary_key: Sequence[str]) -> DataFrame:
    """Write the pending foreign keys into the inserted rows, by primary key."""
    changed = [c for c in updates.columns if c not in primary_key]
    renamed = updates.select(*primary_key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = inserts.join(renamed, list(primary_key), "left")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in inserts.columns]
    )
