"""First-by-position per key; rows that lost draw again, then take free keys. One key, or several that overlap."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.keyed import base36, step_for
from rowloom.operators.generate import POSITION
from rowloom.operators.indexing import dense_index, numbers_below
from rowloom.operators.joins import lookup
from rowloom.session import materialize, materialize_counted


def first_per_key(df: DataFrame, key: list[str], position: str = POSITION, nulls_equal: bool = False) -> DataFrame:
    """Keep, for every key, the row with the lowest position.

    The minimum is aggregated before the shuffle, so a key that holds a large share of the
    rows costs no more than any other; the rows come back by their own positions, which are
    unique. Rows with a null in the key are all kept, unless nulls count as equal.
    """
    keys = [F.col(c) for c in key]
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in keys])
    candidates = df if nulls_equal else df.where(complete)
    winners = candidates.groupBy(*keys).agg(F.min(position).alias(position)).select(position)
    kept = candidates.join(winners, position, "left_semi")
    return kept if nulls_equal else kept.unionByName(df.where(~complete))


def _not_taken(df: DataFrame, taken: DataFrame, key: list[str], nulls_equal: bool) -> DataFrame:
    same = [df[c].eqNullSafe(taken[c]) if nulls_equal else df[c] == taken[c] for c in key]
    return df.join(taken.select(*key), reduce(lambda a, b: a & b, same), "left_anti")


@dataclass(frozen=True)
class Distinct:
    """Rows with distinct keys, and the rows that found none."""

    rows: DataFrame
    left_out: DataFrame


def make_unique(
    df: DataFrame,
    key: list[str],
    redraw: Callable[[DataFrame, int], DataFrame],
    rounds: int = 3,
    position: str = POSITION,
    nulls_equal: bool = False,
    domain: DataFrame | None = None,
) -> Distinct:
    """Losers are redrawn with a new salt for ``rounds`` rounds, then take what is free of ``domain``.

    Only losers are redrawn and shuffled again. A candidate that equals an accepted key loses.
    ``domain`` has one row per possible key. Its free keys in their order go to the remaining rows by
    position, so a row is left out only when every key is taken. Without a domain, rounds go on until
    all rows are placed or one places none.
    """
    pending, accepted = materialize(df), None
    round_ = 0
    while True:
        fresh = pending if accepted is None else _not_taken(pending, accepted, key, nulls_equal)
        kept, n = materialize_counted(first_per_key(fresh, key, position, nulls_equal))
        accepted = kept if accepted is None else accepted.unionByName(kept)
        losers, left = materialize_counted(pending.join(kept.select(position), position, "left_anti"))
        if left == 0 or (round_ >= rounds if domain is not None else n == 0 and round_ >= rounds):
            break
        round_ += 1
        pending = redraw(losers, round_)
    if domain is None or left == 0:
        return Distinct(accepted, losers)
    free = dense_index(_not_taken(domain.select(*key), accepted, key, nulls_equal), key, "_free", derived=True)
    waiting = dense_index(losers, [position], "_free")
    keys = free.df.select("_free", *key)
    placed = waiting.df.drop(*key).join(keys, "_free").select(*df.columns)
    left_out = waiting.df.where(F.col("_free") >= free.count).select(*df.columns)
    return Distinct(accepted.unionByName(placed), left_out)


def with_suffix(text: Column, position: Column, length: int, digits: int) -> Column:
    """Text cut to make room for the position in base 36, which makes it distinct."""
    room = length - digits - 1 if length > 0 else 0
    head = F.substring(text, 1, room) if length > 0 else text
    return F.concat(head, F.lit("-"), F.lpad(base36(position), digits, "0"))


# --- several keys at once ---------------------------------------------------------------------


def _complete(key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])


def key_values(df: DataFrame, keys: Sequence[Sequence[str]], position: str) -> DataFrame:
    """(position, key number, 128-bit digest) for every complete key of every row: all keys in one shape."""
    entries = []
    for number, key in enumerate(keys):
        texts = [F.col(c).cast("string") for c in key]
        value = F.concat_ws("|", *[part for t in texts for part in (F.length(t).cast("string"), t)])
        entries.append(F.struct(F.lit(number).alias("key"), F.when(_complete(key), F.md5(value)).alias("value")))
    return df.select(position, F.explode(F.array(*entries)).alias("e")).select(position, "e.*").where("value is not null")


def least_in_all(df: DataFrame, keys: Sequence[Sequence[str]], position: str = POSITION) -> DataFrame:
    """The rows that are the least of every key group they stand in.

    Minima are aggregated before the shuffle and counted per winning row, so no group is gathered and none
    is joined with its own rows.
    """
    least = key_values(df, keys, position).groupBy("key", "value").agg(F.min(position).alias(position))
    wins = least.groupBy(position).agg(F.count("*").alias("_wins"))
    stands = reduce(lambda a, b: a + b, [_complete(k).cast("int") for k in keys])
    return df.join(wins, position, "left").where(F.coalesce("_wins", F.lit(0)) == stands).drop("_wins")


@dataclass(frozen=True)
class Supply:
    """Values that columns may take together, numbered from 0: one column's domain, or the parents of a foreign key."""

    columns: tuple[str, ...]
    size: int
    values: Callable[[Column], Sequence[Column]]


# So many rounds in a row that place none end a contest; each offers other free values.
IDLE_ROUNDS = 8


def make_all_unique(
    df: DataFrame,
    keys: Sequence[Sequence[str]],
    redraw: Callable[[DataFrame, int], DataFrame],
    supplies: Sequence[Supply] = (),
    rounds: int = 6,
    position: str = POSITION,
) -> Distinct:
    """Rows that agree in none of several keys, which may share columns. Nulls never agree.

    Key groups are the edges of a conflict hypergraph. A row is accepted if it is the least of every group it
    stands in; rows that only lost to rows which lost elsewhere compete again, until all others collide with an
    accepted row: rounds of a maximal independent set. Only those losers are redrawn. After ``rounds`` rounds,
    or a round that places less than a quarter, they are given free values of ``supplies`` key by key, from
    another start in every round, and compete as before; rows are left out when several such rounds in a row place none.
    """
    keys = [list(k) for k in keys]
    waiting, n_waiting = materialize_counted(df)
    parts, taken, round_, idle, given = [], [], 0, 0, 0
    while n_waiting:
        contest, before = waiting, n_waiting
        while True:
            if taken:
                known = reduce(DataFrame.unionByName, taken)
                collide = lookup(key_values(contest, keys, position), known, ["key", "value"], how="inner").select(position).distinct()
                contest = contest.join(collide, position, "left_anti")
            won, n = materialize_counted(least_in_all(contest, keys, position))
            if n == 0:
                break
            parts.append(won)
            taken.append(key_values(won, keys, position).select("key", "value"))
            waiting, n_waiting = materialize_counted(waiting.join(won.select(position), position, "left_anti"))
            if n_waiting == 0:
                break
            contest = waiting
        if n_waiting == 0:
            break
        placed = before - n_waiting
        idle = idle + 1 if placed == 0 else 0
        if idle >= (IDLE_ROUNDS if supplies else 2) and (round_ > rounds or not supplies):
            break
        round_ += 1
        waiting = redraw(waiting, round_)
        if supplies and parts and (round_ >= rounds or idle or 4 * placed < before):
            accepted = reduce(DataFrame.unionByName, parts)
            waiting = give_free_values(materialize(waiting), accepted, keys, supplies, position, given)
            rounds, given = min(rounds, round_), given + 1
        waiting = materialize(waiting)
    rows = reduce(DataFrame.unionByName, parts) if parts else df.limit(0)
    return Distinct(rows, waiting)


def give_free_values(
    waiting: DataFrame, accepted: DataFrame, keys: Sequence[Sequence[str]], supplies: Sequence[Supply], position: str = POSITION, turn: int = 0
) -> DataFrame:
    """Give waiting rows free values, one key after the other; what an earlier key settled stays.

    For a key, rows stand in groups of its settled columns. Among any w + t codes of a group that follow each other,
    with w rows waiting and t taken, at least w are free, so no more are made than there are rows; ``turn`` moves
    their start, so a row whose value broke a later key is offered another one. Free codes and waiting rows are
    numbered within their group over the whole cluster and meet by number.
    """
    done: set[str] = set()
    for key in keys:
        # Columns that are drawn together are given together, and only where the key holds them all.
        used = [s for s in supplies if set(s.columns) <= set(key) - done]
        free = [c for s in used for c in s.columns]
        done |= set(key)
        if not free:
            continue
        settled = [c for c in key if c not in free]
        span = min(prod(s.size for s in used), 1 << 62)
        ready = waiting.where(_complete(settled)) if settled else waiting
        taken = accepted.where(_complete(key))
        group = settled or ["_all"]
        counted = ready.withColumn("_all", F.lit(0)).groupBy(*group).agg(F.count("*").alias("_waiting"))
        held = taken.withColumn("_all", F.lit(0)).groupBy(*group).agg(F.count("*").alias("_taken"))
        room = counted.join(held, group, "left").withColumn(
            "_codes", F.least(F.col("_waiting") + F.coalesce("_taken", F.lit(0)), F.lit(span))
        )
        codes = numbers_below(room.select(*group, "_codes"), "_codes", "_code")
        rest, made = F.pmod(F.col("_code") + F.lit(turn * step_for(span) % span), F.lit(span)), {}
        for supply in used:
            values = supply.values(F.pmod(rest, F.lit(supply.size)))
            made |= dict(zip(supply.columns, values, strict=True))
            rest = F.call_function("div", rest, F.lit(supply.size))
        candidates = codes.select("*", *[v.alias(c) for c, v in made.items()])
        open_ = candidates.join(taken.select(*key), key, "left_anti").select(*group, "_code", *free)
        offered = _numbered(open_, group, "_code").select(*group, "_number", *[F.col(c).alias(f"_free_{c}") for c in free])
        asking = _numbered(ready.withColumn("_all", F.lit(0)).select(*group, position), group, position).select(*group, "_number", position)
        given = asking.join(offered, [*group, "_number"]).select(position, *[f"_free_{c}" for c in free])
        waiting = waiting.join(given, position, "left").select(
            *[F.coalesce(f"_free_{c}", c).alias(c) if c in free else F.col(c) for c in waiting.columns]
        )
    return waiting


def _numbered(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """``_number`` from 0 within each group, without gathering a group."""
    indexed = dense_index(df, [*group, order], "_place", derived=True).df
    starts = indexed.groupBy(*group).agg(F.min("_place").alias("_start"))
    return lookup(indexed, starts, group, how="inner").withColumn("_number", F.col("_place") - F.col("_start"))
