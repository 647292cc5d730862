"""Equi-join with a unique right side, broadcast only when its size is known to be small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast up to this many rows of a narrow key projection.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
# Below this many rows a hot key is not worth a pass of its own.
SMALL_LEFT = 1_000_000


WIDTHS = {"byte": 1, "boolean": 1, "short": 2, "integer": 4, "float": 4, "decimal": 16} | dict.fromkeys(
    ("long", "double", "date", "timestamp", "timestamp_ntz"), 8
)


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Bounded by the row count and the bytes: fixed widths by type, texts as measured. Nested values never fit."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    texts = [n for n, k in kinds.items() if k in ("string", "varchar", "char", "binary")]
    fixed = [WIDTHS.get(k) for n, k in kinds.items() if n not in texts]
    if rows > BROADCAST_ROWS or None in fixed or rows * sum(fixed) > BROADCAST_BYTES:
        return False
    if not texts:
        return True
    measured = df.agg(*[F.sum(F.octet_length(f"`{n}`")).alias(f"b{i}") for i, n in enumerate(texts)]).first()
    return rows * (sum(fixed) + 8 * len(texts)) + sum(b or 0 for b in measured) <= BROADCAST_BYTES


def lookup(
    left: DataFrame, right: DataFrame, on: list[str], right_rows: int | None = None, how: str = "left", even: bool = False,
    counted: str | None = None,
) -> DataFrame:
    """Join ``right`` (one row per key) to ``left``, as a left or an inner join.

    A right side proven small is broadcast. Otherwise rows without a key never enter the
    shuffle, the few hot keys of ``left`` (keys with more than 1/1000 of its rows, so at most
    1000 of them) are looked up by broadcast of just those right rows, and the rest goes
    through an ordinary shuffle join. ``even`` says that keys are spread evenly, which saves
    counting them. In an inner join ``counted`` may name a column of ``right`` that tells how many rows of ``left`` have
    the key, so they are not counted again; that column is left out of the result.
    """
    counts = None
    if counted is not None:
        if how != "inner":
            raise ValueError("counts of the right side's keys serve inner joins only")
        counts, right = right.select(*on, F.col(counted).alias("_n")), right.drop(counted)
    if right_rows is not None and fits_broadcast(right, right_rows):
        return left.join(F.broadcast(right), on, how)
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    keyed = left.where(present)
    joined = _split_hot(keyed, right, on, how, counts) if not even else keyed.join(right, on, how)
    if how == "inner":
        return joined
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in on]
    return joined.unionByName(left.where(~present).select("*", *added))


def _split_hot(left: DataFrame, right: DataFrame, on: list[str], how: str, counts: DataFrame | None = None) -> DataFrame:
    counts = left.groupBy(*on).agg(F.count("*").alias("_n")) if counts is None else counts
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if total < SMALL_LEFT:
        return left.join(right, on, how)
    hot = counts.where(F.col("_n") * 1000 > F.lit(total)).select(*on).collect()
    if not hot:
        return left.join(right, on, how)
    hot_keys = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in hot], left.select(*on).schema))
    hot_right = right.join(hot_keys, on, "left_semi")
    often = left.join(hot_keys, on, "left_semi").join(F.broadcast(hot_right), on, how)
    return often.unionByName(left.join(hot_keys, on, "left_anti").join(right, on, how))
