"""Dense row numbers and running totals over a total order, without a single-task window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import checkpointed, materialize

_SLOT_MASK = (1 << 33) - 1


@dataclass(frozen=True)
class IndexedRows:
    df: DataFrame
    count: int
    position: str


def dense_index(df: DataFrame, order_by: list[str], position: str = "_pos", derived: bool = False) -> IndexedRows:
    """Number the rows 0..n-1 in the order of ``order_by``, which must identify a row.

    Range partitioning sorts in parallel; the driver sees one count per partition and hands
    back one offset per partition. The sorted rows are checkpointed first: numbering reads
    them twice and both readings must agree. Pass only the columns that are needed, and
    ``derived`` when they are costly to compute: sampling the ranges reads the input once more.
    """
    if derived:
        df = materialize(df)
    keys = [F.col(c) for c in order_by]
    ordered = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    sizes = {
        r["part"]: r["n"]
        for r in ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    }
    parts = max(sizes, default=-1) + 1
    offsets, total = [], 0
    for part in range(parts):
        offsets.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.lit(offsets or [0]), F.spark_partition_id() + 1)
    slot = F.monotonically_increasing_id().bitwiseAND(F.lit(_SLOT_MASK))
    return IndexedRows(ordered.select("*", (start + slot).cast("bigint").alias(position)), total, position)


@dataclass(frozen=True)
class RunningTotal:
    df: DataFrame
    total: int


def running_total(df: DataFrame, order_by: list[str], value: str, before: str) -> RunningTotal:
    """The sum of ``value`` (whole numbers, as DECIMAL(38,0)) over all earlier rows, and over all.

    ``order_by`` must identify a row. A window runs inside each range partition; the driver sees one sum a partition.
    """
    keys = [F.col(c) for c in order_by]
    ordered = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_part", F.spark_partition_id())
    sums = {r["_part"]: int(r["n"] or 0) for r in ordered.groupBy("_part").agg(F.sum(value).cast("decimal(38,0)").alias("n")).collect()}
    offsets, total = [], 0
    for part in range(max(sums, default=-1) + 1):
        offsets.append(F.lit(total).cast("decimal(38,0)"))
        total += sums.get(part, 0)
    earlier = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.array(*offsets), F.col("_part") + 1) if offsets else F.lit(0).cast("decimal(38,0)")
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("decimal(38,0)")
    return RunningTotal(ordered.select("*", (start + inside).cast("decimal(38,0)").alias(before)).drop("_part"), total)


def numbers_below(df: DataFrame, limit: str, name: str, block: int = 1000) -> DataFrame:
    """Each row once for every number from 0 to below ``limit``: two short sequences instead of one as long as the limit."""
    low = F.sequence(F.lit(0).cast("bigint"), (F.col(limit) - 1).cast("bigint"), F.lit(block).cast("bigint"))
    blocks = df.where(F.col(limit) > 0).select("*", F.explode(low).alias("_low")).hint("rebalance")
    numbers = F.sequence("_low", F.least(F.col("_low") + block, F.col(limit).cast("bigint")) - 1)
    return blocks.select(*df.columns, F.explode(numbers).alias(name))
