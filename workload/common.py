"""What the registered queries share: table access, the seed, and the draw formula as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.session import tune

SEED = 7
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(owner: str, column: str, row: str, salt: str = "v") -> str:
    return f"md5('{SEED}|{owner}|{column}|' || {row} || '|{salt}')"


def draw(owner: str, column: str, row: str, salt: str = "v", start: int = 1, length: int = 13) -> str:
    """The integer drawn for a cell, as SQL."""
    return f"(('0x' || substr({digest(owner, column, row, salt)}, {start}, {length}))::BIGINT)"


def nullable(owner: str, column: str, row: str, value: str) -> str:
    return f"CASE WHEN {draw(owner, column, row, 'v', 27, 6)} % 10 >= 3 THEN {value} END"


def step(n: str) -> str:
    """The multiplier of the permutation of 0..n-1, as SQL over a one-row expression n."""
    base = f"greatest(floor({n}::DOUBLE * 0.6180339887498949::DOUBLE)::BIGINT, 1)"
    return f"(SELECT min({base} + k) FROM range(0, 1000) t(k) WHERE gcd({base} + k, {n}) = 1)"


def uuid_sql(owner: str, column: str, row: str) -> str:
    d = digest(owner, column, row)
    nibble = f"(('0x' || substr({d}, 17, 1))::BIGINT % 4 + 1)"
    return (
        f"(substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-4' || substr({d}, 14, 3) || '-' || "
        f"substr('89ab', {nibble}, 1) || substr({d}, 18, 3) || '-' || substr({d}, 21, 12))"
    )
