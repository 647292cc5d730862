"""Write generated tables to files, catalog tables or JDBC targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def visible(df: DataFrame) -> DataFrame:
    """Without the helper columns, whose names start with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def write_files(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        visible(df).write.mode(mode).format(fmt).save(f"{path.rstrip('/')}/{name}")


def write_tables(tables: Mapping[str, DataFrame], database: str | None = None, mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        visible(df).write.mode(mode).saveAsTable(f"{database}.{name}" if database else name)


def write_jdbc(
    tables: Mapping[str, DataFrame], order: Sequence[str], url: str, properties: Mapping[str, str] | None = None,
    batch_rows: int = 1000, connections: int = 8, mode: str = "append",
) -> None:
    """Parents first, in the given order. ``connections`` bounds the parallel writers, not the tasks that make the rows."""
    for name in order:
        df = visible(tables[name])
        (df.repartition(connections).write.format("jdbc").mode(mode)
         .options(url=url, dbtable=name, batchsize=batch_rows, **(properties or {})).save())
