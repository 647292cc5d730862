"""Tables in versions: a load is staged beside what is there and becomes visible by one commit.

Every table of a load is written to a folder of its own; the commit is one small file that names the folders of all
tables, appended to the store's list of commits. Readers follow the last commit, so they see a whole load or
none, and references between its tables hold. A table whose rows are the same as before keeps its folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, UnsupportedOperationException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.references import apply_updates
from rowloom.sinks.tables import visible

COMMITS = "_commits"
LISTED = "number bigint, name string, folder string, mark string"


@dataclass(frozen=True)
class Pending:
    """Foreign keys to be filled in after the rows are there, by primary key."""

    updates: DataFrame
    primary_key: Sequence[str]


def commits(spark: SparkSession, path: str) -> list:
    """The tables of the last commit."""
    try:
        listed = spark.read.schema(LISTED).parquet(f"{path.rstrip('/')}/{COMMITS}")
        last = listed.agg(F.max("number")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return listed.where(F.col("number") == last).collect()


def store(
    spark: SparkSession, tables: Mapping[str, DataFrame], path: str, pending: Mapping[str, Pending] | None = None, fmt: str = "parquet"
) -> int:
    """Write tables with their pending updates applied; returns the commit's number, the old one if nothing changed.

    Rows are counted and their digests summed while they are written, which tells whether a table changed.
    Tables of the last commit that this load does not name stay as they are.
    """
    path, before = path.rstrip("/"), commits(spark, path)
    known, number = {r["name"]: r for r in before}, before[0]["number"] if before else 0
    entries = {r["name"]: (r["folder"], r["mark"]) for r in before}
    for name, df in tables.items():
        rows = visible(df)
        if pending and name in pending:
            rows = apply_updates(rows, visible(pending[name].updates), list(pending[name].primary_key))
        seen, folder = Observation(), f"{name}-{uuid.uuid4().hex}"
        digest = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith("map")]).cast("decimal(20,0)")
        marked = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(digest).alias("sum"))
        marked.write.format(fmt).save(f"{path}/{folder}")
        mark = f"{fmt} {rows.schema.simpleString()} {seen.get['n']} {seen.get['sum']}"
        if name in known and known[name]["mark"] == mark:
            _empty(spark, f"{path}/{folder}", rows, fmt)
        else:
            entries[name] = (folder, mark)
    if entries == {r["name"]: (r["folder"], r["mark"]) for r in before}:
        return number
    lines = [(number + 1, name, folder, mark) for name, (folder, mark) in entries.items()]
    spark.createDataFrame(lines, LISTED).coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")
    return number + 1


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the last commit has it."""
    found = next((r for r in commits(spark, path) if r["name"] == name), None)
    if found is None:
        raise KeyError(f"{path} has no table {name}")
    return spark.read.format(found["mark"].split(" ", 1)[0]).load(f"{path.rstrip('/')}/{found['folder']}")


def _empty(spark: SparkSession, folder: str, rows: DataFrame, fmt: str) -> None:
    """Give back the space of a folder that no commit names."""
    spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").format(fmt).save(folder)


def update_table(table: str, pending: Pending) -> str:
    """Apply pending updates to a catalog table; returns ``merged`` or ``rewritten``.

    A table that takes row-level changes is merged into. Another one is rewritten: its rows with the updates are
    staged in a table of their own and put in its place by one INSERT OVERWRITE. Repeating the call changes nothing.
    """
    updates, key = visible(pending.updates), list(pending.primary_key)
    spark = updates.sparkSession
    changed = [c for c in updates.columns if c not in key]
    matching = [F.col(f"{table}.{c}") == F.col(f"_new.{c}") for c in key]
    same = matching[0]
    for test in matching[1:]:
        same = same & test
    try:
        source = updates.alias("_new")
        source.mergeInto(table, same).whenMatched().update({c: F.coalesce(F.col(f"_new.{c}"), F.col(f"{table}.{c}")) for c in changed}).merge()
        return "merged"
    except (AnalysisException, UnsupportedOperationException) as refused:
        if not str(refused.getCondition()).startswith("UNSUPPORTED_FEATURE"):
            raise
    staged = f"{table}__{uuid.uuid4().hex}"
    apply_updates(spark.table(table), updates, key).write.saveAsTable(staged)
    spark.table(staged).write.insertInto(table, overwrite=True)
    spark.sql(f"DROP TABLE {staged}")
    return "rewritten"
