"""Loads with pending updates at a sink: whole or not at all, and the same when repeated."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowloom.model import ColumnSpec as C
from rowloom.model import ForeignKey, TableSpec
from rowloom.operators.quality import integrity_report
from rowloom.operators.references import apply_updates
from rowloom.plans.seeding import SeedOptions, seed
from rowloom.sinks.store import Pending, commits, store, stored, update_table

AUTHORS = TableSpec("authors", (C("id", "int"), C("name", "string", False), C("book_id", "int")), ("id",), (ForeignKey(("book_id",), "books", ("id",)),))
BOOKS = TableSpec("books", (C("id", "int"), C("title", "string", False), C("author_id", "int")), ("id",), (ForeignKey(("author_id",), "authors", ("id",)),))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_cycle_of_tables_is_stored_whole(spark, tmp_path):
    made = seed(spark, (AUTHORS, BOOKS), SeedOptions(rows=30))
    pending = {n: Pending(df, ["id"]) for n, df in made.updates.items()}
    path = str(tmp_path / "s")
    assert commits(spark, path) == [] and store(spark, made.inserts, path, pending) == 1
    tables = {n: stored(spark, path, n) for n in made.inserts}
    assert integrity_report(tables, (AUTHORS, BOOKS)).where("violations > 0").isEmpty()
    for n in tables:
        want = apply_updates(made.inserts[n], made.updates[n], ["id"]).select(*tables[n].columns)
        assert _rows(tables[n]) == _rows(want) and "_idx" not in tables[n].columns
    folders = {r["folder"] for r in commits(spark, path)}
    assert store(spark, made.inserts, path, pending) == 1 and {r["folder"] for r in commits(spark, path)} == folders
    fewer = {"books": made.inserts["books"].where("id > 5")}
    assert store(spark, fewer, path, pending) == 2
    assert stored(spark, path, "books").where("id <= 5").isEmpty() and stored(spark, path, "authors").count() == 30


def test_a_load_that_breaks_off_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    good = spark.range(5).withColumn("v", F.lit("x"))
    store(spark, {"a": good}, path)
    broken = good.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store(spark, {"a": good.where("id < 3"), "b": broken}, path)
    assert stored(spark, path, "a").count() == 5
    with pytest.raises(KeyError):
        stored(spark, path, "b")


def test_updates_of_a_catalog_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", 7), (2, 1, None, None)], "k int, l int, name string, ref int")
    rows.write.option("path", str(tmp_path / "t")).saveAsTable("updated")
    pending = Pending(spark.createDataFrame([(1, 1, 5), (2, 1, 6), (9, 9, 9)], "k int, l int, ref int"), ["k", "l"])
    for _ in range(2):
        assert update_table("updated", pending) in ("merged", "rewritten")
        assert _rows(spark.table("updated")) == [(1, 1, "a", 5), (1, 2, "b", 7), (2, 1, None, 6)]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("updated")] == ["updated"]
    spark.sql("DROP TABLE updated")
