"""Keys of any width and type, and references of several columns by their values alone."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from rowloom.operators.discovery import describe_columns, discover_composite_references, discover_keys, discover_references
from rowloom.plans.discover import discover
from workload import schema_discovery
from workload.common import table


def test_a_key_of_four_columns_is_found_with_few_counts(spark):
    rng = random.Random(1)
    cells = [(a, b, c, d) for a in range(6) for b in range(6) for c in range(6) for d in range(6)]
    rows = [(*cell, rng.randint(0, 3), "same", rng.random() < 0.5, None if k % 9 else k % 5) for k, cell in enumerate(cells)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f string, g boolean, h int")
    assert discover_keys(df).primary == []
    found = discover_keys(df, 8)
    assert found.primary == [("a", "b", "c", "d")] and found.counted < 15 and found.sketched < 60
    assert discover_keys(df.unionByName(df), 8).primary == []
    assert discover_keys(df.where("false"), 8).primary == []


def test_keys_of_every_type_and_with_nulls(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i / 7, start + dt.timedelta(microseconds=i), dt.date(2024, 1, 1) + dt.timedelta(days=i % 40), i % 2 == 0, "x" * 5000 + str(i),
             i if i % 3 else None, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, t timestamp, d date, odd boolean, long string, some int, few int")
    found = discover_keys(df)
    assert {k for k in found.primary if len(k) == 1} == {("x",), ("t",), ("long",)}
    assert ("some",) in found.unique and ("some",) not in found.primary
    apart = spark.createDataFrame([(1, None), (1, None), (None, 2), (None, 2), (5, 6)], "a int, b int")
    assert ("a", "b") in discover_keys(apart).unique and discover_keys(apart).primary == []


def test_composite_references_need_no_names(spark):
    lines = spark.range(300).select((F.col("id") / 3).cast("bigint").alias("bill"), (F.col("id") % 3).cast("int").alias("line"), F.col("id").cast("double").alias("v")).where("bill <> 9 or line <> 2")
    returns = lines.where("bill % 2 = 0").select(F.col("line").cast("decimal(5,0)").alias("p"), F.col("bill").cast("int").alias("q"), (F.col("bill") % 3).alias("r"))
    wrong = spark.createDataFrame([(1, 0), (2, 9)], "p long, q int")
    tables = {"lines": lines, "returns": returns, "wrong": wrong, "none": returns.where("false")}
    got = discover_composite_references(tables, {"lines": ("bill", "line")}).collect()
    assert ("returns", "q,p", 150 / 299, True) in [(r.child_table, r.child_columns, r.coverage, r.one_to_one) for r in got]
    assert {r.child_table for r in got} == {"returns"}
    three = spark.createDataFrame([(i, i % 5, f"n{i % 7}") for i in range(60)], "a int, b int, c string")
    below = three.where("a > 20").selectExpr("c as x", "a as y", "b as z", "a % 4 as w")
    got = discover_composite_references({"three": three, "below": below}, {"three": ("a", "b", "c")}).collect()
    assert [r.child_columns for r in got] == ["y,z,x"]


def test_specifications_take_composite_references_by_value(spark):
    lines = spark.range(120).select((F.col("id") / 4).cast("int").alias("bill"), (F.col("id") % 4).cast("int").alias("line"))
    returns = lines.where("line > 1").select(F.col("line").alias("position"), F.col("bill").alias("document"), F.rand(1).alias("amount"))
    specs = {s.name: s for s in discover({"lines": lines, "returns": returns}, tried=lambda *names: True)}
    fk = specs["returns"].foreign_keys
    assert [(f.columns, f.parent_columns) for f in fk] == [(("document", "position"), ("bill", "line"))]
    assert specs["lines"].primary_key == ("bill", "line")


def test_references_of_every_type(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    parent = spark.createDataFrame([(day(i), i / 4, f"{'name' * 50}{i}") for i in range(30)], "d date, x double, s string")
    child = spark.createDataFrame([(day(i % 20), (i % 9) / 4, f"{'name' * 50}{i % 7}", "name") for i in range(50)], "e date, y double, t string, u string")
    got = discover_references({"parent": parent, "child": child}, {"parent": ("d", "x", "s")}).collect()
    assert {(r.child_column, r.parent_column) for r in got} == {("e", "d"), ("y", "x"), ("t", "s")}


def test_temporal_limits(spark):
    rows = [(dt.datetime(2024, 1, 1, 5, 6, 7, 89), dt.date(2023, 2, 3)), (dt.datetime(2025, 1, 1), None)]
    got = {r.column_name: r for r in describe_columns(spark.createDataFrame(rows, "t timestamp, d date"), "x").collect()}
    assert (got["t"]["first"], got["t"]["last"]) == ("2024-01-01 05:06:07.000089", "2025-01-01 00:00:00.000000")
    assert got["d"]["last"] == "2023-02-03 00:00:00.000000" and got["d"].nullable
    empty = describe_columns(spark.createDataFrame([], "t timestamp, n int"), "x").collect()
    assert {r.column_name: r["first"] for r in empty} == {"t": None, "n": None}


def test_a_described_table_is_scanned_once_beside_exact_counts(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(1000).select(F.udf(counted, "long")("id").alias("id"), (F.col("id") % 3).alias("few"), (F.col("id") % 900).alias("many"))
    got = {r.column_name: r for r in describe_columns(rows, "x", 3).collect()}
    assert seen.value <= 2000
    assert got["id"].is_key and not got["many"].is_key and got["few"].allowed == ["0", "1", "2"] and got["many"].allowed is None
    assert (got["id"].min_value, got["id"].max_value, got["many"].max_value) == (0.0, 999.0, 899.0)


def test_few_tuples_of_a_small_child_in_a_large_parent(spark):
    # The sketch of the large side holds about one of a hundred tuples, so it holds none or few of the child's.
    lines = spark.range(400_000).select((F.col("id") / 4).cast("int").alias("bill"), (F.col("id") % 4).cast("int").alias("line"))
    few = lines.where("bill % 20000 = 8 and line < 3").select(F.col("line").alias("l"), F.col("bill").alias("b"))
    wrong = few.select("b", (F.col("l") + 2).alias("l"))
    tables = {"lines": lines, "few": few, "wrong": wrong}
    got = discover_composite_references(tables, {"lines": ("bill", "line")}).collect()
    assert [(r.child_table, r.child_columns, r.one_to_one) for r in got] == [("few", "b,l", True)]


def test_what_repeats_in_no_slice_is_still_counted(spark):
    # Two equal pairs among 200 000 rows, and few tuples counted in full.
    rows = spark.range(200_000).select(
        F.least("id", F.lit(199_998)).alias("id"), (F.col("id") / 500).cast("int").alias("a"), (F.col("id") % 500).cast("int").alias("b"),
        (F.col("id") % 7).alias("c"), (F.col("id") % 1000).alias("d"),
    )
    found = discover_keys(rows.withColumn("b", F.when(F.col("id") == 150_000, 1).otherwise(F.col("b"))), 3)
    assert ("a", "b") not in found.primary and ("id",) not in found.primary
    assert discover_keys(rows.drop("id"), 3).primary == [("a", "b"), ("a", "d")] and found.counted < 8


def test_a_specification_counts_wide_tuples_only_for_a_primary_key(spark):
    # (a, b) and (a, c) are keys, of which the first is wanted; with a single key no pair is.
    rows = spark.range(40_000).select(
        (F.col("id") / 200).cast("int").alias("a"), (F.col("id") % 200).alias("b"), (F.col("id") * 7 % 200).alias("c"), (F.col("id") % 9).alias("d"),
    )
    assert [k for k in discover_keys(rows, 3).primary if len(k) == 2] == [("a", "b"), ("a", "c")]
    found = discover_keys(rows, 3, 1)
    assert found.primary == [("a", "b")] and found.counted == 1
    single = discover_keys(rows.withColumn("id", F.col("a") * 200 + F.col("b")), 3, 1)
    assert single.primary == [("id",)] and single.sketched == 5
    (spec,) = discover({"rows": rows})
    assert spec.primary_key == ("a", "b") and spec.unique_keys == ()


def test_a_hot_value_among_unique_ones_is_no_key(spark):
    rows = spark.range(300_000).select(F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("id")).alias("id"), F.lit("x").alias("s"), (F.col("id") % 30).cast("string").alias("t"))
    assert discover_keys(rows).primary == []
    (spec,) = discover({"rows": rows})
    assert spec.primary_key == () and spec.column("s").allowed == ("x",) and spec.column("t").allowed == ()


def test_seeded_tables_are_made_once_for_their_report(spark, sf_dir, monkeypatch):
    few = lambda spark, d: {n: table(spark, d, n) for n in ("region", "nation")}
    monkeypatch.setattr(schema_discovery, "star_tables", few)
    report = schema_discovery.discover_and_seed(spark, sf_dir)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "Range (" not in plan
    assert {(r.table_name, r.n_rows, r.violations) for r in report.collect()} == {("region", 5, 0), ("nation", 25, 0)}
