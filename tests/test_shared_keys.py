"""Foreign keys that share columns, and unique keys that overlap: every rule holds, or what is missing is reported."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws
from rowloom.model import ColumnSpec as C
from rowloom.model import CombinationRule, ForeignKey, RepetitionRule, TableSpec
from rowloom.operators.quality import integrity_report
from rowloom.operators.references import MissingParents, assign_combinations, assign_shared, parent_of
from rowloom.operators.uniqueness import Supply, make_all_unique
from rowloom.plans.seeding import SeedOptions, seed

P1 = TableSpec("p1", (C("a", "int"), C("b", "int")), ("a", "b"))
P2 = TableSpec("p2", (C("a", "int"), C("c", "int")), ("a", "c"))
CHILD = TableSpec(
    "child", (C("id", "int"), C("a", "int", False), C("b", "int", False), C("c", "int", False)), ("id",),
    (ForeignKey(("a", "b"), "p1", ("a", "b"), name="first"), ForeignKey(("a", "c"), "p2", ("a", "c"), name="second")),
)


def broken(tables, specs):
    return integrity_report(tables, specs).where("violations > 0").collect()


def test_two_references_share_a_column(spark):
    specs = (P1, P2, CHILD)
    made = seed(spark, specs, SeedOptions(rows={"p1": 100, "p2": 60, "child": 200}))
    assert broken(made.tables, specs) == [] and made.tables["child"].count() == 200
    assert made.unmatched == {"child.first": 40} and made.shortfall == {}
    assert made.tables["child"].select("a").distinct().count() > 40


def test_grandchildren_follow(spark):
    below = TableSpec("below", (C("id", "int"), C("a", "int"), C("b", "int"), C("c", "int")), ("id",),
                      (ForeignKey(("a", "b", "c"), "child", ("a", "b", "c"), name="up"),))
    child = TableSpec("child", CHILD.columns, CHILD.primary_key, CHILD.foreign_keys)
    specs = (P1, P2, child, below)
    made = seed(spark, specs, SeedOptions(rows=50))
    rows = made.tables["below"].join(made.tables["child"].select("a", "b", "c").distinct(), ["a", "b", "c"], "left_semi")
    assert rows.count() == 50 and broken(made.tables, (P1, P2, child)) == []


def test_groups_of_any_size_and_chains_of_keys(spark):
    one = spark.range(300).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    two = spark.range(90).select((F.col("id") % 9).alias("a"), (F.col("id") * 2).alias("c"))
    three = spark.range(40).select((F.col("id") * 4).alias("c"), F.col("id").alias("d"))
    rows = spark.range(500).withColumnRenamed("id", "_idx")
    done = assign_shared(rows, [("one", one), ("two", two), ("three", three)], Draws(1, "t"), "_idx")
    got = done.rows
    assert got.count() == 500 and got.where("a is null or b is null or c is null or d is null").isEmpty()
    for parent in (one, two, three):
        assert got.join(parent, parent.columns, "left_anti").isEmpty()
    linked = two.join(three, "c")
    assert done.unmatched["one"] == one.join(linked, "a", "left_anti").count()
    assert done.unmatched["two"] == two.count() - linked.join(one, "a", "left_semi").select("a", "c").distinct().count()


def test_three_keys_in_a_ring(spark):
    ab = spark.createDataFrame([(i, j) for i in range(6) for j in range(6) if (i + j) % 2], "a int, b int")
    bc = spark.createDataFrame([(i, i + 1) for i in range(6)], "b int, c int")
    ac = spark.createDataFrame([(i, 3) for i in range(6)] + [(9, 9)], "a int, c int")
    rows = spark.range(40).withColumnRenamed("id", "_idx")
    done = assign_shared(rows, [("ab", ab), ("bc", bc), ("ac", ac)], Draws(1, "t"), "_idx")
    assert done.rows.count() == 40 and {tuple(r) for r in done.rows.select("b", "c").distinct().collect()} == {(2, 3)}
    for parent in (ab, bc, ac):
        assert done.rows.join(parent, parent.columns, "left_anti").isEmpty()
    assert done.unmatched == {"ab": 15, "bc": 5, "ac": 4}


def test_nothing_agrees(spark):
    one, two = spark.createDataFrame([(1, 1), (None, 2)], "a int, b int"), spark.createDataFrame([(2, 2)], "a int, c int")
    rows = spark.range(5).withColumnRenamed("id", "_idx")
    with pytest.raises(MissingParents):
        assign_shared(rows, [("one", one), ("two", two)], Draws(1, "t"), "_idx")
    done = assign_shared(rows, [("one", one), ("two", two)], Draws(1, "t"), "_idx", frozenset({"c"}))
    assert {tuple(r) for r in done.rows.select("a", "b", "c").collect()} == {(1, 1, None)}
    assert done.unmatched == {"one": 1, "two": 1}


def test_unique_tuples_of_parents_agree_in_shared_columns(spark):
    one = spark.range(12).select((F.col("id") % 4).alias("x"), (F.col("id") * 10).alias("y"))
    two = spark.range(9).select((F.col("id") % 5).alias("x"), (F.col("id") * 7).alias("z"))
    tuples = one.join(two, "x").count()
    for asked in (7, tuples, tuples + 6):
        rows = spark.range(asked).withColumnRenamed("id", "pos")
        mapping = [(parent_of(one, ["x", "y"]), {"s": "x", "p": "y"}), (parent_of(two, ["x", "z"]), {"s": "x", "q": "z"})]
        got = assign_combinations(rows, mapping, "pos")
        full = got.where("q is not null")
        assert got.count() == asked and full.count() == min(asked, tuples) == full.select("s", "p", "q").distinct().count()
        assert full.join(one.toDF("s", "p"), ["s", "p"], "left_anti").isEmpty()
        assert full.join(two.toDF("s", "q"), ["s", "q"], "left_anti").isEmpty()


# --- unique keys --------------------------------------------------------------------------------


def repeated(df, keys):
    return {k: df.where(" and ".join(f"{c} is not null" for c in k)).groupBy(*k).count().where("count > 1").count() for k in keys}


def test_overlapping_unique_keys(spark):
    keys = (("x", "y"), ("y", "z"))
    digit = lambda name: C(name, "int", False, min_value=1, max_value=30)
    spec = TableSpec("t", (C("id", "int"), digit("x"), digit("y"), digit("z")), ("id",), unique_keys=keys)
    made = seed(spark, (spec,), SeedOptions(rows=500))
    assert broken(made.tables, (spec,)) == [] and made.tables["t"].count() == 500 and made.shortfall == {}
    full = seed(spark, (spec,), SeedOptions(rows=900))
    assert repeated(full.tables["t"], keys) == {k: 0 for k in keys}
    assert full.tables["t"].count() + full.shortfall.get("t", 0) == 900 and full.tables["t"].count() > 850


def test_keys_beyond_their_room(spark):
    spec = TableSpec("t", (C("id", "int"), C("x", "int", False, min_value=1, max_value=4), C("y", "boolean", False), C("z", "int", False)),
                     ("id",), unique_keys=(("x", "y"), ("y", "z")))
    made = seed(spark, (spec,), SeedOptions(rows=20))
    assert made.tables["t"].count() == 8 and made.shortfall == {"t": 12} and broken(made.tables, (spec,)) == []


def test_keys_that_share_primary_and_foreign_columns(spark):
    parent = TableSpec("p", (C("id", "int"),), ("id",))
    spec = TableSpec(
        "t", (C("a", "int", min_value=1, max_value=20), C("b", "int", min_value=1, max_value=20), C("p_id", "int", False),
              C("slot", "smallint", False, min_value=1, max_value=12), C("code", "char", False, 2), C("note")),
        ("a", "b"), (ForeignKey(("p_id",), "p", ("id",)),), (("b", "slot"), ("p_id", "slot"), ("a", "code")),
    )
    below = TableSpec("u", (C("id", "int"), C("p_id", "int"), C("slot", "smallint")), ("id",),
                      (ForeignKey(("p_id", "slot"), "t", ("p_id", "slot"), name="seat"),))
    specs = (parent, spec, below)
    made = seed(spark, specs, SeedOptions(rows={"p": 40, "t": 200, "u": 100}))
    assert broken(made.tables, specs) == []
    assert made.tables["t"].count() + made.shortfall.get("t", 0) == 200 and made.tables["t"].count() > 190


def test_the_last_free_parents_are_found(spark):
    parent = TableSpec("p", (C("id", "int"),), ("id",))
    number = lambda name: C(name, "int", False, min_value=1, max_value=12)
    spec = TableSpec("t", (C("id", "int"), number("x"), number("y"), C("p_id", "int", False)), ("id",),
                     (ForeignKey(("p_id",), "p", ("id",)),), (("x", "y"), ("p_id", "y")))
    made = seed(spark, (parent, spec), SeedOptions(rows={"p": 12, "t": 144}))
    assert broken(made.tables, (parent, spec)) == [] and made.shortfall == {} and made.tables["t"].count() == 144


def test_a_row_is_offered_another_value_after_a_clash(spark):
    # Row 3 clashes with row 0; the first places free in (x, y) have an x that its a already has.
    rows = spark.createDataFrame([(0, 5, 0, 1), (1, 5, 1, 1), (2, 5, 2, 1), (3, 5, 0, 1)], "_idx long, a int, x int, y int")
    supplies = [Supply(("x",), 40, lambda i: [i.cast("int")]), Supply(("y",), 2, lambda i: [i.cast("int")])]
    done = make_all_unique(rows, [["x", "y"], ["a", "x"]], lambda df, n: df, supplies)
    assert done.left_out.isEmpty() and repeated(done.rows, [("x", "y"), ("a", "x")]) == {("x", "y"): 0, ("a", "x"): 0}


def test_left_out_rows_leave_no_orphans(spark):
    parent = TableSpec("p", (C("id", "int"), C("x", "int", False, min_value=1, max_value=6), C("y", "boolean", False), C("z", "boolean", False)),
                       ("id",), unique_keys=(("x", "y"), ("y", "z")))
    child = TableSpec("c", (C("id", "int"), C("p_id", "int", False)), ("id",), (ForeignKey(("p_id",), "p", ("id",)),))
    made = seed(spark, (parent, child), SeedOptions(rows={"p": 12, "c": 80}))
    assert made.shortfall["p"] >= 8 and broken(made.tables, (parent, child)) == [] and made.tables["c"].count() == 80


def test_a_unique_key_inside_the_primary_key(spark):
    spec = TableSpec("t", (C("a", "int", min_value=1, max_value=50), C("b", "int", min_value=1, max_value=50)), ("a", "b"), unique_keys=(("b",),))
    made = seed(spark, (spec,), SeedOptions(rows=50))
    assert broken(made.tables, (spec,)) == [] and made.tables["t"].count() == 50


def test_rules_and_combinations_stay(spark):
    spec = TableSpec(
        "t", (C("id", "int"), C("x", "int", False, min_value=1, max_value=9), C("y", "string", False), C("z", "string", False),
              C("w", "int", False, min_value=1, max_value=40)),
        ("id",), unique_keys=(("x", "y", "w"), ("y", "z", "w")), combinations=(CombinationRule(("y", "z"), (("a", "1"), ("a", "2"), ("b", "1"))),),
    )
    rules = {"t": [RepetitionRule(10, {"x": "3"}, ("w",))]}
    made = seed(spark, (spec,), SeedOptions(rows=60, rules=rules))
    df = made.tables["t"]
    assert broken(made.tables, (spec,)) == [] and df.count() + made.shortfall.get("t", 0) == 60
    ruled = df.where("_rule_id = 0")
    assert ruled.count() >= 2 and ruled.where("x <> 3").isEmpty() and ruled.select("w").distinct().count() == 1


def test_nulls_never_agree_and_hot_values_are_placed(spark):
    rows = spark.range(400).select(F.col("id").alias("_idx"), F.lit(1).alias("x"), F.when(F.col("id") % 2 == 0, F.lit(2)).alias("y"), (F.col("id") % 3).alias("z"))
    keys = [["x", "y"], ["y", "z"]]
    again = lambda df, n: df.withColumn("x", F.pmod(F.hash("_idx", F.lit(n)), F.lit(1000))).withColumn("z", F.pmod(F.hash("_idx", F.lit(n + 50)), F.lit(1000)))
    done = make_all_unique(rows, keys, again)
    assert done.rows.count() == 400 and done.left_out.isEmpty()
    assert repeated(done.rows, [("x", "y"), ("y", "z")]) == {("x", "y"): 0, ("y", "z"): 0}
    assert make_all_unique(rows.where("false"), keys, again).rows.count() == 0
