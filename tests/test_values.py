from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws, permute, step_for, uuid_text
from rowloom.functions.patterns import text_from_pattern
from rowloom.functions.values import ValueSettings, cell_value, numeric_limits, parse_column_list, soft_delete_value
from rowloom.model import ColumnSpec, ForeignKey, TableSpec

DRAWS = Draws(3, "t")


def column(spark, spec, n=2000, **settings):
    value = cell_value(spec, DRAWS, F.col("id"), ValueSettings(**settings), F.col("id"))
    return [r[0] for r in spark.range(n).select(value.alias("v")).collect()]


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 1000, 4096):
        got = [r[0] for r in spark.range(n).select(permute(F.col("id"), n, 5)).collect()]
        assert sorted(got) == list(range(n))


def test_wide_permutation_stays_inside_and_distinct(spark):
    n = 10**13
    near = spark.range(500).select(permute(F.col("id") + (n - 500), n, 9).alias("p"))
    values = [r["p"] for r in near.collect()]
    assert len(set(values)) == 500 and min(values) >= 0 and max(values) < n
    step = step_for(n)
    assert sorted(values) == sorted(((n - 500 + i) * step + 9) % n for i in range(500))


def test_draws_do_not_depend_on_partitioning(spark):
    spec = ColumnSpec("x", "int")
    value = cell_value(spec, DRAWS, F.col("id"))
    a = spark.range(0, 500, 1, 3).select("id", value.alias("v")).collect()
    b = spark.range(0, 500, 1, 11).select("id", value.alias("v")).collect()
    assert sorted(a) == sorted(b)


def test_null_share_and_required_columns(spark):
    values = column(spark, ColumnSpec("x", "int"), 5000)
    assert 0.26 < sum(v is None for v in values) / 5000 < 0.34
    assert None not in column(spark, ColumnSpec("x", "int", False))


def test_bounds_swapped_and_inclusive(spark):
    values = column(spark, ColumnSpec("x", "int", False, min_value=20, max_value=10))
    assert set(values) == set(range(10, 21))


def test_decimal_precision_limits():
    assert numeric_limits(ColumnSpec("x", "decimal", length=2, scale=2))[0] == 0
    low, high = numeric_limits(ColumnSpec("x", "decimal", length=30, scale=4))
    assert low == 1 and str(high) == "99999999999999999999999999.9999"
    assert numeric_limits(ColumnSpec("x", "tinyint")) == (1, 127)


def test_text_rules(spark):
    words = ("alpha", "beta")
    assert all(len(v) == 12 for v in column(spark, ColumnSpec("c", "char", False, 12), words=words))
    assert set(column(spark, ColumnSpec("c", "string", False, 40), words=("only",))) == {"only"}
    assert all(set(v.split()) <= set(words) and len(v.split()) == 1 for v in column(spark, ColumnSpec("c", "string", False), words=words))
    assert all(len(v) == 24 and v.startswith("ES") and v[2:].isdigit() for v in column(spark, ColumnSpec("c", "string", False, 24)))
    assert all(v.startswith("https://") for v in column(spark, ColumnSpec("user_Foto", "string", False, 5)))
    assert all(1 <= len(v) <= 3 for v in column(spark, ColumnSpec("c", "array", False)))


def test_uuid_shape_and_distinct(spark):
    df = spark.range(3000).select(uuid_text(DRAWS.at("u", F.col("id"))).alias("u"))
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    assert df.where(F.col("u").rlike(shape)).distinct().count() == 3000
    fast = Draws(3, "t", "xxhash64")
    assert spark.range(3000).select(uuid_text(fast.at("u", F.col("id"))).alias("u")).where(F.col("u").rlike(shape)).distinct().count() == 3000


def test_unfit_allowed_value_falls_back(spark):
    assert set(column(spark, ColumnSpec("x", "int", False, allowed=("5", "five")))) == {5, 1}


def test_soft_delete(spark):
    row = spark.range(1).select(
        soft_delete_value(ColumnSpec("a", "int"), "1", False).alias("a"),
        soft_delete_value(ColumnSpec("b", "boolean"), "null", False).alias("b"),
        soft_delete_value(ColumnSpec("c", "int", default="9"), "1", True).alias("c"),
        soft_delete_value(ColumnSpec("d", "int"), "x", False).alias("d"),
    ).first()
    assert tuple(row) == (1, None, 9, None)
    assert parse_column_list(" deleted, , archived ,") == {"deleted", "archived"}
    assert parse_column_list(None) == frozenset()


def test_pattern_texts(spark):
    import re

    for pattern in (r"[A-Z]{3}-\d{2,4}", r"(foo|ba[rz])+x?", r"[^a-y]\w\.", r"(ab)\1"):
        text = text_from_pattern(pattern, "k")
        assert re.fullmatch(pattern, text), (pattern, text)
        assert text == text_from_pattern(pattern, "k")
    assert text_from_pattern("[", "k") is None
    assert text_from_pattern(" ", "k") is None
    assert text_from_pattern(r"\d{9}", "k", 5) is None


def test_model_records():
    fk = ForeignKey(("b", "a"), "p", ("x", "y"))
    assert fk.name == "fk_p_a__b"
    spec = TableSpec("t", (ColumnSpec("A", "int"), ColumnSpec("b", "int")), ("A",), (ForeignKey(("b",), "p", ("x",), True),))
    assert not spec.column("a").nullable and spec.fk_nullable(spec.foreign_keys[0])
    assert spec.unique_fk_keys() == [("b",)]
