"""Rules too long for a plan: factorised CHECKs, combination tables, rule tables. Each against its short form."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws
from rowloom.model import ColumnSpec as C
from rowloom.model import CombinationRule, RepetitionRule, TableSpec
from rowloom.operators import checks, combinations, rules
from rowloom.operators.combinations import attach_combinations, choose_combination, combination_rows, combination_violations, missing_combinations
from rowloom.operators.generate import GenerateOptions, generate_over, generate_table
from rowloom.operators.quality import integrity_report


def _size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_factors_of_products_and_contradictions():
    parse = lambda text: checks.factors(text, ["'a'", "'b'"])
    forty = " AND ".join(f'( "x{i}" = 0 OR "x{i}" = 1 )' for i in range(40))
    assert parse(forty) == [[{f"x{i}": "0"}, {f"x{i}": "1"}] for i in range(40)]
    assert parse('"a" = 0 AND "a" = 1') == []
    assert parse('( "a" = 1 OR "b" = 2 ) AND ( "a" = 3 OR "b" = 4 )') == [[{"a": "1", "b": "4"}, {"b": "2", "a": "3"}]]
    assert parse('( "a" = \'0\' AND "b" = 1 ) OR ( ( "a" = \'1\' OR "a" = 7 ) AND "b" = 2 )') == [[{"a": "a", "b": "1"}, {"a": "b", "b": "2"}, {"a": "7", "b": "2"}]]
    assert parse('( "a" > 1 AND "b" = 1 ) OR ( "a" = 2 AND "b" = 3 )') == [[{"a": "2", "b": "3"}]]
    assert parse('"a" BETWEEN 1 AND 2 AND "c" = 4') == [[{"c": "4"}]] and parse('( "a" = 1') == []


def test_factors_equal_brute_force():
    rng = random.Random(4)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            c, v = rng.choice("abcd"), rng.randint(0, 2)
            return f'"{c}" = {v}', lambda row: row[c] == v
        parts = [made(depth - 1) for _ in range(rng.randint(2, 3))]
        word, test = (("AND", all) if rng.random() < 0.5 else ("OR", any))
        return "( " + f" {word} ".join(t for t, _ in parts) + " )", lambda row: test(f(row) for _, f in parts)

    rows = [dict(zip("abcd", (i, j, k, m), strict=True)) for i in range(3) for j in range(3) for k in range(3) for m in range(3)]
    for _ in range(400):
        text, holds = made(3)
        found = checks.factors(text, [])
        got = [all(any(all(str(row[c]) == v for c, v in part.items()) for part in f) for f in found) for row in rows]
        want = [holds(row) for row in rows]
        assert got == want or not any(want)  # what never holds gives no factor


def test_forty_ors_are_generated_and_checked(spark):
    text = " AND ".join(f"((a{i} = 1 AND b{i} = 'x') OR (a{i} = 2 AND b{i} = 'y'))" for i in range(40))
    frame = spark.createDataFrame([("t", text)], "table_name string, expr string")
    columns = tuple(c for i in range(40) for c in (C(f"a{i}", "int", False), C(f"b{i}", "string", False)))
    named = spark.createDataFrame([("t", c.name, 0) for c in columns], "table_name string, column_name string, length int")
    spec = checks.constrain(TableSpec("t", columns), checks.column_limits(frame, named), checks.allowed_values(frame, named), checks.value_factors(frame))
    assert len(spec.combinations) == 40 and all(len(r.combinations) == 2 for r in spec.combinations)
    df = generate_table(spark, spec, 60)
    assert integrity_report({"t": df}, (spec,)).where("violations > 0").isEmpty()
    assert df.select("a0", "a1", "a2").distinct().count() == 8


def _long_rule(n):
    rng = random.Random(5)
    listed = {(f"k{rng.randint(0, 60)}", str(rng.randint(0, 50)), rng.choice(["x", "y", None, "NULL"])) for _ in range(n)}
    return CombinationRule(("kind", "size", "mark"), tuple(sorted(listed, key=str)))


SPEC = TableSpec("t", (C("id", "int"), C("kind"), C("size", "int"), C("mark"), C("v", "int", False)), ("id",))


def test_long_combinations_equal_short_ones(spark, monkeypatch):
    rule = _long_rule(300)
    spec = TableSpec("t", SPEC.columns, SPEC.primary_key, combinations=(rule,))
    fixed = (RepetitionRule(40, {"kind": "k7"}), RepetitionRule(30, {"size": "3", "mark": "x"}), RepetitionRule(20, {"kind": "none"}), RepetitionRule(9, {"mark": None}))
    options = GenerateOptions(3, rules=fixed)
    joined = generate_table(spark, spec, 500, options)
    assert len(rule.combinations) > combinations.INLINE and joined.count() == 500
    long = sorted(map(tuple, joined.collect()))
    monkeypatch.setattr(combinations, "INLINE", 10_000)
    assert long == sorted(map(tuple, generate_table(spark, spec, 500, options).collect()))


def test_checks_of_long_combinations_equal_short_ones(spark, monkeypatch):
    rule, rng = _long_rule(260), random.Random(6)
    rows = [(i, *rng.choice(rule.combinations)) for i in range(300)]
    rows = [(i, k, int(s), None if m == "NULL" else m) for i, k, s, m in rows]
    rows += [(1000 + i, rng.choice(["k1", "k2", "zz", None]), rng.choice([1, 2, 99, None]), rng.choice(["x", "q", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, kind string, size int, mark string")
    long = {r.id for r in combination_violations(df, rule).collect()}
    monkeypatch.setattr(combinations, "INLINE", 10_000)
    assert long == {r.id for r in combination_violations(df, rule).collect()} and len(long) > 100


def test_a_hundred_thousand_combinations_keep_the_plan_small(spark):
    combos = spark.range(100_000).select(F.col("id").alias("at"), F.concat(F.lit("k"), F.col("id") % 317).alias("c0"), F.col("id").cast("string").alias("c1"))
    rows = spark.range(3000).select(F.col("id").alias("_idx"), (F.col("id") % 3 == 0).alias("is"), F.concat(F.lit("k"), F.col("id") % 400).alias("text"))
    got = attach_combinations(rows, combos, ["kind", "n"], Draws(1, "t"), F.col("_idx"), {"kind": (F.col("is"), F.col("text"))})
    few = attach_combinations(rows, combos.where("at < 300"), ["kind", "n"], Draws(1, "t"), F.col("_idx"), {"kind": (F.col("is"), F.col("text"))})
    done = got.join(combos, (F.col("_combo0") == F.col("c0")) & (F.col("_combo1") == F.col("c1")), "left")
    assert done.count() == 3000 and done.where("at is null").isEmpty()
    assert done.where("is and cast(substr(text, 2) as int) < 317 and text <> _combo0").isEmpty()
    assert done.where("is and cast(substr(text, 2) as int) >= 317 and at <> 0").isEmpty()
    assert _size(got) < 1.2 * _size(few)
    made = got.select("_combo0", "_combo1").toDF("kind", "n")
    assert missing_combinations(made, combos, ["kind", "n"]).isEmpty()
    assert missing_combinations(made.withColumn("n", F.lit("x")), combos, ["kind", "n"]).count() == 3000
    listed = CombinationRule(("kind", "n"), tuple((f"k{i % 317}", str(i)) for i in range(1000)))
    plain = spark.range(20).select(choose_combination(listed, Draws(1, "t"), F.col("id")).alias("c")).select("c.c1").collect()
    joined = attach_combinations(spark.range(20), combination_rows(spark, listed), ["kind", "n"], Draws(1, "t"), F.col("id")).orderBy("id").collect()
    assert [r.c1 for r in plain] == [r._combo1 for r in joined]


def _many(n):
    rng = random.Random(9)
    made = []
    for i in range(n):
        fixed = {"kind": f"k{i}"} if i % 3 else {"KIND": None, "v": str(i)}
        if i % 10 == 0:
            fixed["id"] = str(rng.randint(1, 10**6) * 10 + i % 7)
        made.append(RepetitionRule(rng.randint(1, 5), fixed, ("size",) if i % 4 == 0 else (), {"mark": "m[0-9]{3}"} if i % 5 == 0 else {}))
    return tuple(made)


def test_tabled_rules_equal_inline_rules(spark, monkeypatch):
    options = GenerateOptions(3, rules=_many(140))
    tabled = sorted(map(tuple, generate_table(spark, SPEC, 700, options).collect()))
    over = spark.range(0, 700, 3).withColumnRenamed("id", "_idx")
    some = sorted(map(tuple, generate_over(over, SPEC, 700, options).collect()))
    monkeypatch.setattr(rules, "INLINE", 10_000)
    assert tabled == sorted(map(tuple, generate_table(spark, SPEC, 700, options).collect()))
    assert some == sorted(map(tuple, generate_over(over, SPEC, 700, options).collect()))


def test_twenty_thousand_rules_keep_the_plan_small(spark):
    few, many = (generate_table(spark, SPEC, 100_000, GenerateOptions(3, rules=_many(n))) for n in (200, 20_000))
    assert _size(many) < 1.2 * _size(few)
    assert many.count() == 100_000 and many.select("_rule_id").distinct().count() == 20_001
    assert many.select("id").distinct().count() == 100_000
    assert many.where("_rule_id % 3 <> 0 and kind <> concat('k', _rule_id)").isEmpty()


def test_large_vocabularies_are_joined(spark):
    words = spark.range(120_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    columns = (C("id", "int"), C("name", "varchar", False, 40), C("note", "string"), C("code", "char", False, 2), C("title", "string", False, 60), C("kind", allowed=("a", "b")))
    spec = TableSpec("t", columns, ("id",), unique_keys=(("title",),))
    fixed = (RepetitionRule(5, {"name": "pinned"}, ("note",)),)
    from rowloom.plans.seeding import SeedOptions, seed

    made = seed(spark, (spec,), SeedOptions(rows=400, table=GenerateOptions(2, vocabulary=words), rules={"t": fixed}))
    df = made.tables["t"]
    assert df.columns == ["_idx", "_rule_id", *[c.name for c in columns]] and df.count() == 400
    assert integrity_report(made.tables, (spec,)).where("violations > 0").isEmpty()
    rest = df.where("_rule_id is null")
    assert rest.where("name not rlike '^w[0-9]+( w[0-9]*)*$'").isEmpty() and rest.where("note is null").count() > 50
    assert df.where("_rule_id = 0 and name <> 'pinned'").isEmpty() and df.where("_rule_id = 0").select("note").distinct().count() == 1
    assert rest.select(F.explode(F.split("name", " ")).alias("w")).distinct().count() > 500
    assert df.where("length(code) <> 2").isEmpty()
