import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.cleaning import clean_model_text
from rowloom.functions.literals import DIALECTS, literal
from rowloom.model import ColumnSpec as C
from rowloom.model import CombinationRule, RepetitionRule, TableSpec
from rowloom.operators import checks, graph, joins
from rowloom.operators.discovery import profile_columns
from rowloom.functions.keyed import Draws
from rowloom.functions.values import iso_countries
from rowloom.operators.enrichment import attach_phrases, enrich, enrichable_columns, rebuild_lines
from rowloom.operators.generate import GenerateOptions, generate_table
from rowloom.operators.indexing import dense_index
from rowloom.operators.combinations import combination_violations
from rowloom.operators.quality import clamp, outside_bounds, repair_numeric
from rowloom.plans.discover import discover
from rowloom.sinks.script import script, write_script
from rowloom.streaming.line_assembly import assemble_lines


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def levels_of(spark, pairs):
    return {r["node"]: (r["component"], r["level"]) for r in graph.load_levels(edges_of(spark, pairs)).collect()}


def test_diamond_and_cycle_levels(spark):
    assert levels_of(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")]) == {
        "a": ("a", 0), "b": ("b", 1), "c": ("c", 1), "d": ("d", 2)}
    got = levels_of(spark, [("r", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("y", "w"), ("s", "s")])
    assert got == {"r": ("r", 0), "x": ("x", 1), "y": ("x", 1), "z": ("x", 1), "w": ("w", 2), "s": ("s", 0)}


def test_cycle_groups(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "c"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "d"), ("f", "d"), ("b", "d"), ("g", "h")]
    got = sorted(tuple(r) for r in graph.cycle_groups(edges_of(spark, pairs)).collect())
    assert got == [("a", "a"), ("a", "b"), ("c", "c"), ("d", "d"), ("d", "e"), ("d", "f"), ("d", "g")]


def test_dense_components(spark):
    # Every node has several neighbours, so nothing can be contracted and colouring has to work.
    pairs = [(a, b) for g in ("abc", "def") for a in g for b in g if a != b] + [("a", "d"), ("b", "e")]
    got = sorted(tuple(r) for r in graph.cycle_groups(edges_of(spark, pairs)).collect())
    assert got == [("a", x) for x in "abc"] + [("d", x) for x in "def"]


def test_deep_chain_with_a_shared_parent(spark):
    n = 400
    edges = spark.range(n).selectExpr("id as src", "id + 1 as dst").unionByName(spark.range(1, n).selectExpr("-1L as src", "id as dst"))
    got = graph.load_levels(edges).where("node >= 0 and level <> node")
    assert got.isEmpty()


CHECKS = [
    ("t", "age BETWEEN 18 AND 65"), ("t", "age >= 21"), ("t", "score > 0 AND score < 10"), ("t", "(rate)::numeric BETWEEN 9.5 AND 1.5"),
    ("t", "length(name) <= 50"), ("t", "char_length(code) < 10"), ("t", "page_age > 900"), ("t", "state IN ('a', 'b,c', \"d\")"),
    ("t", "kind = ANY (ARRAY['x'::text, 'y z'::character varying])"), ("t", "mode = 'm' OR mode = NULL"), ("t", ""), ("t", None),
]


def test_check_limits(spark):
    texts = spark.createDataFrame(CHECKS, "table_name string, expr string")
    spec = TableSpec("t", (C("age", "int"), C("score", "int"), C("rate", "double"), C("name", "varchar", length=30),
                           C("code", "varchar"), C("state"), C("kind"), C("mode"), C("free", "int")))
    columns = spark.createDataFrame([("t", c.name, c.length) for c in spec.columns], "table_name string, column_name string, length int")
    got = checks.constrain(spec, checks.column_limits(texts, columns), checks.allowed_values(texts, columns))
    assert (got.column("age").min_value, got.column("age").max_value) == (21, 65)
    assert (got.column("score").min_value, got.column("score").max_value) == (1, 9)
    assert (got.column("rate").min_value, got.column("rate").max_value) == (1.5, 9.5)
    assert got.column("name").length == 30 and got.column("code").length == 9
    assert got.column("state").allowed == ("a", "b,c", "d")
    assert got.column("kind").allowed == ("x", "y z") and got.column("mode").allowed == ("m",)
    assert got.column("free") == spec.column("free")


def test_long_check_text(spark):
    long = "kind IN (" + ", ".join(f"'value number {i}'" for i in range(3000)) + ")"
    texts = spark.createDataFrame([("t", long)], "table_name string, expr string")
    columns = spark.createDataFrame([("t", "kind", 0)], "table_name string, column_name string, length int")
    assert checks.allowed_values(texts, columns).count() == 3000


def test_combination_rule(spark):
    rule = CombinationRule(("a", "b"), (("x", "1"), ("y", "NULL")))
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", None), ("y", 1), (None, 1)], "a string, b int")
    assert sorted(map(str, combination_violations(df, rule).collect())) == sorted(
        ["Row(a='x', b=2)", "Row(a='y', b=1)"])


CLEANED = [
    ("1. Alice", "Alice"), ("2) Bob", "Bob"), ("- item", "item"), ("* item", "item"), ('"quoted"', "quoted"), ("'single'", "single"),
    ("```json", ""), ("```", ""), ("``` x ```", "x"), ("Here are 5 values", None), ("I'm sorry, no", None), ("no puedo hacerlo", None),
    ("name: John", "John"), ("NAME = \"John\"", "John"), ("named: John", "named: John"), ("name", None), ("first\nsecond", "first"),
    ("", ""), ("  spaced\t", "spaced"), ("some unique and realistic text", None), (None, None), ("3- x", "x"), ("2024", "2024"),
]


def test_clean_model_text(spark):
    df = spark.createDataFrame([(a,) for a, _ in CLEANED], "t string").coalesce(1)
    got = [r[0] for r in df.select(clean_model_text(F.col("t"), "name")).collect()]
    assert got == [b for _, b in CLEANED]
    per_row = spark.createDataFrame([("city: Rome", "city"), ("city: Rome", None), ("city: Rome", "")], "t string, c string").coalesce(1)
    assert [r[0] for r in per_row.select(clean_model_text(F.col("t"), F.col("c"))).collect()] == ["Rome", "city: Rome", "city: Rome"]


def test_literals(spark):
    cases = [
        (None, T.StringType(), "mysql", "NULL"), ("it's\\\n", T.StringType(), "mysql", "'it''s\\\\ '"), ("a\0b", T.StringType(), "h2", "'ab'"),
        (True, T.BooleanType(), "sqlite", "1"), (False, T.BooleanType(), "h2", "FALSE"), (1.50, T.DoubleType(), "h2", "1.5"),
        (float("nan"), T.DoubleType(), "h2", "NULL"), (float("inf"), T.DoubleType(), "h2", "NULL"), (1e21, T.DoubleType(), "h2", "1000000000000000000000"),
        (0.0, T.DoubleType(), "h2", "0"), (1.5e-7, T.DoubleType(), "h2", "0.00000015"), (-120.0, T.DoubleType(), "h2", "-120"),
        (decimal.Decimal("1.50"), T.DecimalType(5, 2), "h2", "1.50"), (dt.date(2024, 2, 3), T.DateType(), "derby", "DATE('2024-02-03')"),
        (dt.datetime(2024, 2, 3, 4, 5, 6, 120000), T.TimestampNTZType(), "h2", "'2024-02-03 04:05:06.12'"),
        ([1, None], T.ArrayType(T.IntegerType()), "h2", "ARRAY[1, NULL]"), (["a'b"], T.ArrayType(T.StringType()), "h2", "ARRAY['a''b']"),
    ]
    for value, kind, dialect, expected in cases:
        df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
        assert df.select(literal(F.col("v"), kind, DIALECTS[dialect])).first()[0] == expected
    assert DIALECTS["sqlserver"].quote("a]b") == "[a]]b]" and DIALECTS["oracle"].quote("ab") == '"AB"'
    assert len(DIALECTS) == 15


def test_empty_script(spark):
    assert script(spark, [], [], DIALECTS["h2"], deferred=False).isEmpty()
    frame = [r["statement"] for r in script(spark, [], [], DIALECTS["h2"], deferred=True).orderBy("section").collect()]
    assert frame == ["BEGIN;\nSET REFERENTIAL_INTEGRITY FALSE;\n", "SET REFERENTIAL_INTEGRITY TRUE;\nCOMMIT;\n"]


def test_script_files_in_order(spark, tmp_path):
    from rowloom.sinks.script import numbered

    rows = numbered("t", spark.range(250).withColumnRenamed("id", "k"), ["k"])
    write_script(script(spark, [rows], [], DIALECTS["sqlite"], True), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("BEGIN TRANSACTION;\nPRAGMA") and text.endswith("COMMIT;\n")
    assert text.count("INSERT INTO") == 3 and text.index("(0)") < text.index("(99)") < text.index("(249)")


def test_repair(spark):
    df = spark.createDataFrame([("1",), ("30",), ("x",), (None,)], "v string").coalesce(1)
    assert [r[0] for r in df.select(outside_bounds(F.col("v"), 5, 20)).collect()] == [True, True, True, False]
    numbers = spark.createDataFrame([(1,), (30,), (7,), (None,)], "v int").coalesce(1)
    assert [r[0] for r in numbers.select(clamp(F.col("v"), 5, 20)).collect()] == [5, 20, 7, None]
    fixed = repair_numeric(numbers, C("v", "int", min_value=5, max_value=20, allowed=("30",)))
    assert [r[0] for r in fixed.collect()] == [5, 30, 7, None]


def test_dense_index_many_partitions(spark):
    df = spark.range(0, 5000, 1, 37).select((F.col("id") * 7919 % 5003).alias("k"))
    indexed = dense_index(df, ["k"])
    assert indexed.count == 5000
    ranked = [r["_pos"] for r in indexed.df.orderBy("k").collect()]
    assert ranked == list(range(5000))
    assert dense_index(df.where("k < 0"), ["k"]).count == 0


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_LEFT", 100)
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.col("id"))
    left = left.withColumn("k", F.when(F.col("id") != 10, F.col("k")))
    right = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.lookup(left, right, ["k"])
    want = left.join(right, "k", "left")
    assert got.count() == 3000 and got.exceptAll(want.select(*got.columns)).isEmpty()


def provider(table, column, kind, words, count):
    return [f"text {i}" for i in range(count)]


def test_enrichment_keeps_rules_and_uniqueness(spark):
    spec = TableSpec("t", (C("id", "int"), C("note", "string", False, 30), C("ref", "int")), ("id",))
    rules = (RepetitionRule(5, {"note": "pinned"}),)
    df = generate_table(spark, spec, 100, GenerateOptions(2, rules=rules))
    done = enrich(df, spec, spec.column("note"), provider)
    assert done.where("_rule_id = 0 and note <> 'pinned'").isEmpty()
    assert done.where("_rule_id is null and note not like 'text %'").isEmpty()
    unique = enrich(generate_table(spark, spec, 100), spec, spec.column("note"), provider, unique=True)
    texts = unique.where("note like 'text %'")
    assert texts.count() == texts.select("note").distinct().count() > 0
    assert [c.name for c in enrichable_columns(spec, ["note", "ref", "gone"], frozenset({"ref"}), ())] == ["note"]
    assert enrichable_columns(spec, ["note"], rules=rules) == []


def test_provider_failures_keep_generated_values(spark):
    def broken(*_):
        raise RuntimeError("no model")

    spec = TableSpec("t", (C("note", "string", False, 30),))
    df = generate_table(spark, spec, 20)
    assert enrich(df, spec, spec.column("note"), broken).select("note").exceptAll(df.select("note")).isEmpty()
    failed = enrich(df, spec, spec.column("note"), broken, errors="failed").agg(F.sum("failed"), F.count_if(F.col("failed") > 0)).first()
    assert failed[0] == 3 * failed[1] and failed[1] * 50 >= df.count()


LINES = [(1, 0, '{"response":"one\\ntw"}'), (1, 1, "{broken"), (1, 2, '{"response":"o\\n\\nthr"}'), (1, 3, '{"response":"ee"}'),
         (2, 0, '{"message":{"content":"a"}}'), (2, 1, '{"response":"\\nb"}')]


def test_rebuild_lines(spark):
    df = spark.createDataFrame(LINES, "request_id long, seq long, line string").repartition(4)
    got = sorted(tuple(r) for r in rebuild_lines(df).collect())
    assert got == [(1, 0, "one"), (1, 1, "two"), (1, 2, ""), (1, 3, "three"), (2, 0, "a"), (2, 1, "b")]


def test_streamed_lines(spark, tmp_path):
    schema = "request_id long, seq long, line string, done boolean"
    rows = [(*r, (r[0], r[1]) in {(1, 3), (2, 1)}) for r in LINES]
    source = tmp_path / "in"
    for i, part in enumerate((rows[:2] + rows[4:5], rows[2:3], rows[3:4] + rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        (tmp_path / str(i)).mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (assemble_lines(stream).writeStream.format("memory").queryName("whole_lines").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("whole_lines").collect())
    assert got == [(1, 0, "one"), (1, 1, "two"), (1, 2, ""), (1, 3, "three"), (2, 0, "a"), (2, 1, "b")]


def test_oversized_word_list_is_refused():
    from rowloom.functions.values import MAX_INLINE_WORDS, ValueSettings

    with pytest.raises(ValueError):
        ValueSettings(words=("w",) * (MAX_INLINE_WORDS + 1))


def test_combinations_enter_the_specification(spark):
    texts = spark.createDataFrame(
        [("t", "(kind = 'a' AND size = 1) OR (kind = 'b' AND (size = 2 OR size = 3))"), ("t", "kind = 'a' OR kind = 'b'"), ("u", "kind = 'z' AND size = 1")],
        "table_name string, expr string",
    )
    spec = TableSpec("t", (C("kind"), C("size", "int")))
    columns = spark.createDataFrame([("t", c.name, c.length) for c in spec.columns], "table_name string, column_name string, length int")
    got = checks.constrain(spec, checks.column_limits(texts, columns), checks.allowed_values(texts, columns), checks.value_combinations(texts))
    assert got.combinations == (CombinationRule(("kind", "size"), (("a", "1"), ("b", "2"), ("b", "3"))),)


def test_clauses():
    assert checks.clauses("\"a\" BETWEEN 1 AND 3 AND \"b\" = 2 OR ( \"a\" ) = '5' AND \"b\" = 1") == [None, [["a", "'5'"], ["b", "1"]]]
    assert checks.clauses('NOT ( "a" = 1 OR "a" = 2 )') == [None] and checks.clauses('( "a" = 1') == []
    deep = "( " * 3000 + '"a" = 1' + " )" * 3000
    assert checks.clauses(deep) == [[["a", "1"]]]


def test_discover_reads_keys_references_and_rules(spark):
    days = spark.sql("SELECT id div 6 AS a, id div 2 % 3 AS b, id % 2 AS c, date_add(DATE'2024-01-01', CAST(id AS INT)) AS day, 'x' || id % 2 AS kind FROM range(24)")
    used = spark.sql("SELECT id AS use_id, id % 4 AS a, id % 3 AS b, id % 2 AS c, CASE WHEN id % 5 > 0 THEN id END AS n FROM range(50)")
    empty = spark.createDataFrame([], "e_id bigint, t string")
    texts = spark.createDataFrame([("used", "n < 40")], "table_name string, expr string")
    specs = {s.name: s for s in discover({"days": days.drop("day"), "used": used, "empty": empty}, texts)}
    assert specs["days"].primary_key == ("a", "b", "c")
    assert specs["days"].column("kind").allowed == ("x0", "x1")
    assert specs["used"].primary_key == ("use_id",)
    assert [(fk.columns, fk.parent, fk.parent_columns) for fk in specs["used"].foreign_keys] == [(("a", "b", "c"), "days", ("a", "b", "c"))]
    assert specs["used"].column("n").nullable and specs["used"].column("n").max_value < 40
    assert specs["empty"].primary_key == () and specs["empty"].column("t").nullable
    assert discover({"days": days})[0].primary_key == ("day",)


def test_profile_counts_nulls_and_equal_values(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, -0.0, None), (2, float("nan"), None)], "a int, b double, c string")
    got = {r["column_name"]: (r["n_nulls"], r["n_distinct"]) for r in profile_columns(df, "t").collect()}
    assert got == {"a": (0, 2), "b": (0, 2), "c": (3, 0)}


def test_phrases_from_no_and_from_large_vocabularies(spark, monkeypatch):
    rows, draws = spark.range(50).withColumnRenamed("id", "k"), Draws(1, "t")
    words = spark.createDataFrame([(f"w{i}",) for i in range(30)], "word string")
    small = attach_phrases(rows, "k", words, draws, "p")
    beside = {tuple(r) for r in small.collect()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    assert {tuple(r) for r in attach_phrases(rows, "k", words, draws, "p").select(small.columns).collect()} == beside
    filled = attach_phrases(rows, "k", words.where("false"), draws, "p")
    assert filled.count() == 50 and filled.where("p rlike '^[a-z]+( [a-z]+){2,8}$'").count() == 50


def test_broadcast_measures_texts_and_countries_are_all(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1_000_000).alias("t"))
    assert not joins.fits_broadcast(wide, 100) and joins.fits_broadcast(wide.select("id", F.lit("x").alias("t")), 100)
    two, three = iso_countries()
    assert len(two) == len(three) > 200 and dict(zip(two, three))["JP"] == "JPN"
