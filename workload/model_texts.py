"""Text cleaning, rebuilding and enrichment over the provided texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.cleaning import PREAMBLE_PHRASES, PREAMBLE_STARTS, REFUSAL_STARTS, clean_model_text, provided_value
from rowloom.functions.values import ValueSettings
from rowloom.model import ColumnSpec, RepetitionRule, TableSpec
from rowloom.operators.enrichment import enrich, enrichable_columns, first_occurrences, model_values, rebuild_lines
from rowloom.operators.generate import GenerateOptions, generate_over, generate_table
from rowloom.operators.indexing import dense_index
from rowloom.session import materialize, shared_dir, spread
from rowloom.streaming.line_assembly import assemble_lines
from workload.common import SEED, draw, table

# Wrappings put around the provided texts, by document number: (before, after).
WRAPPINGS = (
    ("", ""), ("1. ", ""), ("12)", ""), ("- ", ""), ('"', '"'), ("```json\\n", "\\n```"), ("``` ", " ```"), ("Here are ", ""),
    ("Lo siento, ", ""), ("text: '", "'"), ("TEXT = ", ""), ("textual ", ""), ("\\t  ", "  "), ("* ", ""), ("some values for the ", ""),
    ("3- \"", "\""),
)
TRIM = "'^[\\x00-\\x20]+|[\\x00-\\x20]+$'"


def _wrapped(text: Column, number: Column) -> Column:
    """The whole text inside one of the wrappings."""
    choice = F.pmod(number, F.lit(len(WRAPPINGS))).cast("int") + 1
    before = F.element_at(F.array(*[F.lit(b.encode().decode("unicode_escape")) for b, _ in WRAPPINGS]), choice)
    after = F.element_at(F.array(*[F.lit(a.encode().decode("unicode_escape")) for _, a in WRAPPINGS]), choice)
    return F.concat(before, text, after)


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", clean_model_text(_wrapped(F.col("text"), F.col("doc_id")), "text").alias("value"))


def _trim(e: str) -> str:
    return f"regexp_replace({e}, {TRIM}, '', 'g')"


def _sql_text(s: str) -> str:
    out = "'" + s.replace("'", "''") + "'"
    return out.replace("\\n", "' || chr(10) || '").replace("\\t", "' || chr(9) || '")


def _clean_sql(source: str, raw: str, key: str, column: str | None) -> str:
    """The cleaning rules as SQL steps over ``source``."""
    starts = " OR ".join(f"starts_with(lower(v), {_sql_text(p)})" for p in (*PREAMBLE_STARTS, *REFUSAL_STARTS))
    inside = " OR ".join(f"contains(lower(v), {_sql_text(p)})" for p in PREAMBLE_PHRASES)
    quotes = "regexp_matches({0}, '(?s)^(\".*\"|''.*'')$') AND length({0}) >= 2"
    unquoted = lambda e: f"CASE WHEN {quotes.format(e)} THEN {_trim(f'{e}[2:-2]')} ELSE {e} END"
    final = "v"
    if column:
        n = len(column)
        rest = _trim(f"substr(v, {n + 1})")
        value = _trim(f"substr({rest}, 2)")
        final = (
            f"CASE WHEN starts_with(lower(v), '{column}') AND regexp_matches({rest}, '^[:=]') THEN {unquoted(value)} ELSE v END"
        )
        final = f"(SELECT CASE WHEN lower(x) <> '{column}' THEN x END FROM (SELECT {final} AS x))"
    return f"""
s1 AS (SELECT {key}, {_trim(f"regexp_extract({raw}, '^([^\\r\\n]*)', 1)")} AS v FROM {source}),
s2 AS (SELECT {key}, CASE WHEN starts_with(v, '```') THEN CASE WHEN regexp_matches(v, '^```[\\x00-\\x20]*([a-zA-Z]{{1,12}})?[\\x00-\\x20]*$')
  THEN '' ELSE {_trim('substr(v, 4)')} END ELSE v END AS v FROM s1),
s3 AS (SELECT {key}, CASE WHEN ends_with(v, '```') THEN {_trim("left(v, -3)")} ELSE v END AS v FROM s2),
s4 AS (SELECT {key}, {unquoted('v')} AS v FROM s3),
s5 AS (SELECT {key}, {_trim("regexp_replace(v, '^[0-9]+[.)-][ \\t\\n\\x0B\\f\\r]*', '')")} AS v FROM s4),
s6 AS (SELECT {key}, CASE WHEN starts_with(v, '- ') OR starts_with(v, '* ') THEN {_trim('substr(v, 3)')} ELSE v END AS v FROM s5),
cleaned AS (SELECT {key}, CASE WHEN NOT ({starts} OR {inside}) THEN {final} END AS value FROM s6)
"""


_BEFORE = "[" + ", ".join(_sql_text(b) for b, _ in WRAPPINGS) + "]"
_AFTER = "[" + ", ".join(_sql_text(a) for _, a in WRAPPINGS) + "]"
CLEAN_TEXTS = f"""
WITH w AS (SELECT doc_id, ({_BEFORE})[(doc_id % {len(WRAPPINGS)} + 1)::INTEGER] || text ||
  ({_AFTER})[(doc_id % {len(WRAPPINGS)} + 1)::INTEGER] AS t FROM documents),
{_clean_sql('w', 't', 'doc_id', 'text')}
SELECT doc_id, value FROM cleaned
"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as one model answer, cut into word tokens as NDJSON; some lines malformed."""
    # A small file of texts is one task; the chunks it makes are many.
    turns = spread(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    words = turns.select(
        F.col("conv_id").alias("request_id"), "turn", F.posexplode(F.split(F.concat("text", F.lit("\n")), "(?<= )", -1)).alias("w", "token")
    )
    good = words.select(
        "request_id", (F.col("turn") * 1_000_000 + F.col("w") * 2).alias("seq"),
        F.when(F.col("w") % 2 == 0, F.to_json(F.struct(F.col("token").alias("response"))))
        .otherwise(F.to_json(F.struct(F.struct(F.col("token").alias("content")).alias("message")))).alias("line"),
    )
    bad = words.where("w % 5 = 0").select("request_id", (F.col("turn") * 1_000_000 + F.col("w") * 2 + 1).alias("seq"), F.lit('{"resp').alias("line"))
    return good.unionByName(bad)


def ndjson_lines(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_lines(_chunks(spark, d))


_ANSWERS = """
a AS (SELECT conv_id AS request, string_split(string_agg(text || chr(10), '' ORDER BY turn), chr(10)) AS l FROM conversations GROUP BY conv_id),
lines AS (SELECT request, i - 1 AS line_no, l[i::INTEGER] AS text FROM (SELECT request, l, unnest(range(1, len(l) + 1)) AS i FROM a))
"""
NDJSON_LINES = f"WITH {_ANSWERS} SELECT request, line_no::BIGINT AS line_no, text FROM lines"


def ndjson_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same answers as a stream of files whose chunks come out of order, some twice; every seventh answer never ends.

    A last chunk long after the others lets the unfinished ones be flushed.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n")).alias("text"))
    placed = dense_index(turns, ["conv_id", "turn", "text"], "pos").df
    starts = placed.groupBy("conv_id").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    rows = materialize(placed.join(starts, "conv_id").select(
        F.col("conv_id").alias("request_id"), (F.col("pos") - F.col("start")).alias("seq"),
        F.to_json(F.struct(F.col("text").alias("response"))).alias("line"), ((F.col("pos") == F.col("end")) & (F.col("conv_id") % 7 > 0)).alias("done"),
        (start + F.make_dt_interval(secs=F.col("conv_id") % 60)).alias("ts"),
    ))
    part = F.pmod(F.xxhash64("request_id", "seq"), F.lit(3))
    for number in range(3):  # three loads of every request's chunks, the second with some of the first once more
        own = rows.where(part.isin(number, number - 1) if number == 1 else part == number)
        spread(own).write.mode("append").parquet(f"{folder}/in")
    flush = spark.createDataFrame([(-1, 0, None, True)], "request_id bigint, seq bigint, line string, done boolean").withColumn("ts", start + F.make_dt_interval(hours=F.lit(9)))
    flush.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    # A trigger takes about one load, whose files are as many as there are cores, so batches are not cut to a few tasks.
    files = max(2, len(spark.read.parquet(f"{folder}/in").inputFiles()) // 3)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    query = (
        assemble_lines(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("request long, line_no long, text string").parquet(f"{folder}/out")


# The line break behind the last turn ends a line and opens none.
NDJSON_STREAM = f"""
WITH {_ANSWERS}, n AS (SELECT request, max(line_no) AS last FROM lines GROUP BY request)
SELECT request, line_no::BIGINT AS line_no, text FROM lines JOIN n USING (request) WHERE line_no < last
"""


def ndjson_values(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned lines of every answer, each distinct value at its first line."""
    return model_values(rebuild_lines(_chunks(spark, d)), "et")


NDJSON_VALUES = f"""
WITH {_ANSWERS}, {_clean_sql('lines', 'text', 'request, line_no', 'et')}
SELECT request, min(line_no)::BIGINT AS line_no, value FROM cleaned WHERE trim(value) <> '' GROUP BY request, value
"""


def provided_values(spark: SparkSession, d: str) -> DataFrame:
    """Provided texts applied to columns: trimmed, cut, cast, read as arrays; unfit ones are null."""
    events = table(spark, d, "events")
    raw = F.concat(F.lit(" \t"), F.get_json_object("props", "$.k"), F.lit(" "))
    listed = F.concat(F.lit("["), F.col("event_type"), F.lit(", '"), F.col("event_type"), F.lit(" x' ,\"y\"]"))
    braces = F.concat(F.lit("{"), F.col("event_type"), F.lit("}"))
    return events.select(
        "event_id",
        provided_value(raw, ColumnSpec("n", "int")).alias("n"),
        provided_value(F.col("event_type"), ColumnSpec("m", "bigint")).alias("m"),
        provided_value(F.col("event_type"), ColumnSpec("s", "varchar", length=4)).alias("s"),
        provided_value(F.lit("  "), ColumnSpec("b", "string")).alias("b"),
        provided_value(listed, ColumnSpec("a", "array")).alias("a"),
        provided_value(F.when(F.col("event_id") % 2 == 0, braces).otherwise("[]"), ColumnSpec("z", "array")).alias("z"),
    )


PROVIDED_VALUES = """
SELECT event_id, (props::JSON->>'$.k')::INTEGER AS n, NULL::BIGINT AS m, substr(event_type, 1, 4) AS s, NULL::VARCHAR AS b,
  [event_type, event_type || ' x', 'y'] AS a, CASE WHEN event_id % 2 = 0 THEN [event_type] ELSE [] END AS z FROM events
"""


def enrich_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Provided texts for a unique column: the first row to get a text keeps it."""
    texts = table(spark, d, "documents").select("lang", "doc_id", F.col("text").alias("value"))
    return first_occurrences(texts, ["lang"], "value", "doc_id").select("lang", "value", "doc_id")


ENRICH_DEDUPE = """
SELECT lang, text AS value, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2
"""


def _provider(table_name: str, column: str, kind: str, words: int, count: int) -> list[str]:
    """A provider that always gives the same numbered texts."""
    return [f"{column} {i % 7}" for i in range(count)]


def enrich_from_provider(spark: SparkSession, d: str) -> DataFrame:
    """A provider with only seven different texts: the rest of each batch keeps generated values."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("_idx"))
    spec = TableSpec("notes", (ColumnSpec("note", "string", False, 40), ColumnSpec("n", "int", False)))
    rows = generate_over(keys, spec, 0, GenerateOptions(SEED, values=ValueSettings(words=("alpha", "beta", "gamma"))))
    made = enrich(rows, spec, spec.column("note"), _provider)
    known = F.col("note").rlike(r"^note [0-6]$") | F.col("note").rlike("^(alpha|beta|gamma)( (alpha|beta|gamma))*$")
    return made.select(F.col("_idx").alias("o_orderkey"), known.alias("known"))


NOTES = TableSpec("notes", (ColumnSpec("note", "string", False, 40), ColumnSpec("n", "int", False)))
NOTE_WORDS = ("alpha", "beta", "gamma")


def _broken(table_name: str, column: str, kind: str, words: int, count: int) -> list[str]:
    raise TimeoutError("no answer")


def enrich_failing_provider(spark: SparkSession, d: str) -> DataFrame:
    """A provider that never answers: every row keeps its generated value, and the failures are counted."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("_idx"))
    rows = generate_over(keys, NOTES, 0, GenerateOptions(SEED, values=ValueSettings(words=NOTE_WORDS)))
    made = enrich(rows, NOTES, NOTES.column("note"), _broken, errors="failed")
    # Each batch of at most 50 rows fails three times.
    total = made.agg((F.sum("failed") % 3 == 0).alias("thrice"), (F.sum("failed") * 50 >= 3 * F.count("*")).alias("all_asked"))
    return made.select(F.col("_idx").alias("o_orderkey"), "note").crossJoin(F.broadcast(total))


ENRICH_FAILING_PROVIDER = f"""
SELECT o_orderkey, true AS thrice, true AS all_asked, array_to_string((
  [{', '.join(f"(['alpha', 'beta', 'gamma'])[({draw('notes', 'note', 'o_orderkey', 'v', 1 + 6 * i, 6)} % 3 + 1)::INTEGER]" for i in range(2))}]
  )[1:(1 + {draw('notes', 'note', 'o_orderkey', 'v', 25, 2)} % 2)::INTEGER], ' ') AS note
FROM orders
"""


def enrich_unique(spark: SparkSession, d: str) -> DataFrame:
    """Provided texts in a unique column beside rows that a rule pins: each text once, pinned rows untouched."""
    n = table(spark, d, "orders").count()
    spec = TableSpec("tickets", (ColumnSpec("id", "int", False), ColumnSpec("note", "string", False, 40)), ("id",))
    rules = (RepetitionRule(10, {"note": "note 3"}),)
    rows = generate_table(spark, spec, n, GenerateOptions(SEED, values=ValueSettings(words=NOTE_WORDS), rules=rules))
    made = rows
    for column in enrichable_columns(spec, ["note", "missing"], frozenset({"id"})):
        made = enrich(made, spec, column, _provider, unique=True)
    known = F.when(F.col("note").rlike("^note [0-9]$"), F.col("note")).otherwise("generated")
    return made.groupBy(known.alias("note")).agg(F.count("*").alias("n"))


ENRICH_UNIQUE = """
SELECT note, CASE note WHEN 'note 3' THEN 10 WHEN 'generated' THEN (SELECT count(*) FROM orders) - 16 ELSE 1 END AS n
FROM (SELECT unnest(['note 0', 'note 1', 'note 2', 'note 3', 'note 4', 'note 5', 'note 6', 'generated']) AS note)
"""

QUERIES = {
    "enrich_failing_provider": (enrich_failing_provider, ENRICH_FAILING_PROVIDER),
    "enrich_unique": (enrich_unique, ENRICH_UNIQUE),
    "clean_texts": (clean_texts, CLEAN_TEXTS),
    "ndjson_lines": (ndjson_lines, NDJSON_LINES),
    "ndjson_stream": (ndjson_stream, NDJSON_STREAM),
    "ndjson_values": (ndjson_values, NDJSON_VALUES),
    "provided_values": (provided_values, PROVIDED_VALUES),
    "enrich_dedupe": (enrich_dedupe, ENRICH_DEDUPE),
    "enrich_from_provider": (enrich_from_provider, "SELECT o_orderkey, true AS known FROM orders"),
}
