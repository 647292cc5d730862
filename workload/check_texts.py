"""CHECK expressions written from the data, one set per part, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.model import ColumnSpec as C
from rowloom.operators import checks
from rowloom.sources.tables import checks_from_remarks, strip_check_wrapper
from workload.common import table

# The columns every part's table declares, with their text lengths.
COLUMNS = (("qty", 0), ("Tax", 0), ("price", 0), ("comment", 25), ("title", 0), ("flag", 0), ("status", 0), ("mode", 0), ("free", 12))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.min("l_quantity").cast("bigint").cast("string").alias("a"),
        F.max("l_quantity").cast("bigint").cast("string").alias("b"),
        F.count("*").cast("string").alias("c"),
    ).withColumn("table_name", F.concat(F.lit("part_"), F.col("l_partkey").cast("string")))


FACTS = """
f AS (SELECT 'part_' || l_partkey AS table_name, l_partkey AS k, min(l_quantity)::BIGINT AS a, max(l_quantity)::BIGINT AS b,
  count(*) AS c FROM lineitem GROUP BY l_partkey)
"""


def _texts(facts: DataFrame) -> DataFrame:
    """(table_name, expr) in the spellings databases print."""
    a, b, c, k = F.col("a"), F.col("b"), F.col("c"), F.col("l_partkey").cast("string")
    # Reversed bounds; qualified, quoted and cast names; repeated limits; strict bounds.
    made = [
        F.concat(F.lit("CHECK ((qty BETWEEN "), b, F.lit(" AND "), a, F.lit("))")),
        F.concat(F.lit('((s.t."qty")::numeric >= -'), c, F.lit(") AND (qty <= 40.5)")),
        F.concat(F.lit("(Tax > "), a, F.lit(" AND tax < "), b, F.lit(" AND subtax > 900)")),
        F.concat(F.lit("price = "), a, F.lit(".25 OR length(title) < "), c),
        F.concat(F.lit("char_length(comment) < "), c, F.lit(" AND LENGTH( comment ) <= 30")),
        F.concat(F.lit("CHECK (flag IN ('A', 'N (new)', 'p"), k, F.lit("'))")),
        F.concat(F.lit("((status)::text = ANY (ARRAY['O'::character varying, 'F"), k, F.lit("'::text]))")),
        F.concat(F.lit("mode = 'm"), k, F.lit("' OR mode = NULL")),
        F.lit("  "),
        F.lit(None).cast("string"),
    ]
    return facts.select("table_name", F.explode(F.array(*made)).alias("expr"))


def _columns(facts: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(s).alias("length")) for n, s in COLUMNS])
    return facts.select("table_name", F.explode(rows).alias("c")).select("table_name", "c.column_name", "c.length")


def parse_limits(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d)
    return checks.column_limits(_texts(facts), _columns(facts))


PARSE_LIMITS = f"""
WITH {FACTS}
SELECT table_name, 'qty' AS column_name, a::DOUBLE AS min_value, false AS min_open, least(b, 40.5)::DOUBLE AS max_value, false AS max_open, NULL::INTEGER AS max_length FROM f
UNION ALL SELECT table_name, 'Tax', a, true, b, true, NULL FROM f
UNION ALL SELECT table_name, 'price', a + 0.25, false, a + 0.25, false, NULL FROM f
UNION ALL SELECT table_name, 'comment', NULL, false, NULL, false, least(25, c - 1)::INTEGER FROM f
UNION ALL SELECT table_name, 'title', NULL, false, NULL, false, (c - 1)::INTEGER FROM f
UNION ALL SELECT table_name, 'flag', NULL, false, NULL, false, NULL FROM f
UNION ALL SELECT table_name, 'status', NULL, false, NULL, false, NULL FROM f
UNION ALL SELECT table_name, 'mode', NULL, false, NULL, false, NULL FROM f
UNION ALL SELECT table_name, 'free', NULL, false, NULL, false, 12 FROM f
"""


def parse_integer_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The limits as whole numbers: strict bounds move one step inwards."""
    limits = parse_limits(spark, d).where("column_name in ('qty', 'Tax', 'price')")
    low, high = checks.integer_bounds(F.col("min_value"), F.col("min_open"), F.col("max_value"), F.col("max_open"))
    return limits.select("table_name", "column_name", low.alias("first_value"), high.alias("last_value"))


PARSE_INTEGER_BOUNDS = f"""
WITH {FACTS}
SELECT table_name, 'qty' AS column_name, a AS first_value, least(b, 40)::BIGINT AS last_value FROM f
UNION ALL SELECT table_name, 'Tax', a + 1, b - 1 FROM f
UNION ALL SELECT table_name, 'price', a + 1, a FROM f
"""


def parse_allowed(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d)
    return checks.allowed_values(_texts(facts), _columns(facts))


PARSE_ALLOWED = f"""
WITH {FACTS}
SELECT table_name, 'flag' AS column_name, unnest(['A', 'N (new)', 'p' || k]) AS value FROM f
UNION ALL SELECT table_name, 'status', unnest(['O', 'F' || k]) FROM f
UNION ALL SELECT table_name, 'mode', 'm' || k FROM f
UNION ALL SELECT table_name, 'price', a::VARCHAR || '.25' FROM f
"""


def parse_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Rules over two columns, nested and quoted in several ways; a range clause is dropped."""
    facts = _facts(spark, d)
    a, k = F.col("a"), F.col("l_partkey").cast("string")
    made = [
        F.concat(F.lit("CHECK (((kind = 'x"), k, F.lit("') AND (size = "), a, F.lit(")) OR ((kind = 'this OR (that)') AND (size = 2)))")),
        F.concat(F.lit("(kind = 'r' AND \"size\" > 4) OR (t.kind = 'it''s' AND size = "), k, F.lit(")")),
        F.lit("size > 3"),
    ]
    texts = facts.select("table_name", F.posexplode(F.array(*made)).alias("rule", "expr"))
    found = checks.value_combinations(texts.select("table_name", "expr"))
    return found.join(texts, ["table_name", "expr"]).select("table_name", "rule", "clause", "column_name", "value")


PARSE_COMBINATIONS = f"""
WITH {FACTS}
SELECT table_name, 0 AS rule, 0 AS clause, 'kind' AS column_name, 'x' || k AS value FROM f
UNION ALL SELECT table_name, 0, 0, 'size', a::VARCHAR FROM f
UNION ALL SELECT table_name, 0, 1, 'kind', 'this OR (that)' FROM f
UNION ALL SELECT table_name, 0, 1, 'size', '2' FROM f
UNION ALL SELECT table_name, 1, 1, 'kind', 'it''s' FROM f
UNION ALL SELECT table_name, 1, 1, 'size', k::VARCHAR FROM f
"""


def parse_factors(spark: SparkSession, d: str) -> DataFrame:
    """A rule of forty ORs joined by AND for each supplier, and one whose factors share a column or contradict each other."""
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("table_name"), F.col("s_suppkey").alias("k"))
    k, after = F.col("k").cast("string"), (F.col("k") + 1).cast("string")
    parts = [F.concat(F.lit(f"((a{i} = "), k, F.lit(f" AND b{i} = 'x') OR (a{i} = "), after, F.lit(f" AND t.b{i} = 'it''s'))")) for i in range(40)]
    ring = F.concat(F.lit("(p = "), k, F.lit(" OR q = 1) AND (p = "), after, F.lit(" OR q = 2) AND (r = 1 OR r = 2) AND r = 2"))
    texts = suppliers.select("table_name", F.explode(F.array(F.concat_ws(" AND ", *parts), ring, F.lit("p = 1 AND p = 2"))).alias("expr"))
    found = checks.value_factors(texts)
    return found.select("table_name", F.when(F.col("expr").startswith("(("), 0).otherwise(1).alias("rule"), "factor", "clause", "column_name", "value")


PARSE_FACTORS = """
WITH s AS (SELECT 's' || s_suppkey AS table_name, s_suppkey AS k FROM supplier), f AS (SELECT *, unnest(range(40)) AS i FROM s)
SELECT table_name, 0 AS rule, i::INTEGER AS factor, 0 AS clause, 'a' || i AS column_name, k::VARCHAR AS value FROM f
UNION ALL SELECT table_name, 0, i::INTEGER, 0, 'b' || i, 'x' FROM f
UNION ALL SELECT table_name, 0, i::INTEGER, 1, 'a' || i, (k + 1)::VARCHAR FROM f
UNION ALL SELECT table_name, 0, i::INTEGER, 1, 'b' || i, 'it''s' FROM f
UNION ALL SELECT table_name, 1, 0, 0, unnest(['p', 'q']), unnest([k::VARCHAR, '2']) FROM s
UNION ALL SELECT table_name, 1, 0, 1, unnest(['p', 'q']), unnest([(k + 1)::VARCHAR, '1']) FROM s
UNION ALL SELECT table_name, 1, 1, 0, 'r', '2' FROM s
"""


def parens_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Parentheses in customer and part names, inside and outside quotes."""
    parts = table(spark, d, "part")
    text = F.concat(F.lit("(("), F.col("p_type"), F.lit(") = '("), F.col("p_name"), F.lit(")' AND \"f(x)\" = (1))"))
    return parts.select("p_partkey", checks.strip_parens(text).alias("expr"))


PARENS_STRIPPED = """
SELECT p_partkey, '  ' || p_type || '  = ''(' || p_name || ')'' AND "f(x)" =  1  ' AS expr FROM part
"""


def check_text_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Catalog clauses with wrapper and quotes, one per order."""
    orders = table(spark, d, "orders")
    clause = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).otherwise(
        F.concat(F.lit("CHECK ((`total` <= "), F.col("o_orderkey").cast("string"), F.lit("))"))
    )
    rows = orders.select(F.col("o_orderstatus").alias("schema_name"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("table_name"), clause.alias("clause"))
    return strip_check_wrapper(rows, "`")


CHECK_TEXT_CATALOG = """
SELECT o_orderstatus AS schema_name, 't' || o_orderkey AS table_name, '(total <= ' || o_orderkey || ')' AS expr
FROM orders WHERE o_orderkey % 5 <> 0
"""


def check_text_remarks(spark: SparkSession, d: str) -> DataFrame:
    """CHECK texts inside comments; comments without one give nothing."""
    parts = table(spark, d, "part")
    remark = F.when(F.col("p_size") > 10, F.concat(F.lit("Size rule,\ncheck (p_size\n<= "), F.col("p_size").cast("string"), F.lit(") as agreed"))).otherwise(F.col("p_name"))
    return checks_from_remarks(parts.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table_name"), remark.alias("remark")))


CHECK_TEXT_REMARKS = """
SELECT 't' || p_partkey AS table_name, 'p_size' || chr(10) || '<= ' || p_size AS expr FROM part WHERE p_size > 10
"""


def limits_merged(spark: SparkSession, d: str) -> DataFrame:
    """A column's own limits, narrowed side by side by the limits in CHECK text, then counted against the data."""
    lines = table(spark, d, "lineitem")
    text = lines.agg(F.concat(F.lit("l_quantity >= "), F.round(F.avg("l_quantity")).cast("bigint").cast("string")).alias("expr"))
    found = checks.column_limits(
        text.select(F.lit("lineitem").alias("table_name"), "expr"),
        text.select(F.lit("lineitem").alias("table_name"), F.lit("l_quantity").alias("column_name"), F.lit(0).alias("length")),
    ).first()
    column = C("l_quantity", "double", min_value=1, max_value=48).constrained(found["min_value"], found["max_value"])
    inside = F.col("l_quantity").between(column.min_value, column.max_value)
    return lines.agg(F.count_if(inside).alias("inside"), F.lit(float(column.min_value)).alias("low"), F.lit(float(column.max_value)).alias("high"))


LIMITS_MERGED = """
WITH m AS (SELECT round(avg(l_quantity)) AS low FROM lineitem)
SELECT count(*) FILTER (l_quantity BETWEEN low AND 48) AS inside, any_value(low) AS low, 48::DOUBLE AS high FROM lineitem, m
"""

def parse_edge_limits(spark: SparkSession, d: str) -> DataFrame:
    """Tests that bound no value, exponents, arithmetic, negation, and texts that look like rules."""
    facts = _facts(spark, d)
    a, c = F.col("a"), F.col("c")
    made = [
        F.concat(F.lit("length(code) >= "), a), F.concat(F.lit("char_length(title) BETWEEN 1 AND "), c),
        F.concat(F.lit("price >= "), a, F.lit("e2 AND price < .5E6")), F.concat(F.lit("tax + qty > "), a, F.lit(" OR abs(qty) > 9")),
        F.concat(F.lit("NOT (free > "), a, F.lit(")")), F.concat(F.lit("status = 'tax > "), a, F.lit("'")),
    ]
    names = F.array(*[F.lit(n) for n in ("code", "title", "price", "tax", "qty", "free", "status")])
    columns = facts.select("table_name", F.explode(names).alias("column_name"), F.lit(0).alias("length"))
    return checks.column_limits(facts.select("table_name", F.explode(F.array(*made)).alias("expr")), columns)


PARSE_EDGE_LIMITS = f"""
WITH {FACTS}
SELECT table_name, unnest(['code', 'tax', 'qty', 'free', 'status']) AS column_name, NULL::DOUBLE AS min_value, false AS min_open,
  NULL::DOUBLE AS max_value, false AS max_open, NULL::INTEGER AS max_length FROM f
UNION ALL SELECT table_name, 'title', NULL, false, NULL, false, c::INTEGER FROM f
UNION ALL SELECT table_name, 'price', a * 100.0, false, 500000.0, true, NULL FROM f
"""


def parse_edge_combinations(spark: SparkSession, d: str) -> DataFrame:
    """ORs inside clauses, a range beside them, and several CHECKs in one remark."""
    facts = _facts(spark, d)
    a, k = F.col("a"), F.col("l_partkey").cast("string")
    remark = F.concat(
        F.lit("first CHECK ((kind = 'x"), k, F.lit(") OR' AND size = 1) OR (kind = 'b' AND (size = 2 OR size = "), a,
        F.lit("))) then check ((kind)::text = 'c' AND size BETWEEN 1 AND 3 OR kind = 'd' AND size = 4) (end"),
    )
    found = checks.value_combinations(checks_from_remarks(facts.select("table_name", remark.alias("remark"))))
    return found.select("table_name", F.col("expr").contains("BETWEEN").alias("second"), "clause", "column_name", "value")


PARSE_EDGE_COMBINATIONS = f"""
WITH {FACTS}
SELECT table_name, false AS second, unnest([0, 1, 2]) AS clause, 'kind' AS column_name, unnest(['x' || k || ') OR', 'b', 'b']) AS value FROM f
UNION ALL SELECT table_name, false, unnest([0, 1, 2]), 'size', unnest(['1', '2', a::VARCHAR]) FROM f
UNION ALL SELECT table_name, true, 1, unnest(['kind', 'size']), unnest(['d', '4']) FROM f
"""

QUERIES = {
    "parse_edge_limits": (parse_edge_limits, PARSE_EDGE_LIMITS),
    "parse_edge_combinations": (parse_edge_combinations, PARSE_EDGE_COMBINATIONS),
    "parse_limits": (parse_limits, PARSE_LIMITS),
    "parse_integer_bounds": (parse_integer_bounds, PARSE_INTEGER_BOUNDS),
    "parse_allowed": (parse_allowed, PARSE_ALLOWED),
    "parse_factors": (parse_factors, PARSE_FACTORS),
    "parse_combinations": (parse_combinations, PARSE_COMBINATIONS),
    "parens_stripped": (parens_stripped, PARENS_STRIPPED),
    "check_text_catalog": (check_text_catalog, CHECK_TEXT_CATALOG),
    "check_text_remarks": (check_text_remarks, CHECK_TEXT_REMARKS),
    "limits_merged": (limits_merged, LIMITS_MERGED),
}
