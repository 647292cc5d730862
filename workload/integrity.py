"""Checks and repair on the provided tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws
from rowloom.model import ColumnSpec, ForeignKey, RepetitionRule, TableSpec
from rowloom.operators import quality
from rowloom.operators.combinations import combination_violations
from rowloom.operators.exclusions import exclusion_impact
from rowloom.operators.generate import GenerateOptions
from rowloom.plans.seeding import SeedOptions, seed
from rowloom.sources.tables import table_counts
from workload.common import SEED, TABLES, draw, table
from workload.star import SPECS, STAR, star_tables


def check_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers with a positive balance only: the others lose their parent."""
    parents = table(spark, d, "customer").where("c_acctbal > 0")
    return quality.orphans(table(spark, d, "orders"), parents, ForeignKey(("o_custkey",), "customer", ("c_custkey",)))


CHECK_ORPHANS = """
SELECT o_custkey, count(*) AS child_rows FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey
"""


def check_unique(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


CHECK_UNIQUE = "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def check_range(spark: SparkSession, d: str) -> DataFrame:
    bad = quality.range_violations(table(spark, d, "lineitem"), "l_quantity", 5, 45)
    return bad.groupBy("l_quantity").agg(F.count("*").alias("n"))


CHECK_RANGE = "SELECT l_quantity, count(*) AS n FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45 GROUP BY 1"


def check_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Rows outside the listed pairs; a status is null in every seventh order, which a CHECK lets pass if it may fit."""
    status = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linestatus"))
    lines = table(spark, d, "lineitem").withColumn("l_linestatus", status)
    bad = combination_violations(lines, SPECS["lineitem"].combinations[0])
    return bad.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


CHECK_COMBINATIONS = """
SELECT l_returnflag, status AS l_linestatus, count(*) AS n
FROM (SELECT l_returnflag, CASE WHEN l_orderkey % 7 <> 0 THEN l_linestatus END AS status FROM lineitem)
WHERE NOT (l_returnflag = 'A' AND status = 'F' OR l_returnflag = 'N' AND status = 'O' OR l_returnflag = 'R' AND status = 'F') GROUP BY 1, 2
"""


def check_text_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Text against number bounds: null is inside, text that is no number is outside."""
    events = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", F.col("event_type")).when(
        F.col("event_type") != "view", F.get_json_object("props", "$.k")
    )
    shown = events.select("event_type", quality.outside_bounds(text, 20, 60.5).alias("outside"))
    return shown.groupBy("event_type", "outside").agg(F.count("*").alias("n"))


CHECK_TEXT_BOUNDS = """
WITH e AS (SELECT event_type, CASE WHEN event_type = 'error' THEN event_type WHEN event_type <> 'view'
  THEN props::JSON->>'$.k' END AS t FROM events)
SELECT event_type, t IS NOT NULL AND (try_cast(t AS DOUBLE) IS NULL OR try_cast(t AS DOUBLE) < 20 OR try_cast(t AS DOUBLE) > 60.5) AS outside,
  count(*) AS n FROM e GROUP BY 1, 2
"""


def count_tables(spark: SparkSession, d: str) -> DataFrame:
    return table_counts({n: table(spark, d, n) for n in TABLES})


COUNT_TABLES = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS n_rows,"
    f" (SELECT count(*) FROM (DESCRIBE {n}))::INTEGER AS n_columns"
    for n in TABLES
)


def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    tables = star_tables(spark, d)
    return quality.integrity_report(tables, STAR)


def _report_sql(specs=STAR) -> str:
    lines = []

    def line(t: str, kind: str, name: str, checked: str, violations: str) -> None:
        lines.append(
            f"SELECT '{t}' AS table_name, '{kind}' AS kind, '{name}' AS constraint_name,"
            f" ({checked})::BIGINT AS checked, ({violations})::BIGINT AS violations"
        )

    for s in specs:
        rows = f"SELECT count(*) FROM {s.name}"
        for c in s.columns:
            if not c.nullable:
                line(s.name, "not_null", c.name, rows, f"{rows} WHERE {c.name} IS NULL")
            if c.min_value is not None or c.max_value is not None:
                tests = [f"{c.name} < {c.min_value}"] if c.min_value is not None else []
                tests += [f"{c.name} > {c.max_value}"] if c.max_value is not None else []
                line(s.name, "range", c.name, rows, f"{rows} WHERE {' OR '.join(tests)}")
            if c.allowed:
                values = ", ".join(f"'{v}'" for v in c.allowed)
                line(s.name, "allowed", c.name, rows, f"{rows} WHERE {c.name} NOT IN ({values})")
        for r in s.combinations:
            cols, combos = ", ".join(r.columns), ", ".join("(" + ", ".join(f"'{v}'" for v in k) + ")" for k in r.combinations)
            line(s.name, "combination", ",".join(r.columns), rows, f"{rows} WHERE ({cols}) NOT IN ({combos})")
        line(s.name, "row_count", "*", rows, "SELECT 0")
        for kind, keys in (("primary_key", [s.primary_key]), ("unique", s.unique_keys)):
            for k in keys:
                cols = ", ".join(k)
                line(s.name, kind, ",".join(k), rows, f"SELECT count(*) - count(DISTINCT ({cols})) FROM {s.name}")
        for fk in s.foreign_keys:
            c, p = fk.columns[0], fk.parent_columns[0]
            line(s.name, "foreign_key", fk.name, f"SELECT count({c}) FROM {s.name}",
                 f"{rows} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {p} FROM {fk.parent})")
    return "\nUNION ALL ".join(lines)


QUANTITY = ColumnSpec("l_quantity", "double", min_value=5, max_value=45, allowed=("50.0",))


def reference_types(spark: SparkSession, d: str) -> DataFrame:
    """Orders against nine tenths of the customers, with keys of other scale, type and kind on either side."""
    customers = table(spark, d, "customer").where("c_custkey % 10 <> 0")
    orders = table(spark, d, "orders").select("o_custkey")
    day = F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("c_custkey").cast("int"))
    moment = F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("o_custkey").cast("int")).cast("timestamp")
    pairs = {
        "scales": (F.col("o_custkey").cast("decimal(14,3)"), F.col("c_custkey").cast("decimal(12,2)")),
        "decimal to integer": (F.col("o_custkey").cast("decimal(14,2)"), F.col("c_custkey")),
        "integer to double": (F.col("o_custkey"), F.col("c_custkey").cast("double")),
        "moment to day": (moment, day),
        "text": (F.col("o_custkey").cast("string"), F.col("c_custkey").cast("string")),
    }
    rules = [
        ("orders", ForeignKey(("k",), f"customer {name}", ("k",), name=name), orders.select(a.alias("k")), customers.select(b.alias("k")))
        for name, (a, b) in pairs.items()
    ]
    return quality.reference_rules(spark, rules)


REFERENCE_TYPES = """
SELECT 'orders' AS table_name, 'foreign_key' AS kind,
  unnest(['scales', 'decimal to integer', 'integer to double', 'moment to day', 'text']) AS constraint_name, count(*) AS checked,
  count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)) AS violations FROM orders
"""


def repair_text(spark: SparkSession, d: str) -> DataFrame:
    """Numbers kept as text: what is no number goes to the lower bound, what is too high to the upper."""
    events = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    shown = events.select("event_id", text.alias("k"))
    return quality.repair_numeric(shown, ColumnSpec("k", "string", min_value=20, max_value=60))


REPAIR_TEXT = """
SELECT event_id, CASE WHEN event_type = 'error' OR k::INTEGER < 20 THEN '20' WHEN k::INTEGER > 60 THEN '60' ELSE k END AS k
FROM (SELECT event_id, event_type, props::JSON->>'$.k' AS k FROM events)
"""


def repair_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-range quantities move to the nearest bound; the listed value 50 is left alone."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return quality.repair_numeric(lines, QUANTITY)


REPAIR_CLAMP = """
SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_quantity = 50 THEN l_quantity ELSE least(greatest(l_quantity, 5), 45) END AS l_quantity FROM lineitem
"""


def repair_redraw(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-range prices are drawn again within bounds, keyed by the order."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    price = ColumnSpec("o_totalprice", "double", min_value=1000, max_value=200000)
    return quality.repair_numeric(orders, price, Draws(SEED, "orders"), "o_orderkey")


REPAIR_REDRAW = f"""
SELECT o_orderkey, CASE WHEN o_totalprice < 1000 OR o_totalprice > 200000
  THEN (100000 + {draw('orders', 'o_totalprice', 'o_orderkey', 'repair')} % 19900001)::DOUBLE / 100 ELSE o_totalprice END AS o_totalprice
FROM orders
"""


def exclusion_report(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one nation left out, the part table excluded, and the customer column of orders dropped."""
    tables = star_tables(spark, d)
    gone = tables["supplier"].where("s_nationkey = 3")
    return exclusion_impact(
        tables, [SPECS["customer"], SPECS["orders"], SPECS["lineitem"], SPECS["events"]], frozenset({"part"}),
        {"orders": frozenset({"o_custkey"}), "events": frozenset({"user_id"})}, {"supplier": gone},
    )


EXCLUSION_REPORT = """
SELECT 'orders' AS table_name, 'o_custkey_customer' AS fk_name, 'customer' AS parent_table,
  'required column excluded' AS reason, 0::BIGINT AS rows_without_parent, (SELECT count(o_custkey) FROM orders)::BIGINT AS required_cells_lost
UNION ALL SELECT 'lineitem', 'l_partkey_part', 'part', 'parent table excluded', (SELECT count(l_partkey) FROM lineitem), 0
UNION ALL SELECT 'lineitem', 'l_suppkey_supplier', 'supplier', 'parent rows excluded',
  (SELECT count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)), 0
UNION ALL SELECT 'events', 'user_id_customer', 'customer', 'column excluded', 0, 0
"""

SEEDED = (
    TableSpec("shop", (ColumnSpec("id", "int"), ColumnSpec("name", "varchar", False, 40)), ("id",), unique_keys=(("name",),)),
    TableSpec("buyer", (ColumnSpec("id", "bigint"), ColumnSpec("mentor_id", "bigint"), ColumnSpec("score", "decimal", False, 6, 2, 1, 5)),
              ("id",), (ForeignKey(("mentor_id",), "buyer", ("id",), name="mentor"),)),
    TableSpec("visit", (ColumnSpec("id", "bigint"), ColumnSpec("shop_id", "int", False), ColumnSpec("buyer_id", "bigint", False),
                        ColumnSpec("kind", "string", False, allowed=("in", "out"))), ("id",),
              (ForeignKey(("shop_id",), "shop", ("id",), name="visit_shop"), ForeignKey(("buyer_id",), "buyer", ("id",), name="visit_buyer")),
              (("shop_id", "buyer_id"),)),
    TableSpec("card", (ColumnSpec("id", uuid=True), ColumnSpec("buyer_id", "bigint", False)), ("id",),
              (ForeignKey(("buyer_id",), "buyer", ("id",), True, "card_buyer"),)),
)


def seed_and_check(spark: SparkSession, d: str) -> DataFrame:
    """A whole schema generated at the size of the provided tables, then checked against every rule."""
    counts = {n: table(spark, d, n).count() for n in ("supplier", "customer", "orders")}
    rows = {"shop": counts["supplier"], "buyer": counts["customer"], "visit": counts["orders"], "card": counts["customer"]}
    made = seed(spark, SEEDED, SeedOptions(
        rows=rows, table=GenerateOptions(SEED), deferred=True,
        rules={"visit": [RepetitionRule(5, {"kind": "out"})]},
    ))
    report = quality.integrity_report(made.tables, SEEDED, rows)
    return report.select("table_name", "kind", "constraint_name", "violations")


def _seed_sql() -> str:
    lines = []
    for s in SEEDED:
        for c in s.columns:
            lines += [(s.name, "not_null", c.name)] if not c.nullable else []
            lines += [(s.name, "range", c.name)] if c.min_value is not None else []
            lines += [(s.name, "allowed", c.name)] if c.allowed else []
        lines += [(s.name, "row_count", "*"), (s.name, "primary_key", ",".join(s.primary_key))]
        lines += [(s.name, "unique", ",".join(k)) for k in s.unique_keys]
        lines += [(s.name, "foreign_key", fk.name) for fk in s.foreign_keys]
    values = ", ".join(f"('{t}', '{k}', '{c}', 0::BIGINT)" for t, k, c in lines)
    return f"SELECT * FROM (VALUES {values}) v(table_name, kind, constraint_name, violations)"


QUERIES = {
    "check_orphans": (check_orphans, CHECK_ORPHANS),
    "check_unique": (check_unique, CHECK_UNIQUE),
    "check_range": (check_range, CHECK_RANGE),
    "check_combinations": (check_combinations, CHECK_COMBINATIONS),
    "check_text_bounds": (check_text_bounds, CHECK_TEXT_BOUNDS),
    "count_tables": (count_tables, COUNT_TABLES),
    "integrity_report": (integrity_report, _report_sql()),
    "reference_types": (reference_types, REFERENCE_TYPES),
    "repair_text": (repair_text, REPAIR_TEXT),
    "repair_clamp": (repair_clamp, REPAIR_CLAMP),
    "repair_redraw": (repair_redraw, REPAIR_REDRAW),
    "exclusion_impact": (exclusion_report, EXCLUSION_REPORT),
    "seed_and_check": (seed_and_check, _seed_sql()),
}
