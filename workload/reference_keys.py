"""Foreign-key assignment over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws, permute
from rowloom.operators import references as ref
from rowloom.operators.indexing import dense_index
from workload.common import SEED, draw, step, table

DRAWS = Draws(SEED, "refs")


def fk_random(spark: SparkSession, d: str) -> DataFrame:
    """Every event gets a random customer."""
    events = table(spark, d, "events").select("event_id", "event_type")
    parent = ref.parent_of(table(spark, d, "customer"), ["c_custkey"])
    return ref.assign_random(events, parent, {"customer_id": "c_custkey"}, DRAWS, "event_id", "fk_customer", nullable=False)


FK_RANDOM = f"""
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT event_id, event_type, c_custkey AS customer_id FROM events
JOIN p ON p.pos = {draw('refs', 'fk_customer', 'event_id')} % (SELECT count(*) FROM customer)
"""


def fk_composite(spark: SparkSession, d: str) -> DataFrame:
    """Both columns of a composite key come from the same parent row."""
    parent = ref.parent_of(
        table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"]
    )
    orders = table(spark, d, "orders").select("o_orderkey")
    return ref.assign_random(
        orders, parent, {"ref_order": "l_orderkey", "ref_line": "l_linenumber"}, DRAWS, "o_orderkey", "fk_line"
    )


FK_COMPOSITE = f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos, count(*) OVER () AS n
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT o_orderkey, l_orderkey AS ref_order, l_linenumber AS ref_line
FROM orders JOIN p ON p.pos = {draw('refs', 'fk_line', 'o_orderkey')} % p.n
"""


def fk_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers each get a part of their own; parts run out of suppliers and end with null."""
    suppliers = dense_index(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], "pos")
    parts = dense_index(table(spark, d, "part").select("p_partkey"), ["p_partkey"], "pos")
    up = ref.assign_one_to_one(
        suppliers.df, suppliers.count, ref.Parent(parts, ("p_partkey",)), {"target": "p_partkey"}, "pos", "fk_part", shift=SEED
    )
    down = ref.assign_one_to_one(
        parts.df, parts.count, ref.Parent(suppliers, ("s_suppkey",)), {"target": "s_suppkey"}, "pos", "fk_supplier", shift=SEED
    )
    return up.select(F.lit("supplier").alias("child"), F.col("s_suppkey").alias("id"), "target").unionByName(
        down.select(F.lit("part").alias("child"), F.col("p_partkey").alias("id"), "target")
    )


FK_ONE_TO_ONE = f"""
WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier),
p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
n AS (SELECT ns, np, {step('ns')} AS sts, {step('np')} AS stp FROM
  (SELECT (SELECT count(*) FROM supplier) AS ns, (SELECT count(*) FROM part) AS np))
SELECT 'supplier' AS child, s_suppkey AS id, p_partkey AS target FROM n, s
  LEFT JOIN p ON s.pos < (SELECT np FROM n) AND p.pos = (s.pos * (SELECT stp FROM n) + {SEED}) % (SELECT np FROM n)
UNION ALL
SELECT 'part', p_partkey, s_suppkey FROM n, p
  LEFT JOIN s ON p.pos < (SELECT ns FROM n) AND s.pos = (p.pos * (SELECT sts FROM n) + {SEED}) % (SELECT ns FROM n)
"""


def fk_unique_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every order gets a (part, supplier) pair of its own."""
    parts = ref.parent_of(table(spark, d, "part"), ["p_partkey"])
    suppliers = ref.parent_of(table(spark, d, "supplier"), ["s_suppkey"])
    orders = dense_index(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "pos")
    pairs = ref.assign_combinations(
        orders.df, [(parts, {"part_id": "p_partkey"}), (suppliers, {"supplier_id": "s_suppkey"})], "pos", SEED
    )
    return pairs.select("o_orderkey", "part_id", "supplier_id")


FK_UNIQUE_PAIRS = f"""
WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS spos FROM supplier),
p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ppos FROM part),
n AS (SELECT ns, np, {step('(ns * np)')} AS st FROM
  (SELECT (SELECT count(*) FROM supplier) AS ns, (SELECT count(*) FROM part) AS np)),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
c AS (SELECT o_orderkey, np, CASE WHEN pos < ns * np THEN (pos * st + {SEED}) % (ns * np) END AS code FROM o, n)
SELECT o_orderkey, p_partkey AS part_id, s_suppkey AS supplier_id FROM c
LEFT JOIN p ON ppos = code % np LEFT JOIN s ON spos = code // np
"""


def fk_shared_column(spark: SparkSession, d: str) -> DataFrame:
    """An event keeps its user and gets an order of that same user; none when the user never ordered."""
    events = table(spark, d, "events").select("event_id", "user_id")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return ref.assign_matching(
        events, orders, {"user_id": "o_custkey"}, {"order_id": "o_orderkey"}, DRAWS, "event_id", "fk_order"
    )


FK_SHARED_COLUMN = f"""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT event_id, user_id, o_orderkey AS order_id FROM events
LEFT JOIN o ON o_custkey = user_id AND pos = {draw('refs', 'fk_order', 'event_id')} % n
"""


def fk_self_chain_close(spark: SparkSession, d: str) -> DataFrame:
    """Customers refer to the next one in blocks of three; the last refers to the block's first."""
    customers = table(spark, d, "customer").select("c_custkey")
    return ref.assign_chain(customers, "c_custkey", "next_custkey", 3)


def fk_self_chain_null(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey")
    return ref.assign_chain(customers, "c_custkey", "next_custkey", 4, ref.NULL_FK)


def _chain(depth: int, closing: str) -> str:
    return f"""
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT a.c_custkey, coalesce(b.c_custkey, {closing}) AS next_custkey FROM p a
LEFT JOIN p b ON b.pos = a.pos + 1 AND b.pos // {depth} = a.pos // {depth}
LEFT JOIN p c ON c.pos = a.pos - a.pos % {depth}
"""


def fk_chain_positions(spark: SparkSession, d: str) -> DataFrame:
    """The same chains by arithmetic on positions, for generated rows: no window and no shuffle."""
    indexed = dense_index(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "pos")
    pos = F.col("pos")
    return indexed.df.select(
        "pos",
        ref.chain_position(pos, indexed.count, 3).alias("closed"),
        ref.chain_position(pos, indexed.count, 4, ref.NULL_FK).alias("open"),
    )


FK_CHAIN_POSITIONS = """
WITH p AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer)
SELECT pos, CASE WHEN pos % 3 = 2 OR pos = n - 1 THEN pos - pos % 3 ELSE pos + 1 END AS closed,
  CASE WHEN pos % 4 = 3 OR pos = n - 1 THEN NULL ELSE pos + 1 END AS open FROM p
"""


def fk_generated_parent(spark: SparkSession, d: str) -> DataFrame:
    """Orders refer to generated parents, one per customer; the parent's key is computed, not joined."""
    parents = table(spark, d, "customer").count()
    orders = table(spark, d, "orders").select("o_orderkey")
    place = ref.random_position(DRAWS, "fk_generated", F.col("o_orderkey"), parents)
    key = ref.generated_key(lambda p: permute(p, parents, SEED) + 1, place)
    return orders.select("o_orderkey", key.alias("parent_id"))


FK_GENERATED_PARENT = f"""
WITH n AS (SELECT n, {step('n')} AS st FROM (SELECT count(*) AS n FROM customer))
SELECT o_orderkey, ({draw('refs', 'fk_generated', 'o_orderkey')} % n * st + {SEED}) % n + 1 AS parent_id FROM orders, n
"""


def fk_empty_parent(spark: SparkSession, d: str) -> DataFrame:
    """No parent rows: a nullable key is null everywhere."""
    events = table(spark, d, "events").select("event_id")
    nobody = table(spark, d, "customer").where("c_custkey < 0")
    parent = ref.parent_of(nobody, ["c_custkey"])
    return ref.assign_random(events, parent, {"customer_id": "c_custkey"}, DRAWS, "event_id", "fk_nobody")


def fk_agreeing(spark: SparkSession, d: str) -> DataFrame:
    """Every order gets a customer and a supplier of one nation: two keys that share the nation column."""
    orders = table(spark, d, "orders").select("o_orderkey")
    parents = [
        ("fk_of_customer", table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"))),
        ("fk_of_supplier", table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"))),
    ]
    return ref.assign_shared(orders, parents, DRAWS, "o_orderkey").rows.select("o_orderkey", "nation", "customer", "supplier")


FK_AGREEING = f"""
WITH c AS (SELECT c_nationkey AS nation, c_custkey AS customer, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS pos,
    count(*) OVER () AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)),
s AS (SELECT s_nationkey AS nation, s_suppkey AS supplier, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos,
    count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT o_orderkey, c.nation, customer, supplier FROM orders
JOIN c ON c.pos = {draw('refs', 'fk_of_customer', 'o_orderkey')} % c.n
JOIN s ON s.nation = c.nation AND s.pos = {draw('refs', 'fk_of_supplier', 'o_orderkey')} % s.n
"""


def fk_agreeing_tuples(spark: SparkSession, d: str) -> DataFrame:
    """As many different (customer, supplier) pairs of one nation as there are parts, a nation's share by its number of pairs."""
    customer = ref.parent_of(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"])
    supplier = ref.parent_of(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey", "s_suppkey"])
    parts = dense_index(table(spark, d, "part").select("p_partkey"), ["p_partkey"], "pos").df
    pairs = [(customer, {"nation": "c_nationkey", "customer": "c_custkey"}), (supplier, {"nation": "s_nationkey", "supplier": "s_suppkey"})]
    return ref.assign_combinations(parts, pairs, "pos").select("pos", "p_partkey", "nation", "customer", "supplier")


FK_AGREEING_TUPLES = """
WITH c AS (SELECT c_nationkey AS nation, c_custkey AS customer, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer),
s AS (SELECT s_nationkey AS nation, s_suppkey AS supplier, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier),
cn AS (SELECT nation, count(*) AS n1 FROM c GROUP BY nation), sn AS (SELECT nation, count(*) AS n2 FROM s GROUP BY nation),
g AS (SELECT nation, n1, n2, n1 * n2 AS pairs, coalesce(sum(n1 * n2) OVER (ORDER BY nation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM cn JOIN sn USING (nation)),
t AS (SELECT sum(pairs)::BIGINT AS total, least(sum(pairs)::BIGINT, (SELECT count(*) FROM part)) AS taken FROM g),
a AS (SELECT *, before * taken // total AS first, (before + pairs) * taken // total - before * taken // total AS own FROM g, t),
k AS (SELECT *, unnest(range(0, own)) AS code FROM a),
m AS (SELECT first + code AS pos, nation, (code * pairs // own) % n1 AS p1, (code * pairs // own) // n1 % n2 AS p2 FROM k),
p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey FROM part)
SELECT p.pos, p_partkey, m.nation, customer, supplier FROM p LEFT JOIN m ON m.pos = p.pos
LEFT JOIN c ON c.nation = m.nation AND c.pos = m.p1 LEFT JOIN s ON s.nation = m.nation AND s.pos = m.p2
"""


def _deferred(spark: SparkSession, d: str) -> ref.Deferred:
    chained = ref.assign_chain(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "next_custkey", 3, ref.NULL_FK)
    return ref.defer(chained, ["c_custkey"], ["next_custkey"])


def fk_deferred_updates(spark: SparkSession, d: str) -> DataFrame:
    return _deferred(spark, d).updates


def fk_deferred_inserts(spark: SparkSession, d: str) -> DataFrame:
    return _deferred(spark, d).inserts


def fk_deferred_apply(spark: SparkSession, d: str) -> DataFrame:
    parts = _deferred(spark, d)
    return ref.apply_updates(parts.inserts, parts.updates, ["c_custkey"])


_DEFERRED = f"""
WITH x AS ({_chain(3, 'NULL')}) SELECT x.c_custkey, c_name, next_custkey FROM x JOIN customer c ON c.c_custkey = x.c_custkey
"""

QUERIES = {
    "fk_random": (fk_random, FK_RANDOM),
    "fk_composite": (fk_composite, FK_COMPOSITE),
    "fk_one_to_one": (fk_one_to_one, FK_ONE_TO_ONE),
    "fk_unique_pairs": (fk_unique_pairs, FK_UNIQUE_PAIRS),
    "fk_shared_column": (fk_shared_column, FK_SHARED_COLUMN),
    "fk_self_chain_close": (fk_self_chain_close, _chain(3, "c.c_custkey")),
    "fk_self_chain_null": (fk_self_chain_null, _chain(4, "NULL")),
    "fk_chain_positions": (fk_chain_positions, FK_CHAIN_POSITIONS),
    "fk_generated_parent": (fk_generated_parent, FK_GENERATED_PARENT),
    "fk_empty_parent": (fk_empty_parent, "SELECT event_id, NULL::BIGINT AS customer_id FROM events"),
    "fk_agreeing": (fk_agreeing, FK_AGREEING),
    "fk_agreeing_tuples": (fk_agreeing_tuples, FK_AGREEING_TUPLES),
    "fk_deferred_inserts": (fk_deferred_inserts, "SELECT c_custkey, c_name, NULL::BIGINT AS next_custkey FROM customer"),
    "fk_deferred_updates": (
        fk_deferred_updates, f"SELECT * FROM ({_chain(3, 'NULL')}) WHERE next_custkey IS NOT NULL"
    ),
    "fk_deferred_apply": (fk_deferred_apply, _DEFERRED),
}
