"""Dependency graphs derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import graph
from rowloom.operators.indexing import dense_index
from workload.common import table


def _order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each customer (as a negative number) precedes its orders, and each order the customer's next one."""
    orders = dense_index(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])
    # Neighbours in the dense order, so that a busy customer needs no window of its own.
    following = orders.df.select((F.col(orders.position) - 1).alias(orders.position), F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("dst"))
    steps = orders.df.join(following, orders.position).where("o_custkey = c").select(F.col("o_orderkey").alias("src"), "dst")
    owners = orders.df.select((-F.col("o_custkey") - 1).alias("src"), F.col("o_orderkey").alias("dst"))
    return steps.unionByName(owners)


def graph_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.load_levels(_order_edges(spark, d)).select("node", "level")


GRAPH_LEVELS = """
SELECT o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS level FROM orders
UNION ALL SELECT DISTINCT -o_custkey - 1, 0 FROM orders
"""


def _customer_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers by position: rings of three, every ring leading to the next within groups of 30; every 50th refers to itself."""
    customers = dense_index(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "pos")
    p, n = F.col("pos"), customers.count
    steps = F.array(
        F.when((p % 3 != 2) & (p + 1 < n), p + 1),
        F.when((p % 3 == 2) | (p + 1 == n), p - p % 3),
        F.when((p % 3 == 0) & (p % 30 != 27) & (p + 3 < n), p + 3),
        F.when(p % 50 == 0, p),
    )
    return customers.df.select(p.alias("src"), F.explode(steps).alias("dst")).where("dst is not null").distinct()


_CUSTOMER_EDGES = """
p AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
e AS (SELECT DISTINCT pos AS src, dst FROM (
  SELECT pos, pos + 1 AS dst FROM p WHERE pos % 3 <> 2 AND pos + 1 < n
  UNION ALL SELECT pos, pos - pos % 3 FROM p WHERE pos % 3 = 2 OR pos + 1 = n
  UNION ALL SELECT pos, pos + 3 FROM p WHERE pos % 3 = 0 AND pos % 30 <> 27 AND pos + 3 < n
  UNION ALL SELECT pos, pos FROM p WHERE pos % 50 = 0)),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
ids AS (SELECT pos AS node, least(pos, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.src = p.pos AND b.src = a.dst AND b.dst = p.pos), pos)) AS component FROM p)
"""


def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_groups(_customer_edges(spark, d))


GRAPH_CYCLES = f"""
WITH RECURSIVE {_CUSTOMER_EDGES}
SELECT component, node FROM ids WHERE (SELECT count(*) FROM ids i WHERE i.component = ids.component) > 1
  OR node IN (SELECT src FROM e WHERE src = dst)
"""


def graph_condensed_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.load_levels(_customer_edges(spark, d))


GRAPH_CONDENSED_LEVELS = f"""
WITH RECURSIVE {_CUSTOMER_EDGES},
ce AS (SELECT DISTINCT a.component AS s, b.component AS t FROM e JOIN ids a ON a.node = e.src JOIN ids b ON b.node = e.dst WHERE a.component <> b.component),
lv AS (SELECT DISTINCT component AS c, 0 AS level FROM ids UNION SELECT ce.t, lv.level + 1 FROM lv JOIN ce ON ce.s = lv.c)
SELECT node, component, (SELECT max(level) FROM lv WHERE c = component)::BIGINT AS level FROM ids
"""


def graph_deferral(spark: SparkSession, d: str) -> DataFrame:
    """Whether a ring holds a reference from a customer whose column may not be null (every seventh position)."""
    edges = _customer_edges(spark, d)
    fks = edges.select(F.col("dst").alias("table_name"), F.lit("ref").alias("column_name"), F.col("src").alias("parent"))
    columns = edges.select(F.col("dst").alias("table_name")).distinct().select(
        "table_name", F.lit("ref").alias("column_name"), (F.col("table_name") % 7 != 0).alias("nullable")
    )
    return graph.deferral_needed(graph.cycle_groups(edges), fks, columns)


GRAPH_DEFERRAL = f"""
WITH RECURSIVE {_CUSTOMER_EDGES},
g AS (SELECT component, node FROM ids WHERE (SELECT count(*) FROM ids i WHERE i.component = ids.component) > 1
  OR node IN (SELECT src FROM e WHERE src = dst))
SELECT a.component, bool_or(a.node % 7 = 0) AS deferred FROM e JOIN g a ON a.node = e.dst JOIN g b ON b.node = e.src
WHERE a.component = b.component GROUP BY a.component
"""


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """References among parts of a brand; those to parts outside the listed tables are ignored."""
    parts = table(spark, d, "part")
    fks = parts.select(F.col("p_brand").alias("table_name"), F.lit("c").alias("column_name"), F.col("p_type").alias("parent"))
    listed = parts.select(F.col("p_type").alias("table_name")).where("table_name not like 'S%'").distinct()
    return graph.reference_edges(fks, listed)


GRAPH_EDGES = "SELECT DISTINCT p_type AS src, p_brand AS dst FROM part WHERE p_type NOT LIKE 'S%'"

QUERIES = {
    "graph_edges": (graph_edges, GRAPH_EDGES),
    "graph_levels": (graph_levels, GRAPH_LEVELS),
    "graph_cycles": (graph_cycles, GRAPH_CYCLES),
    "graph_condensed_levels": (graph_condensed_levels, GRAPH_CONDENSED_LEVELS),
    "graph_deferral": (graph_deferral, GRAPH_DEFERRAL),
}
