"""The provided tables described as a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.model import ColumnSpec as C
from rowloom.model import CombinationRule, ForeignKey, TableSpec
from workload.common import table


def _fk(columns: str, parent: str, keys: str) -> ForeignKey:
    return ForeignKey((columns,), parent, (keys,), name=f"{columns}_{parent}")


STAR = (
    TableSpec("region", (C("r_regionkey", "int"), C("r_name", "string", False)), ("r_regionkey",), unique_keys=(("r_name",),)),
    TableSpec("nation", (C("n_nationkey", "int"), C("n_name"), C("n_regionkey", "int", False)), ("n_nationkey",),
              (_fk("n_regionkey", "region", "r_regionkey"),)),
    TableSpec("customer", (C("c_custkey", "bigint"), C("c_name"), C("c_nationkey", "int", False),
                           C("c_acctbal", "double", min_value=0, max_value=5000),
                           C("c_mktsegment", allowed=("BUILDING", "MACHINERY", "HOUSEHOLD"))), ("c_custkey",),
              (_fk("c_nationkey", "nation", "n_nationkey"),), (("c_name",),)),
    TableSpec("supplier", (C("s_suppkey", "bigint"), C("s_name"), C("s_nationkey", "int", False), C("s_acctbal", "double")),
              ("s_suppkey",), (_fk("s_nationkey", "nation", "n_nationkey"),), (("s_name",),)),
    TableSpec("part", (C("p_partkey", "bigint"), C("p_name"), C("p_brand"), C("p_type"),
                       C("p_size", "int", min_value=1, max_value=40), C("p_retailprice", "double")), ("p_partkey",),
              unique_keys=(("p_name", "p_brand"),)),
    TableSpec("orders", (C("o_orderkey", "bigint"), C("o_custkey", "bigint", False), C("o_orderstatus", allowed=("O", "F")),
                         C("o_totalprice", "double", min_value=1000), C("o_orderdate", "timestamp"), C("o_orderpriority")),
              ("o_orderkey",), (_fk("o_custkey", "customer", "c_custkey"),)),
    TableSpec("lineitem", (C("l_orderkey", "bigint", False), C("l_partkey", "bigint", False), C("l_suppkey", "bigint", False),
                           C("l_linenumber", "int"), C("l_quantity", "double", min_value=5, max_value=45),
                           C("l_extendedprice", "double"), C("l_discount", "double", max_value=0.05), C("l_tax", "double"),
                           C("l_returnflag"), C("l_linestatus"), C("l_shipdate", "timestamp")), ("l_orderkey", "l_linenumber"),
              (_fk("l_orderkey", "orders", "o_orderkey"), _fk("l_partkey", "part", "p_partkey"),
               _fk("l_suppkey", "supplier", "s_suppkey")),
              combinations=(CombinationRule(("l_returnflag", "l_linestatus"), (("A", "F"), ("N", "O"), ("R", "F"))),)),
    TableSpec("events", (C("event_id", "bigint"), C("ts", "timestamp"), C("user_id", "bigint"), C("event_type"),
                         C("value", "double"), C("props")), ("event_id",), (_fk("user_id", "customer", "c_custkey"),)),
    TableSpec("documents", (C("doc_id", "bigint"), C("text"), C("lang"), C("source"), C("n_chars", "bigint")), ("doc_id",)),
    TableSpec("labels", (C("doc_id", "bigint", False), C("quality", "int"), C("toxic", "int")), ("doc_id",),
              (_fk("doc_id", "documents", "doc_id"),)),
)
SPECS = {s.name: s for s in STAR}


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {s.name: table(spark, sf_dir, s.name) for s in STAR}
