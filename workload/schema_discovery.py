"""Schema facts read back from the provided tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import discovery, quality
from rowloom.operators.generate import GenerateOptions
from rowloom.plans.discover import discover
from rowloom.plans.seeding import SeedOptions, seed
from rowloom.session import materialize, side_by_side
from rowloom.sources.tables import vocabulary
from workload.common import SEED, table
from workload.star import STAR, star_tables

# The provided schema's column kinds, for the SQL side.
KINDS = {
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "double", "c_mktsegment": "string"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "time", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
                 "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "time"},
    "events": {"event_id": "integer", "ts": "time", "user_id": "integer", "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"},
    "region": {"r_regionkey": "integer", "r_name": "string"},
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "double"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "double"},
    "embeddings": {"vec_id": "integer", "label": "integer"},
    "pages": {"page_id": "integer", "url": "string", "html": "string"},
    "benchmark": {"item_id": "integer", "text": "string"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "conversations": {"conv_id": "integer", "turn": "integer", "role": "string", "text": "string"},
}


def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    parts = [discovery.profile_columns(table(spark, d, n), n) for n in KINDS]
    shown = reduce(DataFrame.unionByName, parts)
    # Readers differ in how they name timestamp types.
    family = F.when(F.col("type_family").startswith("timestamp"), F.lit("time")).otherwise(F.col("type_family"))
    return shown.withColumn("type_family", family)


def _profile_sql() -> str:
    lines = []
    for t, columns in KINDS.items():
        for c, kind in columns.items():
            length = f"max(length({c}))" if kind == "string" else "NULL"
            scale = f"max(length(regexp_extract({c}::VARCHAR, '\\.(\\d*?)0*$', 1)))" if kind == "double" else "NULL"
            lines.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS type_family, count(*) AS n_rows,"
                f" count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct, {length}::INTEGER AS max_length,"
                f" {scale}::INTEGER AS max_scale, false AS is_uuid FROM {t}"
            )
    return "\nUNION ALL ".join(lines)


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All provided tables with their comparable columns."""
    return {n: table(spark, d, n).select(*columns) for n, columns in KINDS.items()}


def discover_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one or two columns of all provided tables, columns of every comparable type."""
    rows = []
    for name, df in _tables(spark, d).items():
        found = discovery.discover_keys(df)
        rows += [(name, "primary", ",".join(k)) for k in found.primary] + [(name, "unique", ",".join(k)) for k in found.unique]
    return spark.createDataFrame(rows, "table_name string, kind string, key_columns string")


def _keys_sql() -> str:
    lines = []
    for t, names in KINDS.items():
        names = list(names)
        for i, a in enumerate(names):
            key = f"(SELECT count(DISTINCT {a}) = count({a}) AND count({a}) > 0 FROM {t})"
            full = f"(SELECT count({a}) = count(*) FROM {t})"
            lines.append(f"SELECT '{t}' AS table_name, 'unique' AS kind, '{a}' AS key_columns WHERE {key}")
            lines.append(f"SELECT '{t}', 'primary', '{a}' WHERE {key} AND {full}")
            for b in names[i + 1:]:
                pair = f"(SELECT count(*) = 0 FROM (SELECT 1 FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b} HAVING count(*) > 1))"
                some = f"(SELECT count(*) > 0 FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
                alone = f"(SELECT (count(DISTINCT {a}) = count({a}) AND count({a}) > 0) OR (count(DISTINCT {b}) = count({b}) AND count({b}) > 0) FROM {t})"
                whole = f"(SELECT count(*) = 0 FROM {t} WHERE {a} IS NULL OR {b} IS NULL)"
                for kind, test in (("unique", "true"), ("primary", whole)):
                    lines.append(f"SELECT '{t}', '{kind}', '{a},{b}' WHERE {pair} AND {some} AND NOT {alone} AND {test}")
    return "\nUNION ALL ".join(lines)


WIDE = ("l_returnflag", "l_linenumber", "l_discount", "l_tax", "l_quantity", "n_lines")


def _wide_table(spark: SparkSession, d: str) -> DataFrame:
    """Order lines counted by five coarse columns: a key of five columns, unless fewer will do."""
    return table(spark, d, "lineitem").groupBy(*WIDE[:-1]).agg(F.count("*").alias("n_lines"))


def discover_wide_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of any width of a table that has no primary key of one or two columns."""
    keys = discovery.discover_keys(_wide_table(spark, d), len(WIDE))
    return spark.createDataFrame([(",".join(k), len(k)) for k in keys.primary], "key_columns string, width int")


def _wide_keys_sql() -> str:
    parts = []
    for width in range(1, len(WIDE) + 1):
        for columns in combinations(WIDE, width):
            names = ", ".join(columns)
            parts.append(f"SELECT '{','.join(columns)}' AS key_columns, {width}::INTEGER AS width WHERE (SELECT count(DISTINCT ({names})) = count(*) FROM w)")
    keys = "\nUNION ALL ".join(parts)
    grouped = ", ".join(WIDE[:-1])
    return f"WITH w AS (SELECT {grouped}, count(*) AS n_lines FROM lineitem GROUP BY {grouped}), k AS ({keys}) SELECT * FROM k WHERE width = (SELECT min(width) FROM k)"


# Single-column keys that columns may refer to.
PARENT_KEYS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"),
    "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey",), "orders": ("o_orderkey",), "documents": ("doc_id",), "events": ("event_id",),
    "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",),
}


def discover_references(spark: SparkSession, d: str) -> DataFrame:
    """Reference candidates among all comparable columns of all provided tables, with coverage and one-to-one flag."""
    return discovery.discover_references(_tables(spark, d), PARENT_KEYS).withColumn("coverage", F.round("coverage", 6))


def _references_sql() -> str:
    lines = []
    for child, columns in KINDS.items():
        for c, kind in columns.items():
            for parent, keys in PARENT_KEYS.items():
                for key in keys:
                    if (child, c) == (parent, key) or kind != KINDS[parent][key]:
                        continue
                    lines.append(
                        f"SELECT '{child}' AS child_table, '{c}' AS child_column, '{parent}' AS parent_table, '{key}' AS parent_column,"
                        f" round(count(DISTINCT {c}) / (SELECT count(DISTINCT {key}) FROM {parent}), 6) AS coverage,"
                        f" count(DISTINCT {c}) = count({c}) AS one_to_one FROM {child}"
                        f" HAVING count({c}) > 0 AND NOT EXISTS (SELECT 1 FROM {child} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{key} = x.{c}))"
                    )
    return "\nUNION ALL ".join(lines)


COMPOSITE_KEYS = {"lines": ("l_orderkey", "l_linenumber"), "turns": ("conv_id", "turn")}


def _composite_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two tables with keys of two columns, their children under other names, and all provided tables beside."""
    lines = table(spark, d, "lineitem").select(*COMPOSITE_KEYS["lines"]).distinct()
    turns = table(spark, d, "conversations").select(*COMPOSITE_KEYS["turns"]).distinct()
    half = lines.where("l_orderkey % 2 = 0").select(F.col("l_linenumber").alias("place"), F.col("l_orderkey").alias("bill"), (F.col("l_orderkey") % 7).cast("int").alias("shelf"))
    first = turns.where("turn < 2").select(F.col("turn").cast("smallint").alias("step"), F.col("conv_id").alias("talk"))
    return {"lines": lines, "turns": turns, "returns": half, "openings": first, **_tables(spark, d)}


def discover_composite_references(spark: SparkSession, d: str) -> DataFrame:
    """References to keys of two columns, found by values under any names, in all provided tables."""
    found = discovery.discover_composite_references(_composite_tables(spark, d), COMPOSITE_KEYS)
    return found.withColumn("coverage", F.round("coverage", 6))


def _composite_sql() -> str:
    made = {
        "lines": ("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem", ("l_orderkey", "l_linenumber")),
        "turns": ("SELECT DISTINCT conv_id, turn FROM conversations", ("conv_id", "turn")),
        "returns": ("SELECT l_linenumber AS place, l_orderkey AS bill, l_orderkey % 7 AS shelf FROM lines WHERE l_orderkey % 2 = 0", ("place", "bill", "shelf")),
        "openings": ("SELECT turn AS step, conv_id AS talk FROM turns WHERE turn < 2", ("step", "talk")),
    }
    own = {n: columns for n, (_, columns) in made.items()}
    own |= {t: tuple(c for c, kind in columns.items() if kind == "integer") for t, columns in KINDS.items()}
    parts = []
    for child, columns in own.items():
        for a, b in permutations(columns, 2):
            for parent, (k, m) in COMPOSITE_KEYS.items():
                if child != parent:
                    parts.append(
                        f"SELECT '{child}' AS child_table, '{a},{b}' AS child_columns, '{parent}' AS parent_table, '{k},{m}' AS parent_columns,"
                        f" round(count(DISTINCT ({a}, {b})) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) / (SELECT count(*) FROM {parent}), 6) AS coverage,"
                        f" count(DISTINCT ({a}, {b})) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) = count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS one_to_one FROM {child}"
                        f" HAVING count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) > 0 AND NOT EXISTS (SELECT 1 FROM {child} x WHERE x.{a} IS NOT NULL AND x.{b} IS NOT NULL"
                        f" AND NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{k} = x.{a} AND y.{m} = x.{b}))"
                    )
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, (q, _) in made.items()) + "\n" + "\nUNION ALL ".join(parts)


def column_domains(spark: SparkSession, d: str) -> DataFrame:
    """Value lists of all columns with at most 50 distinct values, but times, in all provided tables."""
    parts = []
    for name, df in _tables(spark, d).items():
        columns = [c for c, kind in KINDS[name].items() if kind != "time"]
        parts.append(discovery.column_domains(df, name, columns, 50))
    return reduce(DataFrame.unionByName, parts)


def _domains_sql() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM {t}"
        f" WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM {t}) <= 50 GROUP BY {c}"
        for t, columns in KINDS.items() for c, kind in columns.items() if kind != "time"
    )


def numeric_ranges(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [discovery.numeric_ranges(df, name) for name, df in _tables(spark, d).items()])


NUMERIC_RANGES = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value FROM {t}"
    for t, columns in KINDS.items() for c, kind in columns.items() if kind in ("integer", "double")
)


def describe_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of all provided tables put together: keys are required, limits of numbers and times and value lists beside them."""
    parts = [discovery.describe_columns(df, name, max_values=10) for name, df in _tables(spark, d).items()]
    family = F.when(F.col("type_family").startswith("timestamp"), F.lit("time")).otherwise(F.col("type_family"))
    return reduce(DataFrame.unionByName, parts).withColumn("type_family", family)


def _describe_sql() -> str:
    lines = []
    for t, columns in KINDS.items():
        for c, kind in columns.items():
            key = f"(count(DISTINCT {c}) = count(*) AND {str(kind in ('integer', 'string')).lower()})"
            number, moment = kind in ("integer", "double"), kind == "time"
            lines.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS type_family, {key} AS is_key,"
                f" NOT {key} AND count(*) > count({c}) AS nullable, false AS is_uuid,"
                f" {f'min({c})::DOUBLE' if number else 'NULL::DOUBLE'} AS min_value, {f'max({c})::DOUBLE' if number else 'NULL::DOUBLE'} AS max_value,"
                + "".join(f" {f'strftime({f}({c}), $$%Y-%m-%d %H:%M:%S.%f$$)' if moment else 'NULL::VARCHAR'} AS {n}," for f, n in (("min", "first"), ("max", "last")))
                + f" CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 10 THEN list_sort(list(DISTINCT {c}::VARCHAR) FILTER ({c} IS NOT NULL)) END AS allowed FROM {t}"
            )
    return "\nUNION ALL ".join(lines)


def document_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary(table(spark, d, "documents"), "text")


DOCUMENT_VOCABULARY = """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents)
WHERE word <> '' GROUP BY word
"""

def discover_specs(spark: SparkSession, d: str) -> DataFrame:
    """The specifications read from the star schema's tables, one row per column."""
    rows = []
    for s in discover(star_tables(spark, d)):
        for c in s.columns:
            fk = next((fk for fk in s.foreign_keys if c.name in fk.columns), None)
            refers = f"{fk.parent}.{fk.parent_columns[fk.columns.index(c.name)]}" if fk else None
            rows.append((s.name, c.name, c.nullable, c.length if c.is_text else None, refers))
    return spark.createDataFrame(rows, "table_name string, column_name string, nullable boolean, max_length int, refers string")


# Pairs whose names speak of each other, the child first.
NAMED = {
    ("nation", "n_regionkey"): ("region", "r_regionkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey"),
    ("supplier", "s_nationkey"): ("nation", "n_nationkey"), ("orders", "o_custkey"): ("customer", "c_custkey"),
    ("lineitem", "l_orderkey"): ("orders", "o_orderkey"), ("lineitem", "l_partkey"): ("part", "p_partkey"),
    ("lineitem", "l_suppkey"): ("supplier", "s_suppkey"), ("labels", "doc_id"): ("documents", "doc_id"),
}


def _specs_sql() -> str:
    lines = []
    for s in STAR:
        for c, kind in KINDS[s.name].items():
            parent, key = NAMED.get((s.name, c), (None, None))
            lost = f"(SELECT count(*) FROM {s.name} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM {parent}))"
            refers = f"CASE WHEN count({c}) > 0 AND {lost} = 0 THEN '{parent}.{key}' END" if parent else "NULL::VARCHAR"
            lines.append(
                f"SELECT '{s.name}' AS table_name, '{c}' AS column_name, count(*) > count({c}) OR count({c}) = 0 AS nullable,"
                f" {f'coalesce(max(length({c})), 0)' if kind == 'string' else 'NULL'}::INTEGER AS max_length, {refers} AS refers FROM {s.name}"
            )
    return "\nUNION ALL ".join(lines)


def discover_and_seed(spark: SparkSession, d: str) -> DataFrame:
    """The star schema's tables made anew from their own data: as many rows each, and no rule broken."""
    tables = star_tables(spark, d)
    specs = discover(tables)
    rows = {name: df.count() for name, df in tables.items()}
    made = seed(spark, specs, SeedOptions(rows=rows, table=GenerateOptions(SEED)))
    # The report reads a table once per kind of rule; its cells are made once.
    stored = side_by_side(spark, lambda s: materialize(made.tables[s.name].select(*[c.name for c in s.columns])), specs)
    report = quality.integrity_report({s.name: df for s, df in zip(specs, stored, strict=True)}, specs, rows)
    counted = F.max(F.when(F.col("kind") == "row_count", F.col("checked"))).alias("n_rows")
    return report.groupBy("table_name").agg(counted, F.sum("violations").alias("violations"))


DISCOVER_AND_SEED = "\nUNION ALL ".join(
    f"SELECT '{s.name}' AS table_name, count(*) AS n_rows, 0::BIGINT AS violations FROM {s.name}" for s in STAR
)

QUERIES = {
    "discover_specs": (discover_specs, _specs_sql()),
    "discover_and_seed": (discover_and_seed, DISCOVER_AND_SEED),
    "profile_columns": (profile_columns, _profile_sql()),
    "discover_keys": (discover_keys, _keys_sql()),
    "discover_references": (discover_references, _references_sql()),
    "discover_wide_keys": (discover_wide_keys, _wide_keys_sql()),
    "discover_composite_references": (discover_composite_references, _composite_sql()),
    "column_domains": (column_domains, _domains_sql()),
    "numeric_ranges": (numeric_ranges, NUMERIC_RANGES),
    "describe_columns": (describe_columns, _describe_sql()),
    "vocabulary": (document_vocabulary, DOCUMENT_VOCABULARY),
}
