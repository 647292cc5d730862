"""Readers for the tables, CHECK texts and word lists the operators work on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.checks import balanced

# Catalog queries for CHECK texts: schema, table, clause, for the schema put in as an SQL expression.
CHECK_QUERIES = {
    "postgresql": "SELECT connamespace::regnamespace::text, (SELECT relname FROM pg_catalog.pg_class WHERE oid = conrelid),"
    " pg_get_constraintdef(oid) FROM pg_catalog.pg_constraint"
    " WHERE contype = 'c' AND connamespace = (SELECT oid FROM pg_catalog.pg_namespace WHERE nspname = {schema})",
    "mysql": "SELECT constraint_schema, (SELECT table_name FROM information_schema.table_constraints AS t"
    " WHERE t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name AND t.constraint_type = 'CHECK'),"
    " check_clause FROM information_schema.check_constraints AS c WHERE constraint_schema = {schema}",
    # Here constraint names repeat between tables, and the view names the table itself.
    "mariadb": "SELECT constraint_schema, table_name, check_clause FROM information_schema.check_constraints"
    " WHERE constraint_schema = {schema}",
    "h2": "SELECT constraint_schema, (SELECT table_name FROM information_schema.table_constraints AS t"
    " WHERE t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name),"
    " check_clause FROM information_schema.check_constraints AS c WHERE constraint_schema = {schema}",
}
CHECK_QUERIES["cockroachdb"] = CHECK_QUERIES["postgresql"]
# The connection's own schema, where none is named.
OWN_SCHEMA = {"postgresql": "current_schema()", "cockroachdb": "current_schema()", "mysql": "database()", "mariadb": "database()",
              "h2": "current_schema"}


def load_tables(spark: SparkSession, path: str, names: Sequence[str], fmt: str = "parquet", suffix: str = "") -> dict[str, DataFrame]:
    """One DataFrame per table stored under ``path``; nothing is read yet."""
    return {n: spark.read.format(fmt).load(f"{path.rstrip('/')}/{n}{suffix}") for n in names}


def load_catalog_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """All base tables of a catalog database."""
    return {
        t.name: spark.table(f"{database}.{t.name}")
        for t in spark.catalog.listTables(database)
        if t.tableType != "VIEW" and not t.isTemporary
    }


def load_jdbc_tables(spark: SparkSession, url: str, names: Sequence[str], properties: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables over JDBC. For a large table pass partitionColumn, lowerBound, upperBound and numPartitions."""
    return {
        n: spark.read.format("jdbc").options(url=url, dbtable=n, **(properties or {})).load() for n in names
    }


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns); parquet answers the count from its footers."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(n).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _bodies(text: Column) -> Column:
    """What stands in the parentheses of each CHECK of a text; those that never close are left out."""
    behind = F.slice(F.split(text, r"(?i)\bCHECK\s*(?=\()", -1), 2, 1 << 30)
    return F.filter(F.transform(behind, balanced), lambda body: body.isNotNull())


def strip_check_wrapper(checks: DataFrame, quote: str = "", wrapped: bool = True) -> DataFrame:
    """Catalog clauses ``(schema_name, table_name, clause)`` as ``(schema_name, table_name, expr)``.

    The CHECK wrapper and the dialect's identifier quotes are removed; blank clauses are dropped.
    """
    clause = F.col("clause")
    if wrapped:
        clause = F.coalesce(F.get(_bodies(clause), F.lit(0)), clause)
    if quote:
        clause = F.replace(clause, F.lit(quote), F.lit(""))
    return checks.where(F.length(F.trim("clause")) > 0).select("schema_name", "table_name", clause.alias("expr"))


def load_checks(
    spark: SparkSession, url: str, dialect: str, schema: str | None = None, properties: Mapping[str, str] | None = None
) -> DataFrame:
    """CHECK texts from a database catalog, through the JDBC source; without a schema, those of the connection's own."""
    named = OWN_SCHEMA[dialect]
    if schema is not None:
        named = "'" + (schema.upper() if dialect == "h2" else schema).replace("'", "''") + "'"
    query = CHECK_QUERIES[dialect].format(schema=named)
    found = spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load().toDF(
        "schema_name", "table_name", "clause"
    )
    quote = "`" if dialect in ("mysql", "mariadb") else ""
    return strip_check_wrapper(found, quote, wrapped=dialect in ("postgresql", "cockroachdb"))


def checks_from_remarks(remarks: DataFrame) -> DataFrame:
    """CHECK texts embedded in comments: ``(table_name, remark)`` to ``(table_name, expr)``, one row per CHECK."""
    return remarks.select("table_name", F.explode(_bodies(F.col("remark"))).alias("expr"))


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over all whitespace-separated words of a text column."""
    words = texts.select(F.explode(F.split(F.col(column), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def word_list(words: DataFrame, limit: int) -> tuple[str, ...]:
    """A vocabulary small enough to travel in a plan, in order; larger ones are joined by index."""
    found = words.select("word").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} words; use enrichment.attach_phrases")
    return tuple(sorted(r["word"] for r in found))
