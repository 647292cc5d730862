"""SQL script output: INSERT batches, deferred UPDATEs and the surrounding frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.literals import Dialect, literal
from rowloom.operators.indexing import dense_index


def _columns(df: DataFrame, columns: Sequence[str] | None, position: str | None) -> list[str]:
    return list(columns) if columns else [c for c in df.columns if c != position and not c.startswith("_")]


def row_values(df: DataFrame, columns: Sequence[str], dialect: Dialect, uuids: frozenset[str] = frozenset(),
               defaults: frozenset[str] = frozenset()) -> Column:
    """The comma-separated literals of one row. Columns in ``defaults`` print DEFAULT."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws(
        ", ", *[F.lit("DEFAULT") if c in defaults else literal(F.col(c), kinds[c], dialect, c in uuids) for c in columns]
    )


def insert_statements(
    df: DataFrame, table: str, dialect: Dialect, position: str, columns: Sequence[str] | None = None,
    uuids: frozenset[str] = frozenset(), defaults: frozenset[str] = frozenset(),
) -> DataFrame:
    """(batch, statement). ``position`` numbers the rows densely; a batch holds the dialect's row limit.

    Dialects with single-row statements need no shuffle at all. The others gather each batch,
    which is never larger than the limit.
    """
    names = _columns(df, columns, position)
    target = {"table": dialect.quote(table), "columns": ", ".join(dialect.quote(c) for c in names)}
    header, prefix = dialect.header.format(**target), dialect.row_prefix.format(**target)
    tuples = df.select(
        F.col(position).alias("pos"),
        F.concat(F.lit(prefix), row_values(df, names, dialect, uuids, defaults), F.lit(dialect.row_suffix)).alias("line"),
    )
    footer = F.lit(dialect.footer.format(**target))
    if not dialect.multi_row:
        return tuples.select(F.col("pos").alias("batch"), F.concat(F.lit(header), "line", footer).alias("statement"))
    batch = F.call_function("div", F.col("pos"), F.lit(dialect.batch_rows)).alias("batch")
    gathered = tuples.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    body = F.array_join(F.col("lines.line"), dialect.separator)
    return gathered.select("batch", F.concat(F.lit(header), body, footer).alias("statement"))


def update_statements(
    updates: DataFrame, table: str, primary_key: Sequence[str], dialect: Dialect, uuids: frozenset[str] = frozenset()
) -> DataFrame:
    """One UPDATE per pending foreign key; the columns that are not key columns are set."""
    kinds = {f.name: f.dataType for f in updates.schema.fields}

    def assignment(name: str) -> Column:
        return F.concat(F.lit(dialect.quote(name) + "="), literal(F.col(name), kinds[name], dialect, name in uuids))

    changed = [c for c in updates.columns if c not in primary_key]
    sets = F.concat_ws(", ", *[assignment(c) for c in changed])
    where = F.concat_ws(" AND ", *[assignment(c) for c in primary_key])
    text = F.concat(F.lit(f"UPDATE {dialect.quote(table)} SET "), sets, F.lit(" WHERE "), where, F.lit(";\n"))
    return updates.select(*primary_key, text.alias("statement"))


@dataclass(frozen=True)
class TableRows:
    """One table of a script: its rows, their dense position, and columns with special literals."""

    name: str
    df: DataFrame
    position: str
    uuids: frozenset[str] = frozenset()
    defaults: frozenset[str] = frozenset()


@dataclass(frozen=True)
class TableUpdates:
    name: str
    df: DataFrame
    primary_key: tuple[str, ...]
    uuids: frozenset[str] = frozenset()


def numbered(name: str, df: DataFrame, key: Sequence[str], **special) -> TableRows:
    """Number an existing table's rows by its key, for the script."""
    rows = dense_index(df, list(key))
    return TableRows(name, rows.df, rows.position, **special)


def script(
    spark: SparkSession, tables: Sequence[TableRows], updates: Sequence[TableUpdates], dialect: Dialect, deferred: bool
) -> DataFrame:
    """(section, part, line, statement): sort by the first three to read the script.

    Section 0 opens the frame, 1 holds the inserts in load order, 2 the updates, 3 closes it.
    The frame appears only when references are deferred; without rows and frame it is empty.
    """
    schema = "section int, part int, line string, statement string"
    frame = []
    if deferred:
        opening, closing = dialect.begin + dialect.disable, dialect.enable + dialect.commit
        frame = [(0, 0, "", opening)] if opening else []
        frame += [(3, 0, "", closing)] if closing else []
    parts = [spark.createDataFrame(frame, schema)]
    for number, table in enumerate(tables):
        made = insert_statements(table.df, table.name, dialect, table.position, uuids=table.uuids, defaults=table.defaults)
        # Batch numbers as text of fixed width keep their order.
        parts.append(made.select(F.lit(1).alias("section"), F.lit(number).alias("part"),
                                 F.lpad(F.col("batch").cast("string"), 19, "0").alias("line"), "statement"))
    for number, pending in enumerate(updates):
        made = update_statements(pending.df, pending.name, pending.primary_key, dialect, pending.uuids)
        order = F.concat_ws("|", *[F.lpad(F.col(c).cast("string"), 40, " ") for c in pending.primary_key])
        parts.append(made.select(F.lit(2).alias("section"), F.lit(number).alias("part"), order.alias("line"), "statement"))
    return reduce(DataFrame.unionByName, parts)


def write_script(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the script as text files whose names sort in script order; no single task holds it all."""
    ordered = lines.repartitionByRange("section", "part", "line").sortWithinPartitions("section", "part", "line")
    ordered.select(F.regexp_replace("statement", r"\n$", "").alias("value")).write.mode(mode).text(path)
