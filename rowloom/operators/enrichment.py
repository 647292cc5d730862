"""Text supplied from outside: provider batches, duplicate handling, and line rebuilding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from rowloom.functions.cleaning import clean_model_text, provided_value
from rowloom.functions.keyed import Draws
from rowloom.model import ColumnSpec, RepetitionRule, TableSpec
from rowloom.operators.generate import POSITION, RULE
from rowloom.operators.joins import lookup
from rowloom.operators.phrases import attach_phrases  # noqa: F401
from rowloom.operators.uniqueness import first_per_key
from rowloom.session import checkpointed, materialize

# Values asked for at once, and failed or empty answers accepted per batch.
BATCH, TRIES = 50, 3
# provider(table, column, type, words, count) -> texts
Provider = Callable[[str, str, str, int, int], Sequence[str]]


def enrichable_columns(
    spec: TableSpec, wanted: Sequence[str], excluded: frozenset[str] = frozenset(), rules: Sequence[RepetitionRule] = ()
) -> list[ColumnSpec]:
    """The wanted columns that exist and are not excluded, set by a rule, or foreign keys."""
    ruled = {name for rule in rules for name in (*rule.fixed, *rule.constant, *rule.patterns)}
    found = [spec.column(n) for n in wanted if spec.has_column(n)]
    return [c for c in found if c.name not in excluded and c.name not in ruled and c.name not in spec.fk_columns]


def _ask(provider: Provider, table: str, column: str, kind: str, words: int, count: int) -> tuple[list[str], int]:
    """Distinct texts for one batch, and how often the provider raised. A round that brings nothing new is a failed try."""
    seen: dict[str, None] = {}
    tries = errors = 0
    while len(seen) < count and tries < TRIES:
        before = len(seen)
        try:
            for text in provider(table, column, kind, words, count - len(seen)):
                seen.setdefault(text)
        except Exception:  # a provider may fail in any way; the row then keeps its generated value
            errors += 1
        if len(seen) == before:
            tries += 1
    return list(seen)[:count], errors


def provided_texts(
    df: DataFrame, provider: Provider, table: str, column: ColumnSpec, words: int = 3, name: str = "_provided"
) -> DataFrame:
    """Add the provider's texts, asked for in batches of 50 within each partition; null where it gave too few.

    ``_errors`` counts the exceptions of a batch on its first row and is 0 on the others, so sums are right. Only the position column goes to Python. The result is written out, since asking a
    provider again would give other texts.
    """
    kind, label = column.type, column.name

    @F.pandas_udf("text string, errors bigint")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for positions in batches:
            out: list[str | None] = []
            failed: list[int] = []
            for start in range(0, len(positions), BATCH):
                count = min(BATCH, len(positions) - start)
                texts, errors = _ask(provider, table, label, kind, words, count)
                out.extend(texts + [None] * (count - len(texts)))
                failed.extend([errors] + [0] * (count - 1))
            yield pd.DataFrame({"text": pd.Series(out, dtype=object), "errors": pd.Series(failed, dtype="int64")})

    asked = df.withColumn("_answer", ask(F.col(POSITION)))
    return materialize(asked.select(*df.columns, F.col("_answer.text").alias(name), F.col("_answer.errors").alias("_errors")))


def enrich(
    df: DataFrame, spec: TableSpec, column: ColumnSpec, provider: Provider, words: int = 3, unique: bool = False,
    errors: str | None = None,
) -> DataFrame:
    """Replace a generated text column by provided texts; what is missing keeps the generated value.

    With ``errors`` a column of that name keeps the provider's exceptions, one count a batch, to be summed up.

    Rows whose value a rule pinned are left alone. For a unique column a text is used by the
    first row that got it, and only when no row keeps it as its generated value.
    """
    given = provided_texts(df, provider, spec.name, column, words)
    value = provided_value(F.col("_provided"), column)
    # A row whose value a rule pinned takes no text, nor keeps one from another row.
    free = F.col(RULE).isNull() if _is_ruled(df) else F.lit(True)
    given = given.withColumn("_value", F.when(free, value))
    if unique:
        held = given.select(F.col(column.name).alias("_value")).distinct()
        fresh = given.where("_value is not null").select(POSITION, "_value").join(held, "_value", "left_anti")
        winners = first_per_key(fresh, ["_value"], POSITION)
        given = given.drop("_value").join(winners, POSITION, "left")
    made = given.withColumn(column.name, F.coalesce("_value", F.col(column.name))).drop("_provided", "_value")
    return made.withColumnRenamed("_errors", errors) if errors else made.drop("_errors")


def _is_ruled(df: DataFrame) -> bool:
    return RULE in df.columns


def first_occurrences(values: DataFrame, group: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct values per group, each with the order number of its first occurrence."""
    return values.groupBy(*group, value).agg(F.min(order).alias(order))


def response_chunk(line: Column) -> Column:
    """The text chunk of one NDJSON line: ``response``, or ``message.content``; null when malformed."""
    parsed = F.from_json(line, "response string, message struct<content: string>")
    return F.coalesce(parsed["response"], parsed["message"]["content"])


def rebuild_lines(chunks: DataFrame, request: str = "request_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """(request, line_no, text): whole lines put together from token chunks.

    A chunk's line number is the count of line breaks before it within its request: a prefix
    sum over the rows in (request, seq) order. It is made from one total per partition and a
    running sum inside each, so a request of any size spreads over many tasks.
    """
    chunk = response_chunk(F.col(line))
    parsed = chunks.select(F.col(request).alias("request"), F.col(seq).alias("seq"), chunk.alias("chunk")).where("chunk is not null")
    breaks = F.length("chunk") - F.length(F.translate("chunk", "\n", ""))
    # Range partitioning reads its input twice, so the parsed chunks are written once first.
    parsed = materialize(parsed.withColumn("breaks", breaks.cast("bigint")))
    ordered = checkpointed(parsed.repartitionByRange("request", "seq").sortWithinPartitions("request", "seq"))
    pieces = _running_breaks(ordered).select("request", "seq", "before", F.posexplode(F.split("chunk", "\n", -1)).alias("i", "piece"))
    # Lines are put together under their number over all requests, so only lines, not chunks, meet their request's first.
    placed = pieces.select("request", (F.col("before") + F.col("i")).alias("line"), "seq", "piece")
    parts = placed.groupBy("request", "line").agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("parts"))
    whole = materialize(parts.select("request", "line", F.array_join(F.col("parts.piece"), "").alias("text")))
    starts = whole.groupBy("request").agg(F.min("line").alias("start"))
    return lookup(whole, starts, ["request"]).select("request", (F.col("line") - F.col("start")).alias("line_no"), "text")


def _running_breaks(ordered: DataFrame) -> DataFrame:
    """Line breaks before each row, over the whole order. Only the counts go to Python."""
    part = F.spark_partition_id()
    totals = {r["part"]: r["n"] for r in ordered.groupBy(part.alias("part")).agg(F.sum("breaks").alias("n")).collect()}
    offsets, running = [], 0
    for p in range(max(totals, default=-1) + 1):
        offsets.append(running)
        running += totals.get(p, 0)

    @F.pandas_udf(LongType())
    def before(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        total = 0
        for counts in batches:
            sums = counts.cumsum() + total
            yield sums - counts
            total = int(sums.iloc[-1]) if len(counts) else total

    start = F.element_at(F.lit(offsets or [0]), part + 1).cast("bigint")
    inside = ordered.select("request", "seq", "chunk", start.alias("start"), before("breaks").alias("inside"))
    return inside.select("request", "seq", "chunk", (F.col("start") + F.col("inside")).alias("before"))


def model_values(lines: DataFrame, column_name: str | None = None) -> DataFrame:
    """(request, line_no, value): cleaned lines, blanks and chatter dropped, each value at its first line."""
    cleaned = lines.select("request", "line_no", clean_model_text(F.col("text"), column_name).alias("value"))
    filled = cleaned.where(F.length(F.trim("value")) > 0)
    return first_occurrences(filled, ["request"], "value", "line_no").select("request", "line_no", "value")
