"""Repetition rules: blocks of rows at the front of a table with pinned values."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.patterns import pattern_column, texts_from_patterns
from rowloom.model import RepetitionRule, TableSpec
from rowloom.operators.indexing import numbers_below

# More rules than this are a table whose rows meet the positions; fewer are part of the plan. Both give the same rows.
INLINE = 100
PINS, CONSTANT = "_pins", "_constant"


@dataclass(frozen=True)
class RuleBlocks:
    """Rules laid out over row positions 0..total-1."""

    spec: TableSpec
    rules: tuple[RepetitionRule, ...]
    counts: tuple[int, ...]

    @property
    def total(self) -> int:
        return sum(self.counts)

    @property
    def tabled(self) -> bool:
        return len(self.rules) > INLINE

    def rule_of(self, position: Column) -> Column:
        """The rule number of a position, or null; a balanced tree of comparisons."""
        ends = list(accumulate(self.counts))

        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(position < ends[middle], search(low, middle)).otherwise(search(middle + 1, high))

        if not ends:
            return F.lit(None).cast("int")
        return F.when(position < ends[-1], search(0, len(ends) - 1)).cast("int")


def lay_out(spec: TableSpec, rules: list[RepetitionRule]) -> RuleBlocks:
    """A rule that pins a whole key can make one row only; the others would be duplicates."""
    counts = []
    for rule in rules:
        pinned = {spec.column(c).name for c in (*rule.fixed, *rule.constant, *rule.patterns) if spec.has_column(c)}
        keys = [k for k in (spec.primary_key, *spec.unique_keys) if k]
        counts.append(1 if any(set(k) <= pinned for k in keys) else rule.count)
    return RuleBlocks(spec, tuple(rules), tuple(counts))


@dataclass(frozen=True)
class PinnedColumn:
    """For each rule: whether it sets the column, and the text it sets."""

    is_set: Column
    text: Column


def pinned_columns(blocks: RuleBlocks, rule_id: Column, seed: int, numeric_scale: int = 2) -> dict[str, PinnedColumn]:
    """Fixed and regex values per column, read from arrays indexed by rule number.

    Column names ignore case. 'NULL' means null. A null, or a text that does not fit the type,
    is kept for nullable columns and left to the generator for NOT NULL ones.
    """
    if blocks.tabled:
        return _tabled_columns(blocks, numeric_scale)
    spec, per_column = blocks.spec, {}
    asked = [
        (number, name, pattern, spec.column(name)) for number, rule in enumerate(blocks.rules)
        for name, pattern in rule.patterns.items() if spec.has_column(name) and spec.column(name).is_text
    ]
    made = texts_from_patterns([(pattern, f"{seed}|{spec.name}|{column.name}|{number}", column.length) for number, _, pattern, column in asked])
    drawn = {(number, name): text for (number, name, _, _), text in zip(asked, made, strict=True) if text is not None}
    for number, rule in enumerate(blocks.rules):
        settings: dict[str, str | None] = dict(rule.fixed) | {name: text for (n, name), text in drawn.items() if n == number}
        for name, text in settings.items():
            if spec.has_column(name):
                slot = per_column.setdefault(spec.column(name).name, [None] * len(blocks.rules))
                null = text is None or text.upper() == "NULL"
                slot[number] = (None,) if null else (text,)
    out = {}
    for name, slots in per_column.items():
        column = spec.column(name)
        # get, not element_at: the planner takes element_at of a null index for not null.
        given = F.get(F.array(*[F.lit(s is not None) for s in slots]), rule_id)
        text = F.get(F.array(*[F.lit(s[0] if s else None).cast("string") for s in slots]), rule_id)
        is_set = rule_id.isNotNull() & F.coalesce(given, F.lit(False))
        if not column.nullable:
            is_set = is_set & text.try_cast(column.data_type(numeric_scale)).isNotNull()
        out[name] = PinnedColumn(is_set, text)
    return out


def constant_key(blocks: RuleBlocks, column: str, rule_id: Column, row: Column) -> Column:
    """The draw key of a cell: the rule number where a rule holds the column constant, else the row."""
    spec = blocks.spec
    if blocks.tabled:
        held = F.coalesce(F.array_contains(CONSTANT, F.lit(column.lower())), F.lit(False))
        return F.when(held, F.concat(F.lit("r"), rule_id.cast("string"))).otherwise(row.cast("string"))
    holding = [
        number
        for number, rule in enumerate(blocks.rules)
        if any(spec.has_column(c) and spec.column(c).name == column for c in rule.constant)
    ]
    if not holding:
        return row.cast("string")
    return F.when(rule_id.isin(holding), F.concat(F.lit("r"), rule_id.cast("string"))).otherwise(row.cast("string"))


# --- rules as a table -------------------------------------------------------------------------


def _tabled_columns(blocks: RuleBlocks, numeric_scale: int) -> dict[str, PinnedColumn]:
    """As ``pinned_columns``, read from the map of the row's rule."""
    spec, out = blocks.spec, {}
    names = {c.lower() for rule in blocks.rules for c in (*rule.fixed, *rule.patterns)}
    for column in spec.columns:
        if column.name.lower() not in names:
            continue
        key = F.lit(column.name.lower())
        is_set = F.coalesce(F.map_contains_key(F.col(PINS), key), F.lit(False))
        text = F.try_element_at(F.col(PINS), key)
        if not column.nullable:
            is_set = is_set & text.try_cast(column.data_type(numeric_scale)).isNotNull()
        out[column.name] = PinnedColumn(is_set, text)
    return out


def rule_table(spark: SparkSession, blocks: RuleBlocks, seed: int) -> DataFrame:
    """One row per rule: number, first position, rows, the texts it pins (by lower-case column) and its constant columns."""
    spec = blocks.spec
    starts = [0, *accumulate(blocks.counts)]
    rules = [
        (i, starts[i], blocks.counts[i], [spec.column(c).name.lower() for c in rule.constant if spec.has_column(c)])
        for i, rule in enumerate(blocks.rules)
    ]
    plain = spark.createDataFrame(rules, f"rule int, first bigint, count bigint, {CONSTANT} array<string>")
    pins, asked = [], {}
    for i, rule in enumerate(blocks.rules):
        own = {c.lower(): None if t is None or t.upper() == "NULL" else t for c, t in rule.fixed.items() if spec.has_column(c)}
        pins += [(i, c, t) for c, t in own.items()]
        for name, pattern in rule.patterns.items():
            if spec.has_column(name) and spec.column(name).is_text:
                column = spec.column(name)
                asked.setdefault((pattern, column.length), []).append((i, column.name.lower(), f"{seed}|{spec.name}|{column.name}|{i}"))
    kind = "rule int, column string, text string"
    found = spark.createDataFrame(pins, kind).withColumn("rank", F.lit(0))
    for (pattern, length), rows in asked.items():  # one expression per different pattern, over all its rules
        made = spark.createDataFrame(rows, "rule int, column string, key string")
        text = made.select("rule", "column", pattern_column(pattern, F.col("key"), length).alias("text")).where("text is not null")
        found = found.unionByName(text.withColumn("rank", F.lit(1)))
    # A pattern wins over a fixed text of the same column.
    best = found.groupBy("rule", "column").agg(F.max_by("text", "rank").alias("text"), F.max("rank").alias("rank"))
    maps = best.groupBy("rule").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias(PINS))
    return plain.join(maps, "rule", "left")


def rule_rows(table: DataFrame, position: str, rule: str) -> DataFrame:
    """(position, rule, pins, constant columns) of every position that a rule takes, made from the rules' side."""
    rows = numbers_below(table, "count", "_k")
    return rows.select((F.col("first") + F.col("_k")).alias(position), F.col("rule").alias(rule), PINS, CONSTANT)
