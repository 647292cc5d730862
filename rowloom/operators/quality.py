"""Integrity checks and repair on any DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.keyed import Draws
from rowloom.functions.values import numeric_value
from rowloom.model import ColumnSpec, ForeignKey, TableSpec
from rowloom.operators.combinations import INLINE, combination_rows, matches_combination, missing_combinations

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def outside_bounds(value: Column, low: float | None, high: float | None) -> Column:
    """Null and NaN are inside; text that is not a number is outside."""
    number = value.cast("string").try_cast("double")
    tests = [number.isNull()]
    if low is not None:
        tests.append(number < F.lit(float(low)))
    if high is not None:
        # NaN sorts above all numbers here, but breaks no bound.
        tests.append((number > F.lit(float(high))) & ~F.isnan(number))
    return F.coalesce(value.isNotNull() & reduce(lambda a, b: a | b, tests), F.lit(False))


def numeric_outside(value: Column, low: float | None, high: float | None) -> Column:
    """``outside_bounds`` for columns that are numeric already; a plain comparison, which reaches the scan.

    Null for null, which filters and counts take for inside.
    """
    tests = []
    if low is not None:
        tests.append(value < F.lit(low))
    if high is not None:
        tests.append(value > F.lit(high))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def clamp(value: Column, low: float | None, high: float | None) -> Column:
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def repair_numeric(
    df: DataFrame, column: ColumnSpec, draws: Draws | None = None, row: str | None = None, numeric_scale: int = 2
) -> DataFrame:
    """Bring a numeric column into its bounds: redraw by row key, or clamp when no key is given.

    Values on the allowed list are left alone. A redraw cannot fall outside, since draws are
    made in whole units inside the bounds. In a text column, text that is no number goes to the
    lower bound, or to the upper one where there is no lower.
    """
    value = F.col(column.name)
    kind = df.schema[column.name].dataType
    if isinstance(kind, T.StringType):
        return df.withColumn(column.name, _repaired_text(value, column))
    bad = numeric_outside(value, column.min_value, column.max_value)
    if column.allowed:
        bad = bad & ~value.cast("string").isin(*column.allowed)
    if draws is None or row is None:
        fixed = clamp(value, column.min_value, column.max_value)
    else:
        fixed = numeric_value(column, draws.at(column.name, F.col(row), "repair"), numeric_scale)
    return df.withColumn(column.name, F.when(bad, fixed.cast(kind)).otherwise(value))


def _repaired_text(value: Column, column: ColumnSpec) -> Column:
    low, high = column.min_value, column.max_value
    if low is None and high is None:
        return value
    bad = outside_bounds(value, low, high)
    if column.allowed:
        bad = bad & ~value.isin(*column.allowed)
    first, last = (None if b is None else F.lit(str(b)) for b in (low, high))
    if first is None or last is None:
        return F.when(bad, last if first is None else first).otherwise(value)
    above = value.try_cast("double") > F.lit(float(high))
    return F.when(bad & above, last).when(bad, first).otherwise(value)


def orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Foreign-key values without a parent row, with the number of child rows holding each.

    Child rows are counted per key before the join, so the join sees each key once however
    often it occurs.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk.columns])
    used = child.where(present).groupBy(*fk.columns).agg(F.count("*").alias("child_rows"))
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])
    return used.join(keys, list(fk.columns), "left_anti")


def duplicates(df: DataFrame, key: Sequence[str], nulls_equal: bool = False) -> DataFrame:
    """Keys that occur more than once."""
    rows = df if nulls_equal else df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]))
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")


def range_violations(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    return df.where(numeric_outside(F.col(column), low, high))


@dataclass(frozen=True)
class RangeRule:
    column: str
    low: float | None = None
    high: float | None = None


def row_rules(df: DataFrame, spec: TableSpec, expected_rows: int | None = None) -> DataFrame:
    """All rules that look at single rows, in one scan: NOT NULL, range, value list, combinations, row count."""
    tests: list[tuple[str, str, Column]] = []
    for column in spec.columns:
        if column.name not in df.columns:
            continue
        value = F.col(column.name)
        if not column.nullable:
            tests.append(("not_null", column.name, value.isNull()))
        if column.min_value is not None or column.max_value is not None:
            numeric = dict(df.dtypes)[column.name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or dict(
                df.dtypes
            )[column.name].startswith("decimal")
            check = numeric_outside if numeric else outside_bounds
            tests.append(("range", column.name, check(value, column.min_value, column.max_value)))
        if column.allowed and not column.uuid:
            tests.append(("allowed", column.name, value.isNotNull() & ~value.cast("string").isin(*column.allowed)))
    long = [rule for rule in spec.combinations if len(rule.combinations) > INLINE]
    for rule in [r for r in spec.combinations if r not in long]:
        held = matches_combination(rule, [F.col(c) for c in rule.columns])
        tests.append(("combination", ",".join(rule.columns), ~held))
    counts = [F.count("*").alias("n")] + [F.count_if(t).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)]
    totals = df.agg(*counts)
    lines = [
        F.struct(F.lit(k).alias("kind"), F.lit(name).alias("constraint_name"), F.col("n").alias("checked"),
                 F.col(f"t{i}").alias("violations"))
        for i, (k, name, _) in enumerate(tests)
    ]
    missing = F.lit(0).cast("bigint") if expected_rows is None else F.abs(F.col("n") - expected_rows)
    lines.append(
        F.struct(F.lit("row_count").alias("kind"), F.lit("*").alias("constraint_name"), F.col("n").alias("checked"),
                 missing.alias("violations"))
    )
    found = totals.select(F.explode(F.array(*lines)).alias("r")).select(
        F.lit(spec.name).alias("table_name"), "r.kind", "r.constraint_name", "r.checked", "r.violations"
    )
    for rule in long:  # a table of its own to be joined with
        bad = missing_combinations(df, combination_rows(df.sparkSession, rule), list(rule.columns)).agg(F.count("*").alias("violations"))
        seen = totals.select(F.col("n").alias("checked")).crossJoin(F.broadcast(bad))  # one row each
        found = found.unionByName(seen.select(
            F.lit(spec.name).alias("table_name"), F.lit("combination").alias("kind"), F.lit(",".join(rule.columns)).alias("constraint_name"),
            "checked", "violations",
        ))
    return found


def _kind(df: DataFrame, columns: Sequence[str]) -> tuple[str, ...]:
    """How a key's columns are compared among themselves: whole numbers as bigint, all else as text."""
    return tuple("bigint" if isinstance(df.schema[c].dataType, WHOLE) else "string" for c in columns)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which values of both can be compared: equal values are equal in it, whatever their scale."""
    if isinstance(a, WHOLE) and isinstance(b, WHOLE):
        return T.LongType()
    if isinstance(a, (*WHOLE, T.DecimalType)) and isinstance(b, (*WHOLE, T.DecimalType)):
        sizes = [(k.precision, k.scale) if isinstance(k, T.DecimalType) else (19, 0) for k in (a, b)]
        scale = max(s for _, s in sizes)
        return T.DecimalType(min(38, max(p - s for p, s in sizes) + scale), scale)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if a == b:
        return a
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return T.TimestampType() if isinstance(a, moments) and isinstance(b, moments) else T.StringType()


def _pair_kind(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> tuple[str, ...]:
    pairs = zip(fk.columns, fk.parent_columns, strict=True)
    return tuple(common_type(child.schema[c].dataType, parent.schema[p].dataType).simpleString() for c, p in pairs)


def _stack(sources: Sequence[tuple[int, DataFrame, Sequence[str]]], kinds: Sequence[str]) -> DataFrame:
    """(no, v0, v1, ...): several keys of equal kind below each other, one scan per table, nulls left out."""
    values = [f"v{i}" for i in range(len(kinds))]
    per_table: dict[int, tuple[DataFrame, list]] = {}
    for number, df, columns in sources:
        cells = [F.col(c).cast(k).alias(v) for c, k, v in zip(columns, kinds, values)]
        per_table.setdefault(id(df), (df, []))[1].append(F.struct(F.lit(number).alias("no"), *cells))
    parts = []
    for df, lines in per_table.values():
        one = df.select(lines[0].alias("r")) if len(lines) == 1 else df.select(F.explode(F.array(*lines)).alias("r"))
        parts.append(one.select("r.*"))
    present = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in values])
    return reduce(DataFrame.unionByName, parts).where(present)


def _by_kind(rules: Sequence[tuple]) -> dict[tuple[str, ...], list[tuple]]:
    groups: dict[tuple[str, ...], list[tuple]] = {}
    for rule in rules:
        groups.setdefault(rule[0], []).append(rule)
    return groups


def _labelled(spark: SparkSession, labels: list[tuple], totals: DataFrame) -> DataFrame:
    """Put names to the numbered results; a rule without rows has checked none."""
    names = spark.createDataFrame(labels, "no int, table_name string, kind string, constraint_name string")
    return names.join(totals, "no", "left").select(
        "table_name", "kind", "constraint_name",
        F.coalesce("checked", F.lit(0)).cast("bigint").alias("checked"),
        F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"),
    )


def unique_rules(spark: SparkSession, rules: Sequence[tuple[str, str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows minus distinct keys for ``(table, kind, df, columns)``; rows with a null in the key do not count.

    Keys of equal type share one shuffle. Rows are counted per key before it.
    """
    out = []
    for kinds, group in _by_kind([(_kind(df, cols), t, k, df, cols) for t, k, df, cols in rules]).items():
        sources = [(no, df, cols) for no, (_, _, _, df, cols) in enumerate(group)]
        counted = _stack(sources, kinds).groupBy("no", *[f"v{i}" for i in range(len(kinds))]).agg(F.count("*").alias("n"))
        totals = counted.groupBy("no").agg(F.sum("n").alias("checked"), (F.sum("n") - F.count("*")).alias("violations"))
        out.append(_labelled(spark, [(no, t, k, ",".join(c)) for no, (_, t, k, _, c) in enumerate(group)], totals))
    return reduce(DataFrame.unionByName, out)


def reference_rules(
    spark: SparkSession, rules: Sequence[tuple[str, ForeignKey, DataFrame, DataFrame]]
) -> DataFrame:
    """Child rows without a parent for ``(table, fk, child, parent)``.

    Both sides are compared in their common type. References of equal type are tested together: child rows are counted per value before the
    shuffle, and each value then meets the parents' keys once, however often it occurs.
    """
    out = []
    for kinds, group in _by_kind([(_pair_kind(c, p, fk), t, fk, c, p) for t, fk, c, p in rules]).items():
        values = [f"v{i}" for i in range(len(kinds))]
        # Several references may point to the same key; it is read once.
        keys: dict[tuple, tuple[int, DataFrame]] = {}
        for _, _, fk, _, parent in group:
            keys.setdefault((fk.parent, fk.parent_columns), (len(keys), parent))
        target = [keys[fk.parent, fk.parent_columns][0] for _, _, fk, _, _ in group]
        used = _stack([(no, c, fk.columns) for no, (_, _, fk, c, _) in enumerate(group)], kinds)
        used = used.groupBy("no", *values).agg(F.count("*").alias("n"))
        used = used.withColumn("key", F.element_at(F.lit(target), F.col("no") + 1))
        parents = _stack([(no, parent, cols) for (_, cols), (no, parent) in keys.items()], kinds).withColumnRenamed("no", "key")
        lost = used.join(parents, ["key", *values], "left_anti").groupBy("no").agg(F.sum("n").alias("violations"))
        totals = used.groupBy("no").agg(F.sum("n").alias("checked")).join(F.broadcast(lost), "no", "left")
        out.append(_labelled(spark, [(no, t, "foreign_key", fk.name) for no, (_, t, fk, _, _) in enumerate(group)], totals))
    return reduce(DataFrame.unionByName, out)


def integrity_report(
    tables: Mapping[str, DataFrame], specs: Sequence[TableSpec], expected_rows: Mapping[str, int] | None = None
) -> DataFrame:
    """One row per constraint of the schema: rows checked and rows in violation."""
    spark = next(iter(tables.values())).sparkSession
    parts = [row_rules(tables[s.name], s, (expected_rows or {}).get(s.name)) for s in specs]
    unique = [(s.name, "primary_key", tables[s.name], s.primary_key) for s in specs if s.primary_key]
    unique += [(s.name, "unique", tables[s.name], k) for s in specs for k in s.unique_keys]
    references = [
        (s.name, fk, tables[s.name], tables[fk.parent]) for s in specs for fk in s.foreign_keys if fk.parent in tables
    ]
    if unique:
        parts.append(unique_rules(spark, unique))
    if references:
        parts.append(reference_rules(spark, references))
    return reduce(DataFrame.unionByName, parts)
