"""Multi-column CHECK rules: choose and verify allowed value combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws
from rowloom.model import CombinationRule, TableSpec
from rowloom.operators.indexing import dense_index
from rowloom.operators.joins import lookup

# Longer rules are tables that rows are joined with; shorter ones are part of the plan. Both give the same rows.
INLINE = 200


def _combination_array(rule: CombinationRule) -> Column:
    """The rule as an array of string structs; it comes from the schema, so it is small."""
    kind = "struct<" + ",".join(f"c{i}:string" for i in range(len(rule.columns))) + ">"
    rows = [
        F.struct(*[F.lit(v).cast("string").alias(f"c{i}") for i, v in enumerate(combo)])
        for combo in rule.combinations
    ]
    return F.array(*rows).cast(f"array<{kind}>")


def matches_combination(rule: CombinationRule, values: list[Column]) -> Column:
    """True when the values are one of the allowed combinations; a listed NULL matches null.

    As in SQL, null where only a null value keeps this from being known, which a CHECK lets pass.
    """
    tests = []
    for combo in rule.combinations:
        parts = [
            value.isNull() if v is None or v.upper() == "NULL" else value.cast("string") == F.lit(v)
            for v, value in zip(combo, values)
        ]
        test = parts[0]
        for part in parts[1:]:
            test = test & part
        tests.append(test)
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def choose_combination(
    rule: CombinationRule,
    draws: Draws,
    row: Column,
    pinned: dict[str, tuple[Column, Column]] | None = None,
) -> Column:
    """One combination as a struct of strings, in agreement with already pinned values.

    ``pinned`` maps a column to (is pinned, text value). When no combination agrees the first
    one is taken whole, so that the rule holds in every row.
    """
    combos = _combination_array(rule)
    draw = draws.at("__".join(rule.columns), row, "combo")
    if not pinned:
        pick = draw.below(len(rule.combinations)).cast("int") + 1
        return F.element_at(combos, pick)

    def agrees(combo: Column) -> Column:
        test = F.lit(True)
        for i, name in enumerate(rule.columns):
            if name in pinned:
                is_pinned, value = pinned[name]
                part = combo.getField(f"c{i}")
                same = value.eqNullSafe(F.when(F.upper(part) == "NULL", None).otherwise(part))
                test = test & (~is_pinned | same)
        return test

    fitting = F.filter(combos, agrees)
    size = F.greatest(F.size(fitting), F.lit(1))
    chosen = F.get(fitting, F.pmod(draw.value, size.cast("bigint")).cast("int"))
    return F.coalesce(chosen, F.element_at(combos, 1))


def combination_violations(df: DataFrame, rule: CombinationRule) -> DataFrame:
    """Rows whose values are not an allowed combination."""
    if len(rule.combinations) > INLINE:
        return missing_combinations(df, combination_rows(df.sparkSession, rule), list(rule.columns))
    return df.where(~matches_combination(rule, [F.col(c) for c in rule.columns]))


# --- rules as tables --------------------------------------------------------------------------


def combination_rows(spark: SparkSession, rule: CombinationRule) -> DataFrame:
    """(at, c0, c1, ...): the listed combinations as texts, in their order; a listed NULL is null."""
    rows = [(i, *[None if v is None or v.upper() == "NULL" else v for v in combo]) for i, combo in enumerate(rule.combinations)]
    return spark.createDataFrame(rows, "at bigint, " + ", ".join(f"c{i} string" for i in range(len(rule.columns))))


def _marked(value: Column) -> Column:
    """A text that tells null from every value, so that joins need no null-safe equality."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def attach_combinations(
    df: DataFrame, combos: DataFrame, columns: list[str], draws: Draws, row: Column,
    pinned: dict[str, tuple[Column, Column]] | None = None, prefix: str = "_combo",
) -> DataFrame:
    """``df`` with one combination per row (``{prefix}0``, ``{prefix}1``, ...), as ``choose_combination`` picks it.

    ``combos`` has at (0, 1, ...) and c0, c1, ... Rows without a pinned column draw a place and meet their combination by
    it. For each set of pinned columns that occurs, combinations are numbered in the order of those columns, so
    the ones that agree with a row are a range of places; the row draws one of them. Without any, the first is taken.
    """
    names = [f"c{i}" for i in range(len(columns))]
    draw = draws.at("__".join(columns), row, "combo").value
    count = combos.count()
    given = [(i, *pinned[c]) for i, c in enumerate(columns) if pinned and c in pinned]
    work = df.select(
        "*", draw.alias("_draw"), *[F.coalesce(is_set, F.lit(False)).alias(f"_set{i}") for i, is_set, _ in given],
        *[_marked(text).alias(f"_key{i}") for i, _, text in given],
    )
    out = []
    for pattern in work.select(*[f"_set{i}" for i, _, _ in given]).distinct().collect() if given else [()]:
        fixed = [i for (i, _, _), is_set in zip(given, pattern, strict=True) if is_set]
        mine = work
        for (i, _, _), is_set in zip(given, pattern, strict=True):
            mine = mine.where(F.col(f"_set{i}") if is_set else ~F.col(f"_set{i}"))
        if fixed:
            marked = combos.select("at", *names, *[_marked(F.col(f"c{i}")).alias(f"_key{i}") for i in fixed])
            keys = [f"_key{i}" for i in fixed]
            placed = dense_index(marked, [*keys, "at"], "_place").df
            groups = placed.groupBy(*keys).agg(F.min("_place").alias("_start"), F.count("*").alias("_size"))
            ranged = lookup(mine, groups, keys, count)
            first = placed.where("at = 0").select(F.col("_place").alias("_first"))
            chosen = ranged.crossJoin(F.broadcast(first)).withColumn(  # one row
                "_place", F.coalesce(F.col("_start") + F.pmod("_draw", "_size"), F.col("_first"))
            )
            picked = lookup(chosen, placed.select("_place", *names), ["_place"], count)
        else:
            picked = lookup(mine.withColumn("_place", F.pmod("_draw", F.lit(count))), combos.withColumnRenamed("at", "_place"), ["_place"], count, even=True)
        out.append(picked.select(*df.columns, *[F.col(n).alias(f"{prefix}{i}") for i, n in enumerate(names)]))
    return reduce(DataFrame.unionByName, out)


def missing_combinations(df: DataFrame, combos: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that agree with no combination. As in SQL, a null value leaves its column open.

    Rows with the same columns null are compared on the other columns alone, by an anti-join on the different
    combinations of those.
    """
    values = [F.col(f"`{c}`") for c in columns]
    patterns = df.select(*[v.isNull().alias(f"n{i}") for i, v in enumerate(values)]).distinct().collect()
    bad = [df.where(F.lit(False))]
    for pattern in patterns:
        here = [i for i, null in enumerate(pattern) if not null]
        if not here:
            continue
        mine = df.where(reduce(lambda a, b: a & b, [v.isNull() if null else v.isNotNull() for v, null in zip(values, pattern, strict=True)]))
        allowed = combos.where(" and ".join(f"c{i} is not null" for i in here)).select(*[f"c{i}" for i in here]).distinct()
        same = reduce(lambda a, b: a & b, [values[i].cast("string") == allowed[f"c{i}"] for i in here])
        bad.append(mine.join(allowed, same, "left_anti"))
    return reduce(DataFrame.unionByName, bad)


def typed(spec: TableSpec, rule: CombinationRule, combo: Column, numeric_scale: int = 2) -> dict[str, Column]:
    """The chosen combination as typed column values."""
    out = {}
    for i, name in enumerate(rule.columns):
        text = combo.getField(f"c{i}")
        kind = spec.column(name).data_type(numeric_scale)
        out[spec.column(name).name] = F.when(F.upper(text) != "NULL", text).try_cast(kind)
    return out
