"""Rows for one table: a single projection over row positions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws, SharedDraws, base36, permute, step_for
from rowloom.functions.values import (
    ValueSettings,
    cell_value,
    decimal_of_units,
    fallback_value,
    fit_length,
    holds_words,
    numeric_limits,
    soft_delete_value,
    units_between,
)
from rowloom.model import INTEGER_TYPES, ColumnSpec, RepetitionRule, TableSpec
from rowloom.operators import combinations as combos_
from rowloom.operators.combinations import choose_combination, typed
from rowloom.operators.joins import lookup
from rowloom.operators.phrases import attach_phrases
from rowloom.operators.rules import CONSTANT, PINS, constant_key, lay_out, pinned_columns, rule_rows, rule_table

POSITION, RULE = "_idx", "_rule_id"
# Computes a foreign-key column from the row position.
Reference = Callable[[Column], Column]
# Key dates run from the first day to the year 9999; key codes stay below WIDEST.
FIRST_DAY, DAYS = dt.date(2000, 1, 1), 2_900_000
WIDEST = 1 << 60
SHORT_TEXT = 10


@dataclass(frozen=True)
class GenerateOptions:
    seed: int = 0
    algorithm: str = "md5"
    values: ValueSettings = ValueSettings()
    rules: tuple[RepetitionRule, ...] = ()
    excluded: frozenset[str] = frozenset()
    soft_delete: frozenset[str] = frozenset()
    soft_delete_value: str | None = None
    soft_delete_default: bool = False
    references: Mapping[str, Reference] = field(default_factory=dict)
    # Words (column word) that free texts are made of, of any number: they are drawn by number and joined.
    vocabulary: DataFrame | None = None
    # The number inside its domain of a primary key column that shares a code with foreign keys.
    key_places: Mapping[str, Reference] = field(default_factory=dict)


def is_countable(column: ColumnSpec) -> bool:
    return column.type in INTEGER_TYPES and not column.uuid and not column.allowed


def key_domain(column: ColumnSpec, rows: int) -> tuple[int, int]:
    """First value and size of an integer key's domain; without a declared upper bound it grows with the rows."""
    low, high = numeric_limits(column)
    if column.max_value is None:
        high = max(high, low + rows - 1)
    return int(low), int(high) - int(low) + 1


@dataclass(frozen=True)
class Domain:
    """The values a key column may take, numbered from 0."""

    size: int
    value: Callable[[Column], Column]


def domain_of(column: ColumnSpec, rows: int, scale: int = 2) -> Domain | None:
    """The column's values as a numbered domain; None where cells differ by themselves (UUIDs, texts with room)."""
    kind = column.data_type(scale)
    if column.allowed:
        listed = list(dict.fromkeys(column.allowed))
        return Domain(len(listed), lambda i: F.element_at(F.array(*map(F.lit, listed)), (i + 1).cast("int")).try_cast(kind))
    if column.uuid:
        return None
    if is_countable(column):
        low, size = key_domain(column, rows)
        return Domain(size, lambda i: (F.lit(low) + i).cast(kind))
    if column.is_numeric:
        places = column.effective_scale(scale)
        low, high = units_between(*numeric_limits(column, scale), places)
        if column.type == "decimal":
            first = F.lit(Decimal(low)).cast("decimal(38,0)")
            return Domain(
                min(high - low + 1, WIDEST),
                lambda i: decimal_of_units((i.cast("decimal(19,0)") + first).cast("decimal(38,0)"), column.length or 18, places).cast(kind),
            )
        # Whole units below 2^53 (2^24 for floats) stay apart when they are divided.
        most = max(1, (1 << (24 if column.type == "float" else 53)) - max(abs(low), 0))
        return Domain(min(high - low + 1, most), lambda i: ((F.lit(low) + i).cast("double") / F.lit(float(10**places))).cast(kind))
    if column.type == "boolean":
        return Domain(2, lambda i: i == 1)
    if column.type == "date":
        return Domain(DAYS, lambda i: F.date_add(F.lit(FIRST_DAY), i.cast("int")))
    if column.type == "timestamp":
        return Domain(86_400 * DAYS, lambda i: F.timestamp_seconds(F.unix_seconds(F.lit(FIRST_DAY).cast("timestamp")) + i))
    if column.is_text and 0 < column.length <= SHORT_TEXT and 36**column.length < rows:
        return Domain(36**column.length, lambda i: F.lpad(base36(i), column.length, "0"))
    return None


def key_capacity(spec: TableSpec, rows: int, key: Sequence[str] | None = None, scale: int = 2) -> int:
    """How many distinct keys there are, as far as the rows need; foreign-key columns set no bound here."""
    names = spec.primary_key if key is None else key
    sizes = []
    for name in names:
        column = spec.column(name)
        domain = None if column.name in spec.fk_columns else domain_of(column, rows, scale)
        if domain is None:
            return rows
        sizes.append(domain.size)
    return min(rows, prod(sizes)) if sizes else rows


def own_unique_keys(spec: TableSpec) -> list[list[str]]:
    """Unique keys made by construction: those that share no column with another key, a foreign key or a
    combination rule. A key that holds the whole primary key needs nothing; other overlapping keys are kept by
    ``make_all_unique``."""
    used = {spec.column(c).name for c in spec.primary_key} | set(spec.fk_columns)
    used |= {spec.column(c).name for rule in spec.combinations for c in rule.columns if spec.has_column(c)}
    found = []
    for key in spec.unique_keys:
        names = [spec.column(c).name for c in key]
        if not used & set(names):
            used |= set(names)
            found.append(names)
    return found


def split_code(position: Column, sizes: Sequence[int], rows: int, seed: int) -> list[Column]:
    """Numbers below each size that together differ for the first ``rows`` positions: digits of a permuted code.

    Domains are used only as far as the rows need, the last one whole while the code stays 64-bit.
    """
    trimmed, left = [], rows
    for i, size in enumerate(sizes):
        room = left if i < len(sizes) - 1 else max(left, WIDEST // max(prod(trimmed), 1))
        trimmed.append(max(1, min(size, room)))
        left = -(-left // trimmed[-1])
    space = prod(trimmed)
    code = permute(position, space, shift=seed % space)
    out = []
    for size in trimmed:
        out.append(F.pmod(code, F.lit(size)))
        code = F.call_function("div", code, F.lit(size))
    return out


def key_values(
    spec: TableSpec, key: Sequence[str], draws: Draws, position: Column, rows: int, settings: ValueSettings,
    places: Mapping[str, Reference] | None = None,
) -> dict[str, Column]:
    """The key's own columns as one-to-one functions of the position; composite keys split one permuted code.

    ``places`` gives the number inside a column's domain where it is settled elsewhere. Beyond the key's
    capacity a nullable column is null.
    """
    own = [spec.column(c) for c in key if spec.column(c).name not in spec.fk_columns]
    domains = {c.name: domain_of(c, rows, settings.numeric_scale) for c in own}
    out: dict[str, Column] = {}
    if places:
        return {c: domains[c].value(place(position)) for c, place in places.items()}
    endless = [c for c in own if domains[c.name] is None]
    # Beside a column that differs in every row only whole numbers follow the code.
    coded = [c for c in own if domains[c.name] is not None and (not endless or is_countable(c))]
    if coded:
        sizes = [domains[c.name].size for c in coded]
        for column, digit in zip(coded, split_code(position, sizes, rows, draws.seed), strict=True):
            out[column.name] = domains[column.name].value(digit)
        nullable = next((c.name for c in coded if c.nullable), None)
        if not endless and prod(sizes) < rows and nullable is not None:
            out[nullable] = F.when(position < prod(sizes), out[nullable])
    for column in endless:
        if column.is_text and not column.uuid:
            out[column.name] = distinct_text(column, draws, position, rows, settings)
            break
    for column in own:
        if column.name not in out and spec.primary_key and column in map(spec.column, spec.primary_key):
            free_text = column.is_text and not column.uuid and not column.allowed
            out[column.name] = (
                distinct_text(column, draws, position, rows, settings) if free_text
                else cell_value(column, draws, position, settings, position)
            )
    return out


def distinct_text(column: ColumnSpec, draws: Draws, position: Column, rows: int, settings: ValueSettings) -> Column:
    """Text that differs in every row: the generated text followed by the position in base 36."""
    digits = len(_base36(max(rows - 1, 0)))
    if 0 < column.length < digits + 4:
        space = 36**column.length
        code = permute(position, space, shift=draws.seed % space) if space < 1 << 60 else position
        return F.lpad(base36(code), column.length, "0")
    plain = ColumnSpec(column.name, "string", False, column.length)
    text = cell_value(plain, draws, position, settings)
    if column.length > 0:
        text = fit_length(text, column.length - digits - 1)
    made = F.concat(text, F.lit("-"), F.lpad(base36(position), digits, "0"))
    return fit_length(made, column.length, pad=True) if column.type == "char" else made


def _base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        if n == 0:
            return out


def row_columns(
    spec: TableSpec, options: GenerateOptions, position: Column, rows: int, draws: Draws, chosen: Mapping[int, Column] | None = None
) -> tuple[dict[str, Column], Column]:
    """Every column of the table as a function of the position, and the rule number.

    ``chosen`` has the combinations, by number, of rules that are too long for the plan.
    """
    settings, scale = options.values, options.values.numeric_scale
    blocks = lay_out(spec, list(options.rules))
    rule_id = F.col(RULE)
    pinned = pinned_columns(blocks, rule_id, options.seed, scale)
    keys = key_values(spec, spec.primary_key, draws, position, rows, settings, options.key_places)
    unique: dict[str, Column] = {}
    for key in own_unique_keys(spec):
        unique |= key_values(spec, key, draws, position, rows, settings)
    combos: dict[str, Column] = {}
    for number, rule in enumerate(spec.combinations):
        if len(rule.combinations) > combos_.INLINE:
            none = F.struct(*[F.lit(None).cast("string").alias(f"c{i}") for i in range(len(rule.columns))])
            combos.update(typed(spec, rule, (chosen or {}).get(number, none), scale))
            continue
        fixed = {c: (pinned[c].is_set, pinned[c].text) for c in rule.columns if c in pinned}
        combos.update(typed(spec, rule, choose_combination(rule, draws, position, fixed), scale))
    out: dict[str, Column] = {}
    for column in spec.columns:
        kind = column.data_type(scale)
        if column.name in options.excluded:
            value = F.lit(None).cast(kind)
        elif column.name in options.references:
            value = options.references[column.name](position)
        elif column.name in spec.fk_columns:
            value = F.lit(None).cast(kind)
        elif column.name in combos:
            value = combos[column.name]
            if not column.nullable:
                value = F.coalesce(value, fallback_value(column, position, scale))
        elif column.name in options.soft_delete:
            value = soft_delete_value(column, options.soft_delete_value, options.soft_delete_default, scale)
        elif column.name in keys:
            value = keys[column.name]
        elif column.name in unique:
            value = unique[column.name]
        else:
            key = constant_key(blocks, column.name, rule_id, position)
            value = cell_value(column, draws, key, settings, position)
        if column.name in pinned and column.name not in spec.fk_columns and column.name not in combos:
            pin = pinned[column.name]
            if spec.primary_key == (column.name,) and is_countable(column) and not blocks.tabled:
                value = _avoid(value, _pinned_keys(blocks, column), column, rows, draws)
            value = F.when(pin.is_set, pin.text.try_cast(kind)).otherwise(value)
        out[column.name] = value.cast(kind)
    return out, rule_id if blocks.tabled else blocks.rule_of(position)


def _pinned_keys(blocks, column: ColumnSpec) -> list[int]:
    texts = [
        text
        for rule in blocks.rules
        for name, text in rule.fixed.items()
        if name.lower() == column.name.lower() and text is not None
    ]
    return sorted({int(t) for t in texts if t.strip().lstrip("+-").isdigit()})


def _avoid(value: Column, taken: list[int], column: ColumnSpec, rows: int, draws: Draws) -> Column:
    """Swap generated keys that a rule has pinned elsewhere for keys no position uses."""
    if not taken:
        return value
    spare = _spare_keys(taken, column, rows, draws)
    keys = F.array(*[F.lit(k).cast(column.data_type()) for k in taken])
    found = F.array_position(keys, value).cast("int")
    swapped = F.element_at(F.array(*[F.lit(k) for k in spare]), F.greatest(found, F.lit(1)))
    return F.when(found > 0, swapped.cast(column.data_type())).otherwise(value)


def _spare_keys(taken: list[int], column: ColumnSpec, rows: int, draws: Draws) -> list[int]:
    """As many keys that no position below ``rows`` uses."""
    low, size = key_domain(column, rows)
    known = set(taken)
    step, shift = step_for(size), draws.seed % size
    spare, position = [], rows
    while len(spare) < len(taken):
        key = low + (position * step + shift) % size if position < size else max(low + size, taken[-1] + 1) + position - size
        if key not in known:
            spare.append(key)
        position += 1
    return spare


def redrawn(rows: DataFrame, spec: TableSpec, total: int, options: GenerateOptions, names: Sequence[str], position: str = POSITION) -> DataFrame:
    """Generate the named columns of existing rows anew, with the draws of ``options``.

    What a repetition rule pins stays pinned, and its constant columns stay as they are in its rows.
    """
    blocks = lay_out(spec, list(options.rules))
    given = rows
    if blocks.tabled:
        known = rule_table(rows.sparkSession, blocks, options.seed).select(F.col("rule").alias(RULE), PINS, CONSTANT)
        given = lookup(rows, known, [RULE], len(blocks.rules))
    given, chosen = _with_long_combinations(given, spec, options, blocks, position)
    draws = SharedDraws(options.seed, spec.name, options.algorithm)
    columns, _ = row_columns(spec, options, F.col(position), total, draws, chosen)
    hashed = given.select("*", *draws.digest_columns())
    out = []
    for name in rows.columns:
        if name not in names:
            out.append(F.col(name))
            continue
        value = columns[name]
        if blocks.tabled:
            value = F.when(F.coalesce(F.array_contains(CONSTANT, F.lit(name.lower())), F.lit(False)), F.col(name)).otherwise(value)
        elif constant := [i for i, r in enumerate(options.rules) if name.lower() in map(str.lower, r.constant)]:
            value = F.when(F.col(RULE).isin(constant), F.col(name)).otherwise(value)
        out.append(value.alias(name))
    return hashed.select(*out)


def planned_rows(spec: TableSpec, rows: int, options: GenerateOptions) -> int:
    """max(N, rule rows), within the capacity of every key that takes no nulls; a table without columns has no rows."""
    if not spec.columns:
        return 0
    wanted = max(rows, lay_out(spec, list(options.rules)).total)
    scale = options.values.numeric_scale
    binding = [k for k in spec.unique_keys if not any(spec.column(c).nullable or c in options.excluded for c in k)]
    return min(key_capacity(spec, wanted, k, scale) for k in [spec.primary_key, *binding])


def _with_long_combinations(
    rows: DataFrame, spec: TableSpec, options: GenerateOptions, blocks, position: str
) -> tuple[DataFrame, dict[int, Column]]:
    """Rows with the combinations of long rules beside them, as columns, and those as structs by rule number."""
    long = [n for n, rule in enumerate(spec.combinations) if len(rule.combinations) > combos_.INLINE]
    if not long:
        return rows, {}
    pinned, chosen = pinned_columns(blocks, F.col(RULE), options.seed, options.values.numeric_scale), {}
    draws = Draws(options.seed, spec.name, options.algorithm)
    for number in long:
        rule, prefix = spec.combinations[number], f"_combo{number}_"
        fixed = {c: (pinned[c].is_set, pinned[c].text) for c in rule.columns if c in pinned}
        table = combos_.combination_rows(rows.sparkSession, rule)
        rows = combos_.attach_combinations(rows, table, list(rule.columns), draws, F.col(position), fixed, prefix)
        chosen[number] = F.struct(*[F.col(f"{prefix}{i}").alias(f"c{i}") for i in range(len(rule.columns))])
    return rows, chosen


def _with_rules(positions: DataFrame, blocks, options: GenerateOptions, position: str, all_of: int | None) -> DataFrame:
    """Positions with the number of their rule, and what it sets where rules are a table.

    With ``all_of`` the positions are 0 to below that number: those of rules are made from the rules' side and
    the rest is added, without a join. Given positions are joined, one row of rules each.
    """
    if not blocks.tabled:
        return positions.select("*", blocks.rule_of(F.col(position)).alias(RULE))
    made = rule_rows(rule_table(positions.sparkSession, blocks, options.seed), position, RULE)
    if all_of is None:
        return lookup(positions, made, [position], blocks.total, even=True)
    free = positions.where(F.col(position) >= blocks.total)
    none = [F.lit(None).cast(kind).alias(name) for name, kind in made.dtypes if name != position]
    return made.where(F.col(position) < all_of).unionByName(free.select(position, *none))


def generate_over(
    positions: DataFrame, spec: TableSpec, rows: int, options: GenerateOptions, position: str = POSITION, all_of: int | None = None
) -> DataFrame:
    """Fill the table's columns next to existing row positions 0..rows-1."""
    blocks = lay_out(spec, list(options.rules))
    ruled = _with_rules(positions, blocks, options, position, all_of)
    ruled, chosen = _with_long_combinations(ruled, spec, options, blocks, position)
    draws = SharedDraws(options.seed, spec.name, options.algorithm)
    columns, _ = row_columns(spec, options, F.col(position), rows, draws, chosen)
    hashed = ruled.select("*", *draws.digest_columns())
    key = spec.primary_key[0] if len(spec.primary_key) == 1 else None
    pins = pinned_columns(blocks, F.col(RULE), options.seed, options.values.numeric_scale) if blocks.tabled and key else {}
    named = [c.alias(n) for n, c in columns.items()]
    texts = phrase_columns(spec, options) if options.vocabulary is not None else []
    if texts:
        return _with_phrases(hashed, spec, options, blocks, position, columns, texts)
    if key not in pins or key in spec.fk_columns or not is_countable(spec.column(key)):
        return hashed.select(F.col(position), F.col(RULE), *named)
    # Generated keys that a rule has pinned elsewhere are swapped for keys no position uses.
    column = spec.column(key)
    taken = _pinned_keys(blocks, column)
    swaps = list(zip(taken, _spare_keys(taken, column, rows, draws), strict=True))
    table = positions.sparkSession.createDataFrame(swaps, "_taken bigint, _spare bigint")
    filled = hashed.select(F.col(position), F.col(RULE), pins[key].is_set.alias("_given"), *named).withColumn("_taken", F.col(key).cast("bigint"))
    spared = lookup(filled, table, ["_taken"], len(swaps))
    kind = column.data_type(options.values.numeric_scale)
    own = F.when(F.col("_given"), F.col(key)).otherwise(F.coalesce(F.col("_spare").cast(kind), F.col(key))).alias(key)
    return spared.select(F.col(position), F.col(RULE), *[own if c == key else F.col(c) for c in columns])


def phrase_columns(spec: TableSpec, options: GenerateOptions) -> list[ColumnSpec]:
    """Text columns that hold words and no key, list, code or address."""
    keyed = {spec.column(c).name for key in (spec.primary_key, *spec.unique_keys) for c in key}
    keyed |= {spec.column(c).name for rule in spec.combinations for c in rule.columns if spec.has_column(c)}
    keyed |= {*spec.fk_columns, *options.excluded, *options.soft_delete}
    return [c for c in spec.columns if c.is_text and not c.uuid and not c.allowed and c.name not in keyed and holds_words(c)]


def _with_phrases(
    hashed: DataFrame, spec: TableSpec, options: GenerateOptions, blocks, position: str, columns: Mapping[str, Column], texts: list[ColumnSpec]
) -> DataFrame:
    """Free texts from the vocabulary. Nulls stay null, and what a rule pins or holds constant stays as it is."""
    pins = pinned_columns(blocks, F.col(RULE), options.seed, options.values.numeric_scale)
    stay = []
    for i, c in enumerate(texts):
        held = F.lit(False)
        if any(c.name.lower() in map(str.lower, r.constant) for r in blocks.rules):
            held = F.col(RULE).isNotNull()
        stay.append((held | (pins[c.name].is_set if c.name in pins else F.lit(False))).alias(f"_stay{i}"))
    df = hashed.select(F.col(position), F.col(RULE), *[c.alias(n) for n, c in columns.items()], *stay)
    draws = Draws(options.seed, spec.name, options.algorithm)
    for i, c in enumerate(texts):
        df = attach_phrases(df.withColumnRenamed(c.name, "_plain"), position, options.vocabulary, draws, c.name)
        made = fit_length(F.col(c.name), c.length, c.type == "char")
        keep = F.col(f"_stay{i}") | F.col("_plain").isNull()
        df = df.withColumn(c.name, F.when(keep, F.col("_plain")).otherwise(made)).drop("_plain")
    return df.select(position, RULE, *columns)


def generate_table(spark: SparkSession, spec: TableSpec, rows: int, options: GenerateOptions | None = None) -> DataFrame:
    """N rows of one table, with ``_idx`` and ``_rule_id`` beside the columns."""
    options = options or GenerateOptions()
    total = planned_rows(spec, rows, options)
    positions = spark.range(total).withColumnRenamed("id", POSITION)
    return generate_over(positions, spec, total, options, all_of=total)
