"""Schema facts read from the data: column profiles, keys, references and value domains."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from itertools import combinations
from math import inf, isqrt, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.quality import WHOLE, common_type

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
# Sketches of 4096 buckets err by 1.6 %; a key's estimate stays above this share of the rows.
SKETCH_BITS, SKETCH_SHARE = 12, 0.8
SKETCHES = 200
# Families of exact numbers, which may refer to each other.
NUMBERS = {"integer", "decimal"}
THETA_BITS = 12
# About so many rows make up the first slice in which a tuple is looked at; later slices are this many times larger.
SLICE_ROWS, SLICE_STEP = 1 << 14, 16
# A scan carries up to so many tuples side by side.
TUPLES = 40
# So many keys share a word of bits.
WORD = 62
# Up to so many columns all tuples are looked at; wider ones only while a table has no primary key yet.
NARROW = 2


def _estimate(value: Column) -> Column:
    """Estimated number of distinct values; one binary sketch per column."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(SKETCH_BITS)))


def _hashed(*columns: str) -> Column:
    """A hash of the values, null when one of them is."""
    present = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])
    return F.when(present, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    return kind.typeName()


def _key_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _comparable(f.dataType)]


def _comparable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))


def profile_columns(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, longest text, largest scale, UUID share.

    Sizes come from one scan. Exact distinct counts take a second one: each cell becomes its
    column's number and a 128-bit digest, equal ones meet in their task first, and one exchange
    of those counts all columns. With ``exact=False`` a sketch in the first scan replaces them.
    """
    fields = [f for f in df.schema.fields if _comparable(f.dataType)]
    aggs: list[Column] = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        value = F.col(f"`{f.name}`")
        aggs.append(F.count(value).alias(f"c{i}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.max(F.length(value)).alias(f"l{i}"))
            aggs.append(F.count_if(value.rlike(UUID_PATTERN)).alias(f"u{i}"))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            digits = F.regexp_extract(value.cast("string"), r"^-?\d+\.(\d*?)0*$", 1)
            aggs.append(F.max(F.length(digits)).alias(f"s{i}"))
        if not exact:
            aggs.append(_estimate(_hashed(f.name)).alias(f"d{i}"))
    totals = df.agg(*aggs)
    have = set(totals.columns)
    lines = []
    for i, f in enumerate(fields):
        scale = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else None
        lines.append(F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(_family(f.dataType)).alias("type_family"),
            F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"c{i}")).alias("n_nulls"),
            (F.lit(None) if exact else F.col(f"d{i}")).cast("bigint").alias("n_distinct"),
            (F.col(f"l{i}") if f"l{i}" in have else F.lit(None)).cast("int").alias("max_length"),
            (F.col(f"s{i}") if f"s{i}" in have else F.lit(scale)).cast("int").alias("max_scale"),
            (((F.col(f"u{i}") == F.col(f"c{i}")) & (F.col(f"c{i}") > 0)) if f"u{i}" in have else F.lit(False)).alias("is_uuid"),
        ))
    facts = totals.select(F.explode(F.array(*lines)).alias("r")).select(F.lit(table).alias("table_name"), "r.*")
    if not exact:
        return facts
    # One row per column on either side.
    return facts.join(F.broadcast(_distinct_values(df, fields)), "column_name").withColumn("n_distinct", F.col("d")).select(*facts.columns)


def _distinct_values(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(column_name, d): how many values each column has."""
    cells = []
    for i, f in enumerate(fields):
        value = F.col(f"`{f.name}`")
        both = F.struct(F.lit(i).alias("c"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(i), value, value).alias("b"))
        cells.append(F.when(value.isNotNull(), both))
    distinct = df.select(F.explode(F.array(*cells)).alias("x")).where("x is not null").select("x.*").distinct()
    named = F.element_at(F.lit([f.name for f in fields]), F.col("c") + 1).alias("column_name")
    # A column without values has no cell; it still gets its line.
    bare = df.sparkSession.createDataFrame([(i, 0) for i in range(len(fields))], "c int, d bigint")
    found = distinct.groupBy("c").agg(F.count("*").alias("d")).unionByName(bare)
    return found.groupBy("c").agg(F.sum("d").alias("d")).select(named, "d")


def column_domains(df: DataFrame, table: str, columns: Sequence[str], max_values: int) -> DataFrame:
    """(table, column, value) for the columns with at most ``max_values`` distinct values.

    Values are counted before they move, so a frequent value costs one row per task. The
    sketch only sorts out; the limit itself is tested on exact counts.
    """
    # Sketches drop the columns that are far over the limit, so their values never move.
    seen = df.agg(*[_estimate(_hashed(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return _few_values(df, table, [c for i, c in enumerate(columns) if (seen[f"d{i}"] or 0) * SKETCH_SHARE <= max_values], max_values)


def _few_values(df: DataFrame, table: str, columns: Sequence[str], max_values: int) -> DataFrame:
    """The values of the columns, all of which are counted, where they are no more than ``max_values``."""
    if not columns:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, value string, n bigint")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counted = df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    small = counted.groupBy("column_name").agg(F.count("*").alias("d")).where(F.col("d") <= max_values)
    return counted.join(F.broadcast(small.select("column_name")), "column_name", "left_semi").select(
        F.lit(table).alias("table_name"), "column_name", "value", "n"
    )


def numeric_ranges(df: DataFrame, table: str) -> DataFrame:
    """(table, column, min, max) of the numeric columns, in one scan."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not names:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, min_value double, max_value double")
    totals = df.agg(*[g(c).cast("double").alias(f"{k}{i}") for i, c in enumerate(names) for k, g in (("a", F.min), ("b", F.max))])
    lines = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value"))
        for i, c in enumerate(names)
    ]
    return totals.select(F.explode(F.array(*lines)).alias("r")).select(F.lit(table).alias("table_name"), "r.*")


def _digests(columns: Sequence[str | Column]) -> list[Column]:
    """Two 64-bit hashes of a tuple, null when one of its values is."""
    values = [F.col(f"`{c}`") if isinstance(c, str) else c for c in columns]
    present = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return [F.when(present, F.xxhash64(*[F.lit(salt), *values])) for salt in (1, 2)]


def _in_slice(df: DataFrame, candidates: Sequence[tuple[str, ...]], chosen: Sequence[Column] | None = None) -> dict[tuple[str, ...], tuple[int, int]]:
    """How many different tuples each candidate has among rows without nulls, and how often the most frequent one occurs.

    A tuple moves as a 128-bit digest, however long its values are, and is counted before it moves. With ``chosen``,
    a test for each candidate, only rows that pass it are looked at.
    """
    found = {}
    for start in range(0, len(candidates), TUPLES):
        part = candidates[start : start + TUPLES]
        tests = chosen[start : start + TUPLES] if chosen is not None else [F.lit(True)] * len(part)
        lines = []
        for i, (columns, test) in enumerate(zip(part, tests, strict=True)):
            one, two = _digests(columns)
            lines.append(F.when(test & one.isNotNull(), F.struct(F.lit(i).alias("key"), one.alias("a"), two.alias("b"))))
        # Most rows have no tuple that is looked at and are dropped before anything is built.
        met = df.where(reduce(lambda a, b: a | b, {id(t): t for t in tests}.values()))
        tuples = met.select(F.explode(F.array(*lines)).alias("r")).where("r is not null").select("r.*")
        counted = tuples.groupBy("key", "a", "b").agg(F.count("*").alias("n"))
        seen = {r["key"]: (r["d"], r["most"]) for r in counted.groupBy("key").agg(F.count("*").alias("d"), F.max("n").alias("most")).collect()}
        found |= {c: seen.get(i, (0, 0)) for i, c in enumerate(part)}
    return found


def _sliced(columns: Sequence[str], slices: int) -> list[Column] | None:
    """A test for each column whether its value is in one slice of the hashes; ``slices`` is a power of two."""
    tests = {c: F.coalesce(_digests([c])[0].bitwiseAND(F.lit(slices - 1).cast("bigint")) == 0, F.lit(False)) for c in columns}
    return None if slices == 1 else [tests[c] for c in columns]


def _without_duplicates(df: DataFrame, candidates: Sequence[tuple[str, ...]], slices: int = 1, anchors: Sequence[str] = ()) -> list[tuple[str, ...]]:
    """The candidates whose values never repeat among rows without nulls.

    With ``slices``, a power of two, only rows are looked at whose value in one column of the tuple, its anchor, falls
    into one slice of the hashes. Equal tuples have equal anchors, so what repeats there is no key; what does not may
    still repeat elsewhere.
    """
    seen = _in_slice(df, candidates, _sliced(anchors, slices) if slices > 1 else None)
    return [c for c in candidates if seen[c][1] <= 1]


def _without_any_duplicates(df: DataFrame, candidates: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """As ``_without_duplicates`` over all rows, for candidates that repeat hardly or not at all.

    A tuple moves as 64 bits. Where those repeat, which is seldom, the rows in question are counted by 128 bits.
    """
    suspect: dict[int, list[int]] = {}
    for start in range(0, len(candidates), TUPLES):
        part = candidates[start : start + TUPLES]
        hashes = [_digests(columns)[0] for columns in part]
        if len(part) == 1:
            tuples = df.select(F.lit(0).alias("key"), hashes[0].alias("a"))
        else:
            lines = [F.struct(F.lit(i).alias("key"), one.alias("a")) for i, one in enumerate(hashes)]
            tuples = df.select(F.explode(F.array(*lines)).alias("r")).select("r.*")
        counted = tuples.where("a is not null").groupBy("key", "a").agg(F.count("*").alias("n"))
        for r in counted.where("n > 1").groupBy("key").agg(F.collect_list("a").alias("a")).collect():
            suspect[start + r["key"]] = r["a"]
    doubted = [candidates[i] for i in suspect]
    values = list(suspect.values())
    seen = _in_slice(df, doubted, [F.coalesce(_digests(c)[0].isin(v), F.lit(False)) for c, v in zip(doubted, values, strict=True)])
    return [c for c in candidates if c not in seen or seen[c][1] <= 1]


@dataclass(frozen=True)
class Keys:
    """Column tuples without duplicates: ``primary`` has no nulls either, ``unique`` may have some."""

    primary: list[tuple[str, ...]]
    unique: list[tuple[str, ...]]
    # How many tuples were counted over all rows, and how many were looked at.
    counted: int = 0
    sketched: int = 0
    # Every column has so many values at least.
    least: Mapping[str, int] = field(default_factory=dict)


class _Lattice:
    """Tuples of a table that were looked at."""

    def __init__(self, df: DataFrame, rows: int) -> None:
        self.df, self.rows = df, rows
        # Powers of two. Single columns are measured in a larger slice, about 32 times the root of the rows.
        self.slices = 1 << max(0, (rows - 1) // SLICE_ROWS).bit_length()
        self.broad = min(self.slices, 1 << max(0, (isqrt(rows) // 32).bit_length() - 1))
        self.sizes: dict[tuple[str, ...], int] = {}
        # No single column has more values, or fewer; those measured, and of them those that repeat.
        self.most: dict[tuple[str, ...], float] = {}
        self.least: dict[tuple[str, ...], int] = {}
        self.measured: set[tuple[str, ...]] = set()
        self.repeated: set[tuple[str, ...]] = set()
        self.counted = 0

    def keys_among(self, candidates: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
        """Larger and larger slices sort out what repeats; all rows are counted for what they leave."""
        left = self._sifted(candidates)
        return left if self.slices == 1 else self._in_all_rows(left)

    def first_key(self, candidates: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
        """The first of the candidates that is a key."""
        for c in self._sifted(candidates):
            if self.slices == 1 or self._in_all_rows([c]):
                return [c]
        return []

    def _sifted(self, candidates: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
        left = self.promising(candidates)
        slices = (self.broad if self.measured.issuperset(left) else self.slices) // SLICE_STEP
        while left and slices > 1:
            left = _without_duplicates(self.df, left, slices, self.anchors(left))
            slices //= SLICE_STEP
        return left

    def anchors(self, candidates: Sequence[tuple[str, ...]]) -> list[str]:
        """The column of each tuple with the most values, as far as known."""
        return [max(c, key=lambda name: self.least.get((name,), 0)) for c in candidates]

    def _in_all_rows(self, left: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        self.counted += len(left)
        return _without_any_duplicates(self.df, left)

    def promising(self, candidates: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
        """The candidates with values, none of which repeats in the first slice; that is all rows of a small table."""
        self._measure([c for c in candidates if c not in self.sizes or len(c) == 1 and c not in self.most])
        left = [c for c in candidates if self.sizes[c] and self.most.get(c, inf) >= self.sizes[c] and c not in self.repeated]
        fresh = [c for c in left if c not in self.measured]
        kept = {*_without_duplicates(self.df, fresh, self.slices, self.anchors(fresh))} | self.measured
        left = [c for c in left if c in kept]
        self.counted += len(left) if self.slices == 1 else 0
        return left

    def _measure(self, fresh: list[tuple[str, ...]]) -> None:
        """Rows without nulls; values of single columns in a slice. Tuples of full columns need no scan."""
        self.sizes |= _filled(self.df, [c for c in fresh if len(c) == 1 and c not in self.sizes])
        single = [c for c in fresh if len(c) == 1 and self.sizes[c]]
        for c, (values, times) in _in_slice(self.df, single, _sliced([c for (c,) in single], self.broad)).items():
            # So few in a slice that is 1 of ``broad`` have a chance below 1e-12 if there are more values than this.
            self.most[c] = values if self.broad == 1 else self.broad * (values + 7 * sqrt(values) + 32)
            self.least[c] = values
            self.measured.add(c)
            if times > 1:
                self.repeated.add(c)
        self.most |= {c: 0 for c in fresh if len(c) == 1 and c not in self.most}
        wide = [c for c in fresh if len(c) > 1]
        gaps = [c for c in wide if any(self.sizes[x,] < self.rows for x in c)]
        self.sizes |= {c: self.rows for c in wide} | _filled(self.df, gaps)

    def reaches(self, columns: tuple[str, ...], rows: int) -> bool:
        """Whether the columns have enough values between them to tell all rows apart."""
        product = 1.0
        for c in columns:
            product *= max(1.0, self.most[c,])
            if product >= rows:
                return True
        return False


def discover_keys(df: DataFrame, max_columns: int = NARROW, unique_columns: int | None = None) -> Keys:
    """Candidate keys of up to ``max_columns`` columns of any comparable type.

    Single columns and pairs are all looked at: a slice of all tuples rules out what repeats in it, and bounds how many
    values a column has; only the rest is counted over all rows. A tuple that holds a key is not tried, nor one whose columns have too few values
    between them. Wider keys are looked for only while there is no primary key, from the top of the lattice: if all
    columns without nulls together are no key, no tuple is; a column without which the others are no key is part of
    every key. The search starts from those columns and adds others one width at a time, so a wide key is found
    without its many narrower tuples.
    """
    names = _key_columns(df)
    seen = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    rows = seen["n"]
    lattice = _Lattice(df, rows)
    lattice.sizes |= {(c,): seen[f"c{i}"] for i, c in enumerate(names)}
    unique = lattice.keys_among([(c,) for c in names])
    if max_columns > 1:
        # With nulls in a column, fewer values may do.
        filled = {c for c in names if lattice.sizes[c,] == rows}
        pairs = [p for p in combinations(names, 2) if not _holds(p, unique) and (not set(p) <= filled or lattice.reaches(p, rows))]
        if unique_columns is None or unique_columns >= NARROW:
            unique += lattice.keys_among(pairs)
        elif not any(lattice.sizes[k] == rows for k in unique):
            unique += lattice.first_key([p for p in pairs if set(p) <= filled])
    if max_columns > NARROW and rows:
        unique += _wide_keys(lattice, [c for c in names if lattice.sizes[c,] == rows], unique, rows, max_columns)
    full = [k for k in unique if lattice.sizes[k] == rows]
    return Keys(full, unique, lattice.counted, len(lattice.sizes), {c: lattice.least.get((c,), 0) for c in names})


def _wide_keys(lattice: _Lattice, filled: list[str], known: list[tuple[str, ...]], rows: int, max_columns: int) -> list[tuple[str, ...]]:
    if any(lattice.sizes[k] == rows for k in known) or len(filled) <= NARROW or not lattice.keys_among([tuple(filled)]):
        return []
    without = [tuple(c for c in filled if c != left_out) for left_out in filled]
    spare = {next(c for c in filled if c not in k) for k in lattice.promising(without)}
    needed = tuple(c for c in filled if c not in spare)
    rest = [c for c in filled if c in spare]
    for width in range(max(NARROW + 1, len(needed)), max_columns + 1):
        order = {c: i for i, c in enumerate(filled)}
        found = [tuple(sorted((*needed, *more), key=order.get)) for more in combinations(rest, width - len(needed))]
        keys = lattice.keys_among([k for k in found if lattice.reaches(k, rows)])
        if keys:
            return keys
    return []


def _holds(columns: tuple[str, ...], keys: Sequence[tuple[str, ...]]) -> bool:
    return any(set(k) <= set(columns) for k in keys)


def _filled(df: DataFrame, candidates: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Rows without nulls per candidate."""
    found = {}
    for start in range(0, len(candidates), SKETCHES):
        part = candidates[start : start + SKETCHES]
        whole = [reduce(lambda a, b: a & b, [F.col(f"`{x}`").isNotNull() for x in c]) for c in part]
        seen = df.agg(*[F.count_if(w).alias(f"c{i}") for i, w in enumerate(whole)]).first()
        found |= {c: seen[f"c{i}"] for i, c in enumerate(part)}
    return found


def _same_kind(child: DataFrame, column: str, parent: DataFrame, key: str) -> bool:
    kinds = {_family(child.schema[column].dataType), _family(parent.schema[key].dataType)}
    return len(kinds) == 1 or kinds == NUMBERS


def _ranges(tables: Mapping[str, DataFrame], wanted: Callable[[str, str], bool]) -> dict[tuple[str, str], tuple]:
    """(family, min, max) per wanted key-like column; one job over all tables."""
    parts = []
    for name, df in tables.items():
        for kind, cast in (("integer", "bigint"), ("text", "string")):
            cols = [c for c in _key_columns(df) if wanted(name, c) and (_family(df.schema[c].dataType) == "integer") == (kind == "integer")]
            if not cols:
                continue
            lows = df.agg(*[a for i, c in enumerate(cols) for a in (F.min(c).cast(cast).alias(f"a{i}"), F.max(c).cast(cast).alias(f"b{i}"))])
            number = [F.struct(F.lit(c).alias("c"), *[
                (F.col(f"{s}{i}") if kind == k else F.lit(None)).cast(t).alias(f"{s}_{k}")
                for k, t in (("integer", "bigint"), ("text", "string")) for s in ("a", "b")
            ]) for i, c in enumerate(cols)]
            parts.append(lows.select(F.explode(F.array(*number)).alias("r")).select(F.lit(name).alias("t"), "r.*"))
    found = {}
    for r in reduce(DataFrame.unionByName, parts).collect() if parts else []:
        family = _family(tables[r["t"]].schema[r["c"]].dataType)
        kind = "integer" if family == "integer" else "text"
        low, high = r[f"a_{kind}"], r[f"b_{kind}"]
        if family in ("decimal", "double", "float") and low is not None:
            low, high = (Decimal(x) if family == "decimal" else float(x) for x in (low, high))
        found[r["t"], r["c"]] = (family, low, high)
    return found


def discover_references(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]],
    tried: Callable[[str, str, str, str], bool] = lambda child, column, parent, key: True,
) -> DataFrame:
    """Columns whose values all occur in another table's key: (child, column, parent, key, coverage, one_to_one).

    ``coverage`` is the share of parent keys in use. Dense integer keys include each other by
    chance, so these are candidates to rank, not references to enforce. Pairs of different
    type or with values outside the key's range are dropped first, as are those ``tried`` turns down. All remaining pairs are
    tested in one pass: every child value once, joined to the list of keys that hold it, which
    is as short as the schema.
    """
    spark = next(iter(tables.values())).sparkSession
    ends = [(parent, key) for parent, parent_keys in keys.items() for key in parent_keys]

    def related(child: str, column: str) -> bool:
        family = _family(tables[child].schema[column].dataType)
        others = [(p, k) for p, k in ends if (p, k) != (child, column) and tried(child, column, p, k)]
        return any(f == family or {f, family} == NUMBERS for f in (_family(tables[p].schema[k].dataType) for p, k in others))

    ranges = _ranges(tables, lambda name, column: (name, column) in ends or related(name, column))
    pairs: dict[str, list[tuple[tuple[str, str], tuple[str, str]]]] = {}
    for child, (family, low, high) in ranges.items():
        for parent, parent_keys in keys.items():
            for key in parent_keys:
                other, first, last = ranges[parent, key]
                if child != (parent, key) and tried(*child, parent, key) and (family == other or {family, other} == NUMBERS) and low is not None and first is not None and low >= first and high <= last:
                    pairs.setdefault(family if family == other else "decimal", []).append((child, (parent, key)))
    empty = spark.createDataFrame(
        [], "child_table string, child_column string, parent_table string, parent_column string, coverage double, one_to_one boolean"
    )
    return reduce(DataFrame.unionByName, [_included(tables, found) for found in pairs.values()], empty)


def _included(tables: Mapping[str, DataFrame], pairs: list[tuple[tuple[str, str], tuple[str, str]]]) -> DataFrame:
    children = list(dict.fromkeys(c for c, _ in pairs))
    parents = list(dict.fromkeys(p for _, p in pairs))
    cast = reduce(common_type, [tables[t].schema[c].dataType for t, c in dict.fromkeys([*children, *parents])])
    cast = T.LongType() if isinstance(cast, WHOLE) else cast

    # Texts move as digests, however long they are. Every column is read by itself, as columnar files hold it.
    value = lambda c: F.md5(F.col(c)) if isinstance(cast, T.StringType) else F.col(c).cast(cast)

    def stacked(columns: list[tuple[str, str]], marks: Callable[[int], list[Column]]) -> DataFrame:
        """Marks and value of the columns, below each other."""
        parts = [tables[t].select(*marks(i), value(c).alias("v")) for i, (t, c) in enumerate(columns)]
        return reduce(DataFrame.unionByName, parts).where("v is not null")

    used = stacked(children, lambda i: [F.lit(i).alias("child")]).groupBy("child", "v").agg(F.count("*").alias("n"))
    # The keys that hold a value, as bits.
    words = range(-(-len(parents) // WORD))
    bit = lambda i: 1 << (i % WORD)
    marked = stacked(parents, lambda i: [F.lit(bit(i) if i // WORD == k else 0).cast("bigint").alias(f"w{k}") for k in words])
    holders = marked.groupBy("v").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in words])
    held = [F.count_if(F.col(f"w{i // WORD}").bitwiseAND(F.lit(bit(i)).cast("bigint")) != 0).alias(f"p{i}") for i in range(len(parents))]
    numbers = F.array(*[F.struct(F.lit(i).alias("parent"), F.col(f"p{i}").alias("total")) for i in range(len(parents))])
    totals = holders.agg(*held).select(F.explode(numbers).alias("r")).select("r.*").where("total > 0")
    wanted = [[parents.index(p) for c, p in pairs if c == child] for child in children]
    tested = used.join(holders, "v", "left").select(
        "child", "n", F.array(*[f"w{k}" for k in words]).alias("words"), F.explode(F.element_at(F.lit(wanted), F.col("child") + 1)).alias("parent")
    )
    word = F.element_at("words", F.call_function("div", F.col("parent"), F.lit(WORD)).cast("int") + 1)
    own = F.element_at(F.lit([bit(i) for i in range(len(parents))]).cast("array<bigint>"), F.col("parent") + 1)
    summed = tested.groupBy("child", "parent").agg(
        F.count_if(F.coalesce(word.bitwiseAND(own) == 0, F.lit(True))).alias("lost"), F.count("*").alias("used"), F.max("n").alias("most"),
    )
    named = [F.element_at(F.lit([c[k] for c in children]), F.col("child") + 1) for k in (0, 1)]
    keyed = [F.element_at(F.lit([p[k] for p in parents]), F.col("parent") + 1) for k in (0, 1)]
    return summed.where("lost = 0").join(F.broadcast(totals), "parent").select(
        named[0].alias("child_table"), named[1].alias("child_column"), keyed[0].alias("parent_table"), keyed[1].alias("parent_column"),
        (F.col("used") / F.col("total")).alias("coverage"), (F.col("most") == 1).alias("one_to_one"),
    )


def discover_composite_references(
    tables: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]],
    tried: Callable[[str, str, str, str], bool] = lambda child, column, parent, key: True,
) -> DataFrame:
    """Column tuples whose values all occur in another table's key of several columns, whatever the columns are called.

    (child, columns, parent, key, coverage, one_to_one), tuples in the order of the key. The search goes up a
    level at a time: a tuple is only looked at if every column is included in its key column by itself, and a
    longer one only if its first columns are included together, as far as theta sketches of both sides tell: a tuple
    that the parent's sketch would hold and does not is missing there for certain, whatever the sizes of the two.
    What the sketches leave is tested exactly, in one pass over digests.
    """
    spark = next(iter(tables.values())).sparkSession
    empty = spark.createDataFrame(
        [], "child_table string, child_columns string, parent_table string, parent_columns string, coverage double, one_to_one boolean"
    )
    keys = {p: tuple(k) for p, k in keys.items() if len(k) > 1}

    def served(child: str, parent: str) -> bool:
        """Whether every column of the key has a column of the child to be compared with; else no tuple can be held."""
        return child != parent and all(
            any(_same_kind(tables[child], c, tables[parent], k) and tried(child, c, parent, k) for c in _key_columns(tables[child])) for k in keys[parent]
        )

    pairs = {(child, parent) for child in tables for parent in keys if served(child, parent)}
    keys = {p: k for p, k in keys.items() if p in {parent for _, parent in pairs}}
    if not keys:
        return empty
    single = discover_references(
        tables, keys, lambda child, column, parent, key: (child, parent) in pairs and tried(child, column, parent, key)
    ).collect()
    fits: dict[tuple[str, str, str], list[str]] = {}
    for r in single:
        if r["child_table"] != r["parent_table"]:
            fits.setdefault((r["child_table"], r["parent_table"], r["parent_column"]), []).append(r["child_column"])
    level = [
        (child, parent, (column,)) for child in tables for parent, key in keys.items() if child != parent
        for column in sorted(fits.get((child, parent, key[0]), []))
    ]
    found = []
    while level:
        longer = [
            (child, parent, (*columns, more)) for child, parent, columns in level
            for more in sorted(fits.get((child, parent, keys[parent][len(columns)]), [])) if more not in columns
        ]
        held = _sketched_inclusions(tables, keys, longer)
        found += [c for c in held if len(c[2]) == len(keys[c[1]])]
        level = [c for c in held if len(c[2]) < len(keys[c[1]])]
    if not found:
        return empty
    made, exact, named = dict(tables), [], {}
    for i, (child, parent, columns) in enumerate(found):
        own, whole = _tuple_digests(tables, child, columns, parent, keys[parent])
        made[child] = made[child].withColumn(f"_child{i}", own)
        made[parent] = made[parent].withColumn(f"_parent{i}", whole)
        exact.append(((child, f"_child{i}"), (parent, f"_parent{i}")))
        named[f"_child{i}"] = (",".join(columns), ",".join(keys[parent]))
    name = F.create_map(*[F.lit(x) for c, (columns, _) in named.items() for x in (c, columns)])
    key_name = F.create_map(*[F.lit(x) for c, (_, key) in named.items() for x in (c, key)])
    return _included(made, exact).select(
        "child_table", F.element_at(name, F.col("child_column")).alias("child_columns"), "parent_table",
        F.element_at(key_name, F.col("child_column")).alias("parent_columns"), "coverage", "one_to_one",
    )


def _tuple_digests(
    tables: Mapping[str, DataFrame], child: str, columns: Sequence[str], parent: str, key: Sequence[str]
) -> tuple[Column, Column]:
    """A 128-bit digest of a child's tuple and of a parent's, equal for equal values of comparable types."""
    sides: tuple[list[Column], list[Column]] = ([], [])
    for c, k in zip(columns, key, strict=False):
        kind = common_type(tables[child].schema[c].dataType, tables[parent].schema[k].dataType)
        for side, column in zip(sides, (c, k), strict=True):
            text = F.col(f"`{column}`").cast(kind).cast("string")
            side += [F.length(text).cast("string"), text]
    made = []
    for side in sides:
        present = reduce(lambda a, b: a & b, [v.isNotNull() for v in side])
        made.append(F.when(present, F.md5(F.concat_ws("|", *side))))
    return made[0], made[1]


def _sketched_inclusions(
    tables: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]], candidates: Sequence[tuple[str, str, tuple[str, ...]]]
) -> list[tuple[str, str, tuple[str, ...]]]:
    """The candidates that have tuples, none of which the parent is seen to lack; one scan a table, sketches alone move."""
    wanted: dict[str, list[Column]] = {}
    for i, (child, parent, columns) in enumerate(candidates):
        own, whole = _tuple_digests(tables, child, columns, parent, keys[parent][: len(columns)])
        wanted.setdefault(child, []).append(F.theta_sketch_agg(own, F.lit(THETA_BITS)).alias(f"c{i}"))
        wanted.setdefault(parent, []).append(F.theta_sketch_agg(whole, F.lit(THETA_BITS)).alias(f"p{i}"))
    spark = next(iter(tables.values())).sparkSession
    row = spark.range(1)
    for name, sketches in wanted.items():
        for start in range(0, len(sketches), SKETCHES):
            row = row.crossJoin(F.broadcast(tables[name].agg(*sketches[start : start + SKETCHES])))  # one row each
    told = [
        F.struct(
            F.theta_sketch_estimate(f"c{i}").alias("own"), F.theta_sketch_estimate(F.theta_difference(f"c{i}", f"p{i}")).alias("lost")
        ).alias(f"r{i}")
        for i in range(len(candidates))
    ]
    seen = row.select(*told).first() if candidates else {}
    return [c for i, c in enumerate(candidates) if seen[f"r{i}"]["own"] and not seen[f"r{i}"]["lost"]]


DESCRIBED = (
    "table_name string, column_name string, type_family string, is_key boolean, nullable boolean, is_uuid boolean, "
    "min_value double, max_value double, first string, last string"
)
MOMENT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _described(number: int, field: T.StructField) -> list[Column]:
    """What one scan tells of a column: filled rows, a sketch of its values, its limits, its UUIDs."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    out = [F.count(value).alias(f"c{number}"), _estimate(_hashed(field.name)).alias(f"d{number}")]
    ends = (("a", F.min(value)), ("b", F.max(value)))
    if isinstance(kind, T.NumericType):
        out += [end.cast("double").alias(f"{k}{number}") for k, end in ends]
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out += [F.date_format(end, MOMENT).alias(f"{k}{number}") for k, end in ends]
    elif isinstance(kind, T.StringType):
        out.append(F.count_if(value.rlike(UUID_PATTERN)).alias(f"u{number}"))
    return out


def describe_columns(df: DataFrame, table: str, max_values: int = 20) -> DataFrame:
    """One row per comparable column: nullability, limits and value list, as a specification needs them.

    Columns without repeats and nulls are never nullable. Numbers have limits as numbers, dates and times as texts
    with microseconds. The value list is given when at most ``max_values`` values occur, so it is short by
    definition. One scan tells all but keys and value lists; only columns that its sketches leave as possible keys
    or lists are counted exactly.
    """
    fields = [f for f in df.schema.fields if _comparable(f.dataType)]
    if not fields:
        return df.sparkSession.createDataFrame([], f"{DESCRIBED}, allowed array<string>")
    kept = df.select(*[f"`{f.name}`" for f in fields])
    seen = kept.agg(F.count("*").alias("n"), *[a for i, f in enumerate(fields) for a in _described(i, f)]).first().asDict()
    rows, lattice = seen["n"], _Lattice(kept, seen["n"])
    for i, f in enumerate(fields):
        lattice.sizes[f.name,], lattice.most[f.name,] = seen[f"c{i}"], (seen[f"d{i}"] or 0) / SKETCH_SHARE
    able = [(f.name,) for f in fields if _family(f.dataType) in ("integer", "string") and lattice.sizes[f.name,] == rows]
    keys = set(lattice.keys_among(able) if rows else able)
    lines = []
    for i, f in enumerate(fields):
        moment, is_key = not isinstance(f.dataType, T.NumericType), (f.name,) in keys
        ends = [seen.get(f"a{i}"), seen.get(f"b{i}")]
        lines.append((
            table, f.name, _family(f.dataType), is_key, not is_key and seen[f"c{i}"] < rows, 0 < seen[f"c{i}"] == seen.get(f"u{i}"),
            *([None, None, *ends] if moment else [*ends, None, None]),
        ))
    few = [f.name for i, f in enumerate(fields) if (seen[f"d{i}"] or 0) * SKETCH_SHARE <= max_values]
    domains = _few_values(kept, table, few, max_values).groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("allowed"))
    return df.sparkSession.createDataFrame(lines, DESCRIBED).join(domains, "column_name", "left").select(
        "table_name", "column_name", "type_family", "is_key", "nullable", "is_uuid", "min_value", "max_value", "first", "last", "allowed"
    )
