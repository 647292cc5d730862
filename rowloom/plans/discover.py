"""From tables to their specifications: what a generator needs to make such tables again."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.model import ColumnSpec, ForeignKey, TableSpec
from rowloom.operators import checks as texts
from rowloom.operators.discovery import UUID_PATTERN, Keys, discover_composite_references, discover_keys, discover_references
from rowloom.session import side_by_side


def same_name(child: str, column: str, parent: str, key: str) -> bool:
    """Whether the column's name speaks of the key: ``o_custkey`` of ``c_custkey``, ``user_id`` of ``users.id``.

    A prefix of one or two letters before the first underscore counts as the table's mark.
    """
    def stem(name: str) -> str:
        mark, _, rest = name.lower().partition("_")
        return rest if rest and len(mark) <= 2 else name.lower()

    owner = parent.lower()
    singular = owner[:-1] if owner.endswith("s") else owner
    return stem(column) == stem(key) or column.lower() in {f"{owner}_{key.lower()}", f"{singular}_{key.lower()}"}


def discover(
    tables: Mapping[str, DataFrame], checks: DataFrame | None = None, max_values: int = 20, key_columns: int = 3,
    unique_columns: int = 1, tried: Callable[[str, str, str, str], bool] = same_name,
) -> list[TableSpec]:
    """One specification per table, read from its data and, where given, from CHECK texts (table_name, expr).

    The primary key is the first of the shortest candidate keys. Unique keys are taken up to
    ``unique_columns`` columns, since longer ones hold by chance in small tables. A reference is a column whose
    values all occur in another table's primary key and whose pair ``tried`` accepts; of several the one that
    uses most of its parent stays, and of two keys that hold each other the earlier table is the parent.
    References of several columns are found the same way, by their values. Limits are the least and greatest values, text lengths
    the longest ones, and value lists those of text columns with at most ``max_values`` values. An empty table
    gives its columns alone. Only such facts reach the driver: their number follows the schema.
    """
    spark = next(iter(tables.values())).sparkSession
    found = dict(zip(tables, side_by_side(spark, lambda df: discover_keys(df, key_columns, unique_columns), tables.values()), strict=True))
    primary = {name: min(k.primary, key=len) if k.primary else () for name, k in found.items()}
    references = _references(tables, primary, tried)
    unique = {name: tuple(k for k in keys.unique if len(k) <= unique_columns and k != primary[name]) for name, keys in found.items()}
    free = {name: {c for fk in references[name] for c in fk.columns} | {c for k in (primary[name], *unique[name]) for c in k} for name in tables}
    columns = side_by_side(spark, lambda name: _columns(tables[name], free[name], max_values, found[name]), tables)
    specs = [
        TableSpec(name, own, primary[name], tuple(references[name]), unique[name]) for name, own in zip(tables, columns, strict=True)
    ]
    return specs if checks is None else _constrained(specs, checks)


def _columns(df: DataFrame, keyed: set[str], max_values: int, keys: Keys) -> tuple[ColumnSpec, ...]:
    """Every column with the limits its values show; one scan, and two more for the value lists."""
    plain = [ColumnSpec.of(f) for f in df.schema.fields]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(plain):
        value = F.col(f"`{c.name}`")
        aggs.append(F.count(value).alias(f"c{i}"))
        if c.is_numeric:
            # NaN is no limit.
            number = F.when(~F.isnan(value), value) if c.type in ("double", "float") else value
            aggs += [F.min(number).alias(f"a{i}"), F.max(number).alias(f"b{i}")]
        if c.is_text:
            # A line break may follow what the pattern matches.
            uuid = F.length(value).between(36, 38) & value.rlike(UUID_PATTERN)
            aggs += [F.max(F.length(value)).alias(f"l{i}"), F.count_if(uuid).alias(f"u{i}")]
    seen = df.agg(*aggs).first()
    listed = [c.name for c in plain if c.is_text and c.name not in keyed and keys.least.get(c.name, 0) <= max_values]
    allowed = _value_lists(df, listed, max_values) if seen["n"] else {}
    columns = []
    for i, c in enumerate(plain):
        filled = seen[f"c{i}"]
        c = replace(c, nullable=filled < seen["n"] or filled == 0)
        if c.is_numeric and c.name not in keyed:
            c = replace(c, min_value=seen[f"a{i}"], max_value=seen[f"b{i}"])
        if c.is_text:
            uuid = filled > 0 and seen[f"u{i}"] == filled
            c = replace(c, uuid=uuid, length=c.length or seen[f"l{i}"] or 0, allowed=() if uuid else tuple(sorted(allowed.get(c.name, ()))))
        columns.append(c)
    return tuple(columns)


def _value_lists(df: DataFrame, columns: list[str], max_values: int) -> dict[str, list[str]]:
    """The values of the text columns that have no more than ``max_values``; few show so few in a slice and have more.

    Hashes tell how many values a column has, so that no long text is gathered that is in no list.
    """
    named = lambda names, value: [value(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(names)]
    # The hash of null is no value.
    hashed = df.agg(*named(columns, lambda c: F.size(F.collect_set(F.when(c.isNotNull(), F.xxhash64(c)))))).first() if columns else ()
    few = [c for c, n in zip(columns, hashed, strict=True) if 0 < n <= max_values]
    found = df.agg(*named(few, F.collect_set)).first() if few else ()
    return dict(zip(few, found, strict=True))


def _references(
    tables: Mapping[str, DataFrame], primary: Mapping[str, tuple[str, ...]], tried: Callable[[str, str, str, str], bool]
) -> dict[str, list[ForeignKey]]:
    order = {name: i for i, name in enumerate(tables)}
    single = {name: key for name, key in primary.items() if len(key) == 1}
    rows = discover_references(tables, single, tried).collect()
    held = {(r["child_table"], r["child_column"], r["parent_table"], r["parent_column"]) for r in rows}
    best: dict[tuple[str, str], tuple] = {}
    for r in rows:
        child, parent = (r["child_table"], r["child_column"]), (r["parent_table"], r["parent_column"])
        mutual = (*parent, *child) in held and order[child[0]] < order[parent[0]]
        rank = (-r["coverage"], order[parent[0]])
        if not mutual and child[0] != parent[0] and (child not in best or rank < best[child][0]):
            best[child] = (rank, ForeignKey((child[1],), parent[0], (parent[1],), primary[child[0]] == (child[1],)))
    out: dict[str, list[ForeignKey]] = {name: [] for name in tables}
    for (child, _), (_, fk) in best.items():
        out[child].append(fk)
    composite: dict[tuple[str, str], tuple] = {}
    for r in discover_composite_references(tables, {n: k for n, k in primary.items() if len(k) > 1}, tried).collect():
        columns, key = (tuple(r[c].split(",")) for c in ("child_columns", "parent_columns"))
        rank, place = (-r["coverage"], columns), (r["child_table"], r["parent_table"])
        if place not in composite or rank < composite[place][0]:
            composite[place] = (rank, ForeignKey(columns, r["parent_table"], key, set(primary[r["child_table"]]) == set(columns)))
    for (child, parent), (_, fk) in composite.items():
        if (parent, child) in composite and order[child] < order[parent]:
            continue  # two keys that hold each other: the earlier table is the parent
        # Its columns speak of one parent row, so they refer to nothing else by themselves.
        out[child] = [*[other for other in out[child] if not set(other.columns) <= set(fk.columns)], fk]
    return out


def _constrained(specs: list[TableSpec], checks: DataFrame) -> list[TableSpec]:
    spark = checks.sparkSession
    named = [(s.name, c.name, c.length if c.is_text else 0) for s in specs for c in s.columns]
    columns = spark.createDataFrame(named, "table_name string, column_name string, length int")
    limits, allowed = texts.column_limits(checks, columns), texts.allowed_values(checks, columns)
    rules = texts.value_factors(checks)
    return [texts.constrain(s, limits, allowed, rules) for s in specs]
