"""The whole job: a schema in, one DataFrame per table out, plus pending updates and load order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws
from rowloom.functions.literals import Dialect
from rowloom.model import ForeignKey, RepetitionRule, TableSpec
from rowloom.operators import generate as g
from rowloom.operators import graph, references
from rowloom.operators.generate import POSITION, GenerateOptions
from rowloom.operators.combinations import INLINE
from rowloom.operators.indexing import dense_index
from rowloom.operators.references import Deferred, MissingParents
from rowloom.operators.uniqueness import Supply, make_all_unique
from rowloom.plans.contests import Contest, contest_of, narrowed
from rowloom.session import materialize
from rowloom.sinks.script import TableRows, TableUpdates, script


@dataclass(frozen=True)
class ChainRule:
    depth: int = references.DEFAULT_CHAIN_DEPTH
    termination: str = references.CLOSE_CYCLE


@dataclass(frozen=True)
class SeedOptions:
    rows: int | Mapping[str, int] = 100
    table: GenerateOptions = GenerateOptions()
    rules: Mapping[str, Sequence[RepetitionRule]] = field(default_factory=dict)
    excluded_tables: frozenset[str] = frozenset()
    excluded_columns: Mapping[str, frozenset[str]] = field(default_factory=dict)
    uuid_keys: Mapping[str, set[str]] = field(default_factory=dict)
    # {table: {foreign key name: rule}}
    chains: Mapping[str, Mapping[str, ChainRule]] = field(default_factory=dict)
    deferred: bool | None = None


@dataclass(frozen=True)
class Seeded:
    tables: dict[str, DataFrame]
    inserts: dict[str, DataFrame]
    updates: dict[str, DataFrame]
    levels: DataFrame
    deferred: bool
    # {table: rows that were asked for but that its keys have no room for}
    shortfall: dict[str, int] = field(default_factory=dict)
    # {table.foreign key: parent rows that no child can refer to, since another key of the child shares a column
    # and no parent there has the same value}
    unmatched: dict[str, int] = field(default_factory=dict)


class SeedPlan:
    """Every column of every table as a function of the row position; parents need no join."""

    def __init__(self, specs: Sequence[TableSpec], options: SeedOptions) -> None:
        kept = [s for s in specs if s.name not in options.excluded_tables]
        self.specs = {s.name: narrowed(s).with_uuid_keys(set(options.uuid_keys.get(s.name, ()))) for s in kept}
        # A forced UUID key changes the type of the columns that refer to it.
        for name, keys in options.uuid_keys.items():
            for s in list(self.specs.values()):
                pointing = {c for fk in s.foreign_keys if fk.parent == name
                            for c, p in zip(fk.columns, fk.parent_columns) if p in keys}
                self.specs[s.name] = s.with_uuid_keys(pointing | {c.name for c in s.columns if c.uuid})
        self.options = options
        # Tables whose rows were numbered anew after some were left out.
        self.renumbered: set[str] = set()
        # Load levels, once known: rows can be joined only from tables that load earlier.
        self.levels: Mapping[str, int] = {}
        self._contests: dict[str, Contest | None] = {}
        self.counts: dict[str, int] = {}
        for name in self.specs:
            self._count(name)

    def wanted(self, table: str) -> int:
        rows = self.options.rows
        return rows if isinstance(rows, int) else rows.get(table, 0)

    def _count(self, name: str) -> int:
        """Rows of a table: as many as asked for, within the room of its keys, foreign-key digits included."""
        if name not in self.counts:
            spec = self.specs[name]
            rules = tuple(self.options.rules.get(name, ()))
            excluded = frozenset(self.options.excluded_columns.get(name, ()))
            planned = g.planned_rows(spec, self.wanted(name), replace(self.options.table, rules=rules, excluded=excluded))
            # Inside a cycle of tables the row count without the foreign keys' bound holds.
            self.counts[name] = planned
            shared = self.shared_key(spec)
            if shared:
                room = _product([*shared[1].values(), *(self._count(fk.parent) for fk in shared[0])])
                self.counts[name] = min(planned, room)
        return self.counts[name]

    def shared_key(self, spec: TableSpec) -> tuple[list[ForeignKey], dict[str, int]] | None:
        """(foreign keys, {own column: domain size}) of a primary key that only both together keep distinct."""
        own = [spec.column(c).name for c in spec.primary_key if c not in spec.fk_columns]
        if not own or len(own) == len(spec.primary_key):
            return None
        rows = self.counts[spec.name]
        domains = {c: g.domain_of(spec.column(c), rows, self.options.table.values.numeric_scale) for c in own}
        if any(d is None for d in domains.values()) or _product([d.size for d in domains.values()]) >= rows:
            return None
        first = [next(fk for fk in spec.foreign_keys if c in fk.columns) for c in spec.primary_key if c in spec.fk_columns]
        fks = list(dict.fromkeys(first))
        fixed = [fk for fk in fks if fk.one_to_one or fk.parent not in self.specs or fk.name in self.options.chains.get(spec.name, {})]
        return None if fixed else (fks, {c: d.size for c, d in domains.items()})

    def _shared_places(self, spec: TableSpec, position: Column) -> tuple[list[ForeignKey], dict[str, Column], list[Column]]:
        """The digits of one code: the own columns' numbers, then the parents' positions."""
        shared = self.shared_key(spec)
        if shared is None:
            return [], {}, []
        fks, own = shared
        sizes = [*own.values(), *(self.counts[fk.parent] for fk in fks)]
        places = references.combination_positions(position, sizes, self.options.table.seed)
        return fks, dict(zip(own, places, strict=False)), places[len(own):]

    def is_joined(self, table: str, column: str, seen: frozenset[str] = frozenset()) -> bool:
        """Whether a referenced column comes, however far up, from rows that are not a function of the position alone.

        Those are rows under repetition rules, columns of unique keys that rows compete for, and columns of
        foreign keys that share a column.
        """
        if self.options.rules.get(table) or table in self.renumbered:
            return True
        spec = self.specs[table]
        if any(len(r.combinations) > INLINE and column in r.columns for r in spec.combinations):
            return True  # chosen by a join
        contest = self.contest(table)
        if contest and column in contest.columns or any(column in fk.columns for group in self.sharing(spec) for fk in group):
            return True
        if column not in spec.fk_columns or table in seen:
            return False
        fk = next(f for f in spec.foreign_keys if column in f.columns)
        above = fk.parent_columns[fk.columns.index(column)]
        return fk.parent in self.specs and self.is_joined(fk.parent, above, seen | {table})

    def sharing(self, spec: TableSpec) -> list[list[ForeignKey]]:
        """Groups of foreign keys that share columns of the child, however indirectly."""
        groups: list[list[ForeignKey]] = []
        for fk in spec.foreign_keys:
            if fk.parent not in self.specs or not self._loads_earlier(fk.parent, spec.name):
                continue
            near = [g for g in groups if any(set(fk.columns) & set(other.columns) for other in g)]
            groups = [g for g in groups if g not in near] + [[*(f for g in near for f in g), fk]]
        return [g for g in groups if len(g) > 1]

    def _loads_earlier(self, parent: str, table: str) -> bool:
        return parent != table and self.levels.get(parent, 0) < self.levels.get(table, 1)

    def contest(self, name: str) -> Contest | None:
        """Unique keys of a table that its rows compete for, and what may be redrawn."""
        if name not in self._contests:
            self._contests[name] = None  # while it is looked for: tables may refer to each other
            spec = self.specs[name]
            present = [t for t in self.specs if self.counts.get(t, 1)]
            shared = self.shared_key(spec)
            fixed = {*self.options.chains.get(name, {}), *(fk.name for group in self.sharing(spec) for fk in group)}
            fixed |= {fk.name for fk in shared[0]} if shared else set()
            joined = {fk.name for fk in self.ruled(spec)}
            excluded = frozenset(self.options.excluded_columns.get(name, ()))
            # What is referred to by rows made before, or by the table itself, stays as it is.
            early = {
                c for s in self.specs.values() for fk in s.foreign_keys for c in fk.parent_columns
                if fk.parent == name and not self._loads_earlier(name, s.name)
            }
            self._contests[name] = contest_of(spec, present, fixed, joined, excluded, {*early, *self.options.table.soft_delete})
        return self._contests[name]

    def ruled(self, spec: TableSpec) -> list[ForeignKey]:
        """Foreign keys whose values are joined from made rows, those that share columns apart."""
        sharing = [fk for group in self.sharing(spec) for fk in group]
        return [
            fk for fk in spec.foreign_keys
            if fk not in sharing and fk.parent in self.specs and fk.parent != spec.name
            and any(self.is_joined(fk.parent, p) for p in fk.parent_columns)
            or fk.parent == spec.name and bool(self.options.rules.get(spec.name))
        ]

    def leave_out(self, name: str, rows: int) -> None:
        """A made table has fewer rows than planned; tables that load later are planned again."""
        self.counts[name] -= rows
        self.renumbered.add(name)
        later = [t for t in self.counts if self._loads_earlier(name, t)]
        for table in later:
            del self.counts[table]
        for table in later:
            self._count(table)
        self._contests = {t: c for t, c in self._contests.items() if t not in later}

    def _draws(self, table: str) -> Draws:
        return Draws(self.options.table.seed, table, self.options.table.algorithm)

    def options_for(self, name: str, salt: int = 0) -> GenerateOptions:
        spec = self.specs[name]
        made = {}
        for column in sorted(spec.fk_columns):
            if column not in self.options.excluded_columns.get(name, ()):
                made[column] = lambda position, c=column: self.reference(name, c, position, salt)
        return replace(
            self.options.table,
            rules=tuple(self.options.rules.get(name, ())),
            excluded=frozenset(self.options.excluded_columns.get(name, ())),
            references=made,
            key_places={
                c: lambda position, c=c: self._shared_places(spec, position)[1][c] for c in (self.shared_key(spec) or ((), {}))[1]
            },
        )

    def parent_position(self, spec: TableSpec, fk: ForeignKey, position: Column, salt: int = 0) -> Column:
        rows, parents = self.counts[spec.name], self.counts.get(fk.parent, 0)
        nullable = spec.fk_nullable(fk)
        draws = self._draws(spec.name)
        chain = self.options.chains.get(spec.name, {}).get(fk.name)
        if chain is not None and fk.parent == spec.name:
            if chain.termination == references.NULL_FK and not nullable:
                raise MissingParents(f"{fk.name}: a NOT NULL column cannot end a chain with null")
            return references.chain_position(position, rows, chain.depth, chain.termination)
        if fk.parent not in self.specs:
            return F.lit(None).cast("bigint")
        references.require_parents(parents, nullable, fk.name)
        fks, _, places = self._shared_places(spec, position)
        if fk in fks:
            return places[fks.index(fk)]
        shift = draws.seed % max(parents, 1)
        if fk.one_to_one or set(fk.columns) in [set(k) for k in spec.unique_fk_keys()]:
            if rows > parents and not nullable:
                raise MissingParents(f"{fk.name}: {rows} rows need a parent of their own, there are {parents}")
            return references.one_to_one_position(position, parents, shift)
        for key in spec.unique_fk_keys():
            group = [f for f in spec.foreign_keys if set(f.columns) & set(key) and f.parent in self.specs]
            if fk in group and len(group) > 1:
                sizes = [self.counts[f.parent] for f in group]
                return references.combination_positions(position, sizes, draws.seed)[group.index(fk)]
        if salt:
            draws = replace(draws, table=f"{spec.name}~{salt}")
        return references.random_position(draws, fk.name, position, parents)

    def reference(self, table: str, column: str, position: Column, salt: int = 0) -> Column:
        """A foreign-key column; ``salt`` draws another parent where the parent is drawn."""
        spec = self.specs[table]
        fk = next(f for f in spec.foreign_keys if column in f.columns)
        kind = spec.column(column).data_type(self.options.table.values.numeric_scale)
        if fk.parent not in self.specs:
            return F.lit(None).cast(kind)
        parent_column = fk.parent_columns[fk.columns.index(column)]
        place = self.parent_position(spec, fk, position, salt)
        return references.generated_key(lambda p: self.key_at(fk.parent, parent_column, p), place).cast(kind)

    def parent_key(self, spec: TableSpec, fk: ForeignKey, place: Column) -> list[Column]:
        """The foreign-key columns that refer to the parent at a place."""
        kinds = [spec.column(c).data_type(self.options.table.values.numeric_scale) for c in fk.columns]
        return [self.key_at(fk.parent, p, place).cast(k) for p, k in zip(fk.parent_columns, kinds, strict=True)]

    def key_at(self, table: str, column: str, position: Column) -> Column:
        """The value a generated row has in a referenced column."""
        spec = self.specs[table]
        if column in spec.fk_columns:
            return self.reference(table, column, position)
        options = self.options_for(table)
        columns, rule = g.row_columns(spec, replace(options, references={}), position, self.counts[table], self._draws(table))
        if options.rules:
            raise ValueError(f"{table} has repetition rules; join its rows instead of computing keys")
        return columns[spec.column(column).name]


def _product(numbers: Sequence[int]) -> int:
    total = 1
    for n in numbers:
        total *= n
    return total


def schema_frames(spark: SparkSession, specs: Sequence[TableSpec]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The schema as frames: tables, foreign-key columns and columns."""
    tables = spark.createDataFrame([(s.name,) for s in specs], "table_name string")
    fks = spark.createDataFrame(
        [(s.name, c, fk.parent) for s in specs for fk in s.foreign_keys for c in fk.columns],
        "table_name string, column_name string, parent string",
    )
    columns = spark.createDataFrame(
        [(s.name, c.name, c.nullable) for s in specs for c in s.columns], "table_name string, column_name string, nullable boolean"
    )
    return tables, fks, columns


def seed(spark: SparkSession, specs: Sequence[TableSpec], options: SeedOptions | None = None) -> Seeded:
    """Generate all tables. Foreign keys whose parent loads no earlier are emptied in ``inserts`` and listed in ``updates``.

    Nothing is deferred by updates when constraints are switched off for the whole load, that
    is when ``deferred`` holds (asked for, or needed by a NOT NULL cycle).
    """
    options = options or SeedOptions()
    plan = SeedPlan(specs, options)
    kept = list(plan.specs.values())
    tables, fks, columns = schema_frames(spark, kept)
    edges = graph.reference_edges(fks, tables)
    levels = materialize(graph.load_levels(edges, tables.select(F.col("table_name").alias("node"))))
    level = {r["node"]: r["level"] for r in levels.collect()}
    plan.levels = level
    deferred = options.deferred
    if deferred is None:
        cycles = graph.cycle_groups(edges, levels)
        deferred = not graph.deferral_needed(cycles, fks, columns).where("deferred").isEmpty()
    made, inserts, updates, unmatched = {}, {}, {}, {}
    for spec in sorted(kept, key=lambda s: (level[s.name], s.name)):
        df = _with_joined_parents(spark, plan, spec, made, unmatched)
        df = _with_unique_keys(plan, spec, df)
        made[spec.name] = df
        late = [fk for fk in spec.foreign_keys if fk.parent in plan.specs and level[fk.parent] >= level[spec.name]]
        if late and not deferred and spec.primary_key:
            split: Deferred = references.defer(df, spec.primary_key, sorted({c for fk in late for c in fk.columns}))
            inserts[spec.name], updates[spec.name] = split.inserts, split.updates
        else:
            inserts[spec.name] = df
    short = {s.name: plan.wanted(s.name) - plan.counts[s.name] for s in kept if plan.counts[s.name] < plan.wanted(s.name)}
    return Seeded(made, inserts, updates, levels, bool(deferred), short, unmatched)


def _with_joined_parents(
    spark: SparkSession, plan: SeedPlan, spec: TableSpec, made: Mapping[str, DataFrame], unmatched: dict[str, int]
) -> DataFrame:
    """Generate one table; keys that are no function of the position alone are joined by position from made parents.

    Foreign keys that share columns are filled together, so that all of them hold.
    """
    ruled, groups = plan.ruled(spec), plan.sharing(spec)
    options = plan.options_for(spec.name)
    joined = {c for fk in (*ruled, *(fk for group in groups for fk in group)) for c in fk.columns}
    options = replace(options, references={c: f for c, f in options.references.items() if c not in joined})
    df = g.generate_table(spark, spec, plan.counts[spec.name], options)
    excluded = plan.options.excluded_columns.get(spec.name, ())
    for fk in ruled:
        source = df if fk.parent == spec.name else made[fk.parent]
        rows = references.IndexedRows(source.select(POSITION, *fk.parent_columns), plan.counts[fk.parent], POSITION)
        mapping = {c: p for c, p in zip(fk.columns, fk.parent_columns) if c not in excluded}
        place = plan.parent_position(spec, fk, F.col(POSITION))
        df = references.attach_keys(df, references.Parent(rows, fk.parent_columns), place, mapping)
    for group in groups:
        parents = [(fk.name, made[fk.parent].select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])) for fk in group]
        nullable = frozenset(c.name for c in spec.columns if c.nullable)
        shared = references.assign_shared(df, parents, plan._draws(spec.name), POSITION, nullable)
        kinds = {c.name: c.data_type(plan.options.table.values.numeric_scale) for c in spec.columns}
        names = {c for fk in group for c in fk.columns}
        df = shared.rows.select(
            *[F.lit(None).cast(kinds[c]).alias(c) if c in names and c in excluded else F.col(c).cast(kinds[c]).alias(c) if c in names else F.col(c) for c in df.columns]
        )
        unmatched |= {f"{spec.name}.{name}": n for name, n in shared.unmatched.items() if n}
    order = [POSITION, g.RULE, *[c.name for c in spec.columns]]
    return df.select(*order)


def _with_unique_keys(plan: SeedPlan, spec: TableSpec, df: DataFrame) -> DataFrame:
    """Let rows compete for the unique keys that generation leaves open; what finds no place is left out.

    Rows of repetition rules stand first, so they win against others. Left-out rows give up their positions:
    the rest is numbered anew, and the tables below are planned again for what is left.
    """
    contest = plan.contest(spec.name)
    if contest is None:
        return df
    options, total = plan.options_for(spec.name), plan.counts[spec.name]

    def redraw(rows: DataFrame, round_: int) -> DataFrame:
        salted = plan.options_for(spec.name, round_)
        columns = {c for fk in contest.references for c in fk.columns}
        salted = replace(salted, seed=options.seed + round_ * 1_000_003, references={c: f for c, f in salted.references.items() if c in columns})
        return g.redrawn(rows, spec, total, salted, contest.columns)

    pinned = {name.lower() for rule in options.rules for name in (*rule.fixed, *rule.constant, *rule.patterns)}
    combined = {spec.column(c).name for rule in spec.combinations for c in rule.columns if spec.has_column(c)}
    scale = options.values.numeric_scale
    domains = {c: g.domain_of(spec.column(c), total, scale) for c in contest.own if c not in combined and c.lower() not in pinned}
    supplies = [Supply((c,), d.size, lambda i, d=d: [d.value(i)]) for c, d in domains.items() if d is not None]
    for fk in contest.references:
        names = tuple(spec.column(c).name for c in fk.columns)
        if plan.counts.get(fk.parent) and not {*names} & combined and not {c.lower() for c in names} & pinned:
            supplies.append(Supply(names, plan.counts[fk.parent], lambda i, fk=fk: plan.parent_key(spec, fk, i)))
    done = make_all_unique(df, contest.keys, redraw, supplies)
    lost = done.left_out.count()
    if lost == 0:
        return done.rows.select(*df.columns)
    names = [c for c in df.columns if c != POSITION]
    again = dense_index(done.rows.select(F.col(POSITION).alias("_old"), *names), ["_old"], POSITION)
    plan.leave_out(spec.name, lost)
    return again.df.select(*df.columns)


def script_of(
    spark: SparkSession, seeded: Seeded, specs: Sequence[TableSpec], dialect: Dialect,
    defaults: Mapping[str, frozenset[str]] | None = None,
) -> DataFrame:
    """The whole job as an SQL script: parents first, pending foreign keys as updates at the end.

    ``defaults`` names columns, such as soft-delete ones, that print DEFAULT.
    """
    known = {s.name: s for s in specs}
    # ``inserts`` was filled in load order.
    tables, updates = [], []
    for name, df in seeded.inserts.items():
        uuids = _uuid_columns(known[name], df)
        tables.append(TableRows(name, df, POSITION, uuids, (defaults or {}).get(name, frozenset())))
        if name in seeded.updates:
            updates.append(TableUpdates(name, seeded.updates[name], known[name].primary_key, uuids))
    return script(spark, tables, updates, dialect, seeded.deferred)


def _uuid_columns(spec: TableSpec, df: DataFrame) -> frozenset[str]:
    """UUID columns, and those that became text because their parent's key was made a UUID."""
    types = dict(df.dtypes)
    return frozenset(
        c.name for c in spec.columns if c.uuid or (types[c.name] == "string" and not c.is_text and c.data_type().simpleString() != "string")
    )
