"""Schema description shared by every operator.

These are driver-side records: a schema has a handful of tables and columns, so
nothing here ever grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

STRING_TYPES = ("string", "varchar", "char")
INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")
NUMERIC_TYPES = INTEGER_TYPES + ("decimal", "double", "float")


@dataclass(frozen=True)
class ColumnSpec:
    """One column. ``length`` is the character length, or the precision of a decimal."""

    name: str
    type: str = "string"
    nullable: bool = True
    length: int = 0
    scale: int = 0
    min_value: float | int | None = None
    max_value: float | int | None = None
    allowed: tuple[str, ...] = ()
    uuid: bool = False
    default: str | None = None

    @property
    def is_text(self) -> bool:
        return self.type in STRING_TYPES

    @property
    def is_numeric(self) -> bool:
        return self.type in NUMERIC_TYPES

    def data_type(self, numeric_scale: int = 2) -> T.DataType:
        if self.uuid:
            return T.StringType()
        simple = {
            "tinyint": T.ByteType(),
            "smallint": T.ShortType(),
            "int": T.IntegerType(),
            "bigint": T.LongType(),
            "boolean": T.BooleanType(),
            "date": T.DateType(),
            "timestamp": T.TimestampType(),
            "double": T.DoubleType(),
            "float": T.FloatType(),
            "array": T.ArrayType(T.StringType()),
        }
        if self.type == "decimal":
            return T.DecimalType(self.length or 18, self.effective_scale(numeric_scale))
        return simple.get(self.type, T.StringType())

    def effective_scale(self, numeric_scale: int = 2) -> int:
        return self.scale if self.scale > 0 else numeric_scale

    def constrained(
        self,
        min_value: float | None = None,
        max_value: float | None = None,
        allowed: tuple[str, ...] = (),
        max_length: int | None = None,
    ) -> ColumnSpec:
        """Merge limits read from CHECK text; each side of a parsed limit wins over the column's."""
        length = self.length
        if max_length is not None and max_length > 0 and self.is_text:
            length = min(length, max_length) if length > 0 else max_length
        return replace(
            self,
            min_value=self.min_value if min_value is None else min_value,
            max_value=self.max_value if max_value is None else max_value,
            allowed=self.allowed or tuple(allowed),
            length=length,
        )

    @staticmethod
    def of(field_: T.StructField) -> ColumnSpec:
        """Read a Spark field; limits come from its metadata (length, scale, min, max, allowed, uuid)."""
        kind, length, scale = field_.dataType, 0, 0
        if isinstance(kind, T.DecimalType):
            name, length, scale = "decimal", kind.precision, kind.scale
        elif isinstance(kind, (T.CharType, T.VarcharType)):
            name, length = kind.typeName(), kind.length
        elif isinstance(kind, T.ArrayType):
            name = "array"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            name = "timestamp"
        else:
            name = kind.simpleString()
        meta = field_.metadata or {}
        return ColumnSpec(
            field_.name,
            name,
            field_.nullable,
            meta.get("length", length),
            meta.get("scale", scale),
            meta.get("min"),
            meta.get("max"),
            tuple(meta.get("allowed", ())),
            bool(meta.get("uuid", False)),
        )


@dataclass(frozen=True)
class ForeignKey:
    """``columns[i]`` refers to ``parent_columns[i]`` of ``parent``."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    one_to_one: bool = False
    name: str = ""

    def __post_init__(self) -> None:
        if not self.columns or len(self.columns) != len(self.parent_columns):
            raise ValueError("a foreign key needs the same, non-zero number of columns on both sides")
        if not self.name:
            object.__setattr__(
                self, "name", "fk_" + self.parent + "_" + "__".join(sorted(self.columns))
            )


@dataclass(frozen=True)
class CombinationRule:
    """A multi-column CHECK: the columns must take one of the listed value combinations."""

    columns: tuple[str, ...]
    combinations: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class RepetitionRule:
    """Make ``count`` rows with fixed values, per-rule constants, or one text per regex."""

    count: int
    fixed: Mapping[str, str | None] = field(default_factory=dict)
    constant: tuple[str, ...] = ()
    patterns: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.count < 1:
            raise ValueError("a repetition rule makes at least one row")


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    combinations: tuple[CombinationRule, ...] = ()

    def __post_init__(self) -> None:
        keyed = {self.column(c).name for c in self.primary_key}
        object.__setattr__(
            self,
            "columns",
            tuple(replace(c, nullable=False) if c.name in keyed else c for c in self.columns),
        )

    def column(self, name: str) -> ColumnSpec:
        """Column lookup ignores case."""
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"{self.name} has no column {name}")

    def has_column(self, name: str) -> bool:
        return any(c.name.lower() == name.lower() for c in self.columns)

    @property
    def fk_columns(self) -> frozenset[str]:
        return frozenset(c for fk in self.foreign_keys for c in fk.columns)

    def fk_nullable(self, fk: ForeignKey) -> bool:
        """A foreign key may be null only when all of its columns may."""
        return all(self.column(c).nullable for c in fk.columns)

    def unique_fk_keys(self) -> list[tuple[str, ...]]:
        """Unique keys made only of foreign-key columns, one-to-one keys included."""
        found = [k for k in (*self.unique_keys, self.primary_key) if k and set(k) <= self.fk_columns]
        for fk in self.foreign_keys:
            if fk.one_to_one and not any(set(k) == set(fk.columns) for k in found):
                found.append(fk.columns)
        return found

    def with_uuid_keys(self, names: set[str]) -> TableSpec:
        """Force the UUID generator on the named columns."""
        return replace(
            self,
            columns=tuple(replace(c, uuid=True) if c.name in names else c for c in self.columns),
        )

    @staticmethod
    def of(name: str, schema: T.StructType, **keys) -> TableSpec:
        return TableSpec(name, tuple(ColumnSpec.of(f) for f in schema.fields), **keys)
