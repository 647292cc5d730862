"""Relational data generation, integrity checking and script output as Spark jobs."""

from rowloom.model import (
    ColumnSpec,
    CombinationRule,
    ForeignKey,
    RepetitionRule,
    TableSpec,
)

__all__ = [
    "ColumnSpec",
    "CombinationRule",
    "ForeignKey",
    "RepetitionRule",
    "TableSpec",
]
