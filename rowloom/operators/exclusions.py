"""What leaving out tables, columns or parent rows does to the references that remain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.model import TableSpec


def exclusion_impact(
    tables: Mapping[str, DataFrame], specs: Sequence[TableSpec], excluded_tables: frozenset[str] = frozenset(),
    excluded_columns: Mapping[str, frozenset[str]] | None = None,
    excluded_rows: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per foreign key: why it is affected, child rows that lose their parent, required cells that become null.

    ``excluded_rows[table]`` holds the parent rows that are left out (any frame with the key
    columns). Child keys are counted before they are matched, so frequent keys cost nothing.
    """
    excluded_columns, excluded_rows = excluded_columns or {}, excluded_rows or {}
    parts = []
    for spec in specs:
        if spec.name in excluded_tables:
            continue
        child = tables[spec.name]
        for fk in spec.foreign_keys:
            reasons = []
            if fk.parent in excluded_tables:
                reasons.append("parent table excluded")
            elif set(fk.parent_columns) & set(excluded_columns.get(fk.parent, ())):
                reasons.append("parent column excluded")
            elif fk.parent in excluded_rows:
                reasons.append("parent rows excluded")
            own = [c for c in fk.columns if c in excluded_columns.get(spec.name, ())]
            required = [c for c in own if not spec.column(c).nullable]
            if own:
                reasons.append("required column excluded" if required else "column excluded")
            if not reasons:
                continue
            present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk.columns])
            used = child.where(present).groupBy(*fk.columns).agg(F.count("*").alias("n"))
            if "parent rows excluded" in reasons:
                gone = excluded_rows[fk.parent].select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])
                used = used.join(gone, list(fk.columns), "left_semi")
            elif reasons == ["column excluded"] or reasons == ["required column excluded"]:
                used = used.where(F.lit(False))
            filled = child.agg(
                *[F.count(c).alias(f"r{i}") for i, c in enumerate(required)] or [F.lit(0).cast("bigint").alias("r0")]
            )
            cells = reduce(lambda a, b: a + b, [F.col(c) for c in filled.columns])
            lost = used.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_without_parent"))
            # Two one-row frames side by side.
            parts.append(
                lost.join(filled.select(cells.cast("bigint").alias("required_cells_lost"))).select(
                    F.lit(spec.name).alias("table_name"), F.lit(fk.name).alias("fk_name"), F.lit(fk.parent).alias("parent_table"),
                    F.lit("; ".join(reasons)).alias("reason"), "rows_without_parent", "required_cells_lost",
                )
            )
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame(
            [], "table_name string, fk_name string, parent_table string, reason string, rows_without_parent bigint, required_cells_lost bigint"
        )
    return reduce(DataFrame.unionByName, parts)
