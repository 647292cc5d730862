"""Which unique keys of a table generation alone keeps, and what may be redrawn for the others."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, replace

from rowloom.model import ForeignKey, TableSpec
from rowloom.operators.generate import own_unique_keys


@dataclass(frozen=True)
class Contest:
    """Keys that rows may still break, and the columns that may be drawn again for them."""

    keys: tuple[tuple[str, ...], ...]
    own: tuple[str, ...]
    references: tuple[ForeignKey, ...]

    @property
    def columns(self) -> frozenset[str]:
        return frozenset((*self.own, *(c for fk in self.references for c in fk.columns)))


def kept_reference_keys(spec: TableSpec, present: Collection[str], fixed: Collection[str]) -> list[tuple[str, ...]]:
    """Unique keys of foreign-key columns that parent positions keep by construction.

    Either one foreign key that takes each parent once, or several that together run through different tuples
    of parents. ``present``: tables with rows; ``fixed``: names of foreign keys placed in another way.
    """
    usable = [fk for fk in spec.foreign_keys if fk.parent in present and fk.name not in fixed]
    alone = [fk for fk in usable if fk.one_to_one or any(set(fk.columns) == set(k) for k in spec.unique_fk_keys())]
    kept = [tuple(fk.columns) for fk in alone]
    placed = {fk.name for fk in alone} | set(fixed)
    for key in spec.unique_fk_keys():
        group = [fk for fk in spec.foreign_keys if set(fk.columns) & set(key) and fk.parent in present]
        columns = [c for fk in group for c in fk.columns]
        if len(group) < 2:
            continue
        if not {fk.name for fk in group} & placed and len(columns) == len(set(columns)) and set(columns) == set(key):
            kept.append(tuple(key))
        placed |= {fk.name for fk in group}
    return kept


def contest_of(
    spec: TableSpec, present: Collection[str], fixed: Collection[str], joined: Collection[str], excluded: Collection[str], locked: Collection[str]
) -> Contest | None:
    """What generation leaves open; None where it keeps every key.

    ``fixed``: foreign keys placed in another way than by a draw; ``joined``: those whose keys are joined from made
    rows. Neither is redrawn, nor are ``locked`` columns. Keys with an ``excluded`` column are null and never broken.
    """
    named = lambda key: tuple(spec.column(c).name for c in key)
    reference_keys = kept_reference_keys(spec, present, fixed)
    kept = [*map(named, own_unique_keys(spec)), *map(named, reference_keys)]
    primary = named(spec.primary_key)
    if primary and not set(primary) <= set(spec.fk_columns):
        kept.append(primary)
    asked = dict.fromkeys(map(named, (*spec.unique_keys, *([primary] if primary else []))))
    open_ = [k for k in asked if not any(set(known) <= set(k) for known in kept) and not set(k) & set(excluded)]
    if not open_:
        return None
    still = {c for key in kept for c in key} | set(locked) | set(excluded)
    for rule in spec.combinations:  # columns of a rule are drawn together or not at all
        if {spec.column(c).name for c in rule.columns if spec.has_column(c)} & still:
            still |= {spec.column(c).name for c in rule.columns if spec.has_column(c)}
    wanted = {c for key in open_ for c in key}
    for rule in spec.combinations:
        names = {spec.column(c).name for c in rule.columns if spec.has_column(c)}
        wanted |= names if names & wanted else set()
    own = tuple(c.name for c in spec.columns if c.name in wanted - still - set(spec.fk_columns))
    free = tuple(
        fk for fk in spec.foreign_keys
        if set(fk.columns) & wanted and not set(fk.columns) & still and fk.parent in present and fk.name not in {*fixed, *joined} and not fk.one_to_one
        and sum(bool(set(fk.columns) & set(other.columns)) for other in spec.foreign_keys) == 1
    )
    return Contest(tuple(open_), own, free)


def narrowed(spec: TableSpec) -> TableSpec:
    """A primary key that holds a smaller unique key is made by that one; its other columns are then free."""
    smaller = [k for k in spec.unique_keys if set(map(str.lower, k)) < set(map(str.lower, spec.primary_key))]
    if not smaller:
        return spec
    key = min(smaller, key=lambda k: (len(k), spec.unique_keys.index(k)))
    names = tuple(spec.column(c).name for c in key)
    rest = tuple(k for k in spec.unique_keys if k != key)
    return replace(spec, primary_key=names, unique_keys=(*rest, spec.primary_key))
