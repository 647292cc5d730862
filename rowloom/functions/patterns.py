"""Text from a regular expression, as Column expressions.

A pattern is parsed once, on the driver, into nested columns. Every choice in it is a keyed draw of its own:
the place in the pattern names the draw, the row's key and the numbers of the repeats around it select the value.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws

ATTEMPTS = 50
OPEN_REPEAT = 8
_PRINTABLE = "".join(map(chr, range(32, 127)))


def _admitted(items) -> str:
    """The characters a bracket expression admits; a class or its opposite counts within the printable ones."""
    negated = any(str(kind) == "NEGATE" for kind, _ in items)
    listed = set()
    for kind, arg in items:
        if str(kind) == "LITERAL":
            listed.add(chr(arg))
        elif str(kind) == "RANGE":
            listed |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        elif str(kind) == "CATEGORY":
            letter = str(arg).rsplit("_", 1)[1][0].lower()
            test = re.compile("\\" + (letter.upper() if "_NOT_" in str(arg) else letter))
            listed |= {c for c in _PRINTABLE if test.match(c)}
    return "".join(c for c in _PRINTABLE if c not in listed) if negated else "".join(sorted(listed))


@dataclass(frozen=True)
class _Expansion:
    """Columns of the parts of one pattern. ``groups`` holds the text of each numbered group seen so far."""

    draws: Draws

    def text(self, parts, place: str, key: Column, groups: dict[int, Column]) -> Column:
        made = [self._part(str(kind), arg, f"{place}.{i}", key, groups) for i, (kind, arg) in enumerate(parts)]
        return F.concat(F.lit(""), *made)

    def _one_of(self, characters: str, place: str, key: Column) -> Column:
        if not characters:
            raise ValueError("a bracket expression without characters")
        if len(characters) == 1:
            return F.lit(characters)
        at = self.draws.at(place, key).below(len(characters)).cast("int") + 1
        return F.lit(characters).substr(at, F.lit(1))

    def _part(self, kind: str, arg, place: str, key: Column, groups: dict[int, Column]) -> Column:
        if kind == "LITERAL":
            return F.lit(chr(arg))
        if kind == "NOT_LITERAL":
            return self._one_of(_PRINTABLE.replace(chr(arg), ""), place, key)
        if kind == "ANY":
            return self._one_of(_PRINTABLE, place, key)
        if kind == "IN":
            return self._one_of(_admitted(arg), place, key)
        if kind == "AT":
            return F.lit("")
        if kind == "GROUPREF":
            return groups.get(arg, F.lit(""))
        if kind == "SUBPATTERN":
            number, _, _, parts = arg
            made = self.text(parts, place, key, groups)
            groups[number] = made
            return made
        if kind == "BRANCH":
            return self._branch(arg[1], place, key, groups)
        if kind.endswith("_REPEAT"):
            return self._repeat(*arg, place, key, groups)
        raise ValueError(f"unsupported regex part {kind}")

    def _branch(self, ways, place: str, key: Column, groups: dict[int, Column]) -> Column:
        choice = self.draws.at(place, key).below(len(ways))
        outer, made = dict(groups), F.lit("")
        for number, parts in enumerate(ways):
            inner = dict(outer)
            made = F.when(choice == number, self.text(parts, f"{place}.{number}", key, inner)).otherwise(made)
            for group, text in inner.items():
                if text is not outer.get(group):
                    groups[group] = F.when(choice == number, text).otherwise(groups.get(group, F.lit("")))
        return made

    def _repeat(self, low: int, high, parts, place: str, key: Column, groups: dict[int, Column]) -> Column:
        top = low + OPEN_REPEAT if str(high) == "MAXREPEAT" else int(high)
        if top == 0:
            return F.lit("")
        times = F.lit(low) if low == top else F.lit(low) + self.draws.at(place, key, "n").below(top - low + 1).cast("int")

        def turn(number: Column, held: dict[int, Column]) -> Column:
            return self.text(parts, place, F.concat(key, F.lit("."), number.cast("string")), held)

        numbers = F.slice(F.sequence(F.lit(1), F.lit(top)), F.lit(1), times)
        made = F.array_join(F.transform(numbers, lambda i: turn(i, dict(groups))), "")
        # A group keeps the text of the last turn.
        last = dict(groups)
        turn(times, last)
        for group, text in last.items():
            if text is not groups.get(group):
                groups[group] = F.when(times > 0, text).otherwise(F.lit(""))
        return made


def pattern_column(pattern: str, key: Column, max_length: int = 0, draws: Draws = Draws(0, "pattern")) -> Column:
    """One text per row that matches the pattern and fits the length. Same key, same text.

    Null for a null key, for an empty, broken or unsupported pattern, and when none of 50 tries fits the length.
    """
    nothing = F.lit(None).cast("string")
    if not pattern or not pattern.strip():
        return nothing
    try:
        # The standard library's own reading of a pattern, so that no second grammar has to agree with it.
        parsed = re._parser.parse(pattern)
        shortest, longest = parsed.getwidth()
        expansion, key = _Expansion(draws), key.cast("string")
        made = expansion.text(parsed, "r", key, {})
    except (re.error, ValueError):
        return nothing
    if max_length <= 0 or longest <= max_length:
        return made
    if shortest > max_length:
        return nothing

    def fitting(number: Column) -> Column:
        text = expansion.text(parsed, "r", F.concat(key, F.lit("#"), number.cast("string")), {})
        return F.get(F.transform(F.array(text), lambda t: F.when(F.length(t) <= max_length, t)), F.lit(0))

    tries = F.sequence(F.lit(1), F.lit(ATTEMPTS))
    return F.aggregate(tries, nothing, lambda found, number: F.coalesce(found, fitting(number)))


def texts_from_patterns(asked: Sequence[tuple[str, str, int]]) -> list[str | None]:
    """The texts of (pattern, key, max_length), for settings that need them while the plan is built; one job for all."""
    if not asked:
        return []
    one = SparkSession.active().sql("SELECT 1 AS one")
    row = one.select(*[pattern_column(p, F.lit(key), length).alias(f"t{i}") for i, (p, key, length) in enumerate(asked)]).first()
    return list(row)


def text_from_pattern(pattern: str, key: str, max_length: int = 0) -> str | None:
    """The text of one key."""
    return texts_from_patterns([(pattern, key, max_length)])[0]
