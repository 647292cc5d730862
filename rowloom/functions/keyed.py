"""Keyed randomness: every draw is a pure function of (seed, table, column, row key, salt).

No generator state means no shuffle, the same answer for any partitioning, and the same
answer when a lost task is run again. ``md5`` exists in every SQL engine, so results can be
checked elsewhere; ``xxhash64`` is the cheaper choice when that does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_SPACE = 1 << 52
NARROW_DOMAIN = 1 << 30
GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Draw:
    """The random digits of one cell. Slices of one digest serve several decisions."""

    digest: Column
    algorithm: str = "md5"

    def digits(self, start: int, length: int) -> Column:
        """An integer from ``length`` hex digits (at most 15) starting at digit ``start``."""
        if self.algorithm == "md5":
            return F.conv(F.substring(self.digest, start, length), 16, 10).cast("bigint")
        return F.shiftrightunsigned(F.xxhash64(self.digest, F.lit(start)), 64 - 4 * length)

    @property
    def value(self) -> Column:
        """52 random bits."""
        return self.digits(1, 13)

    @property
    def second(self) -> Column:
        """Another 52 bits of the same digest."""
        return self.digits(14, 13)

    @property
    def coin(self) -> Column:
        """24 further bits, used for yes/no decisions."""
        return self.digits(27, 6)

    def below(self, n: int | Column) -> Column:
        """Uniform integer in [0, n)."""
        return F.pmod(self.value, F.lit(n) if isinstance(n, int) else n)


@dataclass(frozen=True)
class Draws:
    seed: int
    table: str
    algorithm: str = "md5"

    def at(self, column: str, row: Column, salt: str = "v") -> Draw:
        return Draw(self._digest(column, row, salt), self.algorithm)

    def _digest(self, column: str, row: Column, salt: str) -> Column:
        prefix = f"{self.seed}|{self.table}|{column}|"
        key = F.concat(F.lit(prefix), row.cast("string"), F.lit(f"|{salt}"))
        return F.md5(key) if self.algorithm == "md5" else key


@dataclass(frozen=True)
class SharedDraws(Draws):
    """Draws whose digests become columns of their own, so each is hashed once per row.

    Ask for all draws first, then put ``digest_columns()`` in a select below the one that
    uses the draws.
    """

    made: dict = field(default_factory=dict, compare=False)

    def at(self, column: str, row: Column, salt: str = "v") -> Draw:
        known = self.made.setdefault(
            (column, salt, str(row)), (f"_digest_{len(self.made)}", self._digest(column, row, salt))
        )
        return Draw(F.col(known[0]), self.algorithm)

    def digest_columns(self) -> list[Column]:
        return [digest.alias(name) for name, digest in self.made.values()]


def step_for(n: int) -> int:
    """A multiplier near the golden section of n and coprime to it, which spreads neighbours apart."""
    step = int(n * GOLDEN) or 1
    while gcd(step, n) != 1:
        step += 1
    return step


def permute(index: Column, n: int, shift: int = 0) -> Column:
    """Map 0..n-1 one-to-one onto 0..n-1, so uniqueness holds by construction.

    Affine map. Domains of 2^30 and more use DECIMAL(38,0) products instead of 64-bit ones.
    """
    if n <= 0:
        raise ValueError("the domain must not be empty")
    step = step_for(n)
    if n < NARROW_DOMAIN:
        return F.pmod(index * F.lit(step) + F.lit(shift % n), F.lit(n))
    product = index.cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)")
    total = (product.cast("decimal(38,0)") + F.lit(shift % n).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.pmod(total, F.lit(n).cast("decimal(19,0)")).cast("bigint")


def uuid_text(draw: Draw) -> Column:
    """A version-4 shaped UUID from one 128-bit digest."""
    if draw.algorithm == "md5":
        hexed = draw.digest
    else:
        hexed = F.concat(
            F.lpad(F.lower(F.hex(F.xxhash64(draw.digest, F.lit(1)))), 16, "0"),
            F.lpad(F.lower(F.hex(F.xxhash64(draw.digest, F.lit(2)))), 16, "0"),
        )
    nibble = F.pmod(F.conv(F.substring(hexed, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1
    return F.concat(
        F.substring(hexed, 1, 8),
        F.lit("-"),
        F.substring(hexed, 9, 4),
        F.lit("-4"),
        F.substring(hexed, 14, 3),
        F.lit("-"),
        F.lit("89ab").substr(nibble, F.lit(1)),
        F.substring(hexed, 18, 3),
        F.lit("-"),
        F.substring(hexed, 21, 12),
    )


def base36(index: Column) -> Column:
    """Lower-case base-36 text of a non-negative integer."""
    return F.lower(F.conv(index.cast("string"), 10, 36))
