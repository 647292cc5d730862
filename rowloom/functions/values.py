"""Cell values as Column expressions: one expression per column, no state, no shuffle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.keyed import DRAW_SPACE, Draw, Draws, uuid_text
from rowloom.model import ColumnSpec

# Defaults when a column declares no limits.
INT_MIN, INT_MAX = 1, 10_000
BIGINT_MAX = 1_000_000
DECIMAL_MAX = 1_000
TEXT_LENGTH = 255
DATE_RANGE_DAYS = 3_650
TIMESTAMP_RANGE_SECONDS = 31_536_000
ARRAY_ELEMENT_LENGTH = 20
TYPE_LIMITS = {
    "tinyint": (-(2**7), 2**7 - 1),
    "smallint": (-(2**15), 2**15 - 1),
    "int": (-(2**31), 2**31 - 1),
    "bigint": (-(2**63), 2**63 - 1),
}
# Column names that ask for a picture address.
PICTURE_NAMES = ("foto", "avatar", "image", "picture", "profile")
# ISO 3166 codes of the countries most used, two and three letters.
COUNTRY_CODES_2 = ("AR", "AT", "AU", "BE", "BR", "CA", "CH", "CL", "CN", "CO", "CZ", "DE", "DK",
                   "EG", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IN", "IS", "IT", "JP", "KE",
                   "KR", "MX", "NL", "NO", "NZ", "PE", "PL", "PT", "RO", "SE", "TR", "US", "UY", "ZA")
COUNTRY_CODES_3 = ("ARG", "AUT", "AUS", "BEL", "BRA", "CAN", "CHE", "CHL", "CHN", "COL", "CZE",
                   "DEU", "DNK", "EGY", "ESP", "FIN", "FRA", "GBR", "GRC", "HUN", "IRL", "IND",
                   "ISL", "ITA", "JPN", "KEN", "KOR", "MEX", "NLD", "NOR", "NZL", "PER", "POL",
                   "PRT", "ROU", "SWE", "TUR", "USA", "URY", "ZAF")
# Filler words for text without a dictionary.
LATIN_WORDS = ("lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed",
               "do", "eiusmod", "tempor", "incididunt", "ut", "labore", "et", "dolore", "magna",
               "aliqua", "enim", "ad", "minim", "veniam", "quis", "nostrud", "exercitation",
               "ullamco", "laboris", "nisi", "aliquip", "ex", "ea", "commodo", "consequat")
IBAN_LENGTH, IBAN_PREFIX, IBAN_HALF = 24, "ES", 11
WORDS_PER_DIGEST, WORD_DIGITS = 4, 6
# Word lists travel inside the plan, so they stay small; larger vocabularies are joined by index.
MAX_INLINE_WORDS = 50_000


@lru_cache(maxsize=1)
def iso_countries() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """All ISO 3166 codes that the JVM knows, of two and of three letters, in the same order."""
    locale = SparkContext.getOrCreate()._jvm.java.util.Locale
    two = tuple(sorted(locale.getISOCountries()))
    return two, tuple(locale("", code).getISO3Country() for code in two)


@dataclass(frozen=True)
class ValueSettings:
    words: tuple[str, ...] = ()
    # Codes of two and of three letters to draw from; all ISO countries without them.
    countries: tuple[tuple[str, ...], tuple[str, ...]] | None = None
    latin: bool = False
    as_of: dt.datetime = dt.datetime(2024, 1, 1)
    numeric_scale: int = 2
    # A nullable cell is null in this many tenths of the rows.
    null_tenths: int = 3

    def __post_init__(self) -> None:
        if len(self.words) > MAX_INLINE_WORDS:
            raise ValueError("word list too large to inline; use text.attach_phrases")


def is_null_draw(draw: Draw, tenths: int = 3) -> Column:
    return F.pmod(draw.coin, F.lit(10)) < tenths


def uniform_integer(draw: Draw, low: int, high: int) -> Column:
    """Inclusive on both sides; swapped bounds are tolerated."""
    low, high = min(low, high), max(low, high)
    span = high - low + 1
    if span <= DRAW_SPACE:
        return F.lit(low).cast("bigint") + draw.below(span)
    return (F.lit(Decimal(low)).cast("decimal(38,0)") + _wide_below(draw, span)).cast("bigint")


def _wide_below(draw: Draw, span: int) -> Column:
    """104 random bits, for domains wider than one draw."""
    wide = draw.value.cast("decimal(16,0)") * F.lit(DRAW_SPACE).cast("decimal(16,0)")
    total = (wide + draw.second.cast("decimal(16,0)")).cast("decimal(38,0)")
    return F.pmod(total, F.lit(Decimal(span)).cast("decimal(38,0)"))


def units_between(low: float | int, high: float | int, scale: int) -> tuple[int, int]:
    """Bounds as integer multiples of 10^-scale, rounded inwards."""
    low, high = min(low, high), max(low, high)
    with localcontext(prec=80):
        a = int(Decimal(str(low)).scaleb(scale).to_integral_value(ROUND_CEILING))
        b = int(Decimal(str(high)).scaleb(scale).to_integral_value(ROUND_FLOOR))
    return (a, b) if a <= b else (b, a)


def uniform_decimal(draw: Draw, low, high, precision: int, scale: int) -> Column:
    """Exact decimal arithmetic in integer units of 10^-scale."""
    a, b = units_between(low, high, scale)
    span = b - a + 1
    below = draw.below(span).cast("decimal(19,0)") if span <= DRAW_SPACE else _wide_below(draw, span)
    return decimal_of_units((below + F.lit(Decimal(a)).cast("decimal(38,0)")).cast("decimal(38,0)"), precision, scale)


def decimal_of_units(units: Column, precision: int, scale: int) -> Column:
    """A DECIMAL(38,0) number of units of 10^-scale as a decimal."""
    unit = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({max(scale, 1)},{scale})")
    if precision + scale + 2 > 38:
        return (units / F.lit(Decimal(10) ** scale).cast("decimal(38,0)")).cast(f"decimal({precision},{scale})")
    whole = units.cast(f"decimal({min(38, precision + 1)},0)")
    return (whole * unit).cast(f"decimal({precision},{scale})")


def uniform_double(draw: Draw, low, high, scale: int) -> Column:
    a, b = units_between(low, high, scale)
    return (F.lit(a).cast("bigint") + draw.below(b - a + 1)).cast("double") / F.lit(float(10**scale))


def past_date(draw: Draw, as_of: dt.datetime) -> Column:
    return F.date_sub(F.lit(as_of.date()), draw.below(DATE_RANGE_DAYS).cast("int"))


def past_timestamp(draw: Draw, as_of: dt.datetime) -> Column:
    seconds = int(as_of.replace(tzinfo=dt.timezone.utc).timestamp())
    return F.timestamp_seconds(F.lit(seconds).cast("bigint") - draw.below(TIMESTAMP_RANGE_SECONDS))


def _word(draws: Draws, column: str, row: Column, slot: int, words: Column, n: int, tag: str) -> Column:
    group, place = divmod(slot, WORDS_PER_DIGEST)
    draw = draws.at(column, row, tag if group == 0 else f"{tag}{group}")
    pick = F.pmod(draw.digits(1 + WORD_DIGITS * place, WORD_DIGITS), F.lit(n)).cast("int") + 1
    return F.element_at(words, pick)


def phrase(
    draws: Draws, column: str, row: Column, words: Sequence[str], low: int, high: int, tag: str = "v"
) -> Column:
    """``low`` to ``high`` words joined by blanks; unrolled so that it stays in generated code."""
    n = len(words)
    inline = F.array(*[F.lit(w) for w in words])
    size = low + F.pmod(draws.at(column, row, tag).digits(25, 2), F.lit(high - low + 1))
    parts = []
    for slot in range(high):
        word = _word(draws, column, row, slot, inline, n, tag)
        parts.append(word if slot < low else F.when(size > slot, word))
    return F.concat_ws(" ", *parts)


def fit_length(text: Column, length: int, pad: bool = False) -> Column:
    """Cut to the length; CHAR columns are padded with blanks."""
    if length <= 0:
        return text
    return F.rpad(text, length, " ") if pad else F.substring(text, 1, length)


def text_value(
    column: ColumnSpec, draws: Draws, row: Column, settings: ValueSettings, length: int | None = None, tag: str = "v"
) -> Column:
    """Text chosen by column name, then by length, then from the words."""
    name = column.name.lower()
    if any(part in name for part in PICTURE_NAMES):
        number = draws.at(column.name, row, tag).below(1_000_000).cast("string")
        return F.concat(F.lit("https://images.example.com/"), number, F.lit(".jpg"))
    size = length if length and length > 0 else (column.length if column.length > 0 else TEXT_LENGTH)
    draw = draws.at(column.name, row, tag)
    pad = column.type == "char"
    if size in (2, 3):
        codes = (settings.countries or iso_countries())[size - 2]
        return F.element_at(F.array(*[F.lit(c) for c in codes]), draw.below(len(codes)).cast("int") + 1)
    if size == IBAN_LENGTH:
        halves = [
            F.lpad(F.pmod(d, F.lit(10**IBAN_HALF)).cast("string"), IBAN_HALF, "0")
            for d in (draw.value, draw.second)
        ]
        return F.concat(F.lit(IBAN_PREFIX), *halves)
    latin_high = min(max(size // 5, 4), 10) - 1
    latin = phrase(draws, column.name, row, LATIN_WORDS, 3, latin_high, tag)
    n = len(settings.words)
    if n == 0:
        return fit_length(latin, size, pad)
    own = F.lit(settings.words[0]) if n == 1 else phrase(
        draws, column.name, row, settings.words, 1, min(n, 5) - 1, tag
    )
    if settings.latin:
        own = F.when(F.pmod(draws.at(column.name, row, tag + "source").coin, F.lit(2)) == 0, own).otherwise(latin)
    return fit_length(own, size, pad)


def holds_words(column: ColumnSpec) -> bool:
    """Whether ``text_value`` makes a phrase for the column, and no address or code."""
    size = column.length if column.length > 0 else TEXT_LENGTH
    return not any(part in column.name.lower() for part in PICTURE_NAMES) and size not in (2, 3, IBAN_LENGTH)


def text_array(column: ColumnSpec, draws: Draws, row: Column, settings: ValueSettings) -> Column:
    """One to three texts."""
    size = column.length if column.length > 0 else ARRAY_ELEMENT_LENGTH
    parts = [text_value(column, draws, row, settings, size, f"e{i}") for i in range(3)]
    count = 1 + draws.at(column.name, row).below(3)
    return F.slice(F.array(*parts), 1, count.cast("int"))


def pick_allowed(column: ColumnSpec, draw: Draw, numeric_scale: int = 2) -> Column:
    values = [v.strip() if v is not None else None for v in column.allowed]
    chosen = F.element_at(F.array(*[F.lit(v) for v in values]), draw.below(len(values)).cast("int") + 1)
    if column.type == "array":
        return F.array(chosen)
    return chosen.try_cast(column.data_type(numeric_scale))


def uuid_value(column: ColumnSpec, draw: Draw, position: Column | None) -> Column:
    """Allowed UUIDs are used up in row order, then generated ones follow."""
    made = uuid_text(draw)
    listed = [v.strip().lower() for v in column.allowed if _looks_like_uuid(v)]
    if not listed or position is None:
        return made
    stock = F.array(*[F.lit(v) for v in listed])
    inside = F.least(position, F.lit(len(listed) - 1)).cast("int") + 1
    return F.when(position < len(listed), F.element_at(stock, inside)).otherwise(made)


def _looks_like_uuid(text: str) -> bool:
    parts = [len(p) for p in (text or "").strip().split("-")]
    digits = (text or "").strip().replace("-", "").lower()
    return parts == [8, 4, 4, 4, 12] and all(c in "0123456789abcdef" for c in digits)


def numeric_limits(column: ColumnSpec, numeric_scale: int = 2) -> tuple[float | int, float | int]:
    """Bounds in force for a numeric column, from its own limits or the defaults of its type."""
    low, high = column.min_value, column.max_value
    if column.type in TYPE_LIMITS:
        default_high = BIGINT_MAX if column.type == "bigint" else INT_MAX
        floor, ceiling = TYPE_LIMITS[column.type]
        a = INT_MIN if low is None else int(low)
        b = min(default_high, ceiling) if high is None else int(high)
        if high is None and b < a:
            b = a + default_high
        a, b = min(a, b), max(a, b)
        return max(a, floor), min(b, ceiling)
    if column.type == "decimal" and column.length > 0 and high is None:
        scale = column.effective_scale(numeric_scale)
        with localcontext(prec=80):
            high = Decimal(10) ** (column.length - scale) - Decimal(10) ** (-scale)
        low = low if low is not None else (1 if high >= 1 else 0)
    low = 1 if low is None else low
    high = DECIMAL_MAX if high is None else high
    return (low, high) if low <= high else (high, low)


def numeric_value(column: ColumnSpec, draw: Draw, numeric_scale: int = 2) -> Column:
    low, high = numeric_limits(column, numeric_scale)
    if column.type in TYPE_LIMITS:
        return uniform_integer(draw, low, high).cast(column.data_type())
    scale = column.effective_scale(numeric_scale)
    if column.type == "decimal":
        return uniform_decimal(draw, low, high, column.length or 18, scale)
    return uniform_double(draw, low, high, scale).cast(column.data_type())


def fallback_value(column: ColumnSpec, row: Column, numeric_scale: int = 2) -> Column:
    """What a NOT NULL column holds when no rule gave a value."""
    kind = column.data_type(numeric_scale)
    if column.is_numeric:
        return F.lit(1).cast(kind)
    if column.type == "boolean":
        return F.lit(True)
    if column.is_text:
        return F.lit("default")
    if column.type == "array":
        return F.array(F.lit("default"))
    return row.cast("string").try_cast(kind)


def cell_value(
    column: ColumnSpec,
    draws: Draws,
    row: Column,
    settings: ValueSettings | None = None,
    position: Column | None = None,
) -> Column:
    """The value of one cell. ``row`` keys the randomness; ``position`` is the 0-based row number."""
    settings = settings or ValueSettings()
    scale = settings.numeric_scale
    draw = draws.at(column.name, row)
    if column.uuid:
        value = uuid_value(column, draw, position)
    elif column.allowed:
        value = pick_allowed(column, draw, scale)
    elif column.is_numeric:
        value = numeric_value(column, draw, scale)
    elif column.type == "boolean":
        value = F.pmod(draw.value, F.lit(2)) == 0
    elif column.type == "date":
        value = past_date(draw, settings.as_of)
    elif column.type == "timestamp":
        value = past_timestamp(draw, settings.as_of)
    elif column.is_text:
        value = text_value(column, draws, row, settings)
    elif column.type == "array":
        value = text_array(column, draws, row, settings)
    else:
        value = row.cast("string")
    if column.nullable:
        return F.when(~is_null_draw(draw, settings.null_tenths), value)
    # Only a value list can fail to give a value, when none of its texts fits the type.
    return F.coalesce(value, fallback_value(column, row, scale)) if column.allowed else value


def soft_delete_value(column: ColumnSpec, value: str | None, use_default: bool, numeric_scale: int = 2) -> Column:
    """A constant for soft-delete columns: the declared default, null, or the typed value.

    With ``use_default`` the script sink prints DEFAULT for the column; elsewhere the
    declared default is written.
    """
    kind = column.data_type(numeric_scale)
    text = column.default if use_default else value
    if text is None or text.upper() == "NULL":
        return F.lit(None).cast(kind)
    return F.lit(text).try_cast(kind)


def parse_column_list(text: str | None) -> frozenset[str]:
    """A comma-separated column list; blanks are trimmed and empty items dropped."""
    return frozenset(p.strip() for p in (text or "").split(",") if p.strip())
