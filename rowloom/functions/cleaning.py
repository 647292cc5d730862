"""Cleaning of free text returned by a model, as Column expressions on any text column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.model import ColumnSpec

# Openings and phrases of introductions (English, Spanish).
PREAMBLE_STARTS = ("here are", "here is", "sure,", "sure!", "certainly", "of course", "below are", "the following",
                   "aquí están", "aquí tienes", "aqui están", "aqui tienes", "por supuesto", "claro,", "claro.",
                   "los siguientes", "las siguientes", "estos son", "estas son")
PREAMBLE_PHRASES = ("unique and realistic", "values for the", "values for column")
# Openings of refusals (English, Spanish).
REFUSAL_STARTS = ("i cannot", "i can't", "i'm sorry", "i am sorry", "sorry,", "as an ai", "i'm not able",
                  "i am not able", "no puedo", "lo siento", "como ia", "como modelo", "como inteligencia artificial")
EDGE_SPACE = r"^[\x00-\x20]+|[\x00-\x20]+$"


def strip(text: Column) -> Column:
    """Remove blanks and control characters from both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


# Every step below refers to its input once, so a chain of steps stays one flat expression.


def first_line(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"^([^\r\n]*)", 1))


def strip_fences(text: Column) -> Column:
    """A bare code fence becomes empty; fences attached to trimmed content are cut off."""
    bare = F.regexp_replace(text, r"^```[\x00-\x20]*(?:[a-zA-Z]{1,12})?[\x00-\x20]*$", "")
    opened = F.regexp_replace(bare, r"^```[\x00-\x20]*", "")
    return F.regexp_replace(opened, r"[\x00-\x20]*```$", "")


def strip_quotes(text: Column) -> Column:
    """One pair of equal quotes around trimmed text is removed."""
    return strip(F.regexp_replace(text, r"""(?s)^(["'])(.*)\1$""", "$2"))


def is_chatter(text: Column) -> Column:
    """Introductions and refusals, which carry no value."""
    starts = "|".join(re.escape(p) for p in (*PREAMBLE_STARTS, *REFUSAL_STARTS))
    inside = "|".join(re.escape(p) for p in PREAMBLE_PHRASES)
    return text.rlike(f"(?isu)^(?:{starts})|{inside}")


def strip_column_prefix(text: Column, column: Column) -> Column:
    """``name: value`` and ``name = value`` become ``value``; a mere common beginning stays."""
    rest = r"""\E[\x00-\x20]*[:=][\x00-\x20]*(?:(["'])(.*)\1|(.*))$"""
    pattern = F.concat(F.lit(r"(?isu)^\Q"), column, F.lit(rest))
    return strip(F.regexp_replace(text, pattern, F.lit("$2$3")))


def clean_model_text(text: Column, column_name: Column | str | None = None) -> Column:
    """First line without fences, quotes, numbering, bullets or column prefix; null for chatter.

    A text that only repeats the column name is null too.
    """
    out = strip_quotes(strip_fences(first_line(text)))
    out = strip(F.regexp_replace(out, r"^\d+[.)\-]\s*", ""))
    out = strip(F.regexp_replace(out, r"^[-*] ", ""))
    cleaned = out
    if isinstance(column_name, str):
        column_name = F.lit(column_name) if column_name else None
    if column_name is not None:
        # An absent or empty name changes nothing.
        name = F.nullif(column_name, F.lit(""))
        cleaned = strip_column_prefix(out, F.coalesce(name, F.lit("\0")))
        cleaned = F.when(name.isNull() | (F.lower(cleaned) != F.lower(name)), cleaned)
    return F.when(~is_chatter(out), cleaned)


def parse_text_array(text: Column) -> Column:
    """``[a, b]`` or ``{a, b}`` as an array of trimmed, unquoted texts."""
    body = F.regexp_replace(strip(text), r"^\[(.*)\]$|^\{(.*)\}$", "$1$2")
    parts = F.transform(
        F.split(body, ",", -1),
        lambda p: F.regexp_replace(strip(p), r"""^"(.*)"$|^'(.*)'$""", "$1$2"),
    )
    return F.when(body == "", F.array().cast("array<string>")).otherwise(parts)


def provided_value(text: Column, column: ColumnSpec, numeric_scale: int = 2) -> Column:
    """A provided text as a value of the column: trimmed, cut to length, cast; null when blank or unfit."""
    trimmed = strip(text)
    filled = F.when(trimmed != "", trimmed)
    kind = column.data_type(numeric_scale)
    if isinstance(kind, T.ArrayType):
        return F.when(filled.isNotNull(), parse_text_array(filled))
    cut = F.substring(filled, 1, column.length) if column.length > 0 and column.is_text else filled
    return cut.try_cast(kind)
