"""Column limits, value lists and combinations from a table of CHECK expressions.

Input ``checks(table_name, expr)``. Each expression is cut into tokens once and written anew in one plain
spelling: one blank between tokens, column names bare of qualifiers and in double quotes, quoted texts
replaced by their token number in single quotes, casts left out. Short patterns over that spelling find the
rules; the finds are then matched to ``columns(table_name, column_name, length)`` by equality. No expression
is paired with columns it does not mention, and nothing inside a quoted text is taken for syntax.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from rowloom.model import ColumnSpec, CombinationRule, TableSpec
from rowloom.session import spread

# Tokens, in the order they are tried.
TEXT = r"'[^']*+(?:''[^']*+)*+'"
WORD = r'(?:"[^"]++"|[A-Za-z_][\w$]*+)'
TYPE = r"[A-Za-z_]\w*+(?:\s+(?:varying|precision|(?:with|without)\s+time\s+zone))?+(?:\s*\(\s*\d++(?:\s*,\s*\d++)?\s*\))?+(?:\s*\[\s*\])*+"
DIGITS = r"(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?"
TOKEN = rf"(?i){TEXT}|::\s*{TYPE}|{WORD}(?:\s*\.\s*{WORD})*+|{DIGITS}|<=|>=|<>|!=|\S"
KEYWORDS = ("AND", "OR", "NOT", "IN", "BETWEEN", "ANY", "ARRAY", "NULL", "IS", "LIKE", "CHECK")
LENGTHS = ("LENGTH", "CHAR_LENGTH", "CHARACTER_LENGTH")

# Rules in the plain spelling without parentheses. A column inside a function call, arithmetic, a negation
# or a list of columns says nothing about the column's own value.
COLUMN = r'(?<!#LENGTH |#CALL |NOT |[-+*/%|,] )"([^"]++)"'
WHOLE = r"(?! [-+*/%|])"
NUMBER = rf"(?:[-+] )?{DIGITS}"
ITEM = rf"""'\d++'|"[^"]++"|{NUMBER}"""
ITEMS = rf"((?:{ITEM})(?: , (?:{ITEM}))*+)"
BETWEEN = rf"{COLUMN} BETWEEN ({NUMBER}) AND ({NUMBER}){WHOLE}"
COMPARE = rf"{COLUMN} (>=|<=|>|<|=) ({NUMBER}){WHOLE}"
LENGTH = r'#LENGTH "([^"]++)" (<=|<|=|BETWEEN \d++ AND) (\d++)'
IN_LIST = rf"{COLUMN} IN {ITEMS}"
ANY_ARRAY = rf"{COLUMN} = ANY (?:ARRAY )?\[ {ITEMS}"
EQUALS = rf"{COLUMN} = ({ITEM}){WHOLE}"
QUOTED_OR_PAREN = r"""('[^']*+'|"[^"]*+")|[()]"""


def strip_parens(expr: Column) -> Column:
    """Parentheses outside quoted strings become blanks.

    Each quoted string and each parenthesis gets a mark; the mark behind a string's closing
    quote goes again, those in place of parentheses become blanks.
    """
    marked = F.regexp_replace(expr, QUOTED_OR_PAREN, "$1\u0001")
    return F.translate(F.regexp_replace(marked, "(['\"])\u0001", "$1"), "\u0001", " ")


def balanced(text: Column) -> Column:
    """What stands between a text's first character, an opening parenthesis, and the one that closes it; else null.

    Parentheses inside quoted texts don't count.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("quoted"))

    def step(state: Column, sign: Column) -> Column:
        quoted = state["quoted"] != (sign == "'")
        depth = state["depth"] + F.when(quoted, 0).when(sign == "(", 1).when(sign == ")", -1).otherwise(0)
        end = F.when((state["end"] == 0) & (depth == 0) & ~quoted, state["at"] + 1).otherwise(state["end"])
        return F.struct(depth.alias("depth"), (state["at"] + 1).alias("at"), end.alias("end"), quoted.alias("quoted"))

    end = F.aggregate(F.split(text, ""), start, step, lambda state: state["end"])
    return F.when(end > 1, F.substring(text, F.lit(2), end - 2))


def _plain_token(token: Column, number: Column, following: Column) -> Column:
    upper = F.upper(token)
    call = F.coalesce(following == "(", F.lit(False))
    name = F.concat(F.lit('"'), F.replace(F.regexp_extract(token, rf"({WORD})$", 1), F.lit('"'), F.lit("")), F.lit('"'))
    return (
        F.when(token.startswith("'"), F.concat(F.lit("'"), number.cast("string"), F.lit("'")))
        .when(token.startswith("::"), F.lit(""))
        .when(upper.isin(*KEYWORDS), upper)
        .when(upper.isin(*LENGTHS) & call, F.lit("#LENGTH"))
        .when(token.rlike(r'^[A-Za-z_"]') & call, F.lit("#CALL"))
        .when(token.rlike(r'^[A-Za-z_"]'), name)
        .otherwise(token)
    )


def plain_spelling(checks: DataFrame) -> DataFrame:
    """(table_name, expr, tokens, plain): blank and null expressions are left out.

    Texts take long for their size, so they are spread over all cores; few files or small partitions would make one task.
    """
    cut = spread(checks).where(F.length(F.trim("expr")) > 0).select("table_name", "expr", F.regexp_extract_all("expr", F.lit(TOKEN), 0).alias("tokens"))
    # Neighbours come side by side: a filter on the result may be moved below, where the tokens are an expression, and a
    # look at them from within would cut the text anew for every token.
    numbered = F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    spelled = F.zip_with(numbered, F.slice("tokens", F.lit(2), F.size("tokens")), lambda a, following: _plain_token(a["t"], a["i"], following))
    return cut.select("table_name", "expr", "tokens", F.array_join(F.filter(spelled, lambda t: t != ""), " ").alias("plain"))


def _flat(checks: DataFrame) -> DataFrame:
    """The plain spelling without parentheses; ``tokens`` are kept to read texts from."""
    flat = F.regexp_replace("plain", r"[()] | ?[()]", "")
    return plain_spelling(checks).select("table_name", "tokens", flat.alias("flat"))


def _finds(flat: DataFrame, rules: dict[str, tuple[str, str]], parts: int) -> DataFrame:
    """(table_name, tokens, kind, key, p0, p1) for ``{kind: (marker, pattern)}``, in one pass.

    A pattern runs only on texts that hold its marker word or sign. ``parts`` groups stand behind the column.
    """
    none = F.array().cast("array<string>")

    def tagged(kind: str, marker: str, pattern: str) -> Column:
        found = F.when(F.col("flat").contains(marker), F.regexp_extract_all(F.col("flat"), F.lit(pattern), 0)).otherwise(none)
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m")))

    every = F.concat(*[tagged(kind, *rule) for kind, rule in rules.items()])
    each = flat.select("table_name", "tokens", F.explode(every).alias("f")).select("table_name", "tokens", "f.kind", "f.m")

    def part(group: int) -> Column:
        if group > parts + 1:
            return F.lit(None).cast("string")
        return F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract("m", p, group)) for k, (_, p) in rules.items()])

    return each.select("table_name", "tokens", "kind", F.lower(part(1)).alias("key"), part(2).alias("p0"), part(3).alias("p1"))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("")).try_cast("double")


def _item(item: Column, tokens: Column) -> Column:
    """The value an item of a list stands for: a quoted text is read from its token."""
    at = F.regexp_extract(item, r"^'(\d+)'$", 1).try_cast("int")
    token = F.get(tokens, at)
    text = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit("''"), F.lit("'"))
    bare = F.when(item.startswith('"'), F.replace(item, F.lit('"'), F.lit(""))).otherwise(F.replace(item, F.lit(" "), F.lit("")))
    return F.coalesce(text, bare)


def column_limits(checks: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per column with its tightest bounds and text length; null where nothing limits it.

    Reversed BETWEEN bounds are swapped, repeated limits intersect, ``length(x) < n`` means
    n-1, and a declared column length caps the result. Other tests of a length bound neither
    the value nor the length. ``*_open`` marks strict bounds.
    """
    found = _finds(_flat(checks), {"between": ("BETWEEN", BETWEEN), "compare": ('"', COMPARE), "length": ("#LENGTH", LENGTH)}, 2)
    kind, first, second = F.col("kind"), _number(F.col("p0")), _number(F.col("p1"))
    op, compare = F.col("p0"), F.col("kind") == "compare"
    ends = F.greatest(F.regexp_extract("p0", r"(\d+)", 1).try_cast("int"), F.col("p1").try_cast("int"))
    limits = found.select(
        "table_name", "key",
        F.when(kind == "between", F.least(first, second)).when(compare & op.isin(">", ">=", "="), second).alias("low"),
        (compare & (op == ">")).alias("low_open"),
        F.when(kind == "between", F.greatest(first, second)).when(compare & op.isin("<", "<=", "="), second).alias("high"),
        (compare & (op == "<")).alias("high_open"),
        F.when(kind == "length", ends - F.when(op == "<", 1).otherwise(0)).alias("size"),
    )
    # Plain numbers aggregate by hash; at equal values the strict bound is the tighter one.
    merged = limits.groupBy("table_name", "key").agg(
        F.max(F.when(~F.col("low_open"), F.col("low"))).alias("low"), F.max(F.when(F.col("low_open"), F.col("low"))).alias("above"),
        F.min(F.when(~F.col("high_open"), F.col("high"))).alias("high"), F.min(F.when(F.col("high_open"), F.col("high"))).alias("below"),
        F.min("size").alias("size"),
    )
    named = columns.select("table_name", "column_name", "length", F.lower("column_name").alias("key"))
    declared = F.when(F.col("length") > 0, F.col("length"))
    low, high = F.greatest("low", "above"), F.least("high", "below")
    return named.join(merged, ["table_name", "key"], "left").select(
        "table_name", "column_name",
        low.alias("min_value"), F.coalesce(F.col("above") >= low, F.lit(False)).alias("min_open"),
        high.alias("max_value"), F.coalesce(F.col("below") <= high, F.lit(False)).alias("max_open"),
        F.least(F.col("size"), declared).alias("max_length"),
    )


def integer_bounds(low: Column, low_open: Column, high: Column, high_open: Column) -> tuple[Column, Column]:
    """Inclusive whole-number bounds: > 10 starts at 11, < 10 ends at 9."""
    first = F.when(low_open, F.floor(low) + 1).otherwise(F.ceil(low))
    last = F.when(high_open, F.ceil(high) - 1).otherwise(F.floor(high))
    return first.cast("bigint"), last.cast("bigint")


def allowed_values(checks: DataFrame, columns: DataFrame) -> DataFrame:
    """The values a column may take, one row each, from IN lists, ANY ARRAY[...] and equalities."""
    finds = _finds(_flat(checks), {"in": (" IN ", IN_LIST), "any": ("ANY", ANY_ARRAY), "eq": ("=", EQUALS)}, 1)
    items = finds.select("table_name", "key", "tokens", F.explode(F.split("p0", " , ")).alias("item"))
    found = items.select("table_name", "key", _item(F.col("item"), F.col("tokens")).alias("value")).where("value <> ''").distinct()
    named = columns.select("table_name", "column_name", F.lower("column_name").alias("key"))
    return found.join(named, ["table_name", "key"]).select("table_name", "column_name", "value")


# One condition of a clause in the plain spelling, and a value alone in parentheses.
_CONDITION = re.compile(rf"""^"([^"]+)" = ({ITEM})$""")
_ALONE = re.compile(rf"""(?<!IN )(?<!CALL )(?<!LENGTH )(?<!ANY )\( ((?:{ITEM})) \)""")


def clauses(plain: str) -> list[list[list[str]] | None]:
    """The alternatives of a condition, each as [column, value] pairs; None for one with other tests than equality.

    Parts joined by AND are multiplied out over the ORs inside them, to any depth.
    """
    before = None
    while before != plain:
        before, plain = plain, _ALONE.sub(r"\1", plain)
    # Per open parenthesis: the finished alternatives, and those of the part being read.
    frames: list[list] = [[[], None]]
    tokens, at = plain.split(" "), 0

    def join(found: list) -> None:
        now = frames[-1][1]
        frames[-1][1] = found if now is None else [None if a is None or b is None else a + b for a in now for b in found]

    fresh = True
    while at < len(tokens):
        token = tokens[at]
        if token in ("AND", "OR"):
            if token == "OR":
                frames[-1][0] += frames[-1][1] or []
                frames[-1][1] = None
            fresh, at = True, at + 1
        elif token == "(" and fresh:
            frames.append([[], None])
            at += 1
        elif token == ")":
            if len(frames) == 1:
                return []
            done, last = frames.pop()
            join(done + (last or []))
            fresh, at = False, at + 1
        else:
            start, depth = at, 0
            while at < len(tokens) and (depth or tokens[at] not in ("OR", ")") and (tokens[at] != "AND" or "BETWEEN" in tokens[start:at] and "AND" not in tokens[start:at])):
                depth += (tokens[at] == "(") - (tokens[at] == ")")
                at += 1
            match = _CONDITION.match(" ".join(tokens[start:at])) if fresh else None
            join([[[match[1].lower(), match[2]]] if match else None])
            fresh = False
    return frames[0][0] + (frames[0][1] or []) if len(frames) == 1 else []


_JOINED = re.compile(r"\b(?:AND|OR)\b")
Part = dict[str, str]


def product(a: list[Part], b: list[Part]) -> list[Part]:
    """Alternatives that take one of either side; contradictions and repeats drop out."""
    made: dict[tuple, Part] = {}
    for x in a:
        for y in b:
            if all(x.get(c, v) == v for c, v in y.items()):
                both = x | y
                made.setdefault(tuple(sorted(both.items())), both)
    return list(made.values())


def factors(plain: str, tokens: list[str]) -> list[list[Part]]:
    """A condition as factors that must all hold, each a list of alternatives {column: value}.

    Parts joined by AND stay apart, to any depth of parentheses, as long as no OR stands above them and they
    speak of different columns. Only factors that share a column are multiplied with each other, without the
    contradictions. Alternatives with other tests than equality are left out, and factors without alternatives.
    """
    before = None
    while before != plain:
        before, plain = plain, _ALONE.sub(r"\1", plain)

    def value(item: str) -> str:
        if item.startswith("'"):
            return tokens[int(item[1:-1])][1:-1].replace("''", "'")
        return item.replace('"', "") if item.startswith('"') else item.replace(" ", "")

    # Per open parenthesis: the alternatives before the last OR (None before the first one), and the factors since.
    frames: list[list] = [[None, []]]

    def closed(frame: list) -> list[list[Part]]:
        done, since = frame
        if done is None:
            return since
        one: list[Part] = [{}]
        for factor in since:
            one = product(one, factor)
        return [done + (one if since else [])]

    words, at, fresh = plain.split(" "), 0, True
    while at < len(words):
        word = words[at]
        if word == "OR":
            frames[-1] = [closed([frames[-1][0] or [], frames[-1][1]])[0], []]
            fresh, at = True, at + 1
        elif word == "AND":
            fresh, at = True, at + 1
        elif word == "(" and fresh:
            frames.append([None, []])
            at += 1
        elif word == ")":
            if len(frames) == 1:
                return []
            inner = closed(frames.pop())
            frames[-1][1] += inner
            fresh, at = False, at + 1
        else:
            start, depth = at, 0
            while at < len(words) and (depth or words[at] not in ("OR", ")") and (words[at] != "AND" or "BETWEEN" in words[start:at] and "AND" not in words[start:at])):
                depth += (words[at] == "(") - (words[at] == ")")
                at += 1
            match = _CONDITION.match(" ".join(words[start:at])) if fresh else None
            frames[-1][1].append([{match[1].lower(): value(match[2])}] if match else [])
            fresh = False
    if len(frames) > 1:
        return []
    # Under an OR a part with another test has no alternatives, so it drops out of the product; at the top it says nothing.
    return _apart([f for f in closed(frames[0]) if f])


def _apart(found: list[list[Part]]) -> list[list[Part]]:
    """Factors over different columns: those that share one are multiplied."""
    apart: list[tuple[set[str], list[Part]]] = []
    for factor in found:
        columns = {c for part in factor for c in part}
        near = [a for a in apart if a[0] & columns]
        for group in near:
            factor = product(group[1], factor)
            columns |= group[0]
        at = apart.index(near[0]) if near else len(apart)
        apart = [a for a in apart if a not in near]
        apart.insert(at, (columns, factor))
    return [factor for _, factor in apart if factor]


def _joins(plain: str) -> bool:
    """Whether equalities are joined; asked here, as a filter on the spelling would spell every text once more."""
    return " = " in plain and _JOINED.search(plain) is not None


_PART = StructType([
    StructField("factor", IntegerType()), StructField("clause", IntegerType()), StructField("column_name", StringType()), StructField("value", StringType()),
])


@F.pandas_udf(ArrayType(_PART))
def _factor_parts(plain: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([
        [
            {"factor": i, "clause": j, "column_name": c, "value": v}
            for i, f in enumerate(factors(p, list(t)) if _joins(p) else []) for j, part in enumerate(f) for c, v in part.items()
        ]
        for p, t in zip(plain, tokens, strict=True)
    ])


def value_factors(checks: DataFrame) -> DataFrame:
    """Rules written with AND, OR and equalities as a product of factors, one row per factor, clause and column.

    A row that takes one clause of each factor keeps the rule. The number of clauses is the sum, not the product,
    of the ORs joined by AND.
    """
    ready = plain_spelling(checks).select("table_name", "expr", "tokens", F.regexp_replace("plain", "^CHECK ", "").alias("plain"))
    # One row of lists per text: the explosions then carry the text's name, not its tokens.
    each = ready.select("table_name", "expr", F.explode(_factor_parts("plain", "tokens")).alias("part"))
    return each.select("table_name", "expr", "part.factor", "part.clause", "part.column_name", "part.value")


@F.pandas_udf(ArrayType(ArrayType(ArrayType(StringType()))))
def _clauses(plain: pd.Series) -> pd.Series:
    return plain.map(lambda p: clauses(p) if _joins(p) else [])


def value_combinations(checks: DataFrame) -> DataFrame:
    """Multi-column rules written as OR and AND of equalities, one row per clause and column.

    ORs inside a clause make a clause each, so this is for rules written as ORs of ANDs; ``value_factors`` is the
    way for ANDs of many ORs. A clause with anything but equalities is dropped.
    """
    ready = plain_spelling(checks).select("table_name", "expr", "tokens", F.regexp_replace("plain", "^CHECK ", "").alias("plain"))
    each = ready.select("table_name", "expr", "tokens", F.posexplode(_clauses("plain")).alias("clause", "parts"))
    single = each.select("table_name", "expr", "tokens", "clause", F.explode("parts").alias("part"))
    return single.select(
        "table_name", "expr", F.col("clause").cast("int").alias("clause"), F.get("part", F.lit(0)).alias("column_name"),
        _item(F.get("part", F.lit(1)), F.col("tokens")).alias("value"),
    )


def _rules(spec: TableSpec, combinations: DataFrame) -> tuple[CombinationRule, ...]:
    """The table's combination rules: the clauses of one factor of a CHECK over the same two or more of its columns."""
    if "factor" not in combinations.columns:
        combinations = combinations.withColumn("factor", F.lit(0))  # multiplied out, as ``value_combinations`` gives them
    texts: dict[tuple[str, int], dict[int, dict[str, str]]] = {}
    for r in combinations.where(F.col("table_name") == spec.name).orderBy("expr", "factor", "clause").collect():
        if spec.has_column(r["column_name"]):
            texts.setdefault((r["expr"], r["factor"]), {}).setdefault(r["clause"], {})[spec.column(r["column_name"]).name] = r["value"]
    found = []
    for by_clause in texts.values():
        names = sorted({c for clause in by_clause.values() for c in clause})
        whole = [tuple(clause[c] for c in names) for clause in by_clause.values() if len(clause) == len(names)]
        if len(names) > 1 and whole:
            found.append(CombinationRule(tuple(names), tuple(dict.fromkeys(whole))))
    return tuple(found)


def constrain(spec: TableSpec, limits: DataFrame, allowed: DataFrame, combinations: DataFrame | None = None) -> TableSpec:
    """Put extracted limits and rules (of ``value_factors``) into a table's specification; the frames are one schema in size."""
    bounds = {r["column_name"].lower(): r for r in limits.where(F.col("table_name") == spec.name).collect()}
    values: dict[str, list[str]] = {}
    for r in allowed.where(F.col("table_name") == spec.name).orderBy("column_name", "value").collect():
        values.setdefault(r["column_name"].lower(), []).append(r["value"])
    columns = []
    for c in spec.columns:
        r = bounds.get(c.name.lower())
        low, high, size = (r["min_value"], r["max_value"], r["max_length"]) if r else (None, None, None)
        if low is not None and high is not None and low > high:
            low = high = None  # equalities of different alternatives, which limit nothing together
        if r and c.type in ("tinyint", "smallint", "int", "bigint"):
            low = None if low is None else (int(low // 1) + 1 if r["min_open"] else int(-(-low // 1)))
            high = None if high is None else (int(-(-high // 1)) - 1 if r["max_open"] else int(high // 1))
        columns.append(_limited(c, low, high, tuple(values.get(c.name.lower(), ())), size))
    rules = spec.combinations + (_rules(spec, combinations) if combinations is not None else ())
    return TableSpec(spec.name, tuple(columns), spec.primary_key, spec.foreign_keys, spec.unique_keys, rules)


def _limited(c: ColumnSpec, low, high, allowed: tuple[str, ...], size: int | None) -> ColumnSpec:
    return c.constrained(low, high, allowed, size)
