"""Generated rows, keyed by the rows of the provided tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.keyed import Draws, uuid_text
from rowloom.functions.patterns import pattern_column
from rowloom.functions.values import (
    COUNTRY_CODES_2,
    COUNTRY_CODES_3,
    LATIN_WORDS,
    ValueSettings,
    parse_column_list,
)
from rowloom.model import ColumnSpec, CombinationRule, ForeignKey, RepetitionRule, TableSpec
from rowloom.operators.combinations import attach_combinations
from rowloom.operators.enrichment import attach_phrases
from rowloom.operators.generate import GenerateOptions, generate_over, generate_table
from rowloom.operators.indexing import dense_index
from rowloom.operators.quality import integrity_report
from rowloom.operators.uniqueness import first_per_key, least_in_all, make_unique
from rowloom.plans.seeding import SeedOptions, seed
from rowloom.sources.tables import vocabulary, word_list
from workload.common import SEED, draw, nullable, step, table, uuid_sql

AS_OF = dt.datetime(2024, 6, 1)
AS_OF_EPOCH = 1717200000
C = ColumnSpec

SCALARS = TableSpec(
    "scalars",
    (
        C("tiny", "tinyint", False), C("small", "smallint"), C("number", "int"), C("big", "bigint", False),
        C("ranged", "int", False, min_value=20, max_value=10), C("price", "decimal", length=10, scale=2),
        C("narrow", "decimal", False, length=2, scale=2), C("bounded", "decimal", False, 8, 3, 0.5, 9.25),
        C("wide", "decimal", False, length=30, scale=4), C("ratio", "double"), C("share", "double", False, 0, 2, 0, 1),
        C("flag", "boolean"), C("day", "date"), C("moment", "timestamp"), C("code", uuid=True, nullable=False),
        C("status", "string", allowed=("F", "O", "P")), C("rank", "int", False, allowed=("1", " 2 ", "x")),
        C("other", "json", False),
    ),
)


def _options(**more) -> GenerateOptions:
    return GenerateOptions(SEED, values=ValueSettings(as_of=AS_OF), **more)


def gen_scalar_types(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("_idx"))
    return generate_over(keys, SCALARS, 0, _options()).drop("_rule_id").withColumnRenamed("_idx", "o_orderkey")


def _s(column: str, salt: str = "v") -> str:
    return draw("scalars", column, "o_orderkey", salt)


def _sn(column: str, value: str) -> str:
    return nullable("scalars", column, "o_orderkey", value)


GEN_SCALAR_TYPES = f"""
SELECT o_orderkey,
  (1 + {_s('tiny')} % 127)::TINYINT AS tiny,
  ({_sn('small', f"1 + {_s('small')} % 10000")})::SMALLINT AS small,
  ({_sn('number', f"1 + {_s('number')} % 10000")})::INTEGER AS number,
  (1 + {_s('big')} % 1000000)::BIGINT AS big,
  (10 + {_s('ranged')} % 11)::INTEGER AS ranged,
  {_sn('price', f"((100 + {_s('price')} % 9999999900)::DECIMAL(18,0) * 0.01::DECIMAL(3,2))::DECIMAL(10,2)")} AS price,
  (({_s('narrow')} % 100)::DECIMAL(18,0) * 0.01::DECIMAL(3,2))::DECIMAL(2,2) AS narrow,
  ((500 + {_s('bounded')} % 8751)::DECIMAL(18,0) * 0.001::DECIMAL(4,3))::DECIMAL(8,3) AS bounded,
  (((10000::HUGEINT + ({_s('wide')}::HUGEINT * 4503599627370496::HUGEINT + {draw('scalars', 'wide', 'o_orderkey', 'v', 14, 13)}::HUGEINT)
     % 999999999999999999999999990000::HUGEINT)::DECIMAL(31,0)) * 0.0001::DECIMAL(5,4))::DECIMAL(30,4) AS wide,
  {_sn('ratio', f"(100 + {_s('ratio')} % 99901)::DOUBLE / 100")} AS ratio,
  ({_s('share')} % 101)::DOUBLE / 100 AS share,
  {_sn('flag', f"{_s('flag')} % 2 = 0")} AS flag,
  {_sn('day', f"DATE '2024-06-01' - ({_s('day')} % 3650)::INTEGER")} AS day,
  {_sn('moment', f"make_timestamp(({AS_OF_EPOCH} - {_s('moment')} % 31536000) * 1000000)")} AS moment,
  {uuid_sql('scalars', 'code', 'o_orderkey')} AS code,
  {_sn('status', f"(['F', 'O', 'P'])[({_s('status')} % 3 + 1)::INTEGER]")} AS status,
  (([1, 2, 1])[({_s('rank')} % 3 + 1)::INTEGER])::INTEGER AS rank,
  o_orderkey::VARCHAR AS other
FROM orders
"""

TEXTS = TableSpec(
    "texts",
    (
        C("note", "string", length=40), C("short", "varchar", False, 8), C("padded", "char", False, 30),
        C("iban", "varchar", False, 24), C("country", "char", False, 2), C("nation", "char", False, 3),
        C("user_avatar", "varchar", False, 10), C("tags", "array", False, 12),
    ),
)


def _type_words(spark: SparkSession, d: str) -> tuple[str, ...]:
    """The distinct words of part types; the limit guards the inline list."""
    return word_list(vocabulary(table(spark, d, "part"), "p_type"), 10_000)


def gen_text(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "events").select(F.col("event_id").alias("_idx"))
    countries = (COUNTRY_CODES_2, COUNTRY_CODES_3)
    options = GenerateOptions(SEED, values=ValueSettings(words=_type_words(spark, d), countries=countries))
    return generate_over(keys, TEXTS, 0, options).drop("_rule_id").withColumnRenamed("_idx", "event_id")


def _phrase(column: str, tag: str, low: int, high: str, count: int, words: str, n: str, owner: str = "texts", row: str = "event_id") -> str:
    """Words low..high joined by blanks; high may depend on the word count."""
    parts = []
    for slot in range(count):
        group, place = divmod(slot, 4)
        salt = tag if group == 0 else f"{tag}{group}"
        parts.append(f"{words}[({draw(owner, column, row, salt, 1 + 6 * place, 6)} % {n} + 1)::INTEGER]")
    size = f"({low} + {draw(owner, column, row, tag, 25, 2)} % ({high} - {low} + 1))"
    return f"array_to_string(([{', '.join(parts)}])[1:{size}::INTEGER], ' ')"


_WORDS_CTE = """
WITH w AS (SELECT list_sort(list(DISTINCT u)) AS l FROM
  (SELECT unnest(string_split_regex(p_type, '\\s+')) AS u FROM part) WHERE u <> ''),
ws AS (SELECT l, len(l) AS n, least(len(l), 5) - 1 AS high FROM w)
"""


def _own(column: str, tag: str = "v") -> str:
    return _phrase(column, tag, 1, "high", 4, "l", "n")


def _codes(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


GEN_TEXT = _WORDS_CTE + f"""
SELECT event_id,
  {nullable('texts', 'note', 'event_id', f"substr({_own('note')}, 1, 40)")} AS note,
  substr({_own('short')}, 1, 8) AS short,
  rpad({_own('padded')}, 30, ' ') AS padded,
  'ES' || lpad(({draw('texts', 'iban', 'event_id')} % 100000000000)::VARCHAR, 11, '0')
       || lpad(({draw('texts', 'iban', 'event_id', 'v', 14)} % 100000000000)::VARCHAR, 11, '0') AS iban,
  ({_codes(COUNTRY_CODES_2)})[({draw('texts', 'country', 'event_id')} % 40 + 1)::INTEGER] AS country,
  ({_codes(COUNTRY_CODES_3)})[({draw('texts', 'nation', 'event_id')} % 40 + 1)::INTEGER] AS nation,
  'https://images.example.com/' || ({draw('texts', 'user_avatar', 'event_id')} % 1000000)::VARCHAR || '.jpg' AS user_avatar,
  ([{', '.join(f"substr({_own('tags', f'e{i}')}, 1, 12)" for i in range(3))}])[1:(1 + {draw('texts', 'tags', 'event_id')} % 3)::INTEGER] AS tags
FROM events, ws
"""

LATIN = TableSpec("latin", (C("body", "string", False, 200), C("brief", "string", False, 15), C("mixed", "string", False, 60)))


def gen_text_latin(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("_idx"))
    options = GenerateOptions(SEED, values=ValueSettings(words=_type_words(spark, d), latin=True))
    plain = generate_over(keys, TableSpec("latin", LATIN.columns[:2]), 0, GenerateOptions(SEED))
    mixed = generate_over(keys, TableSpec("latin", LATIN.columns[2:]), 0, options)
    return plain.drop("_rule_id").join(mixed.drop("_rule_id"), "_idx").withColumnRenamed("_idx", "c_custkey")


def _latin(column: str, high: int) -> str:
    return _phrase(column, "v", 3, str(high), high, _codes(LATIN_WORDS), str(len(LATIN_WORDS)), "latin", "c_custkey")


GEN_TEXT_LATIN = _WORDS_CTE + f"""
SELECT c_custkey, substr({_latin('body', 9)}, 1, 200) AS body, substr({_latin('brief', 3)}, 1, 15) AS brief,
  substr(CASE WHEN {draw('latin', 'mixed', 'c_custkey', 'vsource', 27, 6)} % 2 = 0
    THEN {_phrase('mixed', 'v', 1, 'high', 4, 'l', 'n', 'latin', 'c_custkey')} ELSE {_latin('mixed', 9)} END, 1, 60) AS mixed
FROM customer, ws
"""


def gen_text_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Phrases over the whole vocabulary of the documents, found by index join."""
    rows = table(spark, d, "orders").select("o_orderkey")
    words = vocabulary(table(spark, d, "documents"), "text")
    return attach_phrases(rows, "o_orderkey", words, Draws(SEED, "vocabulary"), "phrase")


GEN_TEXT_VOCABULARY = f"""
WITH v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS pos FROM
    (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) WHERE word <> '')),
s AS (SELECT count(*) AS n, CASE WHEN count(*) > 1 THEN least(count(*), 5) - 1 ELSE 1 END AS high FROM v),
slots AS (SELECT o_orderkey, unnest(range(0, (1 + {draw('vocabulary', 'phrase', 'o_orderkey', 'v', 25, 2)} % high)::BIGINT)) AS slot, n
  FROM orders, s)
SELECT o_orderkey, string_agg(word, ' ' ORDER BY slot) AS phrase
FROM slots JOIN v ON v.pos = {draw('vocabulary', 'phrase', "(o_orderkey::VARCHAR || '#' || slot::VARCHAR)")} % n
GROUP BY o_orderkey
"""

KEYS = TableSpec(
    "keys",
    (
        C("id", "int", False), C("part_a", "smallint", False, min_value=1, max_value=300),
        C("part_b", "bigint", False, min_value=100, max_value=10**9), C("label", "varchar", False, 30),
        C("tag", "varchar", False, 4),
    ),
    ("part_a", "part_b"),
    unique_keys=(("id",), ("label",), ("tag",)),
)


def gen_keys(spark: SparkSession, d: str) -> DataFrame:
    indexed = dense_index(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "_idx")
    made = generate_over(indexed.df, KEYS, indexed.count, _options())
    return made.drop("_rule_id").withColumnRenamed("_idx", "pos")


_LABEL = _phrase("label", "v", 3, "5", 5, _codes(LATIN_WORDS), str(len(LATIN_WORDS)), "keys", "pos")
GEN_KEYS = f"""
WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, (SELECT count(*) FROM orders) AS n FROM orders),
q AS (SELECT n, least(300, n) AS a, 999999901::BIGINT AS b, greatest(10000, n) AS i, 36^4::BIGINT AS t,
  length(CASE WHEN n <= 1 THEN '0' ELSE base36 END) AS digits FROM
  (SELECT DISTINCT n, CASE WHEN n - 1 < 36 THEN '1' WHEN n - 1 < 1296 THEN '22' WHEN n - 1 < 46656 THEN '333'
     WHEN n - 1 < 1679616 THEN '4444' ELSE '55555' END AS base36 FROM p)),
s AS (SELECT q.*, a * b AS space FROM q),
st AS (SELECT s.*, {step('space')} AS step_space, {step('i')} AS step_i, {step('1679616')} AS step_t FROM s),
c AS (SELECT p.pos, st.*, ((pos::HUGEINT * step_space + {SEED}) % space)::BIGINT AS code,
  (pos * step_t + {SEED}) % 1679616 AS tcode FROM p, st)
SELECT pos, (1 + (pos * step_i + {SEED} % i) % i)::INTEGER AS id, (1 + code % a)::SMALLINT AS part_a, 100 + (code // a) AS part_b,
  substr({_LABEL}, 1, (29 - digits)::INTEGER) || '-' ||
    lpad(substr('0123456789abcdefghijklmnopqrstuvwxyz', (pos // 46656 % 36 + 1)::INTEGER, 1)
      || substr('0123456789abcdefghijklmnopqrstuvwxyz', (pos // 1296 % 36 + 1)::INTEGER, 1)
      || substr('0123456789abcdefghijklmnopqrstuvwxyz', (pos // 36 % 36 + 1)::INTEGER, 1)
      || substr('0123456789abcdefghijklmnopqrstuvwxyz', (pos % 36 + 1)::INTEGER, 1), 4, '0')[(5 - digits):4] AS label,
  substr('0123456789abcdefghijklmnopqrstuvwxyz', (tcode // 46656 % 36 + 1)::INTEGER, 1)
    || substr('0123456789abcdefghijklmnopqrstuvwxyz', (tcode // 1296 % 36 + 1)::INTEGER, 1)
    || substr('0123456789abcdefghijklmnopqrstuvwxyz', (tcode // 36 % 36 + 1)::INTEGER, 1)
    || substr('0123456789abcdefghijklmnopqrstuvwxyz', (tcode % 36 + 1)::INTEGER, 1) AS tag
FROM c
"""


def gen_multi_check(spark: SparkSession, d: str) -> DataFrame:
    """Allowed combinations taken from the data, as a table of any length."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("_idx"))
    pairs = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    combos = dense_index(pairs, ["l_returnflag", "l_linestatus"], "at").df.toDF("c0", "c1", "at")
    rows = generate_over(keys, TableSpec("flags", (C("qty", "int", False),)), 0, _options())
    made = attach_combinations(rows, combos, ["l_returnflag", "l_linestatus"], Draws(SEED, "flags"), F.col("_idx"))
    return made.select(F.col("_idx").alias("o_orderkey"), F.col("_combo0").alias("l_returnflag"), F.col("_combo1").alias("l_linestatus"), "qty")


GEN_MULTI_CHECK = f"""
WITH c AS (SELECT list(s ORDER BY s.f, s.t) AS l, count(*) AS n FROM
  (SELECT DISTINCT {{'f': l_returnflag, 't': l_linestatus}} AS s FROM lineitem)),
p AS (SELECT o_orderkey, l[({draw('flags', 'l_returnflag__l_linestatus', 'o_orderkey', 'combo')} % n + 1)::INTEGER] AS s FROM orders, c)
SELECT o_orderkey, s.f AS l_returnflag, s.t AS l_linestatus,
  (1 + {draw('flags', 'qty', 'o_orderkey')} % 10000)::INTEGER AS qty FROM p
"""

RULED = TableSpec(
    "ruled",
    (
        C("id", "bigint", False, min_value=1, max_value=10**9), C("status", "string", True, 10), C("amount", "int", False),
        C("note", "int"), C("kind", "string", False), C("grade", "string", False),
    ),
    ("id",),
    combinations=(CombinationRule(("kind", "grade"), (("a", "1"), ("a", "2"), ("b", "3"))),),
)
RULES = (
    RepetitionRule(50, {"STATUS": "vip", "amount": "12"}, ("note",)),
    RepetitionRule(30, {"status": "NULL", "amount": "oops", "kind": "b"}),
    RepetitionRule(20, {"id": "777", "grade": "2"}, ("amount",)),
)


def gen_rules(spark: SparkSession, d: str) -> DataFrame:
    indexed = dense_index(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "_idx")
    return generate_over(indexed.df, RULED, indexed.count, _options(rules=RULES)).withColumnRenamed("_idx", "pos").withColumnRenamed("_rule_id", "rule_id")


def _constant_row(rule: int) -> str:
    return f"(CASE WHEN rule_id = {rule} THEN 'r{rule}' ELSE pos::VARCHAR END)"


# Rule 2 pins the whole key, so it makes one row.
GEN_RULES = f"""
WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
r AS (SELECT pos, (CASE WHEN pos < 50 THEN 0 WHEN pos < 80 THEN 1 WHEN pos < 81 THEN 2 END)::INTEGER AS rule_id,
  {step('1000000000')} AS st FROM p),
k AS (SELECT *, {draw('ruled', 'kind__grade', 'pos', 'combo')} AS pick FROM r)
SELECT pos, rule_id,
  CASE WHEN rule_id = 2 THEN 777 ELSE 1 + (pos * st + {SEED}) % 1000000000 END AS id,
  CASE rule_id WHEN 0 THEN 'vip' WHEN 1 THEN NULL ELSE
    {nullable('ruled', 'status', 'pos', f"substr({_phrase('status', 'v', 3, '3', 3, _codes(LATIN_WORDS), str(len(LATIN_WORDS)), 'ruled', 'pos')}, 1, 10)")} END AS status,
  (CASE WHEN rule_id = 0 THEN 12 ELSE 1 + {draw('ruled', 'amount', _constant_row(2))} % 10000 END)::INTEGER AS amount,
  ({nullable('ruled', 'note', _constant_row(0), f"1 + {draw('ruled', 'note', _constant_row(0))} % 10000")})::INTEGER AS note,
  CASE WHEN rule_id = 1 THEN 'b' WHEN rule_id = 2 THEN 'a' ELSE (['a', 'a', 'b'])[(pick % 3 + 1)::INTEGER] END AS kind,
  CASE WHEN rule_id = 1 THEN '3' WHEN rule_id = 2 THEN '2' ELSE (['1', '2', '3'])[(pick % 3 + 1)::INTEGER] END AS grade
FROM k
"""


def unique_first_seen(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return first_per_key(events, ["user_id", "event_type"], "event_id")


UNIQUE_FIRST_SEEN = """
SELECT event_id, user_id, event_type, value FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1
"""


def unique_first_seen_nulls(spark: SparkSession, d: str) -> DataFrame:
    """A key with nulls: SQL's rule keeps every row with a null, the stricter one keeps the first."""
    events = table(spark, d, "events").select("event_id", F.when(F.col("value") < 20, F.col("event_type")).alias("kind"))
    strict = first_per_key(events, ["kind"], "event_id", nulls_equal=True).withColumn("rule", F.lit("nulls equal"))
    return first_per_key(events, ["kind"], "event_id").withColumn("rule", F.lit("nulls distinct")).unionByName(strict)


UNIQUE_FIRST_SEEN_NULLS = """
WITH e AS (SELECT event_id, CASE WHEN value < 20 THEN event_type END AS kind FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS rn FROM e)
SELECT event_id, kind, 'nulls distinct' AS rule FROM r WHERE rn = 1 OR kind IS NULL
UNION ALL SELECT event_id, kind, 'nulls equal' FROM r WHERE rn = 1
"""


def unique_retry(spark: SparkSession, d: str) -> DataFrame:
    """Codes for all orders drawn from a domain twice as large; losers draw again, twice, then take the free codes."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("_idx"))
    domain = 2 * orders.count()
    draws = Draws(SEED, "codes")

    def with_code(df: DataFrame, round_: int) -> DataFrame:
        return df.withColumn("code", draws.at("code", F.col("_idx"), f"round{round_}").below(domain))

    codes = spark.range(domain).withColumnRenamed("id", "code")
    done = make_unique(with_code(orders, 0), ["code"], with_code, rounds=2, domain=codes)
    return done.rows.withColumnRenamed("_idx", "o_orderkey")


def _retry_round(n: int) -> str:
    return f"{draw('codes', 'code', 'k', f'round{n}')} % (SELECT 2 * count(*) FROM orders)"


UNIQUE_RETRY = f"""
WITH c0 AS (SELECT o_orderkey AS k, {_retry_round(0).replace("|| k ||", "|| o_orderkey ||")} AS code FROM orders),
a0 AS (SELECT min(k) AS k, code FROM c0 GROUP BY code),
c1 AS (SELECT k, {_retry_round(1)} AS code FROM c0 WHERE k NOT IN (SELECT k FROM a0)),
a1 AS (SELECT min(k) AS k, code FROM c1 WHERE code NOT IN (SELECT code FROM a0) GROUP BY code),
c2 AS (SELECT k, {_retry_round(2)} AS code FROM c1 WHERE k NOT IN (SELECT k FROM a1)),
a2 AS (SELECT min(k) AS k, code FROM c2 WHERE code NOT IN (SELECT code FROM a0) AND code NOT IN (SELECT code FROM a1) GROUP BY code),
drawn AS (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2),
waiting AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderkey NOT IN (SELECT k FROM drawn)),
free AS (SELECT code, row_number() OVER (ORDER BY code) AS nth FROM (SELECT unnest(range(0, 2 * count(*))) AS code FROM orders)
  WHERE code NOT IN (SELECT code FROM drawn))
SELECT k AS o_orderkey, code FROM drawn UNION ALL SELECT k, code FROM waiting JOIN free USING (nth)
"""


def rekey_uuid(spark: SparkSession, d: str) -> DataFrame:
    """Customers and their orders re-keyed by the same expression, then joined on the new key."""
    draws = Draws(SEED, "customer")
    customers = table(spark, d, "customer").select(
        uuid_text(draws.at("c_custkey", F.col("c_custkey"))).alias("customer_uuid"), "c_custkey", "c_name"
    )
    orders = table(spark, d, "orders").select(
        uuid_text(draws.at("c_custkey", F.col("o_custkey"))).alias("customer_uuid"), "o_orderkey"
    )
    return orders.join(customers, "customer_uuid").select("o_orderkey", "customer_uuid", "c_custkey", "c_name")


REKEY_UUID = f"""
SELECT o_orderkey, {uuid_sql('customer', 'c_custkey', 'c_custkey')} AS customer_uuid, c_custkey, c_name
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def uuid_allowed(spark: SparkSession, d: str) -> DataFrame:
    """A listed stock of UUIDs is used up in row order, then generated ones follow."""
    stock = ("00000000-0000-4000-8000-000000000001", "not a uuid", "00000000-0000-4000-8000-000000000002")
    indexed = dense_index(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "_idx")
    spec = TableSpec("stocked", (C("code", nullable=False, uuid=True, allowed=stock),))
    return generate_over(indexed.df, spec, indexed.count, _options()).select(F.col("_idx").alias("pos"), "code")


UUID_ALLOWED = f"""
WITH p AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT pos, CASE pos WHEN 0 THEN '00000000-0000-4000-8000-000000000001' WHEN 1 THEN '00000000-0000-4000-8000-000000000002'
  ELSE {uuid_sql('stocked', 'code', 'pos')} END AS code FROM p
"""

SOFT = TableSpec(
    "soft",
    (
        C("name", "string", False, 20, allowed=("x", "y")), C("is_deleted", "int", False), C("archived", "boolean", False),
        C("deleted_at", "timestamp"), C("secret", "int", False), C("owner_id", "bigint"),
    ),
    foreign_keys=(ForeignKey(("owner_id",), "owners", ("id",)),),
)


def soft_delete_fill(spark: SparkSession, d: str) -> DataFrame:
    """Soft-delete columns get a typed constant; unfit constants become null; excluded and FK columns are null."""
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").alias("_idx"))
    options = _options(
        soft_delete=parse_column_list(" is_deleted, , archived ,deleted_at"), soft_delete_value="0",
        excluded=frozenset({"secret"}),
    )
    return generate_over(keys, SOFT, 0, options).drop("_rule_id").withColumnRenamed("_idx", "s_suppkey")


SOFT_DELETE_FILL = f"""
SELECT s_suppkey, (['x', 'y'])[({draw('soft', 'name', 's_suppkey')} % 2 + 1)::INTEGER] AS name, 0 AS is_deleted,
  false AS archived, NULL::TIMESTAMP AS deleted_at, NULL::INTEGER AS secret, NULL::BIGINT AS owner_id FROM supplier
"""


def regex_rows(spark: SparkSession, d: str) -> DataFrame:
    """One text per order from a pattern, and whether it matches; a second one has to fit ten characters."""
    pattern, repeated = r"[A-Z]{2}-\d{3,5}(x|yz)?", r"([a-c]\d)+_\1"
    orders = table(spark, d, "orders").select("o_orderkey")
    key, draws = F.col("o_orderkey"), Draws(SEED, "codes")
    made = orders.withColumn("code", pattern_column(pattern, key, draws=draws)).withColumn("short", pattern_column(repeated, key, 10, draws))
    fits = F.col("short").rlike(f"^(?:{repeated})$") & (F.length("short") <= 10)
    return made.select("o_orderkey", "code", F.col("code").rlike(f"^(?:{pattern})$").alias("matches"), fits.alias("fits"))


def _places(place: str, characters: str, times: int) -> str:
    """The characters drawn by the turns of a repeat, as SQL."""
    return " || ".join(
        f"substr('{characters}', ({draw('codes', place, f"o_orderkey || '.{i}'")} % {len(characters)} + 1)::INTEGER, 1)"
        for i in range(1, times + 1)
    )


REGEX_ROWS = f"""
SELECT o_orderkey, true AS matches, true AS fits,
  {_places('r.0.0', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 2)} || '-' ||
  substr({_places('r.2.0', '0123456789', 5)}, 1, (3 + {draw('codes', 'r.2', 'o_orderkey', 'n')} % 3)::INTEGER) ||
  CASE WHEN {draw('codes', 'r.3', 'o_orderkey', 'n')} % 2 = 0 THEN ''
       WHEN {draw('codes', 'r.3.0.0', "o_orderkey || '.1'")} % 2 = 0 THEN 'x' ELSE 'yz' END AS code
FROM orders
"""


def gen_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Fewer rows than asked for when the key has fewer values: a tenth of the orders, as keys 1..n/10."""
    n = table(spark, d, "orders").count()
    spec = TableSpec("small", (C("id", "int", False, min_value=1, max_value=n // 10),), ("id",))
    made = generate_table(spark, spec, n, _options())
    return made.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_keys"), F.min("id").alias("low"), F.max("id").alias("high"))


GEN_CAPACITY = """
SELECT count(*) // 10 AS n_rows, count(*) // 10 AS n_keys, 1 AS low, (count(*) // 10)::INTEGER AS high FROM orders
"""

def unique_all_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct keys for keys of every kind, as many rows as there are orders (lines: five times)."""
    n = table(spark, d, "orders").count()
    primary = {
        "date": (C("k", "date"),), "decimal": (C("k", "decimal", length=14, scale=2),),
        "boolean and date": (C("f", "boolean"), C("k", "date")),
        "value list and number": (C("k", allowed=("a", "b", "c")), C("m", "int", min_value=1, max_value=n)),
    }
    unique = {"unique pair": (C("a", "int", False, min_value=1, max_value=n), C("b", "smallint", False, min_value=1, max_value=3)),
              "unique date": (C("a", "date", False),)}
    specs = [TableSpec(name, cols, tuple(c.name for c in cols)) for name, cols in primary.items()]
    specs += [TableSpec(name, cols, unique_keys=(tuple(c.name for c in cols),)) for name, cols in unique.items()]
    made = {s.name: (generate_table(spark, s, n, _options()), [c.name for c in s.columns]) for s in specs}
    parent = TableSpec("parents", (C("id", "bigint"),), ("id",))
    lines = TableSpec("lines", (C("parent", "bigint"), C("line", "int", min_value=1, max_value=7), C("v", "int")), ("parent", "line"),
                      (ForeignKey(("parent",), "parents", ("id",)),))
    seeded = seed(spark, (parent, lines), SeedOptions(rows={"parents": n, "lines": 5 * n}, table=_options()))
    made["parent and line"] = (seeded.tables["lines"], ["parent", "line"])
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("key_kind"), F.count("*").alias("n_rows"), F.count_distinct(*key).alias("n_keys")) for name, (df, key) in made.items()
    ])


UNIQUE_ALL_KINDS = """
SELECT unnest(['date', 'decimal', 'boolean and date', 'value list and number', 'unique pair', 'unique date']) AS key_kind,
  count(*) AS n_rows, count(*) AS n_keys FROM orders
UNION ALL SELECT 'parent and line', 5 * count(*), 5 * count(*) FROM orders
"""


def shortfall_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows made and rows missing where a key has fewer values than rows were asked for."""
    n = table(spark, d, "orders").count()
    codes = TableSpec("codes", (C("code", "int", False, min_value=1, max_value=n // 10),), unique_keys=(("code",),))
    lines = TableSpec("lines", (C("code", "int"), C("line", "int", min_value=1, max_value=3)), ("code", "line"),
                      (ForeignKey(("code",), "codes", ("code",)),))
    made = seed(spark, (codes, lines), SeedOptions(rows=n, table=_options()))
    return reduce(DataFrame.unionByName, [
        made.tables[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"), F.lit(made.shortfall.get(t, 0)).cast("bigint").alias("missing"))
        for t in ("codes", "lines")
    ])


SHORTFALL_REPORT = """
SELECT 'codes' AS table_name, count(*) // 10 AS n_rows, count(*) - count(*) // 10 AS missing FROM orders
UNION ALL SELECT 'lines', 3 * (count(*) // 10), count(*) - 3 * (count(*) // 10) FROM orders
"""


def seed_ruled_shared_key(spark: SparkSession, d: str) -> DataFrame:
    """Rules on a root table, a table that shares its key, and one that refers to that: all rules hold."""
    n = table(spark, d, "supplier").count()
    users = TableSpec("users", (C("id", "int"), C("kind")), ("id",))
    profile = TableSpec("profile", (C("id", "int"),), ("id",), (ForeignKey(("id",), "users", ("id",), one_to_one=True, name="of"),))
    photo = TableSpec("photo", (C("id", "int"), C("p", "int", False)), ("id",), (ForeignKey(("p",), "profile", ("id",), name="shows"),))
    specs = (users, profile, photo)
    rules = {"users": [RepetitionRule(3, {"kind": "vip"})]}
    made = seed(spark, specs, SeedOptions(rows=n, rules=rules, table=_options()))
    return integrity_report(made.tables, specs, {s.name: n for s in specs}).where("kind in ('primary_key', 'foreign_key', 'row_count')")


SEED_RULED_SHARED_KEY = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS kind, '{c}' AS constraint_name, count(*) AS checked, 0 AS violations FROM supplier"
    for t, k, c in (("users", "primary_key", "id"), ("profile", "primary_key", "id"), ("photo", "primary_key", "id"),
                    ("profile", "foreign_key", "of"), ("photo", "foreign_key", "shows"),
                    ("users", "row_count", "*"), ("profile", "row_count", "*"), ("photo", "row_count", "*"))
)

def gen_many_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Each order takes one of all combinations of supplier, part and line in the data; the supplier of every third one is given."""
    listed = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
    combos = dense_index(listed, ["l_suppkey", "l_partkey", "l_linenumber"], "at").df
    texts = combos.select("at", *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(("l_suppkey", "l_partkey", "l_linenumber"))])
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    pinned = {"supp": (F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") % 1500).cast("string"))}
    made = attach_combinations(orders, texts, ["supp", "part", "line"], Draws(SEED, "stock"), F.col("o_orderkey"), pinned)
    return made.select("o_orderkey", F.col("_combo0").alias("supp"), F.col("_combo1").alias("part"), F.col("_combo2").alias("line"))


GEN_MANY_COMBINATIONS = f"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY l_suppkey, l_partkey, l_linenumber) - 1 AS pos, count(*) OVER () AS n,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_linenumber) - 1 AS own, count(*) OVER (PARTITION BY l_suppkey) AS n_own
  FROM (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber FROM lineitem)),
r AS (SELECT o_orderkey, {draw('stock', 'supp__part__line', 'o_orderkey', 'combo')} AS d, o_orderkey % 3 = 0 AS given, o_custkey % 1500 AS want FROM orders),
p AS (SELECT o_orderkey, t.pos FROM r JOIN t ON NOT given AND t.pos = d % (SELECT count(*) FROM t)
  UNION ALL SELECT o_orderkey, t.pos FROM r JOIN t ON given AND l_suppkey = want AND own = d % n_own
  UNION ALL SELECT o_orderkey, 0 AS pos FROM r WHERE given AND want NOT IN (SELECT l_suppkey FROM t))
SELECT o_orderkey, l_suppkey::VARCHAR AS supp, l_partkey::VARCHAR AS part, l_linenumber::VARCHAR AS line FROM p JOIN t USING (pos)
"""


def gen_many_rules(spark: SparkSession, d: str) -> DataFrame:
    """As many repetition rules as there are customers, each for one to four rows, and rows without a rule behind them."""
    n = table(spark, d, "customer").count()
    rules = tuple(RepetitionRule(1 + i % 4, {"kind": f"c{i}"}, ("amount",) if i % 5 == 0 else ()) for i in range(n))
    spec = TableSpec("many", (C("kind", "string", False), C("amount", "int", False), C("extra", "int", False)))
    total = sum(r.count for r in rules) + n
    made = generate_table(spark, spec, total, _options(rules=rules))
    return made.select(F.col("_idx").alias("pos"), F.col("_rule_id").alias("rule_id"), F.when(F.col("_rule_id").isNotNull(), F.col("kind")).alias("kind"), "amount", "extra")


GEN_MANY_RULES = f"""
WITH i AS (SELECT unnest(range((SELECT count(*) FROM customer))) AS i), r AS (SELECT i, 1 + i % 4 AS n, (sum(1 + i % 4) OVER (ORDER BY i) - 1 - i % 4)::BIGINT AS first FROM i),
p AS (SELECT unnest(range(first, first + n)) AS pos, i::INTEGER AS rule_id FROM r
  UNION ALL SELECT unnest(range((SELECT sum(n)::BIGINT FROM r), (SELECT sum(n)::BIGINT + count(*) FROM r))), NULL)
SELECT pos, rule_id, CASE WHEN rule_id IS NOT NULL THEN 'c' || rule_id END AS kind,
  (1 + {draw('many', 'amount', "(CASE WHEN rule_id % 5 = 0 THEN 'r' || rule_id ELSE pos::VARCHAR END)")} % 10000)::INTEGER AS amount,
  (1 + {draw('many', 'extra', 'pos')} % 10000)::INTEGER AS extra FROM p
"""


def unique_least_in_all(spark: SparkSession, d: str) -> DataFrame:
    """Order lines that are the first of their part and supplier, and of their supplier and day: two keys that share a column."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    placed = dense_index(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "day"], "_idx").df
    return least_in_all(placed, [["l_partkey", "l_suppkey"], ["l_suppkey", "day"]]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "day")


UNIQUE_LEAST_IN_ALL = """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS day,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE) AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, day FROM l QUALIFY pos = min(pos) OVER (PARTITION BY l_partkey, l_suppkey)
  AND pos = min(pos) OVER (PARTITION BY l_suppkey, day)
"""


def seed_overlapping_keys(spark: SparkSession, d: str) -> DataFrame:
    """Unique keys that share columns with each other, with the primary key and with a foreign key: duplicates per key.

    As many rows as there are customers, four times as many places in each key.
    """
    n = table(spark, d, "customer").count()
    parent = TableSpec("places", (C("id", "int"),), ("id",))
    spec = TableSpec(
        "seats",
        (C("a", "int", min_value=1, max_value=n), C("b", "int", min_value=1, max_value=n), C("x", "int", False, min_value=1, max_value=4 * n // 30),
         C("y", "smallint", False, min_value=1, max_value=30), C("place", "int", False)),
        ("a", "b"), (ForeignKey(("place",), "places", ("id",)),), (("x", "y"), ("place", "y"), ("a", "x")),
    )
    made = seed(spark, (parent, spec), SeedOptions(rows={"places": 4 * n // 30, "seats": n}, table=_options()))
    rows = made.tables["seats"]
    return reduce(DataFrame.unionByName, [
        rows.groupBy(*key).count().agg(
            F.lit(",".join(key)).alias("key"), F.sum("count").alias("n_rows"), F.sum((F.col("count") > 1).cast("bigint")).alias("duplicates"),
            F.lit(made.shortfall.get("seats", 0)).cast("bigint").alias("missing"),
        )
        for key in (spec.primary_key, *spec.unique_keys)
    ])


SEED_OVERLAPPING_KEYS = """
SELECT unnest(['a,b', 'x,y', 'place,y', 'a,x']) AS key, count(*) AS n_rows, 0 AS duplicates, 0 AS missing FROM customer
"""


def seed_shared_references(spark: SparkSession, d: str) -> DataFrame:
    """Three foreign keys of a table that share a column, and a table below: every key holds in every row."""
    n = table(spark, d, "supplier").count()
    shops = TableSpec("shops", (C("town", "int"), C("shop", "int")), ("town", "shop"))
    staff = TableSpec("staff", (C("town", "int"), C("name", "varchar", length=12)), ("town", "name"))
    roads = TableSpec("roads", (C("town", "int"), C("road", "uuid", uuid=True)), ("town", "road"))
    visits = TableSpec(
        "visits", (C("id", "int"), C("town", "int", False), C("shop", "int", False), C("name", "varchar", False, 12), C("road", uuid=True, nullable=False)), ("id",),
        (ForeignKey(("town", "shop"), "shops", ("town", "shop"), name="in"), ForeignKey(("town", "name"), "staff", ("town", "name"), name="by"),
         ForeignKey(("town", "road"), "roads", ("town", "road"), name="on")),
    )
    notes = TableSpec("notes", (C("id", "int"), C("town", "int"), C("shop", "int")), ("id",), (ForeignKey(("town", "shop"), "shops", ("town", "shop"), name="about"),))
    specs = (shops, staff, roads, visits, notes)
    made = seed(spark, specs, SeedOptions(rows={"shops": n, "staff": n, "roads": n // 2, "visits": 5 * n, "notes": n}, table=_options()))
    counts = {"visits": 5 * n, "notes": n}
    return integrity_report(made.tables, specs, counts).where("table_name in ('visits', 'notes') and kind in ('primary_key', 'foreign_key', 'row_count')")


SEED_SHARED_REFERENCES = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS kind, '{c}' AS constraint_name, {times} * count(*) AS checked, 0 AS violations FROM supplier"
    for t, times, k, c in (
        ("visits", 5, "primary_key", "id"), ("visits", 5, "foreign_key", "in"), ("visits", 5, "foreign_key", "by"), ("visits", 5, "foreign_key", "on"),
        ("visits", 5, "row_count", "*"), ("notes", 1, "primary_key", "id"), ("notes", 1, "foreign_key", "about"), ("notes", 1, "row_count", "*"),
    )
)

QUERIES = {
    "gen_many_combinations": (gen_many_combinations, GEN_MANY_COMBINATIONS),
    "gen_many_rules": (gen_many_rules, GEN_MANY_RULES),
    "unique_least_in_all": (unique_least_in_all, UNIQUE_LEAST_IN_ALL),
    "seed_overlapping_keys": (seed_overlapping_keys, SEED_OVERLAPPING_KEYS),
    "seed_shared_references": (seed_shared_references, SEED_SHARED_REFERENCES),
    "unique_all_kinds": (unique_all_kinds, UNIQUE_ALL_KINDS),
    "shortfall_report": (shortfall_report, SHORTFALL_REPORT),
    "seed_ruled_shared_key": (seed_ruled_shared_key, SEED_RULED_SHARED_KEY),
    "gen_scalar_types": (gen_scalar_types, GEN_SCALAR_TYPES),
    "gen_text": (gen_text, GEN_TEXT),
    "gen_text_latin": (gen_text_latin, GEN_TEXT_LATIN),
    "gen_text_vocabulary": (gen_text_vocabulary, GEN_TEXT_VOCABULARY),
    "gen_keys": (gen_keys, GEN_KEYS),
    "gen_multi_check": (gen_multi_check, GEN_MULTI_CHECK),
    "gen_rules": (gen_rules, GEN_RULES),
    "gen_capacity": (gen_capacity, GEN_CAPACITY),
    "unique_first_seen": (unique_first_seen, UNIQUE_FIRST_SEEN),
    "unique_first_seen_nulls": (unique_first_seen_nulls, UNIQUE_FIRST_SEEN_NULLS),
    "unique_retry": (unique_retry, UNIQUE_RETRY),
    "rekey_uuid": (rekey_uuid, REKEY_UUID),
    "uuid_allowed": (uuid_allowed, UUID_ALLOWED),
    "soft_delete_fill": (soft_delete_fill, SOFT_DELETE_FILL),
    "regex_rows": (regex_rows, REGEX_ROWS),
}
