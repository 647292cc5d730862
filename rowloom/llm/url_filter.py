"""URL verdicts: rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rowloom.llm.linear import Model, hashed, train
from rowloom.llm.texts import map_texts

# (host and path, verdict). A rule's host is what stands before the first slash.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
# The labelled table: at most so many URLs of each verdict, those of least hash.
LABELLED = 4000
GRAMS = (3, 4, 5)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What the first ``://`` is followed by; both empty for null or without it."""
    parts = r"(?s)://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(found, parts, 1), upper, lower), F.regexp_extract(found, parts, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(host: bytes, path: bytes) -> np.ndarray:
    """Feature numbers of the n-grams of host and path, each side marked; runs of digits read as 0."""
    found = set()
    for mark, part in ((b"h^", host), (b"p^", path)):
        framed = mark + re.sub(rb"[0-9]+", b"0", part) + b"$"
        found.update(framed[:1] + framed[i : i + n] for n in GRAMS for i in range(1, len(framed) - n + 1))
    return hashed(found, crc32)


def _split(address: bytes | None) -> tuple[bytes, bytes]:
    host, _, path = (address or b"").partition(b"\n")
    return host, path


def fit(labelled: DataFrame, limit: int = 2 * LABELLED) -> Model:
    """A model of ``block`` from a small table (host, path, block) of at most ``limit`` rows."""
    rows = labelled.orderBy("host", "path", "block").limit(limit).collect()
    features = [grams((r["host"] or "").encode(), (r["path"] or "").encode()) for r in rows]
    return train(features, np.array([float(r["block"]) for r in rows]))


def labelled_by_rules(parsed: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The small labelled table: URLs that rules decide, a bounded sample of distinct ones per verdict."""
    known = parsed.where("ruled is not null").select("host", "path", "ruled").distinct()
    order = [F.xxhash64("host", "path"), "host", "path"]
    sides = [known.where(F.col("ruled") == verdict).orderBy(*order).limit(limit) for verdict in ("allow", "block")]
    return sides[0].union(sides[1]).select("host", "path", (F.col("ruled") == "block").cast("double").alias("block"))


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every row of ``pages``.

    The rule's verdict holds; other URLs are blocked from a score of 0.5 on. Null URLs and such without
    ``://`` have no host and no path, and are scored like any other. ``labelled`` (host, path, block) may
    be given; else the rules label a bounded sample. With one verdict only, that one is given to all;
    with none, all are allowed.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"))
    parsed = split.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    model = fit(labelled if labelled is not None else labelled_by_rules(parsed))
    found = StructType([StructField("block_score", DoubleType())])
    address = F.concat("host", F.lit("\n"), "path").alias("address")

    def scores(addresses):
        return [pa.array([model.score(grams(*_split(a))) for a in addresses], pa.float64())]

    scored = map_texts(parsed.select("*", address), scores, found, "address").select("row.*", "found.block_score")
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "block_score")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
