"""Language identification with bit-sliced Bloom filters: a language mask per filter slot."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from rowloom.llm.rolling import Rolling, mixed
from rowloom.llm.texts import map_texts

GRAM = 4
HASHES = 3
SLOTS = 1 << 20
# At most so many documents are learned from per language, those of least hash.
PER_LANGUAGE = 1000
# Ranked are about this many times as many.
SPARE = 4
# An n-gram is filed under a language if this share of its learned documents hold it.
COMMON = 0.02
UNKNOWN = "und"
# Longer texts are read in pieces of so many characters.
PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: bytes | None) -> np.ndarray:
    """Hashes of the n-grams of the lower-cased letters, words framed by one blank; empty without a letter."""
    parts, folded = [], text.decode("utf-8", "replace").lower() if text else ""
    for at in range(0, len(folded), PIECE):
        points = np.frombuffer(folded[max(0, at - GRAM) : at + PIECE].encode("utf-32-le", "replace"), np.uint32)
        points = np.where(_letters()[points], points, 32)
        framed = np.concatenate(([32], points, [32]))
        framed = framed[np.concatenate(([True], (framed[1:] != 32) | (framed[:-1] != 32)))]
        if len(framed) > GRAM:
            parts.append(Rolling(mixed(framed.astype(np.uint64) + np.uint64(1))).every(GRAM))
        elif (framed != 32).any():
            parts.append(Rolling(mixed(framed.astype(np.uint64) + np.uint64(1))).every(len(framed)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def places(hashed: np.ndarray, slots: int) -> list[np.ndarray]:
    """HASHES slots for each n-gram."""
    low, step = hashed % np.uint64(slots), (hashed >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * step) % np.uint64(slots)).astype(np.int64) for k in range(HASHES)]


@dataclass(frozen=True)
class Filters:
    """All languages' filters, bit-sliced: ``masks[slot]`` has a bit per language, in words of 64 languages."""

    languages: list[str]
    masks: np.ndarray  # slots x words
    false_rates: np.ndarray

    def counts(self, hashed: np.ndarray) -> np.ndarray:
        """For each language, how many n-grams its filter holds, corrected for false positives."""
        found = None
        for at in places(hashed, len(self.masks)):
            found = self.masks[at] if found is None else found & self.masks[at]
        total = np.zeros(len(self.languages))
        for k in range(len(total)):
            total[k] = np.count_nonzero((found[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1))
        return np.maximum(0, total - len(hashed) * self.false_rates) / (1 - self.false_rates)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        hashed = grams(text)
        if not len(hashed) or not self.languages:
            return UNKNOWN, 0.0
        counts = self.counts(hashed)
        best = int(np.argmax(counts))
        share = counts.sum()
        return self.languages[best], float(counts[best] / share) if share else 0.0


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, common: float = COMMON, slots: int = SLOTS) -> Filters:
    """Fill the filters from (text, lang): a bounded sample per language, n-grams counted by Spark.

    The sample holds the texts of least hash; only hashes are sorted to find its bounds. Equal texts are
    learned from once, so a large group of copies neither fills a sample nor speaks for its language.
    N-grams of a single text count only where a language has no other.

    Slots that several n-grams share hold the languages of all; the share of set slots tells each
    language's rate of false positives. Only the filters come to the driver: ``slots`` masks at most.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("order"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    # Hashes spread evenly: those of the first few thousand texts lie below this reach, and no more are ranked.
    share = F.lit(SPARE * per_language) / F.approx_count_distinct("order")
    reach = F.when(share < 1, (F.lit(2.0**64) * share - 2.0**63).cast("bigint"))
    reaches = known.groupBy("lang").agg(F.coalesce(reach, F.lit(2**63 - 1)).alias("reach"))
    near = known.select("lang", "order").join(F.broadcast(reaches), "lang").where("order <= reach")
    least = near.select("lang", "order").distinct().withColumn("nth", nth).where(F.col("nth") <= per_language)
    bounds = least.groupBy("lang").agg(F.max("order").alias("bound"), F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in bounds)
    words = (len(languages) + 63) // 64
    if not languages:
        return Filters([], np.zeros((slots, 1), np.uint64), np.zeros(0))
    limits = docs.sparkSession.createDataFrame([(r["lang"], r["bound"], float(max(r["n"] * common, min(r["n"], 2)))) for r in bounds], "lang string, bound long, least double")
    chosen = known.join(F.broadcast(limits), "lang").where(F.col("order") <= F.col("bound"))
    sample = chosen.dropDuplicates(["lang", "order"]).select("lang", "text", "least")
    found = StructType([StructField("grams", ArrayType(LongType()))])

    def distinct(texts):
        return [pa.array([np.unique(grams(t)).view(np.int64).tolist() for t in texts], pa.list_(pa.int64()))]

    each = map_texts(sample, distinct, found).select("row.lang", "row.least", F.explode("found.grams").alias("gram"))
    kept = each.groupBy("lang", "least", "gram").agg(F.count("*").alias("n")).where("n >= least")
    rows = kept.select("lang", "gram").toArrow()
    numbers = {x: k for k, x in enumerate(languages)}
    masks = np.zeros((slots, words), np.uint64)
    hashed = rows["gram"].to_numpy().view(np.uint64)
    owner = np.fromiter((numbers[x] for x in rows["lang"].to_pylist()), np.int64, len(hashed))
    for at in places(hashed, slots):
        np.bitwise_or.at(masks, (at, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))
    filled = np.array([np.count_nonzero((masks[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)) for k in range(len(languages))])
    return Filters(languages, masks, np.minimum(0.99, (filled / slots) ** HASHES))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``row`` (all columns of docs) and ``found`` with lang_pred and score.

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0, as is all where
    nothing was learned; ties go to the language that sorts first. The score is the language's share of
    all corrected counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    found = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def work(texts):
        predicted = [sent.value.predict(t) for t in texts]
        return [pa.array([p for p, _ in predicted], pa.string()), pa.array([s for _, s in predicted], pa.float64())]

    return map_texts(docs, work, found)


def held_out(doc_id):
    """Documents that are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), filters)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "found.lang_pred", "found.score")
