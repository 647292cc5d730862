"""Toxicity categories by a classifier chain of linear models."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from rowloom.llm.linear import chained, hashed, train_chain
from rowloom.llm.texts import map_texts

# The categories, in the order of the chain, as conditions on the label columns.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
# At most so many labelled documents are learned from, those of least hash.
LABELLED = 16_000
FOLDS = 3
REJECT = 0.5

# Runs of letters, and runs of other marks.
_TERM = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\s]+")


def terms(text: bytes | None) -> np.ndarray:
    """The document's distinct terms (ASCII letters lower-cased) as feature numbers."""
    return hashed(set(_TERM.findall(text.lower())), crc32) if text else np.zeros(0, np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, limit: int = LABELLED) -> DataFrame:
    """(text, one 0/1 column per category) of a bounded sample: the labelled documents of least hash."""
    wanted = [F.coalesce(F.expr(rule).cast("double"), F.lit(0.0)).alias(f"is_{name}") for name, rule in categories]
    known = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).where("id is not null and text is not null")
    ranked = labels.where("doc_id is not null").select(F.col("doc_id").alias("id"), *wanted).distinct()
    chosen = ranked.orderBy(F.xxhash64("id"), *ranked.columns).limit(limit)
    joined = known.join(F.broadcast(chosen), "id")
    return joined.orderBy(F.xxhash64("id", "text"), "id", "text").limit(limit).drop("id")


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, limit: int = LABELLED):
    """The chain's models. Folds go by text, so copies of a document are never on both sides."""
    sample = labelled_sample(docs, labels, categories, limit)
    found = StructType([StructField("terms", ArrayType(IntegerType())), StructField("fold", LongType())])

    def features(texts):
        folds = [crc32(t or b"") % FOLDS for t in texts]
        return [pa.array([terms(t).tolist() for t in texts], pa.list_(pa.int32())), pa.array(folds, pa.int64())]

    names = [name for name, _ in categories]
    made = map_texts(sample, features, found).select("found.terms", "found.fold", *[f"row.is_{name}" for name in names])
    rows = made.toArrow().combine_chunks()
    every = rows["terms"].combine_chunks()
    parts = np.split(every.values.to_numpy(), every.offsets.to_numpy()[1:-1]) if len(every) else []
    labelled = [rows[f"is_{name}"].to_numpy() for name in names]
    return train_chain(parts, labelled, rows["fold"].to_numpy(), FOLDS)


def score(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, limit: int = LABELLED) -> DataFrame:
    """``row`` (all columns of docs) and ``found`` with a probability per category, chained.

    Null and empty texts have no terms and get what the biases say. Labels of unknown documents teach
    nothing, a null label counts as not in the category; a category seen with one value only has that as
    its probability, and without any label all probabilities are 0. Rows that repeat an id are scored
    each by its own text.
    """
    models = train(docs, labels, categories, limit)
    found = StructType([StructField(name, DoubleType()) for name, _ in categories])

    def probabilities(texts):
        scored = [chained(models, terms(t)) for t in texts]
        return [pa.array([s[k] for s in scored], pa.float64()) for k in range(len(models))]

    return map_texts(docs, probabilities, found)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected as toxic."""
    return score(docs, labels).where(F.col("found.toxic") < REJECT).select("row.*")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("row.doc_id", "found.*", (F.col("found.toxic") >= REJECT).alias("rejected"))
