"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.indexing import dense_index
from rowloom.operators.joins import lookup
from rowloom.session import materialize, materialize_counted

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 17


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (one row per source: no_source, source, source_size) with its target.

    Weights repeat along the sources by code point, null last. A target stops at ``most`` times the
    source's size; what is over goes to the others by weight. The level all open sources share is
    raised until it stops moving: it only rises, and each round is one aggregate over the sources.
    """
    ranked = dense_index(sources, ["no_source", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighted = ranked.df.withColumn("weight", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    wanted = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1.0
    while level != before:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        closed, open_weight = weighted.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (wanted - (closed or 0.0)) / open_weight if open_weight else level
    return weighted.withColumn("target", F.least("_cap", F.lit(level) * F.col("weight"))).drop("_rank", "_cap", "weight")


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1): 32 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), source))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mixed(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Every document (doc_id, source, size) with source_size, target, copies and taken.

    A document is expected target / source_size times, so the prefix sum of expected copies within a
    source is its position times that rate; a document is taken once for each integer the sum, moved by
    the source's random offset, passes. Documents stand in order of size, so the words taken stay within
    about one document of the target. Positions come from one parallel sort of narrow rows: no source is
    ever in one task. Null texts have size 0, a null source is a source of its own (the last), a source
    without words has target 0, and rows that repeat an id are documents of their own.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id").alias("doc_id"), F.col("source").isNull().alias("no_source"),
            F.coalesce("source", F.lit("")).alias("source"), word_count(F.col("text")).alias("size"),
        )
    )
    indexed = dense_index(sized, ["no_source", "source", "size", "doc_id"], "_at").df
    keys = ["no_source", "source"]
    sources, n = materialize_counted(
        indexed.groupBy(*keys).agg(F.sum("size").alias("source_size"), F.min("_at").alias("_first"))
    )
    with_targets = materialize(targets(sources, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nth, shift = F.col("_at") - F.col("_first"), offset(F.col("source"), seed)
    passed = F.floor((nth + 1) * F.col("_rate") + shift) - F.floor(nth * F.col("_rate") + shift)
    return (
        lookup(indexed, with_targets, keys, n, "inner")
        .withColumn("_rate", rate)
        .withColumn("copies", F.least(passed, F.ceil(F.lit(most))).cast("bigint"))
        .select(
            "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target",
            (F.col("copies") * F.col("size")).alias("taken"), "copies",
        )
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with its number in ``copy``.

    Rows that share doc_id, source and size cannot be told apart here: each is emitted as often as the
    one of them that is taken most.
    """
    size = word_count(F.col("row.text"))
    keyed = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").alias("_id"), F.col("row.source").alias("_source"), size.alias("_size")
    )
    taken = mixed(docs, seed).where("copies > 0").groupBy("doc_id", "source", "size").agg(
        F.max("copies").alias("copies")
    )
    same = (
        keyed["_id"].eqNullSafe(taken["doc_id"]) & keyed["_source"].eqNullSafe(taken["source"]) & (keyed["_size"] == taken["size"])
    )
    emitted = keyed.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    names = set(docs.columns)
    return emitted.select("row.*", F.col("copy").alias("copy" if "copy" not in names else "copy_number"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("source")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT no_source, source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY no_source, source),
trial AS (
  SELECT a.no_source, a.source,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM src)::DOUBLE
          - coalesce(sum(2 * b.source_size) FILTER (WHERE b.source_size * a.weight < a.source_size * b.weight), 0)::DOUBLE)
         / (sum(b.weight) FILTER (WHERE b.source_size * a.weight >= a.source_size * b.weight))::DOUBLE AS level,
         2.0::DOUBLE * any_value(a.source_size) / any_value(a.weight) AS reach
  FROM src a, src b GROUP BY a.no_source, a.source, a.weight, a.source_size),
chosen AS (SELECT min_by(level, reach) AS level FROM trial WHERE level <= reach),
goal AS (
  SELECT src.*, least(2.0::DOUBLE * source_size, level * weight) AS target,
         ('0x' || substr(md5('17|' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM src, chosen),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, shift,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         (row_number() OVER (PARTITION BY s.no_source, s.source ORDER BY s.size, s.doc_id) - 1) AS nth
  FROM sized s JOIN goal g USING (no_source, source)),
counted AS (
  SELECT *, least(floor((nth + 1) * rate + shift) - floor(nth * rate + shift), 2)::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""
