"""Long repeated strings, found with a logarithmic family of sparse suffix indexes.

A suffix index holds the suffixes that start at anchors: of all positions a 200-byte window offers, the
one whose first 32 bytes have the least hash. The choice depends on the window's own bytes only, so equal
windows have their anchor at the same offset, and only suffixes that start alike need to be compared. A
level is a written table of suffix starts in order. New batches are merge-scanned against every level;
levels of equal size are merged into one of twice the size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rowloom.llm.rolling import BYTES, Rolling
from rowloom.llm.texts import map_texts
from rowloom.operators.joins import lookup
from rowloom.session import forget, materialize, shared_dir

LENGTH = 200
ANCHOR = 32
# Texts are filed in batches of about so many bytes, and in BATCHES at least.
BATCH_BYTES = 32 << 30
BATCHES = 3
# Texts are read in pieces of so many window starts.
PIECE = 1 << 20
_PLACE = 21  # bits for a position within a piece
# Anchors with more different surroundings have them compared in parts of about this many.
GROUP = 2000

_FIELDS = ("anchor", "around", "first", "last")
SUFFIXES = StructType([StructField(n, ArrayType(LongType())) for n in _FIELDS])
KEY = ["digest", "size"]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def suffixes(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> list[np.ndarray]:
    """For each anchored suffix: a hash of its first bytes, a hash of all its windows' bytes, and the
    first and last start of its windows."""
    out: list[list[np.ndarray]] = [[] for _ in _FIELDS]
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        raw = np.frombuffer(data, np.uint8)[base : base + PIECE + length - 1]
        rolling = Rolling(BYTES[raw])
        grams = rolling.every(anchor)
        if len(grams) < len(raw) - anchor + 1:
            grams = np.append(grams, rolling.of(np.array([len(raw) - anchor]), np.array([len(raw)])))
        ranked = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
        at = (_least(ranked, length - anchor + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        place = at[first]
        around = rolling.of(first, last + length) ^ (place - first).astype(np.uint64)
        for k, part in enumerate((grams[place].view(np.int64), around.view(np.int64), first + base, last + base)):
            out[k].append(part)
    return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def _listed(texts: list[bytes | None]) -> list[pa.Array]:
    found = [suffixes(t or b"") for t in texts]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]), pa.int64())) for k in range(len(_FIELDS))]


def read_suffixes(texts: DataFrame) -> DataFrame:
    """(digest, size, anchor, around, first, last) of all anchored suffixes of (digest, size, text)."""
    listed = map_texts(texts, _listed, SUFFIXES)
    one = F.explode(F.arrays_zip(*[F.col(f"found.{n}").alias(n) for n in _FIELDS]))
    return listed.select("row.digest", "row.size", one.alias("s")).select(
        *KEY, "s.anchor", "s.around", F.col("s.first").cast("int").alias("first"), F.col("s.last").cast("int").alias("last")
    )


class SuffixIndex:
    """Levels of suffix starts (anchor, times). Level n holds 2^n batches, as in binary counting."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}

    def add(self, anchors: DataFrame) -> list[DataFrame]:
        """File a batch (anchor, times; one row per anchor). Returns the anchors it repeats: within itself, or in a level.

        Each level is scanned along with the batch, both in order of anchors.
        """
        batch = materialize(anchors.select("anchor", "times").sortWithinPartitions("anchor"))
        repeats = [batch.where("times > 1").select("anchor")]
        repeats += [batch.select("anchor").join(level.select("anchor"), "anchor") for level in self.levels.values()]
        found, number = [materialize(r) for r in repeats], 0
        while number in self.levels:
            smaller, level = batch, self.levels.pop(number)
            both = smaller.union(level).groupBy("anchor").agg(F.sum("times").alias("times"))
            batch = materialize(both.sortWithinPartitions("anchor"))
            for table in (smaller, level):
                forget(table)
            number += 1
        self.levels[number] = batch
        return found


def repeated_anchors(texts: DataFrame, batches: int | None = None) -> DataFrame:
    """The anchors at which more than one suffix starts, from batches filed one after the other.

    The texts are read once: their anchors are counted and written batch by batch, and each batch then reads its
    own files. A batch is bounded in bytes, so its level is too, however large the corpus.
    """
    if batches is None:
        size = texts.agg(F.sum("size")).first()[0] or 0
        batches = max(BATCHES, -(-size // BATCH_BYTES))
    path = f"{shared_dir(texts.sparkSession).rstrip('/')}/anchors-{uuid.uuid4().hex}"
    found = read_suffixes(texts).select(F.pmod("digest", F.lit(batches)).cast("int").alias("batch"), "anchor")
    counted = found.groupBy("batch", "anchor").agg(F.count("*").alias("times"))
    counted.write.partitionBy("batch").parquet(path)
    filed = texts.sparkSession.read.schema("anchor bigint, times bigint, batch int").parquet(path)
    index, repeats = SuffixIndex(), []
    for number in range(batches):
        repeats += index.add(filed.where(F.col("batch") == number))
    distinct = materialize(reduce(DataFrame.union, repeats).distinct())
    for table in (*repeats, *index.levels.values()):
        forget(table)
    return distinct


def _windows(rows: list[dict], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, offset) of every window of some strings."""
    sizes = np.array([len(r["bytes"]) for r in rows], np.int64)
    rolling = Rolling(BYTES[np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)])
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
    return rolling.of(start, start + length), row, offset


RUNS = StructType(
    [StructField(n, LongType()) for n in ("anchor", "around")]
    + [StructField(n, ArrayType(IntegerType())) for n in ("starts", "stops")]
)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor's group of different surroundings: which windows of each occur in another."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in RUNS}
        for anchor, group in zip(batch.column("anchor").to_pylist(), batch.column("members").to_pylist(), strict=True):
            hashes, row, offset = _windows(group)
            _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
            twice = times[back] > 1
            for k in np.unique(row[twice]).tolist():
                at = offset[twice & (row == k)]
                cut = np.flatnonzero(np.diff(at) > 1)
                out["anchor"].append(anchor)
                out["around"].append(group[k]["around"])
                out["starts"].append(at[np.concatenate(([0], cut + 1))].tolist())
                out["stops"].append(at[np.concatenate((cut, [len(at) - 1]))].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["anchor"], pa.int64()), pa.array(out["around"], pa.int64())]
            + [pa.array(out[n], pa.list_(pa.int32())) for n in ("starts", "stops")],
            RUNS.names,
        )


def _distinct_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different window of a part of a group once; with its place if it is alone in the part."""
    for batch in batches:
        for anchor, group in zip(batch.column("anchor").to_pylist(), batch.column("members").to_pylist(), strict=True):
            hashes, row, offset = _windows(group)
            window, at, times = np.unique(hashes, return_index=True, return_counts=True)
            around = np.array([m["around"] for m in group], np.int64)[row[at]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(window), anchor, np.int64)), pa.array(around, mask=times > 1),
                    pa.array(window.view(np.int64)), pa.array(offset[at], pa.int32()),
                ],
                ["anchor", "around", "window", "at"],
            )


def _contested(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(anchor, around, starts, stops): repeated windows of surroundings that occur once as a whole.

    Surroundings of the same anchor are compared by the bytes of one place each, in parts of about GROUP
    by hash. Where there are several parts, windows alone in theirs are then counted across parts; what a
    part holds more than once goes there as one row, so a passage found everywhere adds a row per part.
    """
    per = groups.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    wanted = groups.join(per.select("anchor", "kinds"), "anchor").select(
        "place.digest", "place.size", F.struct("anchor", "around", "kinds", "place.first", "place.last").alias("s")
    )
    spans = wanted.groupBy(*KEY).agg(F.collect_list("s").alias("spans"))
    piece = F.explode("spans").alias("s")
    raw = F.col("text")
    cut = (
        texts.join(spans, KEY)
        .select("text", piece)
        .select(
            "s.anchor", "s.around", "s.kinds",
            F.substring(raw, F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + LENGTH).alias("bytes"),
        )
    )
    part = F.pmod(F.xxhash64("around"), F.ceil(F.col("kinds") / GROUP)).cast("int").alias("part")
    parts = cut.select("anchor", "kinds", part, "around", "bytes").groupBy("anchor", "kinds", "part")
    members = parts.agg(F.collect_set(F.struct("around", "bytes")).alias("members"))
    inside = members.select("anchor", "members").mapInArrow(_grouped, RUNS)
    large = members.where(F.col("kinds") > GROUP).select("anchor", "members")
    windows = large.mapInArrow(_distinct_windows, "anchor long, around long, window long, at int")
    shared = windows.groupBy("anchor", "window").agg(F.count("*").alias("parts")).where("parts > 1").drop("parts")
    across = windows.where("around is not null").join(shared, ["anchor", "window"]).groupBy("anchor", "around").agg(F.collect_list("at").alias("starts"))
    return inside.unionByName(across.select("anchor", "around", "starts", F.col("starts").alias("stops")))


REMOVED = StructType(
    [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType())]
)


def merged_spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Maximal runs (start, stop) covered by half-open spans; spans that touch are one run."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > stops[:-1]))
    return np.column_stack((starts[new], stops[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]))


def kept_bytes(data: bytes, runs: np.ndarray) -> bytes:
    """What is left outside the runs."""
    edges = np.concatenate(([0], runs.ravel(), [len(data)])).reshape(-1, 2)
    return b"".join(data[a:b] for a, b in edges.tolist())


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, starts, stops in zip(*(batch.column(n).to_pylist() for n in ("text", "starts", "stops")), strict=True):
            data = text or b""
            runs = merged_spans(np.array(starts or [], np.int64), np.array(stops or [], np.int64))
            kept = kept_bytes(data, runs)
            out.append((len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array([o[k] for o in out], pa.int64()) for k in range(3)] + [pa.array([o[3] for o in out], pa.string())],
            ["doc_id", *REMOVED.names],
        )


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (doc_id, digest, size, text in bytes), and (digest, size, starts, stops): the spans
    covered by strings of LENGTH bytes that start elsewhere too."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    plain = docs.select("doc_id", F.xxhash64(text).alias("digest"), F.octet_length(text).alias("size"), text.alias("text"))
    texts = plain.select(*KEY, "text")
    repeats = repeated_anchors(texts)
    # Copies of a text meet in one row by all of its fields, so neither a frequent anchor nor a large group of
    # copies is gathered; the join itself stands alone in its stage, where Spark can split it.
    same = [*KEY, "anchor", "around", "first", "last"]
    kept = lookup(read_suffixes(texts), repeats, ["anchor"], repeats.count(), "inner", even=True).select(*same)
    held = materialize(kept.repartition(*same).groupBy(*same).agg(F.count("*").alias("copies")))
    forget(repeats)
    groups = materialize(
        held.groupBy("anchor", "around").agg(F.sum("copies").alias("times"), F.min(F.struct(*KEY, "first", "last")).alias("place"))
    )
    whole = groups.where("times > 1").select(
        "anchor", "around", F.array(F.lit(0)).alias("starts"), F.array(F.col("place.last") - F.col("place.first")).alias("stops")
    )
    single = groups.where("times = 1").select("anchor", "around")
    some = _contested(groups, texts).join(single, ["anchor", "around"])
    runs = materialize(whole.unionByName(some.select("anchor", "around", "starts", "stops")))
    pair = F.explode(F.arrays_zip("starts", "stops")).alias("run")
    spans = held.join(runs, ["anchor", "around"]).select(*KEY, "first", pair)
    listed = spans.groupBy(*KEY).agg(
        F.collect_list(F.struct((F.col("first") + F.col("run.starts")).alias("a"), (F.col("first") + F.col("run.stops") + LENGTH).alias("b"))).alias("s")
    )
    return plain, listed.select(*KEY, F.col("s.a").alias("starts"), F.col("s.b").alias("stops"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Null and empty texts, and those below LENGTH bytes, lose nothing. Rows that repeat, in part or whole,
    each count as a document: their strings start elsewhere too. Equal texts are worked on once.
    """
    plain, spans = repeated_spans(docs)
    joined = plain.join(spans, KEY, "left").select("doc_id", "text", "starts", "stops")
    schema = StructType([StructField("doc_id", plain.schema["doc_id"].dataType), *REMOVED.fields])
    return joined.mapInArrow(_cut_out, schema)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

