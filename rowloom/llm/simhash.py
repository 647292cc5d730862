"""SimHash near-duplicates: bit planes stored vertically, distances counted with carry-save adders."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rowloom.llm import near_copies
from rowloom.llm.components import components
from rowloom.llm.texts import map_texts
from rowloom.operators.joins import lookup
from rowloom.session import materialize, materialize_counted

WORDS = 3
SEED = 42
RADIUS = 3
BITS = 64
# Two fingerprints within RADIUS bits agree in BLOCKS - RADIUS of BLOCKS stretches at least.
BLOCKS = 5
# A bucket with more fingerprints is compared in cells of about this many.
CELL = 1024
# Small cells are put side by side until so many fingerprints are compared at once.
LANES = 512

FOUND = StructType([StructField("fingerprint", LongType())])


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the hashes of all word shingles, repeats included; 0 without words."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    line = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stops = np.cumsum(sizes + 1) - 1
    starts = (stops - sizes).tolist()
    reach = min(words, len(tokens))
    hashed = np.fromiter(
        (xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops[reach - 1 :].tolist(), strict=False)),
        np.uint64, len(tokens) - reach + 1,
    )
    return _majority(hashed)


def _majority(hashed: np.ndarray) -> int:
    """Ones per bit place are counted in slices, so a long text needs no matrix of its own size."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashed), 1 << 14):
        part = hashed[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``row`` with all columns and ``found.fingerprint``. Null and empty texts, and white space: 0."""
    return map_texts(docs, lambda texts: [pa.array([fingerprint(t) for t in texts], pa.int64())], FOUND)


def planes(fps: np.ndarray) -> np.ndarray:
    """BITS rows of packed lanes: bit i of row p is bit p of fingerprint i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((BITS, (len(fps) + 63) // 64 * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(fps: np.ndarray, cell: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one cell at ``radius`` (at most 3) differing bits or fewer.

    Every fingerprint is compared with all lanes at once: its differences to a bit plane are added to a
    two-bit counter per lane, carry-save; lanes that pass 3 are over. Rows whose lanes are all over are
    abandoned every eight planes.
    """
    if radius > 3:
        raise ValueError("two-bit counters reach a radius of 3")
    lanes = planes(fps)
    own = np.zeros((len(fps), lanes.shape[1] * 64), np.uint8)
    own[:, : len(fps)] = np.triu(cell[:, None] == cell[None, :], 1)
    live = np.packbits(own, axis=1, bitorder="little").view("<u8")
    rows = np.flatnonzero(live.any(axis=1))
    live = live[rows]
    low, high, over = np.zeros_like(live), np.zeros_like(live), ~live
    for plane in range(BITS):
        flip = (np.uint64(0) - ((fps[rows].astype(np.uint64) >> np.uint64(plane)) & np.uint64(1)))[:, None]
        differ = lanes[plane][None, :] ^ flip
        carry = low & differ
        low ^= differ
        over |= high & carry
        high ^= carry
        if plane % 8 == 7:
            keep = ~(over == ~np.uint64(0)).all(axis=1)
            if not keep.all():
                rows, low, high, over = rows[keep], low[keep], high[keep], over[keep]
            if not len(rows):
                break
    near = ~over
    if radius < 3:
        for count in range(radius + 1, 4):
            is_count = (low if count & 1 else ~low) & (high if count & 2 else ~high)
            near &= ~is_count
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, lane = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
    return rows[at], lane


def stars(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the pairs: each member with the least of its component."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _linked(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    fps = np.concatenate(cells)
    i, j = within(fps, np.repeat(np.arange(len(cells)), [len(c) for c in cells]))
    a, b = stars(len(fps), i, j)
    return fps[a].astype(np.int64), fps[b].astype(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(cells):
        a, b = _linked(cells)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        column = batch.column(0)
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        waiting, size = [], 0
        for k in range(len(offsets) - 1):
            waiting.append(values[offsets[k] : offsets[k + 1]])
            size += len(waiting[-1])
            if size >= LANES:
                yield out(waiting)
                waiting, size = [], 0
        if waiting:
            yield out(waiting)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fingerprint), enough to connect all that link.

    Fingerprints within ``radius`` bits agree in at least blocks - radius of the ``blocks`` stretches of
    bits, so each is filed once per choice of that many stretches, and only equal files are compared.
    A file of many fingerprints is split into cells by hash, and every pair of cells is a task's work of
    bounded size; nothing is left out.
    """
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    filed = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        filed.append(F.struct(F.lit(number).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(signed)).alias("key")))
    keyed = fps.select("fingerprint", F.explode(F.array(*filed)).alias("f")).select("fingerprint", "f.table", "f.key")
    counts = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    salt = F.pmod(F.xxhash64("fingerprint"), F.col("cells")).cast("int")
    placed = (
        keyed.join(counts, ["table", "key"])
        .select("fingerprint", "table", "key", cells.alias("cells"))
        .select("fingerprint", "table", "key", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    )
    return (
        placed.groupBy("table", "key", F.least("salt", "other"), F.greatest("salt", "other"))
        .agg(F.collect_list("fingerprint").alias("members"))
        .where("size(members) > 1")
        .select("members")
        .mapInArrow(_compare, "a long, b long")
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of RADIUS bits or fewer; equal fingerprints,
    that of no words included, link too. Rows that repeat an id each get a row; null ids are never the
    smallest, and a component of null ids only has none.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text")).select("row.doc_id", "found.fingerprint"))
    distinct, n = materialize_counted(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    group = components(links(distinct.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    named = distinct.join(group, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fingerprint", "component_id")
    return lookup(marked, classes, ["fingerprint"], n, "inner").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are no near copy of an earlier one, by the general rule of near_copies.

    RADIUS and WORDS bind op6 only: at a Jaccard of 0.8 two fingerprints of 64 bits differ by about ten, and no
    choice of blocks files so wide a radius. There, wider SimHash fingerprints are filed by samples of their bits and
    compared in bit planes with carry-save counters as here.
    """
    return near_copies.keep_first(docs)


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
