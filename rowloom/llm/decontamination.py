"""Benchmark decontamination: an FM-index per shard of documents, searched for all benchmark windows."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from rowloom.llm.fm_index import FMIndex
from rowloom.llm.texts import WHO, map_texts, who_columns
from rowloom.session import materialize

WINDOW = 13
# A document is contaminated if a word of RATIO or more is hit.
RATIO = 20
# Benchmark texts are searched in blocks of so many bytes, each sent to the executors on its own.
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1 << 21

_WORD_BYTES = bytes(
    (c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField("starts", ArrayType(IntegerType())),
        StructField("stops", ArrayType(IntegerType())),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and bytes of other characters."""
    return text.translate(_WORD_BYTES).split() if text else []


class Phrases:
    """The windows of a block of benchmark items, as word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            length = min(window, len(words))
            for start in range(len(words) - length + 1 if length else 0):
                by_length.setdefault(length, {}).setdefault(tuple(words[start : start + length]), set()).add(item)
        self.windows = {n: (np.array(list(w), np.int64), list(w.values())) for n, w in by_length.items()}
        self.shortest = min(by_length, default=0)


def _runs(codes: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches of known words that a window fits into."""
    edge = np.diff(np.concatenate(([0], (codes > 0).astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = stops - starts >= shortest
    return starts[keep], stops[keep]


def search(codes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Start, length and items of every occurrence of a window in one shard's word numbers.

    The index covers every stretch of words known to the benchmark that is long enough for a window;
    no occurrence can lie outside them.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if not phrases.shortest:
        return nothing
    starts, stops = _runs(codes, phrases.shortest)
    if not len(starts):
        return nothing
    sizes = stops - starts + 1  # and the end mark
    first = np.cumsum(sizes) - sizes
    origin = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
    kept = np.append(codes, 0)[origin]
    kept[first + sizes - 1] = 0
    index = FMIndex(kept, len(phrases.vocabulary) + 1)
    at, lengths, items = [], [], []
    for length, (windows, owners) in phrases.windows.items():
        low, high = index.find(windows)
        times = high - low
        hit = np.flatnonzero(times)
        rows = np.concatenate([np.arange(low[i], high[i]) for i in hit]) if len(hit) else np.zeros(0, np.int64)
        at.append(origin[index.locate(rows)])
        lengths.append(np.full(len(rows), length, np.int64))
        items += [owners[i] for i in np.repeat(hit, times[hit])]
    return np.concatenate(at), np.concatenate(lengths), items


def _shards(counts: list[int]):
    start, total = 0, 0
    for i, n in enumerate(counts):
        if total + n > SHARD_WORDS and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(counts):
        yield start, len(counts)


def _found(texts: list[bytes | None], phrases: Phrases) -> list[pa.Array]:
    tokens = [words_of(t) for t in texts]
    counts = [len(t) for t in tokens]
    n_hit, items, starts, stops = [0] * len(texts), [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]
    for low, high in _shards(counts):
        sizes = np.array(counts[low:high], np.int64) + 1
        base = np.cumsum(sizes) - sizes
        codes = np.zeros(int(sizes.sum()), np.int64)
        for b, words in zip(base, tokens[low:high], strict=True):
            codes[b : b + len(words)] = np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int64, len(words))
        at, lengths, owners = search(codes, phrases)
        if not len(at):
            continue
        depth = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + lengths, minlength=len(codes) + 1)
        edge = np.diff(np.concatenate(([0], (np.cumsum(depth) > 0).astype(np.int8), [0])))
        for start, stop in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            doc = int(np.searchsorted(base, start, side="right")) - 1
            n_hit[low + doc] += int(stop - start)
            starts[low + doc].append(int(start - base[doc]))
            stops[low + doc].append(int(stop - base[doc]))
        names: dict[int, set[str]] = {}
        for doc, owner in zip(np.searchsorted(base, at, side="right") - 1, owners, strict=True):
            names.setdefault(low + int(doc), set()).update(owner)
        for doc, owner in names.items():
            items[doc] = sorted(owner)
    return [
        pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
        pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())),
    ]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark's (item, text) pairs in blocks of bounded size, one block on the driver at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast(BinaryType()).alias("text")
    ).where("text is not null")
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item"], bytes(row["text"])))
        size += len(row["text"])
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (all columns of docs) and ``found``: n_words, n_hit, items, and the word spans hit.

    Null and empty texts have no words and no hits. Items that share an id are one item; a null id is
    the empty string; items without words are never found. Rows that repeat are judged each. A benchmark of
    one block is searched in one pass over the documents. Of a larger one, one block at a time is on the driver
    and the executors; its hits are written and the block is released before the next one is read.
    """
    stream = blocks(benchmark, block_bytes)
    first, second = next(stream), next(stream, None)
    if second is None:
        phrases = Phrases(first, window)
        return map_texts(docs, lambda texts: _found(texts, phrases), FOUND)
    kind = docs.schema["doc_id"].dataType
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    plain = packed.select("row", *who_columns(F.col("_id"), F.col("_text"), kind), F.col("_text").alias("text"))
    texts, parts = plain.select(*WHO, "text"), []
    for block in chain((first, second), stream):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        found = map_texts(texts, _searched(sent, window), FOUND).where("found.n_hit > 0")
        parts.append(materialize(found.select(*[f"row.{w}" for w in WHO], "found.items", F.arrays_zip("found.starts", "found.stops").alias("spans"))))
        sent.destroy()
    each = reduce(DataFrame.unionByName, parts)
    # Rows that repeat id and text bring the same spans.
    whole = each.groupBy(*WHO).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _union(F.flatten(F.collect_list("spans"))).alias("u")
    )
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint")
    none = F.array().cast("array<int>")
    struct = F.struct(
        words.alias("n_words"), F.coalesce("u.n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("u.starts", none).alias("starts"), F.coalesce("u.stops", none).alias("stops"),
    )
    return plain.join(whole, WHO, "left").select("row", struct.alias("found"))


def _searched(sent, window: int):
    """Searches texts for a block that was sent; its windows are numbered once a task."""
    held: list[Phrases] = []

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        if not held:
            held.append(Phrases(sent.value, window))
        return _found(texts, held[0])

    return work


UNION = StructType([StructField("n_hit", LongType()), StructField("starts", ArrayType(IntegerType())), StructField("stops", ArrayType(IntegerType()))])


@F.pandas_udf(UNION)
def _union(spans):
    """Spans of several blocks; those that touch become one."""
    import pandas as pd

    rows = []
    for found in spans:
        merged: list[list[int]] = []
        for start, stop in sorted((int(s["starts"]), int(s["stops"])) for s in found):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        rows.append((sum(b - a for a, b in merged), [a for a, _ in merged], [b for _, b in merged]))
    return pd.DataFrame(rows, columns=UNION.names)


def contaminated():
    """At least one word in RATIO is hit."""
    return (F.col("found.n_hit") > 0) & (F.col("found.n_hit") * RATIO >= F.col("found.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, without their merged hit spans.

    Only what stands between the first and the last character of a span goes. Documents without a hit
    keep their text as it is.
    """
    found = hits(docs, benchmark, window).where(~contaminated())
    columns = [
        _cut(F.col("row.text"), F.col("found.starts"), F.col("found.stops")).alias(c) if c == "text" else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return found.select(*columns)


def _cut(text, starts, stops):
    return F.when(F.size(starts) == 0, text).otherwise(_cut_udf(text, starts, stops))


@F.pandas_udf(StringType())
def _cut_udf(text, starts, stops):
    import pandas as pd

    return pd.Series([_without(t, a, b) for t, a, b in zip(text, starts, stops, strict=True)])


def _without(text: str | None, starts, stops) -> str | None:
    if text is None or not len(starts):
        return text
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_WORD_BYTES))]
    kept, at = [], 0
    for start, stop in zip(starts, stops, strict=True):
        kept.append(data[at : spans[start][0]])
        at = spans[stop - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "row.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


OP10_SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
lengths AS (SELECT DISTINCT least(13, len(w)) AS n FROM words WHERE kind = 'b' AND len(w) > 0),
spread AS (
  SELECT kind, id, n, w, unnest(range(1, len(w) - n + 2)) AS first
  FROM words, lengths WHERE len(w) >= n AND (kind = 'd' OR n = least(13, len(w)))),
windows AS (SELECT kind, id, n, first, array_to_string(w[first:first + n - 1], ' ') AS phrase FROM spread),
hits AS (
  SELECT DISTINCT d.id, d.first, d.n, b.id AS item FROM windows d JOIN windows b ON d.kind = 'd' AND b.kind = 'b' AND d.n = b.n AND d.phrase = b.phrase),
covered AS (SELECT id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT id, unnest(range(first, first + n)) AS pos FROM hits) GROUP BY id),
found AS (
  SELECT id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM hits) GROUP BY id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN covered c ON w.id = c.id LEFT JOIN found f ON w.id = f.id WHERE w.kind = 'd'
"""
