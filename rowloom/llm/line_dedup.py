"""Line dedup: documents that share rare lines are aligned with patience diff; common blocks go from the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from rowloom.llm import similar_sets
from rowloom.llm.texts import id_or_default, map_texts
from rowloom.operators.joins import lookup
from rowloom.session import forget, materialize, materialize_counted

# A block of common lines goes if it has so many words; shorter ones are everyday lines.
MIN_WORDS = 10


def evidence(hashes: list[int], words: list[int], least: int = MIN_WORDS) -> list[tuple[int, ...]]:
    """For each line the shortest run of lines from it that has ``least`` words, as its hashes.

    Such runs are rare by their length, and any common block that may go holds one of them whole.
    """
    found, stop, total = [], 0, 0
    for start in range(len(hashes)):
        while total < least and stop < len(hashes):
            total += words[stop]
            stop += 1
        if total < least:
            break
        found.append(tuple(hashes[start:stop]))
        total -= words[start]
        stop = max(stop, start + 1)
    return found


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks (start in a, start in b, length): lines unique on both sides anchor, the
    longest increasing run of anchors holds, and each anchor is stretched over equal neighbours."""
    blocks, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        head = 0
        while a0 + head < a1 and b0 + head < b1 and a[a0 + head] == b[b0 + head]:
            head += 1
        if head:
            blocks.append((a0, b0, head))
        a0, b0, tail = a0 + head, b0 + head, 0
        while a1 - tail > a0 and b1 - tail > b0 and a[a1 - tail - 1] == b[b1 - tail - 1]:
            tail += 1
        if tail:
            blocks.append((a1 - tail, b1 - tail, tail))
        a1, b1 = a1 - tail, b1 - tail
        if a0 == a1 or b0 == b1:
            continue
        anchors = _increasing(_unique_pairs(a, a0, a1, b, b0, b1))
        before = (a0, b0)
        for i, j in anchors:
            if i < before[0] or j < before[1]:
                continue  # an earlier anchor was stretched over it
            up = 0
            while i - up > before[0] and j - up > before[1] and a[i - up - 1] == b[j - up - 1]:
                up += 1
            down = 1
            while i + down < a1 and j + down < b1 and a[i + down] == b[j + down]:
                down += 1
            blocks.append((i - up, j - up, up + down))
            if i - up > before[0] and j - up > before[1]:
                waiting.append((before[0], i - up, before[1], j - up))
            before = (i + down, j + down)
        if anchors and before[0] < a1 and before[1] < b1:
            waiting.append((before[0], a1, before[1], b1))
    return _joined(blocks)


def _unique_pairs(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
    return sorted((i, once_b[line]) for line, i in once_a.items() if line in once_b)


def _once(lines, start, stop) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(start, stop):
        seen[lines[i]] = -1 if lines[i] in seen else i
    return {line: i for line, i in seen.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) whose second rises."""
    tops, top_at, previous = [], [], []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        previous.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = j, k
    chain, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = previous[k]
    return chain[::-1]


def _joined(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(blocks):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def longest_matches(a: list[int], b: list[int]) -> list[int]:
    """For each place of b, how many lines up to it stand as a block somewhere in a.

    A suffix automaton of a is walked along b, so both sides cost linear time, however often lines repeat.
    """
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for line in a:
        state = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and line not in steps[at]:
            steps[at][line] = state
            at = link[at]
        if at >= 0:
            to = steps[at][line]
            if length[to] != length[at] + 1:
                steps.append(steps[to].copy())
                link.append(link[to])
                length.append(length[at] + 1)
                copy = len(steps) - 1
                while at >= 0 and steps[at].get(line) == to:
                    steps[at][line] = copy
                    at = link[at]
                link[to] = to = copy
            link[state] = to
        last = state
    found, state, run = [], 0, 0
    for line in b:
        while state and line not in steps[state]:
            state = link[state]
            run = length[state]
        if line in steps[state]:
            state, run = steps[state][line], run + 1
        else:
            run = 0
        found.append(run)
    return found


def left_over(a: list[int], b: list[int], total: list[int], gone: set[int], least: int = MIN_WORDS) -> set[int]:
    """The lines of b, besides ``gone``, in blocks of a with ``least`` words that no alignment holds: those whose
    lines repeat on a side, or that stand in another order. ``total``: the words before each line, and all."""
    known = set(a)
    if all(p in gone or line not in known for p, line in enumerate(b)):
        return set()
    more: set[int] = set()
    begin = 0  # lines below are settled
    for p, run in enumerate(longest_matches(a, b)):
        start = p + 1 - run
        if total[p + 1] - total[start] >= least:
            more.update(range(max(start, begin), p + 1))
            begin = p + 1
    return more - gone


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The later document of each pair with the line numbers that go from it."""
    for batch in batches:
        who, earlier, later, words = batch.columns
        gone = []
        for a, b, w in zip(earlier.to_pylist(), later.to_pylist(), words.to_pylist(), strict=True):
            total = np.concatenate(([0], np.cumsum(w))).tolist()
            lines = {p for _, j, n in patience(a, b) if total[j + n] - total[j] >= MIN_WORDS for p in range(j, j + n)}
            gone.append(sorted(lines | left_over(a, b, total, lines)))
        yield pa.RecordBatch.from_arrays([who, pa.array(gone, pa.list_(pa.int32()))], ["who", "gone"])


LINES = StructType(
    [
        StructField("hashes", ArrayType(LongType())),
        StructField("words", ArrayType(IntegerType())),
        StructField("runs", ArrayType(LongType())),
    ]
)


def _lines(texts: list[bytes | None]) -> list[pa.Array]:
    hashes, words, runs = [], [], []
    for text in texts:
        lines = text.split(b"\n") if text else []
        hashes.append([xxh64_intdigest(x) - (1 << 63) for x in lines])
        words.append([len(x.split()) for x in lines])
        packed = {np.array(r, np.int64).tobytes() for r in evidence(hashes[-1], words[-1])}
        runs.append([xxh64_intdigest(r, 1) - (1 << 63) for r in packed])
    return [pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int64()))]


def _who(row: str = "") -> Column:
    """Identity and order of a document: its id, null last, then a digest of its text."""
    doc_id = F.col(f"{row}doc_id")
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.xxhash64(F.col(f"{row}text")).alias("digest"))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(who, hashes, words, runs) of every document, and the links (first, who).

    Each run of evidence links all its holders with the earliest of them, one link a holder, so neither
    a frequent line nor a large group of copies makes all pairs.
    """
    # Texts go to Python only: what comes back stands beside the identity alone.
    listed = map_texts(docs.select(_who().alias("who"), "text"), _lines, LINES, keep=["who"])
    base = materialize(listed.select("row.who", "found.*"))
    held = base.select("who", F.explode("runs").alias("run")).distinct()
    first = held.groupBy("run").agg(F.min("who").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return base, held.join(first, "run").where("who <> first").select("first", "who").distinct()


def removals(docs: DataFrame) -> DataFrame:
    """(who, gone): the line numbers that go, for each document that loses lines."""
    return _aligned(*_linked(docs))


def _aligned(base: DataFrame, links: DataFrame) -> DataFrame:
    """The two ends of a link are aligned by their line hashes; documents themselves don't travel. Runs that the
    alignment leaves are matched as blocks, so every run that an earlier document holds goes by its own link."""
    lines = base.select("who", "hashes", "words").dropDuplicates(["who"])
    pairs = links.join(lines.select(F.col("who").alias("first"), F.col("hashes").alias("earlier")), "first").join(lines, "who")
    aligned = pairs.select("who", "earlier", F.col("hashes").alias("later"), "words").mapInArrow(
        _common, StructType([StructField("who", lines.schema["who"].dataType), StructField("gone", ArrayType(IntegerType()))])
    )
    single = aligned.select("who", F.explode("gone").alias("line")).distinct()
    return single.groupBy("who").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def _code(who: str) -> Column:
    return F.xxhash64(f"{who}.no_id", f"{who}.doc_id", f"{who}.digest")


def cut_copies(docs: DataFrame, base: DataFrame, links: DataFrame, gone: DataFrame) -> DataFrame:
    """(code): the documents that lose some of their words to a link and were near copies of its other end.

    Only those are looked at whose lines with words go in part; texts of both ends are then compared whole.
    """
    lines = base.select("who", "words").dropDuplicates(["who"])
    worded = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i) > 0)
    part = gone.join(lines, "who").where(F.size(F.array_except(worded, F.col("gone").cast("array<int>"))) > 0).select("who")
    pairs = materialize(links.join(part, "who").select(_code("first").alias("a"), _code("who").alias("b")).distinct())
    ends, n = materialize_counted(pairs.select(F.col("a").alias("code")).union(pairs.select("b")).distinct())
    texts = docs.select(_who().alias("who"), F.col("text").cast("binary").alias("bytes")).select(_code("who").alias("code"), "bytes")
    asked = lookup(texts, ends, ["code"], n, "inner", even=True).dropDuplicates(["code"])
    known = materialize(asked.mapInArrow(similar_sets.shingled, similar_sets.SHINGLED))
    copies = materialize(similar_sets.near_pairs(pairs, known).select(F.col("b").alias("code")).distinct())
    for table in (pairs, ends, known):
        forget(table)
    return copies


@F.arrow_udf(StringType())
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines that go; null where none do."""

    def kept(t: str, lines: list[int]) -> str:
        dropped = set(lines)
        return "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped)

    pairs = zip(text, gone, strict=True)
    return pa.array([kept(t.as_py(), g.as_py()) if g.is_valid else None for t, g in pairs], pa.string())


def deduped(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of docs), ``kept`` (the text left), ``n_lines`` and ``n_removed``.

    Documents come in order of id; ids that repeat with other texts come in order of a text digest, and
    null ids come last. Ids may be of any type. Rows that repeat id and text are one document and lose the same
    lines. Null texts have no lines and stay null; empty ones have one empty line, which never goes alone.
    """
    return _without_lines(docs, removals(docs))


def _without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    gone = removed.select(F.struct(F.col("who.no_id"), id_or_default(F.col("who.doc_id"), kind), "who.digest").alias("key"), "gone")
    packed = docs.select(F.struct("*").alias("row"))
    id_ = F.col("row.doc_id")
    keyed = packed.withColumn("key", F.struct(id_.isNull(), id_or_default(id_, kind), F.xxhash64("row.text")))
    joined = keyed.join(gone, keyed["key"] == gone["key"], "left")
    text = F.col("row.text")
    lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    # Only texts that lose lines are sent to Python.
    cut = _without(F.when(F.col("gone").isNotNull(), text), F.col("gone"))
    return joined.select(
        "row",
        F.coalesce(cut, text).alias("kept"),
        lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the text left.

    Documents that lose lines and keep no word go. So do documents that lose lines to an earlier one they were a
    near copy of (a Jaccard of 0.8 or more over 5-word shingles of the whole texts): what is left of them are
    the changed lines, which would look like a new document to every later step.
    """
    base, linked = _linked(docs)
    links = materialize(linked)
    gone = materialize(_aligned(base, links))
    left = _without_lines(docs, gone).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    left = left.withColumn("who", _who("row.")).withColumn("code", _code("who")).join(cut_copies(docs, base, links, gone), "code", "left_anti")
    return left.select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
