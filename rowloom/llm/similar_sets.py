"""Sets of word shingles that are similar: pairs sifted in bit planes, decided by their exact Jaccard, joined to groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import bit_planes
from rowloom.llm.components import components
from rowloom.llm.rolling import Rolling, word_hashes
from rowloom.session import forget, materialize

SHINGLE = 5
SIMILAR = 0.8
# A bucket with more shingles is compared in cells of about this many.
CELL = 1 << 19
# Members of a cell are compared with the whole cell so many at a time.
ROWS_AT_ONCE = 256
# Planes pay off from so many members on; in smaller cells the sets themselves are quicker.
LANES = 48


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, ASCII letters lower-cased; the whole sequence if it is shorter."""
    words = word_hashes(data.lower())[0]
    return np.unique(Rolling(words).every(min(size, len(words)))) if len(words) else words


def _similar(a: set, b: set) -> bool:
    """Exact Jaccard of SIMILAR or more."""
    if SIMILAR * max(len(a), len(b)) > min(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, shingles, mark) of texts: the set itself, and its fingerprint where it is large enough to be sifted."""
    for batch in batches:
        sets = [shingles(t) for t in batch.column("bytes").to_pylist()]
        marks = [bit_planes.fingerprint(s) if len(s) >= bit_planes.LEAST else None for s in sets]
        lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("code"), lists, pa.array(marks, pa.binary())], ["code", "shingles", "mark"])


SHINGLED = "code long, shingles array<long>, mark binary"


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose fingerprints are near, and all pairs without a fingerprint on a side."""
    for batch in batches:
        one, two = batch.column("mark").to_pylist(), batch.column("mark_b").to_pylist()
        known = np.array([x is not None and y is not None for x, y in zip(one, two, strict=True)], bool)
        keep, at = ~known, np.flatnonzero(known)
        if len(at):
            keep[at] = bit_planes.pairs_within(bit_planes.words([one[i] for i in at]), bit_planes.words([two[i] for i in at]))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose shingle sets have a Jaccard of SIMILAR or more."""
    for batch in batches:
        keep = []
        for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
            x, y = one.values.to_numpy(), two.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what is similar in each cell. Bit planes tell which members a text may be near to; of
    those it is checked against the members of other groups until it joins them."""
    for batch in batches:
        left, right = [], []
        for members in batch.column("members").to_pylist():
            members.sort(key=lambda m: m["code"])
            sets = [set(m["shingles"]) for m in members]
            marked = [k for k, m in enumerate(members) if m["mark"] is not None]
            marked = marked if len(marked) >= LANES else []
            places = {k: i for i, k in enumerate(marked)}
            fps = bit_planes.words([members[k]["mark"] for k in marked])
            rows, begin = np.zeros((0, len(marked)), bool), 0
            groups: list[list[int]] = []
            for k, own in enumerate(sets):
                row = places.get(k)
                if row is not None and row >= begin + len(rows):
                    rows, begin = bit_planes.rows_within(fps[row : row + ROWS_AT_ONCE], fps), row

                def may(j: int) -> bool:
                    return row is None or j not in places or bool(rows[row - begin, places[j]])

                joined = []
                for group in groups:
                    near = next((j for j in group if may(j) and _similar(own, sets[j])), None)
                    if near is not None:
                        joined.append(group)
                        left.append(members[k]["code"])
                        right.append(members[near]["code"])
                groups = [g for g in groups if not any(g is j for j in joined)]
                groups.append([k, *(j for g in joined for j in g)])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def near_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of pairs (a, b) of codes those that are near copies: sifted by fingerprints, checked on the sets themselves."""
    mark = known.select("code", "mark")
    both = pairs.join(mark.select(F.col("code").alias("a"), "mark"), "a").join(mark.select(F.col("code").alias("b"), F.col("mark").alias("mark_b")), "b")
    left = both.select("a", "b", "mark", "mark_b").mapInArrow(_sifted, "a long, b long")
    one = known.select(F.col("code").alias("a"), F.col("shingles").alias("one"))
    two = known.select(F.col("code").alias("b"), F.col("shingles").alias("two"))
    return left.join(two, "b").join(one, "a").select("a", "b", "one", "two").mapInArrow(_near, "a long, b long")


def similar_sets(filed: DataFrame, known: DataFrame, cell: int = CELL) -> DataFrame:
    """(node, component) over the codes of sets that are similar to another one of a bucket.

    ``filed`` has a row (key, code, size, least) for each set and bucket that holds several, ``least`` its least
    code; ``known`` has the sets. First every set is checked against the least of each of its buckets, which
    connects most groups at one check a member. Buckets that then still hold several components are compared
    whole, in pairs of cells of bounded size, so no group is in one task and none makes all its pairs.
    """
    pairs = filed.where("code <> least").select(F.col("least").alias("a"), F.col("code").alias("b")).distinct()
    edges = materialize(near_pairs(pairs, known))
    group = components(edges)
    label = filed.join(group, filed["code"] == group["node"], "left").select(
        "key", "code", "size", F.coalesce("component", "code").alias("component")
    )
    label = materialize(label)
    several = (
        label.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("size").alias("weight"))
        .where("low < high").select("key", F.ceil(F.col("weight") / cell).cast("int").alias("cells"))
    )
    salt = F.pmod(F.xxhash64("code"), F.col("cells")).cast("int")
    dealt = label.join(several, "key").select(
        "code", "key", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")
    )
    cells = dealt.select("code", "key", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))
    members = cells.join(known, "code").groupBy("key", "i", "j").agg(F.collect_set(F.struct("code", "shingles", "mark")).alias("members"))
    more = materialize(members.where("size(members) > 1").select("members").mapInArrow(_verified, "a long, b long").distinct())
    forget(label)
    if more.isEmpty():
        return group
    forget(group)
    return components(edges.union(more).distinct())
