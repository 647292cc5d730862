"""Near copies of whole texts: wide SimHash fingerprints are filed by samples of their bits, files are compared in bit planes
with carry-save counters, and the exact Jaccard of word shingles decides on what the planes find."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from rowloom.llm import bit_planes, similar_sets
from rowloom.llm.similar_sets import shingles
from rowloom.llm.texts import WHO, map_texts, who_columns
from rowloom.operators.joins import lookup
from rowloom.session import forget, materialize, materialize_counted

CELL = similar_sets.CELL
# A file holds about so many fingerprints; one of twice as many or more is compared in pairs of cells of this size.
FILE = 2048
# So many tables of files are made that a pair at similarity 0.8 misses all of them with at most this probability.
MISS = 1e-6
# The share of bits in which such a pair differs (see bit_planes).
DIFFER = 0.155
BITS = bit_planes.PARTS * 64
# A smaller set is similar to no other: one of four and one of five share four of five.
LEAST_SET = 4

MARKS = StructType([StructField("code", LongType()), StructField("size", IntegerType()), StructField("mark", BinaryType())])


def _marks(texts: list[bytes | None]) -> list[pa.Array]:
    sets = [shingles(t or b"") for t in texts]
    codes = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
    marks = [bit_planes.fingerprint(s) for s in sets]
    return [pa.array(codes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.binary())]


def missed(bits: int, tables: int) -> float:
    """The probability that fingerprints which differ in a bit by DIFFER agree in none of ``tables`` samples of ``bits`` bits."""

    def ways(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    apart = range(BITS + 1)
    chance = np.exp([ways(BITS, d) + d * np.log(DIFFER) + (BITS - d) * np.log(1 - DIFFER) for d in apart])
    agree = np.exp([ways(BITS - d, bits) - ways(BITS, bits) if d + bits <= BITS else -np.inf for d in apart])
    return float((chance * (1 - np.minimum(agree, 1)) ** tables).sum())


def samples(n: int) -> list[np.ndarray]:
    """The bit places that file n fingerprints, one sample a table: as many that a file holds FILE of them on average at
    most, and tables until MISS is reached. Few fingerprints are one file."""
    bits = max(0, (-(-n // FILE) - 1).bit_length())
    tables = 1
    while missed(bits, tables) > MISS:
        tables += 1
    rng = np.random.default_rng(20)
    return [np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(tables)]


def _filed(places: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The files of every fingerprint: the number of a table, then the bits at its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = bit_planes.words(batch.column("mark").to_pylist())
            bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
            files = np.empty((len(fps), len(places)), np.int64)
            for table, own in enumerate(places):
                files[:, table] = (table << len(own)) + bits[:, own] @ (1 << np.arange(len(own)))
            offsets = pa.array(np.arange(len(fps) + 1, dtype=np.int32) * np.int32(len(places)))
            listed = pa.ListArray.from_arrays(offsets, pa.array(files.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("mark"), listed], ["code", "mark", "files"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, least, code): the groups that near fingerprints of a file form, ``key`` a digest of their codes."""
    for batch in batches:
        members = batch.column("members")
        offsets, codes = members.offsets.to_numpy(), members.values.field("code").to_numpy()
        marks = members.values.field("mark")
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            label = bit_planes.groups_within(bit_planes.words(marks.slice(start, stop - start).to_pylist()))
            own = codes[start:stop]
            order = np.lexsort((own, label))
            label, own = label[order], own[order]
            edges = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    group = own[a:b]
                    key = xxhash.xxh64_intdigest(group.tobytes()) - (1 << 63)
                    for column, part in zip(found, (np.full(b - a, key), np.full(b - a, group[0]), group), strict=True):
                        column.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f), pa.int64()) for f in found], ["key", "least", "code"])


def near_groups(codes: DataFrame, n: int) -> DataFrame:
    """(key, least, code): groups of codes that near fingerprints connect, ``least`` the least code of each.

    Every fingerprint is filed once a table by a sample of its bits, and all of a file are compared with each other in
    bit planes. A file that is too large is split into cells by hash and compared in pairs of cells; nothing is left out.
    """
    files = codes.select("code", "mark").mapInArrow(_filed(samples(n)), "code long, mark binary, files array<long>")
    each = files.select("code", "mark", F.explode("files").alias("file"))
    counts = files.select(F.explode("files").alias("file")).groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > 2 * FILE)
    large, n_large = materialize_counted(counts.select("file", F.ceil(F.col("n") / FILE).cast("int").alias("cells")))
    salt = F.pmod(F.xxhash64("code"), F.col("cells")).cast("int")
    all_cells = F.when(F.col("cells").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cells") - 1))
    placed = lookup(each, large, ["file"], n_large).select(
        "code", "mark", "file", F.coalesce(salt, F.lit(0)).alias("salt"), F.explode(all_cells).alias("other")
    )
    members = placed.groupBy("file", F.least("salt", "other"), F.greatest("salt", "other")).agg(
        F.collect_list(F.struct("code", "mark")).alias("members")
    )
    return members.where("size(members) > 1").select("members").mapInArrow(_grouped, "key long, least long, code long").distinct()


def similar_texts(codes: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """(node, component) over the codes of shingle sets that are similar to another.

    ``codes`` has one row per different set (code, place, size, mark), n of them. Groups of near fingerprints are the
    candidates; their sets are then compared exactly.
    """
    groups = materialize(near_groups(codes.where(F.col("size") >= LEAST_SET), n))
    wanted = codes.join(groups.select("code").distinct(), "code")
    filed = materialize(groups.join(wanted.select("code", "size"), "code").select("key", "code", "size", "least"))
    held = texts.join(wanted.select("code", "place.*"), WHO).select("code", F.col("text").alias("bytes"))
    known = materialize(held.mapInArrow(similar_sets.shingled, similar_sets.SHINGLED).dropDuplicates(["code"]))
    forget(groups)
    return similar_sets.similar_sets(filed, known, CELL)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near copies; the others go.

    Two texts are near copies if their sets of word shingles have a Jaccard of SIMILAR or more, and so are
    all that such pairs connect; texts without words are alike. The order is that of ids, null last, then
    of a digest of the text. Rows that repeat id and text are one document.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("text"))
    plain = packed.select("row", *who_columns(F.col("_id"), F.col("text"), docs.schema["doc_id"].dataType), "text")
    texts = plain.select(*WHO, "text")
    found = materialize(map_texts(texts, _marks, MARKS).select(*[f"row.{w}" for w in WHO], "found.*"))
    codes, n = materialize_counted(
        found.groupBy("code").agg(F.min(F.struct(*WHO)).alias("place"), F.max("size").alias("size"), F.max("mark").alias("mark"))
    )
    group = similar_texts(codes, n, texts)
    named = codes.join(group, codes["code"] == group["node"], "left").select("code", "place", F.coalesce("component", "code").alias("component"))
    firsts = named.groupBy("component").agg(F.min("place").alias("first"))
    classes = named.join(firsts, "component").select("code", "first")
    placed = lookup(found.select(*WHO, "code"), classes, ["code"], n, "inner")
    gone = placed.where(F.struct(*WHO) != F.col("first")).select(*WHO).distinct()
    return plain.join(gone, WHO, "left_anti").select("row.*")
