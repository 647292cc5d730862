"""Substring dedup by paragraph MinHash banding, with exact Jaccard checks and removal by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from rowloom.llm.rolling import Rolling, mixed, word_bounds, word_hashes
from rowloom.llm.similar_sets import CELL, SHINGLE, SHINGLED, shingled, similar_sets
from rowloom.llm.suffix_index import _least, kept_bytes, merged_spans
from rowloom.llm.texts import WHO, map_texts, who_columns
from rowloom.operators.joins import fits_broadcast, lookup
from rowloom.session import forget, materialize, materialize_counted

# BANDS bands of ROWS minima: a pair at similarity 0.8 collides with probability 1 - (1 - 0.8^3)^9 > 0.998.
BANDS = 9
ROWS = 3
# Shorter paragraphs are everyday lines: they are left alone.
MIN_WORDS = 20
# Sentences of so many words count as passages of their own.
MIN_PASSAGE = 12
# A run of so many words that stands elsewhere too is a repeated passage, whatever lines and marks it has.
RUN = 51
# Runs are found by the least hash of the GRAM-word stretches in them.
GRAM = 12

# Minima are taken over the lines of about so many words at once.
SLICE = 1 << 14

_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_PLACES = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))

UNITS = StructType(
    [StructField(n, ArrayType(IntegerType())) for n in ("start", "stop", "words")]
    + [StructField("code", ArrayType(LongType())), StructField("bands", ArrayType(ArrayType(LongType())))]
)
ANCHORS = StructType(
    [StructField(n, ArrayType(LongType())) for n in ("anchor", "around")]
    + [StructField(n, ArrayType(IntegerType())) for n in ("first", "last")]
)


def _words(data: bytes) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """Hashes of word stretches, and the starts and stops of the words."""
    hashes, starts, stops = word_hashes(data.lower())
    return Rolling(hashes), starts, stops


def units(data: bytes, words: tuple[Rolling, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, list[int] | None]]:
    """(start, stop, words, code, bands) of a document's paragraphs and passages, in bytes.

    A paragraph is a line of MIN_WORDS or more. A passage is a sentence of MIN_PASSAGE words or more, so
    text copied into the middle of another line is found by the sentences it brings along. Passages have
    no bands: they count as repeated when equal.
    """
    rolling, starts, stops = words or _words(data)
    if not len(starts):
        return []
    raw = np.frombuffer(data, np.uint8)
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    ends_line = np.concatenate((line[1:] != line[:-1], [True]))
    ends_passage = ends_line | _ENDS[raw[stops - 1]]
    found, bounds = [], set()
    low, high = _stretches(ends_line, MIN_WORDS)
    if len(low):
        code = rolling.of(low, high).view(np.int64).tolist()
        bounds = set(zip(low.tolist(), high.tolist(), strict=True))
        keys = _bands(rolling, low, high)
        found += list(zip(starts[low].tolist(), stops[high - 1].tolist(), (high - low).tolist(), code, keys, strict=True))
    low, high = _stretches(ends_passage, MIN_PASSAGE)
    code = rolling.of(low, high).view(np.int64).tolist()
    each = zip(low.tolist(), high.tolist(), starts[low].tolist(), stops[high - 1].tolist(), code, strict=True)
    found += [(start, stop, b - a, c, None) for a, b, start, stop, c in each if (a, b) not in bounds]
    return found


# Bytes that end a sentence.
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True


def anchors(data: bytes, words: tuple[Rolling, np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """(anchor, around, first, last): neighbouring runs of RUN words with the same least stretch, a hash of
    all their words, and the first words of the first and the last run. Equal runs have equal anchors."""
    rolling, starts, _ = words or _words(data)
    if len(starts) < RUN:
        return [np.zeros(0, np.int64)] * 4
    grams = rolling.every(GRAM)
    low = np.uint64(32)  # bits for a position
    ranked = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(ranked, RUN - GRAM + 1) & np.uint64((1 << 32) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return [grams[at[first]].view(np.int64), rolling.of(first, last + RUN).view(np.int64), first, last]


def _stretches(ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    high = np.flatnonzero(ends) + 1
    low = np.concatenate(([0], high[:-1]))
    keep = high - low >= least
    return low[keep], high[keep]


def _bands(rolling: Rolling, low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """The band keys of word stretches: minima of the shingle hashes under BANDS * ROWS functions."""
    every = rolling.every(SHINGLE)
    least, start = [], 0
    while start < len(low):  # some lines at once, so a long text needs no matrix of its own size
        stop = max(start + 1, int(np.searchsorted(high, low[start] + SLICE)))
        base, end = int(low[start]), int(high[stop - 1]) - SHINGLE + 1
        part = every[base:end, None]
        edges = np.column_stack((low[start:stop], high[start:stop] - SHINGLE + 1)).ravel() - base
        # Every second stretch lies between two lines.
        rows = np.minimum.reduceat(part * _SEEDS ^ (part >> np.uint64(31)), edges[: -1 if edges[-1] == end - base else None], axis=0)
        least.append(rows[::2])
        start = stop
    keys = mixed(np.concatenate(least) ^ _PLACES).reshape(len(low), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def _marked(texts: list[bytes | None]) -> list[pa.Array]:
    listed, marks = [], []
    for text in texts:
        words = _words(text or b"")
        listed.append(units(text or b"", words))
        marks.append(anchors(text or b"", words))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    made = [pa.array([[u[k] for u in f] for f in listed], pa.list_(kind)) for k, kind in enumerate(kinds)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return made + [pa.array([f[k] for f in marks], pa.list_(kind)) for k, kind in enumerate(kinds)]


CODE = ["code", "words"]


def _sizes(found: DataFrame) -> DataFrame:
    """(code, size, key) of every paragraph's band keys; a repeated paragraph has the same row each time."""
    each = found.select(F.explode(F.arrays_zip("code", "words", "bands")).alias("u")).where("u.bands is not null")
    return each.select("u.code", (F.col("u.words") - (SHINGLE - 1)).alias("size"), F.explode("u.bands").alias("key"))


def similar_paragraphs(found: DataFrame, codes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) over the codes of paragraphs that are similar to another.

    ``found`` has the arrays code, words and bands of every document, ``codes`` one row per different paragraph
    (code, place). A band key with different codes makes candidates: keys are reduced to their least and largest
    code before they are shuffled, and only rows of keys with several come back. The texts of those paragraphs
    are cut out of their first documents and compared as in ``similar_sets``.
    """
    keyed = _sizes(found)
    shared = keyed.groupBy("key").agg(F.min("code").alias("least"), F.max("code").alias("most"), F.count("*").alias("n")).where("least < most").select("key", "least", "n")
    buckets, n = materialize_counted(shared)
    filed = materialize(lookup(keyed, buckets, ["key"], n, "inner", counted="n").select("key", "code", "size", "least").distinct())
    wanted = codes.join(filed.select("code").distinct(), "code").select("code", "place.*")
    listed, n_listed = materialize_counted(wanted.groupBy(*WHO).agg(F.collect_list(F.struct("code", "start", "stop")).alias("parts")))
    cut = _only(texts, listed, n_listed).join(listed, WHO).select("text", F.explode("parts").alias("p")).select(
        F.col("p.code").alias("code"), F.substring("text", F.col("p.start") + 1, F.col("p.stop") - F.col("p.start")).alias("bytes")
    )
    known = materialize(cut.mapInArrow(shingled, SHINGLED))
    forget(listed)
    return similar_sets(filed, known, CELL)


def _only(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The texts that ``wanted`` asks for; where few do, the others are left behind before they are shuffled."""
    asked = wanted.select(*WHO)
    return texts.join(F.broadcast(asked), WHO, "left_semi") if fits_broadcast(asked, n) else texts


def _run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every run of RUN words that starts in some stretches of a text."""
    for batch in batches:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            every = Rolling(word_hashes(text.lower())[0]).every(RUN).view(np.int64)
            for s in spans:
                at = np.arange(s["first"], s["last"] + 1)
                parts = (np.full(len(at), s["anchor"]), np.full(len(at), s["around"]), at - s["first"], every[at])
                for column, part in zip(found, parts, strict=True):
                    column.append(part)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(f), k) for f, k in zip(found, kinds, strict=True)], ["anchor", "around", "off", "run"]
        )


def repeated_runs(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(who, runs): the runs of RUN words that stand earlier too, as ranges (at, n, keeper), keeper the place (who, at) of the
    first of n neighbouring runs.

    Runs that are equal share their anchor. Where all holders of an anchor have the same surroundings,
    these go as a whole; else each run of one holder per surroundings is compared by hash.
    """
    names = ANCHORS.names
    spans = found.select(*WHO, F.explode(F.arrays_zip(*names)).alias("s")).select(*WHO, "s.*")
    repeats, n = materialize_counted(spans.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "n"))
    held = materialize(lookup(spans, repeats, ["anchor"], n, "inner", counted="n").select(*WHO, *names))
    place = F.struct(*WHO, F.col("first").alias("at"))
    groups = materialize(held.groupBy("anchor", "around").agg(F.min(place).alias("place"), F.max(F.expr("last - first")).alias("reach")))
    several = groups.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    mixed_ = materialize(groups.join(several, "anchor"))
    span = F.struct("anchor", "around", F.col("place.at").alias("first"), (F.col("place.at") + F.col("reach")).alias("last"))
    wanted = mixed_.select(*[F.col(f"place.{w}").alias(w) for w in WHO], span.alias("s")).groupBy(*WHO).agg(F.collect_list("s").alias("spans"))
    wanted, n_wanted = materialize_counted(wanted)
    hashed = _only(texts, wanted, n_wanted).join(wanted, WHO).select("text", "spans").mapInArrow(_run_hashes, "anchor long, around long, off int, run long")
    own = F.struct(*[F.col(f"place.{w}").alias(w) for w in WHO], (F.col("place.at") + F.col("off")).alias("at"))
    # Rows of repeated documents go after the join, whose shuffle serves that too.
    placed = hashed.join(mixed_, ["anchor", "around"]).dropDuplicates(["anchor", "around", "off"])
    runs = materialize(placed.select("anchor", "around", "off", "run", own.alias("place")))
    firsts, n_runs = materialize_counted(runs.groupBy("run").agg(F.min("place").alias("keeper"), F.count("*").alias("n")))
    compared = lookup(runs.select("anchor", "around", "off", "run"), firsts, ["run"], n_runs, "inner", counted="n")
    offs = F.sort_array(F.collect_list(F.struct("off", "keeper"))).alias("offs")
    some = _ranges(compared.groupBy("anchor", "around").agg(offs)).select("anchor", "around", "ranges")
    one = F.struct(F.lit(0).alias("off"), (F.col("reach") + 1).alias("n"), F.col("place").alias("keeper"))
    whole = groups.join(several, "anchor", "left_anti").select("anchor", "around", F.array(one).alias("ranges"))
    kept, n_kept = materialize_counted(whole.unionByName(some))
    for table in (groups, mixed_, wanted, runs, firsts):
        forget(table)
    moved = F.transform("ranges", lambda o: F.struct((F.col("first") + o["off"]).alias("at"), o["n"].alias("n"), o["keeper"].alias("keeper")))
    gone = lookup(held, kept, ["anchor", "around"], n_kept, "inner").select(*WHO, moved.alias("runs"))
    other = F.filter("runs", lambda r: F.struct(*WHO, r["at"].alias("at")) != r["keeper"])
    found_ = materialize(gone.select(*WHO, F.explode(other).alias("r")).groupBy(*WHO).agg(F.collect_set("r").alias("runs")))
    for table in (held, kept, repeats):
        forget(table)
    return found_


def _ranges(rows: DataFrame) -> DataFrame:
    """Neighbouring runs whose keepers are neighbours too become one range (off, n, keeper of the first)."""

    def follows(i):
        one, two = F.get("offs", i - 1), F.get("offs", i)
        same = F.struct(*[one["keeper"][w] for w in WHO]) == F.struct(*[two["keeper"][w] for w in WHO])
        return same & (one["off"] + 1 == two["off"]) & (one["keeper"]["at"] + 1 == two["keeper"]["at"])

    begun = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("offs") - 1), lambda i: (i == 0) | ~F.coalesce(follows(i), F.lit(False))))
    n = lambda i, k: (F.coalesce(F.get("starts", k + 1), F.size("offs")) - i).alias("n")
    return begun.withColumn(
        "ranges", F.transform("starts", lambda i, k: F.struct(F.get("offs", i)["off"].alias("off"), n(i, k), F.get("offs", i)["keeper"].alias("keeper")))
    )


def _run_spans(text: bytes, who: tuple, runs: list[dict]) -> list[tuple[int, int]]:
    """The bytes of ranges of runs. Runs that overlap the ones kept in the same text go from those ones' end."""
    starts, stops = word_bounds(text)
    out = []
    for r in runs:
        low, high, kept = r["at"], r["at"] + r["n"] - 1 + RUN, r["keeper"]
        if who == (kept["no_id"], kept["id"], kept["digest"]):
            low = max(low, kept["at"] + RUN)
        if low < high:
            out.append((int(starts[low]), int(stops[high - 1])))
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        texts = batch.column("row").field("text").cast(pa.binary()).to_pylist()
        columns = [batch.column(n).to_pylist() for n in ("parts", "runs", *WHO)]
        for text, parts, repeated, *who in zip(texts, *columns, strict=True):
            cut = [(p["start"], p["stop"]) for p in parts or []]
            if repeated:
                cut += _run_spans(text, tuple(who), repeated)
            runs = merged_spans(*np.array(cut, np.int64).reshape(-1, 2).T)
            kept.append(None if text is None else kept_bytes(text, runs).decode("utf-8", "replace"))
            removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
            spans.append(len(runs))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(kept, pa.string()), pa.array(spans, pa.int64()), pa.array(removed, pa.int64()), batch.column("kept_in")],
            ["row", "kept", "n_spans", "n_removed", "kept_in"],
        )


def deduped(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of docs), the text ``kept``, ``n_spans`` and ``n_removed`` (bytes cut out), and
    ``kept_in``: the ids of the documents that keep what was cut.

    Of each component of similar paragraphs, of equal passages, and of equal runs of RUN words, the first by document order (id, null
    last; then a digest of the text; then place) stays, the others go. Rows that repeat id and text are
    one document. Null texts stay null; texts without a paragraph, passage or run stay as they are.
    """
    raw = F.col("text").cast("binary")
    plain = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), raw.alias("text")).select(
        "row", *who_columns(F.col("_id"), F.col("text"), docs.schema["doc_id"].dataType), "text"
    )
    texts = plain.select(*WHO, "text")
    found = materialize(map_texts(texts, _marked, StructType([*UNITS.fields, *ANCHORS.fields]), keep=WHO).select(*[f"row.{w}" for w in WHO], "found.*"))
    each = found.select(*WHO, F.explode(F.arrays_zip("start", "stop", "words", "code")).alias("u")).select(*WHO, "u.*").withColumn(
        "place", F.struct(*WHO, "start", "stop")
    )
    codes = materialize(each.groupBy(*CODE).agg(F.min("place").alias("place"), F.count("*").alias("n")))
    group = similar_paragraphs(found, codes.select("code", "place"), texts)
    named = codes.join(group, codes["code"] == group["node"], "left").select(*CODE, "place", "n", "component")
    firsts = named.where("component is not null").groupBy("component").agg(F.min("place").alias("first"))
    keepers, n_keepers = materialize_counted(
        named.join(firsts, "component", "left").where("n > 1 or component is not null").select(*CODE, "n", F.coalesce("first", "place").alias("keeper"))
    )
    forget(codes)
    forget(group)
    gone = lookup(each, keepers, CODE, n_keepers, "inner", counted="n").where("place <> keeper")
    parts = materialize(
        gone.groupBy(*WHO).agg(
            F.collect_set(F.struct("start", "stop")).alias("parts"),
            F.sort_array(F.collect_set(F.when(~F.col("keeper.no_id"), F.col("keeper.id")))).alias("kept_in"),
        )
    )
    forget(keepers)
    runs = repeated_runs(found, texts)
    forget(found)
    both = parts.join(runs, WHO, "full").select(*WHO, "parts", "runs", _keepers().alias("kept_in"))
    # The text goes along once, inside its row.
    joined = plain.drop("text").join(both, WHO, "left").select("row", *WHO, "parts", "runs", "kept_in")
    schema = StructType(
        [
            StructField("row", docs.schema), StructField("kept", StringType()), StructField("n_spans", LongType()),
            StructField("n_removed", LongType()), StructField("kept_in", ArrayType(joined.schema["kept_in"].dataType.elementType)),
        ]
    )
    return joined.mapInArrow(_cut_out, schema)


def _keepers():
    """The ids of the documents that keep the parts or the runs."""
    ids = F.transform(F.filter("runs", lambda r: ~r["keeper"]["no_id"]), lambda r: r["keeper"]["id"])
    return F.when(F.col("runs").isNull(), F.col("kept_in")).otherwise(
        F.array_sort(F.array_distinct(F.when(F.col("kept_in").isNull(), ids).otherwise(F.concat("kept_in", ids))))
    )


def op8_paragraph_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_spans", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"), "kept_in"
    )
