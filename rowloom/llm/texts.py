"""Texts handed to numpy in bounded slices of Arrow batches, rows passed through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

# A slice holds texts of so many bytes at most, or a single longer text.
SLICE_BYTES = 4 << 20
# Rows and bytes sent to a Python worker at once. Whole documents are long: Spark's 10,000 rows fill its memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def map_texts(
    docs: DataFrame, work: Callable[..., list[pa.Array]], found: StructType, text: str = "text", beside: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` holds all its columns, ``found`` what ``work`` made of the texts.

    ``work`` gets the UTF-8 bytes of some texts (None for null) and returns one array per field of
    ``found``; with ``beside``, it gets the values of that expression as a second list. Packing both
    sides keeps extra columns of any name from clashing. With ``keep``, ``row`` holds only those columns.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kept = list(range(len(docs.columns))) if keep is None else [docs.columns.index(c) for c in keep]
    schema = StructType([StructField("row", StructType([docs.schema[k] for k in kept])), StructField("found", found)])
    names = [f.name for f in found]
    at, width = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).cast(pa.binary()).to_pylist()
                more = [c.to_pylist() for c in part.columns[width:]]
                row = pa.StructArray.from_arrays([part.columns[k] for k in kept], fields=[part.schema.field(k) for k in kept])
                yield pa.RecordBatch.from_arrays([row, pa.StructArray.from_arrays(work(texts, *more), names)], ["row", "found"])

    given = docs if beside is None else docs.select("*", beside.alias("|".join(["beside", *docs.columns])))
    return given.mapInArrow(run, schema)


def id_or_default(doc_id: Column, kind: DataType) -> Column:
    """A document's id of any type, and some value of that type for null: joins by id then need no null-safe equality."""
    default = "1970-01-01" if kind.typeName().startswith(("date", "timestamp")) else "0"
    return F.coalesce(doc_id, F.lit(default).cast(kind))


#: Identity and order of a document; a text binary or string.
WHO = ["no_id", "id", "digest"]


def who_columns(doc_id: Column, text: Column, kind: DataType) -> list[Column]:
    """WHO: its id of any type, null last, then a digest of its text."""
    return [doc_id.isNull().alias("no_id"), id_or_default(doc_id, kind).alias("id"), F.xxhash64(text).alias("digest")]


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts in column ``at`` stay below SLICE_BYTES where one text does."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(at).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
