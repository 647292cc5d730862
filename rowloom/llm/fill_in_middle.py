"""Fill-in-middle transformation over seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from rowloom.llm.texts import map_texts

SEED = 1
# Of 100 documents: so many are transformed, and of 100 transformed ones so many have the suffix first.
TRANSFORMED = 90
SUFFIX_FIRST = 20
MARKS = P, S, M = b"<P>", b"<S>", b"<M>"
# A frame holds so many bytes of text at most.
FRAME_BYTES = 64 << 10
LEVEL = 1

FOUND = StructType(
    [
        StructField("n", LongType()),
        StructField("form", StringType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("frames", ArrayType(BinaryType())),
        StructField("ends", ArrayType(LongType())),
    ]
)


def _units(data: bytes) -> int:
    """Code points of whole UTF-8 text."""
    return len(data) if data.isascii() else len(data.decode())


class Frames:
    """UTF-8 text as independent zstandard frames, with the number of code points up to the end of each."""

    def __init__(self, frames: Iterable[bytes] = (), ends: Iterable[int] = ()):
        self.frames, self.ends = list(frames), list(ends)

    @classmethod
    def of(cls, parts: Iterable[bytes], size: int = FRAME_BYTES) -> Frames:
        """Store a text that comes in parts, each of whole code points."""
        made, packer, held = cls(), zstandard.ZstdCompressor(level=LEVEL), b""
        for part in parts:
            held = held + part if held else part
            at = 0
            while len(held) - at >= size:
                stop = at + size
                while stop < len(held) and held[stop] & 0xC0 == 0x80:  # whole code points only
                    stop += 1
                made._add(packer, held[at:stop])
                at = stop
            held = held[at:]
        if held:
            made._add(packer, held)
        return made

    def _add(self, packer: zstandard.ZstdCompressor, data: bytes) -> None:
        self.frames.append(packer.compress(data))
        self.ends.append((self.ends[-1] if self.ends else 0) + _units(data))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The code points from ``start`` to ``stop``, a frame at a time; frames outside stay packed."""
        stop = len(self) if stop is None else stop
        opener = zstandard.ZstdDecompressor()
        k = bisect_left(self.ends, start + 1)
        while start < stop:
            begin, end = self.ends[k - 1] if k else 0, self.ends[k]
            data = opener.decompress(self.frames[k])
            if start > begin or stop < end:
                data = data[start - begin : stop - begin] if data.isascii() else data.decode()[start - begin : stop - begin].encode()
            yield data
            start, k = end, k + 1


def holds(text: Frames, marks: Iterable[bytes] = MARKS) -> bool:
    """A mark stands somewhere in the text, also across frames."""
    tail = b""
    for data in text.stream():
        data = tail + data
        if any(m in data for m in marks):
            return True
        tail = data[-2:]
    return False


def cut(n: int, digest: str) -> tuple[str, int, int]:
    """Form, end of the prefix and end of the middle, from the first four 8-digit groups of a hex digest."""
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if n == 0 or h3 % 100 >= TRANSFORMED:
        return "plain", 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm", low, high


def transformed(text: Frames, form: str, low: int, high: int) -> Iterator[bytes]:
    """The output, in parts."""
    if form == "plain":
        yield from text.stream()
    elif form == "psm":
        yield P
        yield from text.stream(0, low)
        yield S
        yield from text.stream(high)
        yield M
        yield from text.stream(low, high)
    else:
        yield S
        yield from text.stream(high)
        yield P
        yield from text.stream(0, low)
        yield M
        yield from text.stream(low, high)


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text, in parts, from the output and its form alone: the marks are looked up in the output."""
    if form == "plain":
        yield from output.stream()
        return
    at, tail, seen = {}, b"", 0  # code points before the tail
    for data in output.stream():
        data = tail + data
        for mark in MARKS:
            if mark not in at and (place := data.find(mark)) >= 0:
                at[mark] = seen + _units(data[:place])
        keep = len(data) - 2 if len(data) > 2 else 0
        while keep and data[keep] & 0xC0 == 0x80:
            keep -= 1
        seen, tail = seen + _units(data[:keep]), data[keep:]
    second, third = (S, M) if form == "psm" else (P, M)
    first, after, last = 3, at[second], at[third]
    one, two, three = (first, after), (after + 3, last), (last + 3, len(output))
    prefix, suffix, middle = (one, two, three) if form == "psm" else (two, one, three)
    for start, stop in (prefix, middle, suffix):
        yield from output.stream(start, stop)


def _made(texts: list[bytes | None], digests: list[str]) -> list[pa.Array]:
    rows = []
    for text, digest in zip(texts, digests, strict=True):
        stored = Frames.of((text or b"",))
        form, low, high = cut(len(stored), digest)
        if form != "plain" and holds(stored):
            form = "plain"
        output = stored if form == "plain" else Frames.of(transformed(stored, form, low, high))
        plain = form == "plain"
        rows.append((len(stored), form, None if plain else low, None if plain else high - low, output.frames, output.ends))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``row`` (all columns of docs) and ``found``: n, form, prefix_chars, middle_chars, and the output's frames.

    Texts are stored as independent frames with cumulative counts of code points; only the frames that hold
    a cut are opened to select, and outputs are written frame by frame, so a text of any length is unpacked
    one frame at a time. The draw depends on the seed and doc_id alone, of any type; a null id draws as the
    empty string, and rows that repeat draw alike. Null texts are empty, and empty texts or texts with a
    mark stay plain. Other columns pass through, whatever their names.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return map_texts(docs, _made, FOUND, beside=key)


DIGESTS = StructType([StructField("output_sha256", StringType()), StructField("restored_sha256", StringType())])


@F.pandas_udf(DIGESTS)
def _digests(frames, ends, form):
    import pandas as pd

    rows = []
    for kept, counts, kind in zip(frames, ends, form, strict=True):
        output = Frames(kept, counts)
        rows.append([_sha256(output.stream()), _sha256(restored(output, kind))])
    return pd.DataFrame(rows, columns=DIGESTS.names)


def _sha256(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def digests(found: Column) -> Column:
    """output_sha256 and restored_sha256 of transformed texts, streamed from their ordered frames."""
    return _digests(found["frames"], found["ends"], found["form"])


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = transform(docs).withColumn("sums", digests(F.col("found")))
    return both.select("row.doc_id", "found.n", "found.form", "found.prefix_chars", "found.middle_chars", "sums.output_sha256", "sums.restored_sha256")
