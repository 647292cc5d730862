"""SentencePiece encoding and decoding: exact merges by backtracking over longest matches."""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from rowloom.llm.texts import map_texts

SPACE = "▁"
# Ids of so many short chunks, and the answers of so many token pairs, are kept in a worker (twice as many at most).
KEPT = 250_000
KEPT_CHARS = 48
_NEVER = float("-inf")

_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
FOUND = StructType([StructField("n_tokens", LongType()), StructField("ids", BinaryType())])


class _Recent(dict):
    """What ``make`` gives for a key; the keys of the last KEPT to 2 KEPT misses are kept."""

    def __init__(self, make, fits=lambda key: True):
        super().__init__()
        self.make, self.fits, self.older = make, fits, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if self.fits(key):
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def _reader(model: bytes) -> sentencepiece.SentencePieceProcessor:
    reader = sentencepiece.SentencePieceProcessor(model_proto=model)
    if reader.normalize("A  b ") != f"{SPACE}A{SPACE}{SPACE}b{SPACE}":
        raise ValueError("only models that keep texts as they are, with a space put before, are read")
    return reader


class Printer:
    """What ids print as, read from the model's bytes."""

    def __init__(self, model: bytes):
        reader = _reader(model)
        size = range(reader.get_piece_size())
        self.control = {i for i in size if reader.is_control(i)}
        # These begin a text as they are; other pieces lose a space there.
        self.bare = {i for i in size if reader.is_byte(i) or reader.is_unknown(i)}
        self.prints = [b""] * len(size)
        for i in size:
            if reader.is_byte(i):
                self.prints[i] = bytes([int(reader.id_to_piece(i)[1:-1], 16)])
            elif i not in self.control:
                self.prints[i] = (" ⁇ " if reader.is_unknown(i) else reader.id_to_piece(i).replace(SPACE, " ")).encode()

    def decode(self, ids: bytes) -> str:
        """The text of ids: control pieces print nothing, the space before the first piece goes, bytes join."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        first = next((k for k, i in enumerate(numbers) if i not in self.control), len(numbers))
        data = b"".join(map(self.prints.__getitem__, numbers[first:]))
        if first < len(numbers) and numbers[first] not in self.bare:
            data = data.removeprefix(b" ")
        return data.decode("utf-8", "each-invalid-byte")


class Pieces:
    """The vocabulary of a merge-type model, read from the model's bytes."""

    def __init__(self, model: bytes):
        reader = _reader(model)
        size = range(reader.get_piece_size())
        in_bytes = [i for i in size if reader.is_byte(i)]
        if len(in_bytes) != 256 or any(reader.is_unused(i) for i in size):
            raise ValueError("only models with all byte pieces and no unused pieces are read")
        plain = [i for i in size if not (reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i))]
        self.ids = {reader.id_to_piece(i): i for i in plain}
        self.scores = {reader.id_to_piece(i): reader.get_score(i) for i in plain}
        byte_id = {int(reader.id_to_piece(i)[1:-1], 16): i for i in in_bytes}
        self.byte_ids = [byte_id[b] for b in range(256)]
        self.begin, self.end = (struct.pack("<I", i) for i in (reader.bos_id(), reader.eos_id()))
        if any("\n" in p for p in self.ids):
            raise ValueError("only models without a line end in their pieces are read")
        # No merge joins two characters that stand side by side in no piece.
        self.touching = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.trie = ahocorasick.Automaton()
        made = [p for p in self.ids if len(p) > 1 and self.merged(p) == [p]]
        for p in made:
            self.trie.add_word(p, len(p))
        self.trie.make_automaton()
        tokens = set(made)
        self.shorter = {p: next((k for k in range(len(p) - 1, 1, -1) if p[:k] in tokens), 1) for p in made}
        self.agree = _Recent(self.stays)
        self.packed = _Recent(self.pack, lambda chunk: len(chunk) <= KEPT_CHARS)

    def merged(self, text: str) -> list[str]:
        """The merges themselves, on a short text: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.scores.get
        scores = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != _NEVER:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], _NEVER)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], _NEVER)
        return parts

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text without inner boundaries, by backtracking.

        The longest token that starts at a place is tried first. It may follow the token before only if merging
        both anew gives just these two. A place from which no token fits is marked in the field of failed
        places, and the token before it gives way to the next shorter one.
        """
        n = len(text)
        if n == 1:
            return [text]
        longest = [1] * n
        for last, length in self.trie.iter(text):
            if length > longest[last - length + 1]:
                longest[last - length + 1] = length
        failed = bytearray((n >> 3) + 1)
        found: list[str] = []
        at, length = 0, longest[0]
        while True:
            while length:
                token, stop = text[at : at + length], at + length
                if not failed[stop >> 3] >> (stop & 7) & 1 and (not found or self.fits(found[-1], token)):
                    break
                length = self.shorter[token] if length > 1 else 0
            if length:
                found.append(token)
                at = stop
                if at == n:
                    return found
                length = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = found.pop()
                at -= len(token)
                length = self.shorter[token] if len(token) > 1 else 0

    def fits(self, left: str, right: str) -> bool:
        return left[-1] + right[0] not in self.touching or self.agree[f"{left}\n{right}"]

    def stays(self, pair: str) -> bool:
        """Merging two tokens anew gives the two again."""
        left, right = pair.split("\n")
        return self.merged(left + right) == [left, right]

    def pack(self, chunk: str) -> bytes:
        """The ids of a chunk, 32 bits each; its parts between boundaries are looked up on their own."""
        if not chunk[1:].isalpha():
            parts, start, touching = [], 0, self.touching
            for k in range(1, len(chunk)):
                if chunk[k - 1 : k + 1] not in touching:
                    parts.append(chunk[start:k])
                    start = k
            if parts:
                return b"".join(map(self.packed.__getitem__, [*parts, chunk[start:]]))
        found = []
        for token in self.tokens(chunk):
            number = self.ids.get(token)
            found += [number] if number is not None else [self.byte_ids[b] for b in token.encode()]
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: str) -> bytes:
        """Ids of a text with begin and end, as little-endian unsigned 32-bit integers."""
        chunks = _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return b"".join((self.begin, *map(self.packed.__getitem__, chunks), self.end))


codecs.register_error("each-invalid-byte", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    """Read once in a worker."""
    return Pieces(model)


@lru_cache(maxsize=2)
def _printer(model: bytes) -> Printer:
    return Printer(model)


def _encoded(texts: Iterable[bytes | None], model: bytes) -> list[pa.Array]:
    pieces = _pieces(model)
    ids = [pieces.encode(t.decode() if t else "") for t in texts]
    return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``row`` (all columns of docs) and ``found``: n_tokens and the packed ids of each whole text.

    ``model`` is the path of a model file that the driver can read; its bytes (some hundred kilobytes) go
    out with the job. Texts are cut where no piece of the vocabulary crosses, so a very long text is worked
    on in short chunks, and ids of frequent chunks are kept in bounded number. Null and empty texts have the
    begin and end ids only; rows that repeat are encoded each; other columns pass through, whatever their names.
    """
    with open(model, "rb") as file:
        data = file.read()
    return map_texts(docs, lambda texts: _encoded(texts, data), FOUND)


def decode(ids: Column, model: str) -> Column:
    """The texts of packed ids; null for null."""
    with open(model, "rb") as file:
        data = file.read()

    @F.pandas_udf("string")
    def texts(packed):
        printer = _printer(data)
        return packed.map(lambda i: None if i is None else printer.decode(i))

    return texts(ids)


def op12_sentence_pieces(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode(docs, model).select("row.doc_id", "found.n_tokens", "found.ids")
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), model), 256).alias("decoded_sha256"))
