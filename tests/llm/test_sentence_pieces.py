"""Own encoding and decoding against the library, on random and awkward texts."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rowloom.llm import sentence_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def pieces(model):
    return sentence_pieces.Pieces(model)


@pytest.fixture(scope="module")
def printer(model):
    return sentence_pieces.Printer(model)


def _texts():
    rng = random.Random(4)
    pool = ["th", "e", "er", "in", " ", "  ", "    ", "▁", "\n", "\t", "é", "中", "日", "\0", "😀", "<s>", "<0x0A>", "(", "0", "1", ".", "Ä", "▁▁", "x"]
    yield from ("", " ", "   ", "a", " a", "a ", "▁", "\n\n", "<unk>", "�", "é")
    yield from (" " * n for n in range(70))
    yield from (" " * n + "the" for n in range(40))
    for _ in range(4000):
        yield "".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))
    for _ in range(4000):
        yield "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 60)))
    yield "theon" * 30_000
    yield "日本" * 5_000 + " " * 5_000


def test_ids_and_texts_equal_the_library(library, pieces, printer):
    for text in _texts():
        want = library.encode(text, add_bos=True, add_eos=True)
        ids = pieces.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert printer.decode(ids) == library.decode(want)


def test_any_ids_decode_as_the_library_does(library, printer):
    rng = random.Random(6)
    for _ in range(4000):
        ids = [rng.choice([rng.randint(0, 258), rng.randint(0, 31999), 259, 260, 28705]) for _ in range(rng.randint(0, 8))]
        assert printer.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def test_kept_chunks_change_nothing(library, model, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KEPT", 3)
    small = sentence_pieces.Pieces(model)
    text = "the other one and the other two, and so on to the other end " * 3
    ids = small.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_bos=True, add_eos=True)
    assert len(small.packed) <= 3 and len(small.packed.older) <= 3


def test_rows(spark, library):
    texts = [None, "", "one two", "one two", "é" * 5000, " \n "]
    rows = [(i, t, "x", i, None) for i, t in enumerate(texts)] + [(None, "null id", "x", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, ids long, found string")
    made = sentence_pieces.encode(docs, MODEL)
    got = made.select("row.*", F.col("found.ids").alias("packed"), sentence_pieces.decode(F.col("found.ids"), MODEL).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r.packed == struct.pack(f"<{len(want)}I", *want) and r.back == library.decode(want)
    assert sentence_pieces.encode(docs.where("false"), MODEL).count() == 0


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sentence_pieces.op12_sentence_pieces(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
