"""Fill-in-middle against a plain version on whole strings, with frames so small that everything crosses them."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from rowloom.llm import fill_in_middle
from rowloom.llm.fill_in_middle import Frames, restored, transformed

SCHEMA = "doc_id long, text string, row string, found string, beside string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plainly(doc, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, _sha(text), _sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc, n, "spm", a, b - a, _sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), _sha(text)
    return doc, n, "psm", a, b - a, _sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), _sha(text)


def _rows():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aé中😀 <>PSM\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "<", "<P", "P>", "<P>", "x<S>y", "a<M>", "<<<", "S>M>P>", "é" * 200_000, "<" * 100_000, "word " * 50_000 + "<M>"]
    rows = [(i, t, "r", "f", "b") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "a text without an id", None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("size", [fill_in_middle.FRAME_BYTES, 7])
def test_equals_the_plain_version(spark, monkeypatch, size):
    rows = [r for r in _rows() if size > 7 or len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if size == 7:
        monkeypatch.setattr(Frames.of.__func__, "__defaults__", (7,))
        got = []
        for doc, text, *_ in rows:
            digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
            n, form, a, b, frames, ends = (x.to_pylist()[0] for x in fill_in_middle._made([None if text is None else text.encode()], [digest]))
            output = Frames(frames, ends)
            assert len(frames) <= 1 or len(frames) >= len(output) / 10
            sums = [hashlib.sha256(b"".join(p)).hexdigest() for p in (output.stream(), restored(output, form))]
            got.append((doc, n, form, a, b, *sums))
    else:
        made = fill_in_middle.transform(docs)
        got = [
            tuple(r)
            for r in made.select("row.doc_id", "found.n", "found.form", "found.prefix_chars", "found.middle_chars", fill_in_middle.digests(made["found"]).alias("s"))
            .select("doc_id", "n", "form", "prefix_chars", "middle_chars", "s.output_sha256", "s.restored_sha256").collect()
        ]
    assert Counter(got) == Counter(_plainly(doc, text) for doc, text, *_ in rows)
    assert {"plain", "psm", "spm"} == {g[2] for g in got}


def test_only_cut_frames_are_opened():
    text = "abcdefgé" * 100
    stored = Frames.of((text.encode(),), 64)
    stored.frames[0] = stored.frames[-1] = b"not a frame"
    assert b"".join(stored.stream(100, 600)).decode() == text[100:600]
    assert list(stored.stream(5, 5)) == [] and len(stored) == len(text)


def test_marks_across_frames():
    text = "ab<" * 9 + "P>"
    stored = Frames.of((text.encode(),), 4)
    assert fill_in_middle.holds(stored) and not fill_in_middle.holds(Frames.of((b"<P><S><M>"[1:3],), 1))
    plain = Frames.of(("<<P<S" * 5).encode() for _ in range(1))
    for form in ("psm", "spm"):
        for low in range(0, 26, 3):
            for high in range(low, 26, 4):
                output = Frames.of(transformed(plain, form, low, high), 5)
                assert b"".join(restored(output, form)) == ("<<P<S" * 5).encode()


def test_empty_table(spark):
    assert fill_in_middle.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in fill_in_middle.op13_fill_in_middle(spark, sf_dir).collect()]
    assert sorted(got) == sorted(_plainly(r.doc_id, r.text) for r in rows)
