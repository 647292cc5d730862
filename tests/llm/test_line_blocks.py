"""Blocks that patience diff alone does not align."""

from __future__ import annotations

import random

from rowloom.llm import line_dedup


def test_repeated_and_reordered_blocks_go(spark):
    rng = random.Random(6)

    def line(n=12):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    block, other = [line(), line(2)], [line(), line(), line()]
    docs = [
        [line(), *block, line(), *block, line()],  # holds it twice
        [line(), *block, line()],
        [line(), *block, line(), *block, line()],
        [line(), *other, line(), *block, line(), line(1)],
        [line(), *block, line(), *other, line()],  # in another order
        [line(), line(2), line()],
    ]
    rows = [(i, "\n".join(d)) for i, d in enumerate(docs)]
    found = {r.row.doc_id: r for r in line_dedup.deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    shared = [set(), set(block), set(block), set(block), set(block + other), set()]
    for i, d in enumerate(docs):
        assert found[i].kept == "\n".join(x for x in d if x not in shared[i])


def _brute(a, b, words, least=line_dedup.MIN_WORDS):
    """Every line of b in some block of a with so many words."""
    blocks = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    return {
        p for i in range(len(b)) for j in range(i + 1, len(b) + 1) if sum(words[i:j]) >= least and tuple(b[i:j]) in blocks for p in range(i, j)
    }


def test_no_line_stays_in_a_block_that_the_earlier_document_holds():
    rng = random.Random(12)
    for _ in range(600):
        size = {k: rng.randint(0, 6) for k in range(9)}
        a, b = ([rng.randint(0, 8) for _ in range(rng.randint(0, 16))] for _ in range(2))
        if rng.random() < 0.6:
            b = b[:5] + a[rng.randint(0, 6) :] + b[5:] + a[:4]
        words = [size[x] for x in b]
        total = [sum(words[:k]) for k in range(len(b) + 1)]
        lines = {p for _, j, n in line_dedup.patience(a, b) if total[j + n] - total[j] >= line_dedup.MIN_WORDS for p in range(j, j + n)}
        assert lines | line_dedup.left_over(a, b, total, lines) == _brute(a, b, words)


def test_repetitive_logs_cost_linear_time():
    import time

    a = [k % 7 for k in range(60_000)] + list(range(100, 2000))
    b = [k % 7 for k in range(3, 60_003)]
    began = time.perf_counter()
    assert line_dedup.longest_matches(a, b)[-1] > 50_000
    assert line_dedup.left_over(a, b, list(range(len(b) + 1)), set()) == set(range(len(b)))
    assert time.perf_counter() - began < 10


def test_near_copies_go_whole_and_ids_may_be_texts(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(14)] for _ in range(30)]
    near = [list(line) for line in base]
    for k in (3, 14, 25):
        near[k][7] = word()
    half = [list(line) if k < 12 else [word() for _ in range(14)] for k, line in enumerate(base)]
    text = lambda lines: "\n".join(" ".join(x) for x in lines)
    rows = [("a", text(base), 1), ("b", text(near), 2), ("c", text(half), 3), ("d", text(base), 4), (None, None, 5), ("e", "", 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, code long")
    kept = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert set(kept) == {"a", "c", None, "e"} and kept["a"].text == text(base)
    assert kept["c"].text == text(half[12:])
    assert {r.row.doc_id for r in line_dedup.deduped(docs).collect()} == {"a", "b", "c", "d", None, "e"}


def test_only_texts_that_lose_lines_go_to_python(spark, monkeypatch):
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def strict(text, gone):
        assert text.is_valid().equals(gone.is_valid())
        return text

    monkeypatch.setattr(line_dedup, "_without", strict)
    line = " ".join(f"word{k}" for k in range(12))
    docs = spark.createDataFrame([(1, line), (2, f"{line}\nother"), (3, "other"), (4, None)], "doc_id long, text string")
    assert {r.row.doc_id: r.n_removed for r in line_dedup.deduped(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
