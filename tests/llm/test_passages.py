"""Repeated passages that no line or sentence shows."""

from __future__ import annotations

import random

from rowloom.llm import paragraphs


def _words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


def test_passages_without_marks_or_long_lines(spark):
    rng = random.Random(4)
    plain, short, wrapped, two = (_words(rng, n) for n in (51, 55, 60, 130))
    forms = [
        " ".join(plain),
        " ".join(w + "." if k % 5 == 4 else w for k, w in enumerate(short)),
        "".join(w + ("\n" if k % 6 == 5 else " ") for k, w in enumerate(wrapped)).strip(),
    ]
    rows = []
    for k, form in enumerate(forms):
        rows += [(10 * k + i, " ".join(_words(rng, 40)) + " " + form + " " + " ".join(_words(rng, 40))) for i in range(3)]
    rows += [(50, " ".join(two[:70])), (51, " ".join(two)), (52, " ".join(_words(rng, 9) + two[60:] + _words(rng, 9)))]
    rows += [(60, " ".join(["z"] * 500)), (61, " ".join([*_words(rng, 8), *plain[:50], *_words(rng, 8)])), (62, None), (63, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.row.doc_id: r for r in paragraphs.deduped(docs).collect()}
    assert len(found) == len(rows)
    for k, form in enumerate(forms):
        assert found[10 * k].n_removed == 0
        for i in (1, 2):
            r = found[10 * k + i]
            assert (r.n_removed, r.n_spans, r.kept_in) == (len(form), 1, [10 * k]) and form not in r.kept
    assert found[50].n_removed == 0 and found[51].kept.strip() == " ".join(two[70:]) and found[51].kept_in == [50]
    assert found[52].n_removed == len(" ".join(two[60:])) and found[52].kept_in == [51]
    assert found[60].kept.split() == ["z"] * 51
    assert found[61].n_removed == 0 and found[62].kept is None and found[63].kept == ""
