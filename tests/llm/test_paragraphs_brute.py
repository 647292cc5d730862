"""Paragraph dedup against a brute force over all lines, sentences and runs, and the recall of its bands."""

from __future__ import annotations

import random
import re

from rowloom.llm import paragraphs
from rowloom.llm.similar_sets import shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _units(data):
    """(first word, last word + 1, is a line) of lines of 20 words and sentences of 12."""
    words = [m.span() for m in WORD.finditer(data)]
    found, line, sentence = [], 0, 0
    for k, (_, stop) in enumerate(words):
        ends_line = k + 1 == len(words) or b"\n" in data[stop : words[k + 1][0]]
        if ends_line or data[stop - 1 : stop] in (b".", b"!", b"?"):
            if k + 1 - sentence >= 12:
                found.append((sentence, k + 1, False))
            sentence = k + 1
        if ends_line:
            if k + 1 - line >= 20:
                found.append((line, k + 1, True))
            line = k + 1
    return words, found


def _brute(rows):
    units, spans = [], {}
    for doc, text in rows:
        data = (text or "").encode()
        words, found = _units(data)
        low = [data[a:b].lower() for a, b in words]
        spans[doc] = (data, words, low)
        units += [(doc, words[a][0], words[b - 1][1], tuple(low[a:b]), line) for a, b, line in found]
    units = sorted(set(units), key=lambda u: u[:3])
    label = list(range(len(units)))

    def join(i, j):
        if label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label[:] = [low if x == high else x for x in label]

    grams = [{u[3][i : i + 5] for i in range(max(1, len(u[3]) - 4))} for u in units]
    for i, u in enumerate(units):
        for j in range(i):
            if u[3] == units[j][3]:
                join(i, j)
            elif u[4] and units[j][4]:
                both = len(grams[i] & grams[j])
                if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                    join(i, j)
    cut = {doc: set() for doc, _ in rows}
    for i, u in enumerate(units):
        if units[label[i]][:3] != u[:3]:
            cut[u[0]].update(range(u[1], u[2]))
    first = {}
    for doc, _ in sorted(rows, key=lambda r: r[0]):
        data, words, low = spans[doc]
        for at in range(len(words) - paragraphs.RUN + 1):
            run = tuple(low[at : at + paragraphs.RUN])
            keeper = first.setdefault(run, (doc, at))
            if keeper != (doc, at):
                start = max(at, keeper[1] + paragraphs.RUN) if keeper[0] == doc else at
                if start < at + paragraphs.RUN:
                    cut[doc].update(range(words[start][0], words[at + paragraphs.RUN - 1][1]))
    return {doc: bytes(c for k, c in enumerate(spans[doc][0]) if k not in cut[doc]).decode() for doc, _ in rows}


def _rows():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7)))
    words = lambda n: [word() for _ in range(n)]
    lines = [" ".join(words(rng.choice((25, 60, 130)))) + "." for _ in range(30)]
    sentences = [" ".join(words(rng.choice((8, 13, 30)))) + rng.choice(".!?") for _ in range(12)]
    passages = [" ".join(words(70)) for _ in range(5)]
    rows = []
    for doc in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            line = rng.choice(lines)
            if kind < 0.3:
                parts.append(line)
            elif kind < 0.5:  # one word in a long line changed: a Jaccard above 0.9
                changed = line.split()
                if len(changed) > 100:
                    changed[50] = word()
                parts.append(" ".join(changed))
            elif kind < 0.65:
                parts.append(f"{' '.join(words(15))}. {rng.choice(sentences)} {rng.choice(sentences)} {' '.join(words(15))}")
            elif kind < 0.8:
                parts.append(f"{' '.join(words(9))} {rng.choice(passages)} {' '.join(words(9))}")
            else:
                parts.append(" ".join(words(rng.randint(1, 40))).upper())
        rows.append((doc, "\n".join(parts)))
    repeat = " ".join(words(5)) + " "
    return [*rows, (60, ""), (61, None), (62, rows[3][1]), (63, repeat * 40), (64, "x " + repeat * 30)]


def test_equals_brute_force(spark, monkeypatch):
    rows = _rows()
    want = _brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for cell in (paragraphs.CELL, 200):
        monkeypatch.setattr(paragraphs, "CELL", cell)
        got = {r.row.doc_id: r.kept for r in paragraphs.deduped(docs).collect()}
        assert {d: t or "" for d, t in got.items()} == want and got[61] is None
    as_text = docs.selectExpr("cast(doc_id + 100 as string) as doc_id", "text")
    assert {int(r.row.doc_id) - 100: r.kept or "" for r in paragraphs.deduped(as_text).collect()} == want


def test_recall_of_the_bands():
    """Paragraph pairs at a Jaccard just above 0.8 share a band key nearly always."""
    rng = random.Random(22)
    hits = pairs = 0
    for _ in range(400):
        one = [str(rng.randint(0, 10**9)) for _ in range(rng.randint(40, 200))]
        two = list(one)
        for k in range(len(one) * 2 // 100):
            two[(k * 37 + 11) % len(one)] = "changed" + str(k)
        a, b = (set(shingles(" ".join(x).encode()).tolist()) for x in (one, two))
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            pairs += 1
            keys = [set(paragraphs.units(" ".join(x).encode())[0][4]) for x in (one, two)]
            hits += bool(keys[0] & keys[1])
    assert pairs > 100 and hits / pairs > 0.98
