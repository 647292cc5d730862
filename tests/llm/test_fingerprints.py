"""Fingerprints and likenesses against a plain Python version, and what positional matching must tell apart."""

from __future__ import annotations

import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from rowloom.llm import fingerprints

SIZE = fingerprints.SIZE


def _signed(n):
    return n - (1 << 64) if n >> 63 else n


def _anchors(text):
    hashes = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    reach = min(len(hashes), SIZE)
    found = []
    for at in range(len(hashes) - reach + 1 if hashes else 0):
        own = hashes[at : at + reach]
        if len(hashes) < SIZE or min(own[0], own[-1]) <= min(own[1:-1]):
            digest = 42
            for h in own:
                digest = xxhash.xxh64_intdigest((h % (1 << 64)).to_bytes(8, "little"), digest)
            found.append((at, digest >> 36))
    return found


def _fingerprint(text):
    last, out = 0, []
    for at, digest in _anchors(text):
        out.append(f"{(at - last) << 28 | digest:08x}")
        last = at
    return "".join(out)


def _likeness(one, two):
    a, b = [h for _, h in _anchors(one)], [h for _, h in _anchors(two)]
    if not a and not b:
        return 1.0
    if _fingerprint(one) == _fingerprint(two):
        return 1.0
    both = sorted([(h, i, 0) for i, h in enumerate(a)] + [(h, i, 1) for i, h in enumerate(b)])
    apart = Counter((y[1] - x[1]) * (1 if x[2] == 0 else -1) for x, y in zip(both, both[1:], strict=False) if x[0] == y[0] and x[2] != y[2])
    return max(apart.values(), default=0) / max(len(a), len(b))


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_equals_the_plain_version(spark):
    rng = random.Random(1)
    line = _words(rng, 15)
    texts = [_words(rng, rng.randint(0, 90)) for _ in range(40)] + ["", None, "one", "a b c", "a a a a a a a", "\n\t ", "x " * 500, f"{line}\n" * 30, _words(rng, 4000)]
    texts += [texts[3], texts[3]]
    rows = [(f"id{i:03}", t, "x", i) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id string, text string, own string, next long")).collect()}
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        after, r = plain[(i + 1) % len(plain)], got[f"id{i:03}"]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert r.fingerprint == _fingerprint(text) and r.edited_fingerprint == _fingerprint(edited)
        assert abs(r.near_edited - _likeness(text, edited)) < 1e-12 and abs(r.near_next - _likeness(text, after)) < 1e-12


def test_gaps_are_short():
    rng = random.Random(2)
    for n in (4, 5, 50, 3000):
        places = [at for at, _ in _anchors(_words(rng, n))]
        assert places and places[0] < SIZE and all(0 < b - a < SIZE for a, b in zip(places, places[1:], strict=False))


def _near(spark, one, two):
    df = spark.createDataFrame([(one, two)], "one string, two string")
    both = fingerprints.with_anchors(fingerprints.with_anchors(df, "one", "a"), "two", "b")
    return fingerprints.with_likeness(both, "a", "b", "near").first()["near"]


def test_long_texts_and_order_are_told_apart(spark):
    rng = random.Random(3)
    long = _words(rng, 20_000).split()
    texts = [" ".join([*long[: 900 * k], "other", *long[900 * k + 1 :]]) for k in range(1, 21)]
    df = fingerprints.with_anchors(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "a")
    assert df.select(fingerprints.digits(F.col("a"))).distinct().count() == 20
    assert 0.99 < _near(spark, texts[0], texts[1]) < 1
    parts = [_words(rng, 60) for _ in range(6)]
    assert _near(spark, "\n".join(parts), "\n".join(parts[::-1])) < 0.3
    assert _near(spark, "\n".join(parts), "added words here before\n" + "\n".join(parts)) > 0.9
