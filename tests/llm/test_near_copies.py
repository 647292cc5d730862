"""Near copies against brute-force Jaccard over 5-word shingles."""

from __future__ import annotations

import random

import pytest

from rowloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, found string"


def _grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _first(rows):
    """The rows that brute force keeps; rows are (doc_id, text) with different ids."""
    sets = [_grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == c) for c in set(label)}


def _rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [None, "", " \n", "two words", "Two  WORDS", "two words more"]
    for _ in range(40):
        base = [word() for _ in range(rng.choice((30, 120, 400)))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05):  # the last ones are mostly below the limit
            changed = [word() if rng.random() < share else w for w in base]
            texts.append(" ".join(changed))
    # A chain: each links with its neighbours only.
    base = [word() for _ in range(100)]
    for k in range(8):
        texts.append(" ".join(base[k * 9 :] + [word() for _ in range(0)] + [f"tail{i}" for i in range(k * 9)]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("cell", [near_copies.CELL, 300])
def test_stage_equals_brute_force_jaccard(spark, monkeypatch, cell):
    monkeypatch.setattr(near_copies, "CELL", cell)
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id for r in kept.collect()}
    assert got == _first(rows)
    by_simhash = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got < by_simhash  # what three bits of 3-word shingles leave


def test_bit_planes_equal_counted_bits():
    import numpy as np

    from rowloom.llm import bit_planes

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, (700, bit_planes.PARTS)).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.integers(0, 256, rng.integers(0, 150)):
            b[i, k >> 6] ^= np.uint64(1) << np.uint64(k & 63)
    for radius in (0, 5, 75, 127):
        assert (bit_planes.pairs_within(a, b, radius) == (np.bitwise_count(a ^ b).sum(axis=1) <= radius)).all()
        apart = np.bitwise_count(b[:90, None, :] ^ a[None]).sum(axis=2)
        assert (bit_planes.rows_within(b[:90], a, radius) == (apart <= radius)).all()


def test_similar_sets_are_never_sifted_out():
    import numpy as np

    from rowloom.llm import bit_planes

    rng = np.random.default_rng(1)
    most = 0
    for _ in range(2000):
        union = rng.integers(0, 1 << 63, int(rng.integers(80, 400))).astype(np.uint64)
        both = int(np.ceil(0.8 * len(union)))
        cut = int(rng.integers(both, len(union) + 1))
        one, two = bit_planes.words([bit_planes.fingerprint(s) for s in (union[:cut], np.concatenate((union[:both], union[cut:])))])
        most = max(most, int(np.bitwise_count(one ^ two).sum()))
    assert most <= bit_planes.RADIUS - 10


def test_ids_may_be_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    near = " ".join(base[:100] + ["other"] + base[101:])
    rows = [("x", near), ("m", " ".join(base)), (None, " ".join(base)), ("z", "something else entirely")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {r.doc_id for r in kept.collect()} == {"m", "z"}


@pytest.mark.parametrize("file", [40, 12])
def test_files_of_simhash_bits_bring_up_every_near_copy(spark, monkeypatch, file):
    monkeypatch.setattr(near_copies, "FILE", file)
    rows = _rows()
    places = near_copies.samples(len(rows))
    assert len(places) > 1 and near_copies.missed(len(places[0]), len(places)) <= near_copies.MISS
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == _first(rows)


def test_groups_within_a_file_equal_counted_bits():
    import numpy as np

    from rowloom.llm import bit_planes

    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, (700, bit_planes.PARTS)).astype(np.uint64)
    for i, j in rng.integers(0, len(fps), (200, 2)):
        fps[i] = fps[j]
        for k in rng.integers(0, 256, rng.integers(0, 110)):
            fps[i, k >> 6] ^= np.uint64(1) << np.uint64(k & 63)
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= bit_planes.RADIUS
    want = np.arange(len(fps))
    while True:
        least = np.where(near, want[None, :], len(fps)).min(axis=1)
        if (least == want).all():
            break
        want = least
    assert (bit_planes.groups_within(fps) == want).all()
