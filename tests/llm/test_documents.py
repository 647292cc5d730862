"""Corpus operators against brute force, on small fixtures with every awkward kind of row."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import pytest
import xxhash
from pyspark.sql import functions as F

from rowloom.llm import decontamination, fingerprints, language, line_dedup, mixing, paragraphs, simhash, suffix_index, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, found string"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgho") for _ in range(rng.randint(1, 8))) for _ in range(n))


def _rows():
    """Plain, null, empty, blank, tied, repeated, copied, near-copied and long texts; extra columns that clash."""
    rng = random.Random(5)
    base = [_words(rng, 60) + ".\n" + _words(rng, 45) + ".\n" + _words(rng, 30) + "." for _ in range(12)]
    texts = [*base, base[0], base[1], None, "", " \t\n ", "one", "ÄÖ ü", base[2] + " more words at the end", "?! 12 34"]
    texts.append(_words(rng, 20_000))
    texts.append(base[3].split("\n")[0] + "\n" + _words(rng, 50) + ".\n" + base[4].split("\n")[1])
    texts += ["É" * 450, "aaaa" * 120]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None, len(t or ""), "x", i, None) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[4], (None, base[5], None, "s0", 1, None, None, "y"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(rows):
    return sorted(map(repr, rows))


def test_simhash_equals_brute_force(docs):
    def marked(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashed = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed)) if hashed else 0

    rows = [(r.doc_id, marked(r.text)) for r in docs.collect()]
    component = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3 and component[i] != component[j]:
                component = [component[j] if c == component[i] else c for c in component]
    least = {}
    for (doc, _), c in zip(rows, component, strict=True):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    want = [(d, f"{fp:016x}", least.get(c)) for (d, fp), c in zip(rows, component, strict=True)]
    assert _sorted(map(tuple, simhash.near_duplicates(docs).collect())) == _sorted(want)


def test_bit_planes_find_all_pairs_and_cells_keep_links(spark, monkeypatch):
    import numpy as np

    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps for _ in range(2)]
    fps = sorted(set(fps))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}
    i, j = simhash.within(np.array(fps, np.uint64), np.zeros(len(fps), np.int64))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    monkeypatch.setattr(simhash, "CELL", 4)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fingerprint long")).collect()
    assert _groups(len(fps), want) == _groups(len(fps), {(signed.index(e.a), signed.index(e.b)) for e in edges})


def _groups(n, pairs):
    label = list(range(n))
    for i, j in pairs:
        a, b = label[i], label[j]
        if a != b:
            label = [b if x == a else x for x in label]
    return sorted(sorted(k for k in range(n) if label[k] == c) for c in set(label))


@pytest.mark.parametrize("group", [2000, 1])
def test_repeated_strings_equal_brute_force(docs, monkeypatch, group):
    monkeypatch.setattr(suffix_index, "GROUP", group)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(d[j : j + 200] for _, d in rows for j in range(len(d) - 199))
    want = []
    for doc, data in rows:
        gone = bytearray(len(data))
        for j in range(len(data) - 199):
            if seen[data[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert _sorted(map(tuple, suffix_index.remove_repeats(docs).collect())) == _sorted(want)


def test_fingerprints(docs):
    rows = docs.select("doc_id", "text").distinct().where("doc_id is not null").collect()
    texts = dict(sorted((r.doc_id, r.text or "") for r in rows))
    ids = sorted(texts)
    found = {r.doc_id: r for r in fingerprints.fingerprints(docs.where("doc_id is not null")).collect()}
    for k, doc in enumerate(ids):
        text, after = texts[doc], texts[ids[(k + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert found[doc].n_chars == len(text)
        assert found[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[doc].near_edited <= 1 and 0 <= found[doc].near_next <= 1
    assert found[0].fingerprint == found[12].fingerprint
    assert found[5].near_edited > 0.3 > found[5].near_next
    assert fingerprints.fingerprints(docs).count() == docs.count()


def test_syncmers_depend_on_their_words_only(spark):
    words = [random.Random(k).randint(-9, 9) for k in range(60)]
    df = spark.createDataFrame([(words,), (words[17:],)], "h array<long>")
    one, two = (r[0] for r in df.select(fingerprints.syncmers(F.col("h"))).collect())
    want = [i for i in range(57) if min(words[i], words[i + 3]) <= min(words[i + 1 : i + 3])]
    assert [a["at"] for a in one] == want
    assert [a["at"] + 17 for a in two] == [i for i in want if i >= 17]


def test_decontamination(docs, spark):
    rng = random.Random(3)
    long = _words(rng, 40)
    items = [(1, long), (2, "Short item"), (3, None), (4, ""), (10, long.upper()), (None, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    more = [(100, "x1 x2 " + " ".join(long.split()[3:20]) + " tail", 0), (101, "a short, ITEM! indeed", 0), (102, " ".join(["z"] * 500) + " short item", 0)]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, n_chars long"), allowMissingColumns=True)
    for block in (1 << 20, 10):
        found = {r.row.doc_id: r.found for r in decontamination.hits(both, benchmark, block_bytes=block).collect()}
        assert (found[100].n_hit, found[100].items) == (17, ["1", "10"])
        assert (found[101].n_hit, found[101].items) == (2, ["2"])
        assert found[102].n_hit == 2 and found[17].items == [""]
        assert found[0].n_hit == 0 and found[14].n_words == 0
    kept = {r.doc_id: r.text for r in decontamination.decontaminate(both, benchmark).collect()}
    assert 100 not in kept and 101 not in kept and kept[0] == _rows()[0][1]
    assert kept[102].endswith("z ")


def test_patience_blocks():
    assert line_dedup.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(0, 0, 4)]
    assert line_dedup.patience([9, 1, 2, 8], [1, 2, 7]) == [(1, 0, 2)]
    assert line_dedup.patience([], [1]) == []
    assert line_dedup.patience([5, 1, 5, 2, 5], [1, 6, 2]) == [(1, 0, 1), (3, 2, 1)]


def test_line_dedup(docs):
    rows = {(r.row.doc_id, r.row.text): r for r in line_dedup.deduped(docs).collect()}
    by_id = {k[0]: r for k, r in rows.items()}
    texts = {k[0]: k[1] for k in rows}
    assert by_id[0].n_removed == 0 and by_id[12].n_removed == 3 and by_id[12].kept == ""
    assert by_id[14].kept is None and by_id[15].kept == "" and by_id[14].n_lines == 0
    lines = texts[22].split("\n")
    assert by_id[22].n_removed == 2 and by_id[22].kept == lines[1]
    kept = line_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert {12, 13} & {r.doc_id for r in kept.collect()} == set()
    assert kept.where("doc_id = 0").count() == 2


def test_paragraph_dedup(docs, spark, monkeypatch):
    for cell in (500, 2):
        monkeypatch.setattr(paragraphs, "CELL", cell)
        found = {r.row.doc_id: r for r in paragraphs.deduped(docs.where("doc_id is not null")).collect()}
        assert found[0].n_removed == 0 and found[12].kept.strip() == "" and found[12].kept_in == [0]
        assert found[14].kept is None and found[19].kept_in == [2]
        assert set(found[22].kept_in) == {3, 4} and found[7].n_removed == 0
    rng = random.Random(9)
    passage = ". ".join(_words(rng, 14) for _ in range(5)) + "."
    made = [(i, f"{_words(rng, 30)} {passage} {_words(rng, 30)}") for i in range(2)]
    near = _words(rng, 60).split()
    made += [(5, " ".join(near)), (6, " ".join([*near[:30], "changed", *near[31:]]))]
    found = {r.row.doc_id: r for r in paragraphs.deduped(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert found[1].n_removed > 100 and found[1].kept_in == [0]
    assert found[6].n_removed == len(made[3][1]) and found[6].kept_in == [5] and found[5].n_removed == 0


def test_language(docs, spark):
    en, fr = "the quick brown fox jumps over lazy dogs", "le vif renard brun saute par dessus les chiens"
    rows = [(i, f"{en if i % 2 else fr} {i}", "en" if i % 2 else "fr") for i in range(40)]
    filters = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.languages == ["en", "fr"]
    assert filters.predict(b"lazy brown dogs")[0] == "en" and filters.predict("les chiens".encode())[0] == "fr"
    assert filters.predict(b"12 ?!") == ("und", 0.0) == filters.predict(None) == filters.predict(b"")
    assert language.identify(docs, filters).count() == docs.count()
    many = [(f"{chr(97 + k // 10)}{chr(97 + k % 10)}word " * 5, f"l{k:02}") for k in range(70) for _ in range(3)]
    wide = language.train(spark.createDataFrame(many, "text string, lang string"))
    assert wide.masks.shape[1] == 2 and wide.predict(b"gjword gjword")[0] == "l69"
    none = language.train(docs.where("false").select("text", "lang"))
    assert none.predict(b"word") == ("und", 0.0)
    ids = spark.createDataFrame([(None,), (1,), (2,), (7,)], "doc_id long").select("doc_id", language.held_out(F.col("doc_id"))).collect()
    assert [r[1] for r in ids] == [False if r[0] is None else crc32(str(r[0]).encode()) % 3 == 1 for r in ids]


def test_language_held_out_accuracy(spark, sf_dir):
    found = language.op3_language_id(spark, sf_dir.replace("0.001", "0.01")).where("held_out")
    truth = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    assert found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_toxicity(docs, spark):
    rng = random.Random(2)
    rows = [(i, _words(rng, 40) + (" vile scum" if i % 4 == 0 else "")) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, 160)] + [(7, None, None), (None, 1, 1), (999, 0, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.row.doc_id: r.found for r in toxicity.score(texts, known).collect()}
    assert all((found[i].toxic >= 0.5) == (i % 4 == 0) for i in range(200))
    assert {r.doc_id for r in toxicity.clean(texts, known).collect()} == {i for i in range(200) if i % 4}
    scored = toxicity.score(docs, known.where("false"))
    assert scored.where("found.toxic <> 0 or found.low_quality <> 0").count() == 0 and scored.count() == docs.count()
    assert toxicity.clean(docs, known).columns == docs.columns
    ones = toxicity.score(texts, known.where("toxic = 1"))
    assert ones.where("found.toxic <> 1").count() == 0


def test_urls(spark):
    urls = [
        "http://WWW.Example.com/en/1", "https://example.com/en/x?y=/fr/", "http://a.example.com/de", "http://x.net/es/1#/fr/",
        "http://x.net", "http://net/fr/a", "http://xnet/fr/", "no scheme", None, "", "ftp://b.www.example.com/en/?q", "http://notexample.com/en/",
        "http://h.org?x=://z.net/es/", "x://y://z/p",
    ]
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.judge(pages).collect()}
    rules = dict(url_filter.RULES)
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [r for r in rules if (host.lower() == r.split("/")[0] or host.lower().endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, key=len, default=None)
        assert (found[i].host, found[i].path, found[i].rule) == (host.lower(), path, best)
        assert found[i].verdict == rules[best] if best else found[i].verdict in ("allow", "block")
    own = spark.createDataFrame([("spam.org", "/buy", 1.0), ("good.org", "/read", 0.0)] * 5, "host string, path string, block double")
    judged = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(1, "http://spam.org/buy"), (2, "http://good.org/read")], "page_id long, url string"), own).collect()}
    assert (judged[1].verdict, judged[2].verdict) == ("block", "allow")
    assert url_filter.judge(pages.where("false")).count() == 0


def test_mixing(docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count()
    total = sum({r.source: r.source_size for r in rows}.values())
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert all(r.target <= 2 * r.source_size and r.taken <= 2 * r.size for r in rows)
    for source in targets:
        taken = sum(r.taken for r in rows if r.source == source)
        assert abs(taken - targets[source]) <= max(r.size for r in rows if r.source == source)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert _sorted((r.doc_id, r.size, r.source, r.taken) for r in rows) == _sorted((r.doc_id, r.size, r.source, r.taken) for r in again)
    emitted = mixing.mix(docs)
    assert emitted.columns[:-1] == docs.columns and emitted.where("text is null and n_chars > 0").count() == 0


def test_empty_tables(spark, empty):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).columns == empty.columns
    assert suffix_index.remove_repeats(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert line_dedup.dedup(empty).count() == 0 and paragraphs.deduped(empty).count() == 0
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert toxicity.clean(empty, labels).count() == 0


def test_decontamination_block_by_block_equals_one_block(docs, spark):
    rng = random.Random(31)
    long = [_words(rng, 30) for _ in range(6)]
    items = [(k, t) for k, t in enumerate(long)] + [(10, long[0]), (11, "two words"), (None, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    mixed = [(200 + k, f"x1 {' '.join(long[k].split()[2:20])} x2 {long[(k + 1) % 6]} TWO words, " + " ".join(["é"] * 40), 0) for k in range(6)]
    both = docs.unionByName(spark.createDataFrame(mixed, "doc_id long, text string, n_chars long"), allowMissingColumns=True)
    one, many = (
        sorted((repr(r.row.doc_id), r.found.n_words, r.found.n_hit, r.found["items"], r.found.starts, r.found.stops)
               for r in decontamination.hits(both, benchmark, block_bytes=size).select("row", "found").collect())
        for size in (1 << 20, 100)
    )
    assert one == many and sum(r[2] > 0 for r in one) >= 6
