"""The corpus pipeline: each stage's decisions on its own input."""

from __future__ import annotations

import corpus_pipeline
from rowloom.llm import decontamination, mixing, toxicity


def _one_of_each(texts):
    """The least id of each group that pairs with a Jaccard of 0.8 over 5-word shingles connect, by brute force."""
    words = {d: (t or "").lower().split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    label, order = {}, sorted(sets)
    for k, d in enumerate(order):
        label[d] = d
        for e in order[:k]:
            both = len(sets[d] & sets[e])
            if both >= 0.8 * (len(sets[d]) + len(sets[e]) - both) and label[d] != label[e]:
                low, high = sorted((label[d], label[e]))
                label = {x: low if c == high else c for x, c in label.items()}
    return set(label.values())


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["toxicity", "line", "simhash", "benchmark", "mixing"]
    stages = dict(corpus_pipeline.STAGES)
    mild = stages["toxicity"](spark, docs, sf_dir)
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.row.doc_id for r in scored.where("found.toxic >= 0.5").collect()}
    assert {r.doc_id for r in mild.collect()} == {r.doc_id for r in docs.collect()} - rejected
    assert mild.columns == docs.columns
    single = {r.doc_id for r in stages["simhash near-dedup"](spark, docs, sf_dir).collect()}
    assert single == _one_of_each({r.doc_id: r.text for r in docs.collect()})
    clean = stages["benchmark decontamination"](spark, docs, sf_dir)
    found = decontamination.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert clean.count() == found.where(~decontamination.contaminated()).count() and clean.columns == docs.columns
    taken = {r.doc_id: r.copies for r in mixing.mixed(docs).collect() if r.copies}
    mixed = stages["mixing sources to target weights"](spark, docs, sf_dir).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == taken


def test_run_writes_every_stage(spark, sf_dir):
    first, again = (sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert first and first == again
