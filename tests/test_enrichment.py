"""Lines of model answers put together from chunks."""

import json

from rowloom.operators import enrichment


def test_lines_not_chunks_meet_their_request(spark, monkeypatch):
    sizes = []
    lookup = enrichment.lookup
    monkeypatch.setattr(enrichment, "lookup", lambda left, *rest: sizes.append(left.count()) or lookup(left, *rest))
    texts = {1: "one two\nthree", 2: "", 3: "\na b c d\n\ne", 4: "x"}
    chunks = [(r, i, json.dumps({"response": c})) for r, text in texts.items() for i, c in enumerate([*text] or [""])]
    got = enrichment.rebuild_lines(spark.createDataFrame(chunks, "request_id long, seq long, line string")).collect()
    want = {(r, i, x) for r, text in texts.items() for i, x in enumerate(text.split("\n"))}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and sizes == [len(want)]
