"""Streamed lines: chunks out of order, late, repeated, and requests that never end."""

from __future__ import annotations

import datetime as dt
import json
import random

import pandas as pd

from rowloom.streaming.line_assembly import LineProcessor, assemble_lines

SCHEMA = "request_id string, seq long, line string, done boolean, ts timestamp"
START = dt.datetime(2024, 1, 1)


def _run(spark, folder, batches, **limits):
    source = folder / "in"
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (assemble_lines(stream, **limits).writeStream.format("parquet").option("path", str(folder / "out")).outputMode("append")
             .option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    out = spark.read.schema("request string, line_no long, text string").parquet(str(folder / "out"))
    return sorted(tuple(r) for r in out.collect()), state


def _row(request, seq, text, minute=0, done=False):
    return request, seq, None if text is None else json.dumps({"response": text}), done, START + dt.timedelta(minutes=minute)


def test_order_repeats_and_flush(spark, tmp_path):
    batches = [
        [_row("a", 2, "e\nthr"), _row("a", 0, "one\nt"), _row("b", 0, "open "), _row("c", 1, "behind\na gap"), _row("d", 0, "x\n", done=True)],
        [_row("a", 1, "wo\n\nmor", 1), _row("a", 0, "one\nt", 1), _row("b", 1, "line\nnext", 1), _row("d", 0, "x\n", 1, True)],
        [_row("a", 4, "!", 2, True), _row("e", 0, None, 2, True)],
        [_row("a", 3, "ee", 3)],
        [_row("z", 0, "later\n", 200)],
        [_row("z", 1, "end", 500, True)],
    ]
    got, state = _run(spark, tmp_path, batches)
    assert got == [
        ("a", 0, "one"), ("a", 1, "two"), ("a", 2, ""), ("a", 3, "more"), ("a", 4, "three!"),
        ("b", 0, "open line"), ("b", 1, "next"), ("c", 0, "behind"), ("c", 1, "a gap"), ("d", 0, "x"), ("z", 0, "later"), ("z", 1, "end"),
    ]
    assert state <= 2  # what is finished or quiet is forgotten; the newest request alone may still be marked


def test_random_orders_equal_the_whole_text(spark, tmp_path):
    rng = random.Random(3)
    rows, want = [], []
    for r in range(12):
        text = "".join(rng.choice(["ab", "\n", "c", "dé", "\n\n"]) for _ in range(rng.randint(1, 40)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        rows += [_row(f"r{r}", i, part, rng.randint(0, 5), i == len(parts) - 1) for i, part in enumerate(parts)]
        lines = text.split("\n")
        want += [(f"r{r}", i, x) for i, x in enumerate(lines[:-1] if lines[-1] == "" else lines)]
    rng.shuffle(rows)
    got, _ = _run(spark, tmp_path, [rows[i::3] + rows[i::7] for i in range(3)])
    assert got == sorted(want)


class _Counted:
    """A state that counts the calls to it."""

    def __init__(self, calls, kept=None):
        self.calls, self.kept = calls, kept

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return self.kept if name == "get" else [] if name == "listTimers" else False if name in ("exists", "containsKey") else None

        return call


def test_state_is_asked_only_for_what_it_holds():
    calls: list[str] = []
    machine = LineProcessor(1000)
    machine.handle = machine.tail = machine.waiting = machine.place = _Counted(calls)
    frame = pd.DataFrame({"seq": range(50), "chunk": ["a\n"] * 50, "done": [False] * 49 + [True], "at": [5] * 50})
    made = list(machine.handleInputRows(("r",), iter([frame]), None))
    assert [x for m in made for x in m["text"]] == ["a"] * 50
    assert sorted(calls) == ["get", "registerTimer", "update"]
