"""Conversation repair against a brute force that carries whole audits along."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from rowloom.llm import conversations, edit_paths

SCHEMA = "conv_id long, turn long, role string, text string, at long, codes string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
WHOLE = {"u": "user", "a": "assistant"}


def _least(rows):
    """(cost, audit, repaired rows) of rows (role, text, must go, truncated), by what the repaired roles end in."""
    best = {"": (0, "", ())}

    def inserted(found):
        for _ in range(3):
            for end, (cost, audit, out) in list(found.items()):
                new = (cost + 3, audit + "I", (*out, (WHOLE[NEXT[end]], "")))
                found[NEXT[end]] = min(found.get(NEXT[end], new), new)
        return found

    for role, text, goes, truncated in rows:
        after = {}
        for end, (cost, audit, out) in inserted(dict(best)).items():
            ways = [(end, (cost + 4, audit + "D", out))]
            if not goes:
                more = 3 if truncated else 0
                ways.append((NEXT[end], (cost + 3 + more, audit + "R", (*out, (WHOLE[NEXT[end]], text)))))
                if role[:1] == NEXT[end] or role[:1] == "s" and end == "":
                    ways.append((role[:1], (cost + more, audit + "K", (*out, (role, text)))))
            for state, way in ways:
                after[state] = min(after.get(state, way), way)
        best = after
    return min(way for end, way in inserted(dict(best)).items() if end in ("", "a"))


def _want(rows, damage=True):
    ids, convs = set(), defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        times = {0: 0, 3: 2}.get(kind, 1)
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * times
    result = {}
    for conv in ids:
        own = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            judged.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, out = _least(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        result[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return result


def _rows():
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "So! ", "a.b", "long text " * 20 + ".", "É.", "end\x0b"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(0, 14)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None, 3]), rng.choice(roles), rng.choice(texts) if turn % 3 else f"word {turn}.", 0, "x"))
    for turn in range(400):  # a hot conversation
        rows.append((500, turn if turn % 50 else None, roles[rng.randint(0, 7)], f"say {rng.randint(0, 300)}{rng.choice(['.', '', '!'])}", 1, None))
    rows += [(None, i, r, "no id.", None, None) for i, r in enumerate(["user", "assistant", "user"])]
    rows += [(501, None, "user", "once.", 0, "x")] * 40 + [(502, 1, "assistant", " ", 0, "x")] * 9 + [(None, None, None, None, None, None)]
    return rows


def _found(spark, rows, damage=True, parts=3, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    given = conversations.damaged(df) if damage else df
    made = conversations.summary(df.select("conv_id").distinct(), conversations.repair(given, **sizes))
    return {r[0]: tuple(r)[1:] for r in made.collect()}


@pytest.mark.parametrize("sizes", [{}, {"piece": 3, "fan": 2}, {"piece": 1, "fan": 7}])
@pytest.mark.parametrize("damage", [True, False])
def test_equals_brute_force(spark, sizes, damage):
    rows = _rows()
    assert _found(spark, rows, damage, **sizes) == _want(rows, damage)


def test_repaired_rows_have_the_form(spark):
    rows = _rows()
    made = conversations.repair(conversations.damaged(spark.createDataFrame(rows, SCHEMA)))
    out = defaultdict(str)
    for r in made.rows.orderBy("conv_id", "place", "step").collect():
        out[r.conv_id] += r.role[0]
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
    assert out and all(re.fullmatch("s?(ua)+", o) for o in out.values())


def test_joined_stretches_equal_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        codes = [rng.choice([0, 1, 2, 3, 2, 3, 4, 6, 7, 8, 9, 10, 11]) for _ in range(rng.randint(0, 30))]
        cuts = [0, *sorted(rng.randint(0, len(codes)) for _ in range(3)), len(codes)]
        parts = [edit_paths.rows_matrix(codes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        whole = edit_paths.rows_matrix(codes)
        assert edit_paths.joined(parts) == whole
        end = edit_paths.closing(whole[0])[1]
        states = edit_paths.row_crossings(codes, 0, end)
        assert [states[c] for c in cuts] == edit_paths.matrix_crossings(parts, 0, end)


def test_ids_of_any_type_and_empty_tables(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", 1, "assistant", "Cut"), (None, 1, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    made = conversations.summary(df.select("conv_id").distinct(), conversations.repair(df))
    found = {r.conv_id: (r.cost, r.audit) for r in made.collect()}
    assert found == {"a": (0, "KK"), "b": (4, "D"), None: (3, "KI")}
    none = df.where("false")
    assert conversations.summary(none.select("conv_id"), conversations.repair(none)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in conversations.op11_conversation_repair(spark, sf_dir).select(F.col("*")).collect()}
    assert got == _want(rows)
