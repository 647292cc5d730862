"""Conversation structure repair by divide and conquer over forward and backward four-state costs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rowloom.llm import edit_paths as paths
from rowloom.operators.indexing import dense_index
from rowloom.session import materialize

# A piece is a run of so many neighbouring rows of one conversation at most, solved within a task.
PIECE = 2048
# So many pieces of a conversation (or groups of pieces) are joined in one step.
FAN = 512
BATCH = 256

BLANKS = " \t\n\x0b\x0c\r"
_ROLES = {paths.USER: "user", paths.ASSISTANT: "assistant"}
_SHORT = ["conv_id", "turn", "role", "digest"]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one row in four damaged, by crc32 of ``conv_id:turn``; nulls read as a space."""
    one = F.lit(" ")
    drawn = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one)))
    known = rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), (drawn % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = known.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    ).where("times > 0")
    return made.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


@dataclass(frozen=True)
class Repair:
    """What ``repair`` found; a conversation is one conv_id, null included.

    ``audits``: conv_id, at, audit, the edits' initials piece by piece in order of ``at``.
    ``counts``: conv_id, blank, duplicate, truncated, illegal, cost, in parts to be summed.
    ``turns``: conv_id, turn, of every different row.
    ``rows``: conv_id, place, step, edit (K, R or I), role, text: the repaired rows in order of place and step.
    """

    audits: DataFrame
    counts: DataFrame
    turns: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, piece: int = PIECE, fan: int = FAN) -> Repair:
    """Find the faults of conversations and the cheapest edits that give roles of the form ``(s?(ua)+)?``.

    ``rows`` has conv_id of any type, turn, role and text; other columns are left out. Rows stand in order
    of turn, nulls first; rows of one turn by role and digest of the text, and equal rows side by side. A
    null role or text reads as one space, which is a role without a place and a blank text, and so does an
    empty role.

    No conversation is gathered: equal rows are counted before they move, all rows are sorted and numbered
    over the whole cluster, and each sorted partition is cut into pieces. A piece gives a matrix of costs
    between the four states. Matrices of a conversation that lies in several pieces are joined ``fan`` at a
    time, level by level; the states at the borders then come back down the levels, and each piece is solved
    between its two states.
    """
    blank = F.lit(" ")
    plain = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    different = materialize(plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.unhex(F.sha2("text", 256))))
    order = dense_index(_coded(different), _SHORT, "at", derived=True)
    pieces = materialize(_pieces(order.df, piece))
    tops, states = _borders(pieces.where("not whole"), order.count, piece, fan)
    alone = pieces.where("whole").select("conv_id", "illegal", "costs")
    total = alone.union(tops.select("conv_id", "illegal", "costs")).select("conv_id", "illegal", _closing_cost(F.col("costs")).alias("cost"))
    none = F.lit(0).cast("bigint")
    counts = pieces.select("conv_id", "blank", "duplicate", "truncated", none.alias("illegal"), (F.col("extra") * paths.DELETE).alias("cost")).unionByName(
        total.select("conv_id", none.alias("blank"), none.alias("duplicate"), none.alias("truncated"), "illegal", "cost")
    )
    solved = materialize(_solved(pieces.join(states, "at", "left")))
    edits = solved.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")
    kept = edits.where("edit <> 'I'").select("conv_id", "turn", "old", "digest", "place", "step", "edit", F.col("role").alias("new"))
    same = [F.col("k.conv_id").eqNullSafe(F.col("d.conv_id")), F.col("k.turn").eqNullSafe(F.col("d.turn"))]
    same += [F.col("k.old") == F.col("d.role"), F.col("k.digest") == F.col("d.digest")]
    texts = kept.alias("k").join(different.alias("d"), same).select("k.conv_id", "place", "step", "edit", F.col("new").alias("role"), "d.text")
    inserted = edits.where("edit = 'I'").select("conv_id", "place", "step", "edit", "role", F.lit("").alias("text"))
    return Repair(solved.select("conv_id", "at", "audit"), counts, different.select("conv_id", "turn"), texts.unionByName(inserted))


def _closing_cost(costs: Column) -> Column:
    """The least cost from the first state to the end."""
    return F.least(*[costs[s] + F.lit(cost).cast("bigint") for s, (cost, _) in enumerate(paths.CLOSE)])


def _coded(different: DataFrame) -> DataFrame:
    """Narrow rows with their code: the first of equal (role, text) in a conversation is the one of the least turn.

    Equal rows are one row here, so at most one row of a conversation, role and text has its first turn:
    the least turn of each is joined back on a key that is unique on both sides.
    """
    short = different.select(
        *_SHORT, "copies",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(".", "!", "?")).alias("open"),
    )
    turn = F.when(~F.max(F.col("turn").isNull()), F.min("turn")).alias("turn")
    first = different.groupBy("conv_id", "role", "digest").agg(turn).withColumn("first", F.lit(True))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in _SHORT]
    both = short.alias("s").join(first.alias("f"), same, "left")
    initial = F.substring("s.role", 1, 1)
    role = F.when(initial == "s", paths.SYSTEM).when(initial == "u", paths.USER).when(initial == "a", paths.ASSISTANT).otherwise(0)
    goes = F.col("blank") | F.col("first").isNull()
    code = role + F.when(goes, paths.GOES).when(F.col("open"), paths.TRUNCATED).otherwise(0)
    return both.select(*[F.col(f"s.{c}") for c in _SHORT], "copies", "blank", code.alias("code"))


def _pieces(ordered: DataFrame, piece: int) -> DataFrame:
    """Cut sorted partitions into runs of neighbouring rows of one conversation. ``whole``: all of its rows for certain."""
    kinds = {f.name: f for f in ordered.schema.fields}
    schema = StructType(
        [kinds["conv_id"], StructField("at", LongType())]
        + [StructField(n, kinds["copies"].dataType) for n in ("blank", "duplicate", "truncated", "illegal", "extra", "first", "last")]
        + [StructField("costs", ArrayType(LongType())), StructField("ranks", ArrayType(LongType())), StructField("codes", ArrayType(LongType()))]
        + [StructField("copies", ArrayType(LongType())), StructField("turns", ArrayType(kinds["turn"].dataType))]
        + [StructField("roles", ArrayType(StringType())), StructField("digests", ArrayType(kinds["digest"].dataType))]
    )
    schema = schema.add("whole", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, clear, kind = [], [], False, None
        for batch in batches:
            kind = batch.schema
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "turn", "role", "digest", "copies", "blank", "code")), strict=True):
                new = not held or row[0] != held[0][0]
                if held and (new or len(held) >= piece):
                    made.append((*_piece(held), clear and new))
                    clear, held = new, []
                    if len(made) >= BATCH:
                        yield _batch(schema, made, kind)
                        made = []
                held.append(row)
        if held:
            yield _batch(schema, [*made, (*_piece(held), False)], kind)

    return ordered.mapInArrow(run, schema)


def _batch(schema: StructType, rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    """Rows as Arrow; conv_id, turns and digests keep the types they came with."""
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    given = {"conv_id": "conv_id", "turns": "turn", "digests": "digest"}
    arrays = []
    for i, field in enumerate(schema.fields):
        kind = kinds.get(field.dataType.simpleString())
        if field.name in given:
            kind = like.field(given[field.name]).type if field.name == "conv_id" else pa.list_(like.field(given[field.name]).type)
        arrays.append(pa.array([r[i] for r in rows], kind))
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def _legal(left: int, right: int) -> bool:
    return (left & 3, right & 3) in ((paths.SYSTEM, paths.USER), (paths.USER, paths.ASSISTANT), (paths.ASSISTANT, paths.USER))


def _piece(held: list[tuple]) -> tuple:
    """One piece's counts, matrix and rows. Further copies of a row are faults of their own and must go."""
    conv, at = held[0][0], held[0][1]
    turns, roles, digests, copies, blanks, codes = ([r[i] for r in held] for i in range(2, 8))
    extra = sum(copies) - len(copies)
    blank = sum(c for c, b in zip(copies, blanks, strict=True) if b)
    duplicate = sum(c if code & paths.GOES else c - 1 for c, b, code in zip(copies, blanks, codes, strict=True) if not b)
    truncated = sum(1 for code in codes if code & paths.TRUNCATED)
    illegal = extra + sum(not _legal(a, b) for a, b in zip(codes, codes[1:], strict=False))
    matrix = paths.rows_matrix(codes)
    costs, ranks = ([v for row in matrix for v in row[k]] for k in (0, 1))
    return conv, at, blank, duplicate, truncated, illegal, extra, codes[0], codes[-1], costs, ranks, codes, copies, turns, roles, digests


def _matrix(costs, ranks) -> paths.Matrix:
    costs, ranks = [int(c) for c in costs], [int(r) for r in ranks]
    return tuple((tuple(costs[i : i + 4]), tuple(ranks[i : i + 4])) for i in range(0, 16, 4))


def _borders(pieces: DataFrame, count: int, piece: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Conversations in several pieces: their joined matrices, and (at, begin, end, closes) of each piece.

    Only pieces at the borders of partitions and of long conversations come here. A level joins the pieces
    that start within a stretch of places ``fan`` times as long as before, so the levels are few.
    """
    node = ["conv_id", "at", "illegal", "first", "last", "costs", "ranks"]
    levels, level, width = [], pieces.select(*node), piece
    part = StructType([f for f in level.schema.fields if f.name in ("at", "costs", "ranks")])
    schema = StructType([*level.schema.fields, StructField("parts", ArrayType(part))])
    while True:
        width *= fan
        grouped = level.withColumn("stretch", F.floor(F.col("at") / F.lit(width))).groupBy("conv_id", "stretch")
        level = materialize(grouped.applyInArrow(_joined, schema))
        levels.append(level)
        if width >= count:
            break
    states = level.select("at", F.lit(paths.NOTHING).alias("begin"), F.lit(-1).alias("end"), F.lit(True).alias("closes"))
    for below in reversed(levels):
        states = materialize(below.join(states, "at").select("begin", "end", "closes", "parts").mapInArrow(_spread, "at long, begin int, end int, closes boolean"))
    return level, states


def _joined(table: pa.Table) -> pa.Table:
    """One row for neighbouring nodes of a conversation."""
    nodes = sorted(table.select(["at", "illegal", "first", "last", "costs", "ranks"]).to_pylist(), key=lambda n: n["at"])
    matrix = paths.joined([_matrix(n["costs"], n["ranks"]) for n in nodes])
    illegal = sum(n["illegal"] for n in nodes) + sum(not _legal(a["last"], b["first"]) for a, b in zip(nodes, nodes[1:], strict=False))
    costs, ranks = ([v for row in matrix for v in row[k]] for k in (0, 1))
    many = pa.list_(pa.int64())
    parts = [[{k: n[k] for k in ("at", "costs", "ranks")} for n in nodes]]
    return pa.table(
        {
            "conv_id": table.column("conv_id").slice(0, 1), "at": pa.array([nodes[0]["at"]], pa.int64()), "illegal": pa.array([illegal], pa.int64()),
            "first": pa.array([nodes[0]["first"]], pa.int64()), "last": pa.array([nodes[-1]["last"]], pa.int64()),
            "costs": pa.array([costs], many), "ranks": pa.array([ranks], many),
            "parts": pa.array(parts, pa.list_(pa.struct([("at", pa.int64()), ("costs", many), ("ranks", many)]))),
        }
    )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the borders of a node's parts."""
    for batch in batches:
        rows = []
        for node in batch.to_pylist():
            matrices = [_matrix(p["costs"], p["ranks"]) for p in node["parts"]]
            end = node["end"]
            if end < 0:
                end = paths.closing(paths.joined(matrices)[node["begin"]])[1]
            states = paths.matrix_crossings(matrices, node["begin"], end)
            last = len(matrices) - 1
            rows += [(p["at"], states[i], states[i + 1], node["closes"] and i == last) for i, p in enumerate(node["parts"])]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["at", "begin", "end", "closes"])


def _solved(pieces: DataFrame) -> DataFrame:
    """(conv_id, at, audit, edits): the least of the cheapest edits of each piece between its states."""
    kinds = {f.name: f.dataType for f in pieces.schema.fields}
    edit = StructType(
        [StructField("place", LongType()), StructField("step", LongType()), StructField("edit", StringType()), StructField("role", StringType())]
        + [StructField("turn", kinds["turns"].elementType), StructField("old", StringType()), StructField("digest", kinds["digests"].elementType)]
    )
    schema = StructType([StructField("conv_id", kinds["conv_id"]), StructField("at", LongType()), StructField("audit", StringType()), StructField("edits", ArrayType(edit))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn, digest = (batch.schema.field(c).type.value_type for c in ("turns", "digests"))
            kind = pa.struct([("place", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("turn", turn), ("old", pa.string()), ("digest", digest)])
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                found = [_edited(p) for p in part.select(["at", "codes", "copies", "turns", "roles", "digests", "costs", "ranks", "begin", "end", "closes"]).to_pylist()]
                arrays = [part.column("conv_id"), part.column("at"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(kind))]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return pieces.mapInArrow(run, schema)


def _edited(piece: dict) -> tuple[str, list[dict]]:
    codes, begin, end, closes = piece["codes"], piece["begin"], piece["end"], piece["closes"]
    if begin is None:
        begin, closes = paths.NOTHING, True
        end = paths.closing(_matrix(piece["costs"], piece["ranks"])[begin])[1]
    states = paths.row_crossings(codes, begin, end)
    audit, rows = [], []
    for i, code in enumerate(codes):
        text = paths.edits(code)[states[i], states[i + 1]][1]
        audit.append(text + "D" * (piece["copies"][i] - 1))
        state, place = states[i], piece["at"] + i
        for step, letter in enumerate(text):
            row = {"place": place, "step": step, "edit": letter, "role": _ROLES[paths.NEXT[state]], "turn": None, "old": None, "digest": None}
            if letter in "KR":
                row |= {"turn": piece["turns"][i], "old": piece["roles"][i], "digest": piece["digests"][i]}
                row["role"] = row["old"] if letter == "K" else row["role"]
            if letter != "D":
                rows.append(row)
                state = paths.NEXT[state]
    if closes:
        text, state = paths.CLOSE[end][1], end
        audit.append(text)
        for step, letter in enumerate(text):
            rows.append({"place": piece["at"] + len(codes) - 1, "step": 9 + step, "edit": letter, "role": _ROLES[paths.NEXT[state]], "turn": None, "old": None, "digest": None})
            state = paths.NEXT[state]
    return "".join(audit), rows


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and sha256: of each conversation's ``role:text``, newline-joined, in order of place and step.

    A digest takes its bytes one after another, so a conversation's rows stream through one task; only the
    state of the digest is held.
    """
    lines = rows.select("conv_id", "place", "step", F.concat_ws(":", "role", "text").alias("line"))
    schema = StructType([rows.schema["conv_id"], StructField("sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if digest is None or conv != held:
                    if digest is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], schema.names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([digest.hexdigest()], pa.string())], schema.names)

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").mapInArrow(run, schema)


def summary(all_ids: DataFrame, made: Repair) -> DataFrame:
    """One row per conversation of ``all_ids``, also those of which no row is left."""
    turns = made.turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    counted = ("blank", "duplicate", "truncated", "illegal", "cost")
    parts = [all_ids.select("conv_id"), turns, made.counts, made.audits.select("conv_id", F.struct("at", "audit").alias("piece")), digests(made.rows)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    pieces = F.array_sort(F.collect_list("piece"))
    return both.groupBy("conv_id").agg(
        F.coalesce(F.max("gaps"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counted],
        F.concat_ws("", F.transform(pieces, lambda p: p["audit"])).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return summary(rows.select("conv_id").distinct(), repair(damaged(rows)))
