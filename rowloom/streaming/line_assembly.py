"""Whole lines from a stream of token chunks: a state machine per request, with timers.

The state of a request is where it stands, the pieces of its unfinished line, and chunks that came before
their turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rowloom.operators.enrichment import response_chunk

# A request without news for so long in event time is flushed and forgotten.
QUIET = "10 minutes"
# Chunks may come so much later than the newest one of the stream.
LATE = "10 minutes"

# Every look into the state is a call to the JVM. So the place of a request also tells how many chunks wait at most,
# whether a tail is kept, and when its timer rings (0: none is set): what is not there is not asked for.
PLACE = "next long, line_no long, last long, finished boolean, until long, held long, kept boolean, alarm long"
NEW = (0, 0, -1, False, 0, 0, False, 0)


# The state store that keeps lists and maps.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LineProcessor(StatefulProcessor):
    """Takes a request's chunks in order of seq, whatever order they come in, and gives out whole lines."""

    def __init__(self, quiet_ms: int | None) -> None:
        self.quiet_ms = quiet_ms  # none: without timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.tail = handle.getListState("tail", "piece string")
        self.waiting = handle.getMapState("waiting", "seq long", "chunk string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        following, number, last, finished, until, held, kept, alarm = self.place.get() or NEW
        pieces, taken, lines, newest = [], [], [], 0
        for frame in rows:
            newest = max(newest, *frame["at"].tolist())
            seqs = frame["seq"].tolist()
            last = max(last, *compress(seqs, frame["done"].tolist()), -1)
            if finished:
                continue  # repeats of what is done
            early = {seq: chunk for seq, chunk in zip(seqs, frame["chunk"].tolist(), strict=True) if seq >= following}
            while True:
                known = self.waiting.getValue((following,)) if held else None
                if known is not None:
                    taken.append(following)
                    held -= 1
                elif following in early:
                    known = (early[following],)
                else:
                    break
                pieces.append(known[0])
                following += 1
            for seq, chunk in early.items():
                if seq > following:
                    self.waiting.updateValue((int(seq),), (chunk,))
                    held += 1
        if taken and held:
            for seq in taken:
                self.waiting.removeKey((seq,))
        elif taken:
            self.waiting.clear()
        text = "".join(pieces)
        ended = not finished and 0 <= last < following
        if ended or "\n" in text:
            whole = "".join(p for (p,) in self.tail.get()) + text if kept else text
            lines = whole.split("\n")
            text = lines.pop()
            if ended and text:
                lines.append(text)
            self._forget(kept, held if ended else 0)
            kept, held, finished = False, 0 if ended else held, finished or ended
        if text and not finished:
            self.tail.appendValue((text,))
            kept = True
        if self.quiet_ms is not None:
            until = max(until, newest + self.quiet_ms)
            if not alarm:  # one that rings too early is set anew then
                alarm = until
                self.handle.registerTimer(alarm)
        if finished and self.quiet_ms is None:
            self.place.clear()
        else:
            self.place.update((following, number + len(lines), last, finished, until, held, kept, alarm))
        if lines:
            yield self._shown(key, number, lines)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """What a request that never ended has left: its open line, then chunks behind a gap, in order."""
        *known, until, held, kept, _ = self.place.get()
        if until > timerValues.getCurrentWatermarkInMs():  # there was news since
            self.handle.registerTimer(until)
            self.place.update((*known, until, held, kept, until))
            return
        late = sorted((k[0], v[0]) for k, v in self.waiting.iterator()) if held else []
        rest = "".join(p for (p,) in self.tail.get()) if kept else ""
        rest += "".join(chunk for _, chunk in late)
        lines = rest.split("\n") if rest else []
        lines = lines[:-1] if lines and lines[-1] == "" else lines
        self._forget(kept, held)
        self.place.clear()
        if lines:
            yield self._shown(key, known[1], lines)

    def close(self) -> None:
        pass

    def _forget(self, kept: bool, held: int) -> None:
        if kept:
            self.tail.clear()
        if held:
            self.waiting.clear()

    @staticmethod
    def _shown(key, number: int, lines: list[str]) -> pd.DataFrame:
        request, text = (pd.Series(v, dtype=object) for v in ([key[0]] * len(lines), lines))
        return pd.DataFrame({"request": request, "line_no": pd.Series(range(number, number + len(lines)), dtype="int64"), "text": text})


def assemble_lines(chunks: DataFrame, quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """(request, line_no, text) from streamed ``(request_id, seq, line, done, ts)`` rows; seq counts from 0.

    Switches the session to the RocksDB state store.

    Chunks are taken in order of seq; one that comes early waits in the state, a repeated one is dropped. Lines are
    given out when their line break has come, the last one when the row marked ``done`` and all before it have.
    A request without news for ``quiet`` is flushed as it is and its state freed; so is the mark of a finished one.
    Malformed lines are empty chunks. The text held per request is one unfinished line and what waits. Rows without
    ``ts`` are assembled without timers: what never ends then stays.
    """
    chunks.sparkSession.conf.set(*STORE)
    timed = "ts" in chunks.columns
    known = chunks.withWatermark("ts", late) if timed else chunks
    parsed = known.select(
        F.col("request_id").alias("request"), F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(response_chunk(F.col("line")), F.lit("")).alias("chunk"), F.coalesce("done", F.lit(False)).alias("done"),
        *(["ts", F.unix_millis("ts").alias("at")] if timed else [F.lit(0).cast("bigint").alias("at")]),
    )
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000) if timed else None
    kind = dict(parsed.dtypes)["request"]
    return parsed.groupBy("request").transformWithStateInPandas(
        LineProcessor(quiet_ms), f"request {kind}, line_no long, text string", "Append", "EventTime" if timed else "None"
    )
