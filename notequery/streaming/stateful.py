"""Stream operators that keep state of their own and release it by timers: debounced changes and frames of completions.

Both give, over any cut of the input into batches and chunks, the rows that their counterparts over tables give.  They
need a state store that holds timers: ``spark.sql.streaming.stateStore.providerClass`` set to RocksDB's.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from notequery.streaming import completions

#: What the session must be set to.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_BREAK = re.compile(r"\r?\n\r?\n")


def _micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


class _Debouncer(StatefulProcessor):
    """Of each path the bursts that are still open: first and last event, and whether the last one was a removal."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("bursts", "first array<long>, last array<long>, removed array<boolean>")

    def _read(self) -> list[tuple[int, int, bool]]:
        held = self.open.get() if self.open.exists() else None
        return list(zip(*(list(x) for x in held), strict=True)) if held else []

    def _write(self, bursts: list[tuple[int, int, bool]]) -> None:
        if bursts:
            self.open.update(tuple(list(x) for x in zip(*bursts, strict=True)))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        bursts = self._read()
        for batch in rows:
            for ts, removed in zip(batch["ts"], batch["removed"], strict=True):
                first = last = _micros(ts)
                near = [b for b in bursts if b[0] - self.quiet <= last and first <= b[1] + self.quiet]
                bursts = [b for b in bursts if b not in near]
                # The last event says what became of the path; of events at one time a removal does not.
                every = [*near, (first, last, bool(removed))]
                end = max(b[1] for b in every)
                bursts.append((min(b[0] for b in every), end, all(b[2] for b in every if b[1] == end)))
        self._write(sorted(bursts))
        for _, end, _ in bursts:
            self.handle.registerTimer(-(-(end + self.quiet) // 1000) + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        bursts = self._read()
        done = [b for b in bursts if b[1] + self.quiet < now]
        if done:
            self._write([b for b in bursts if b not in done])
            yield pd.DataFrame({"path": [key[0]] * len(done), "removed": [b[2] for b in done], "ts": pd.to_datetime([b[1] for b in done], unit="us")})


def debounce(events: DataFrame, late: str = "10 seconds", quiet: dt.timedelta = dt.timedelta(milliseconds=500)) -> DataFrame:
    """(path, removed, ts): of a stream of events (path, removed, ts) the last of each burst, once its path has been quiet.

    A change comes as soon as the watermark has passed the pause.  Of events at one time a written file wins.
    """
    rows = events.select("path", "removed", "ts").withWatermark("ts", late).groupBy("path")
    processor = _Debouncer(int(quiet.total_seconds() * 1_000_000))
    return rows.transformWithStateInPandas(statefulProcessor=processor, outputStructType="path string, removed boolean, ts timestamp", outputMode="Append", timeMode="EventTime")


class _Frames(StatefulProcessor):
    """Of each request what has come of the next frame, chunks that came too early, and how many chunks and frames there were."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("buffer", "buffer string, chunks long, frames long, until long")
        self.early = handle.getMapState("early", "seq long", "chunk string")

    def _out(self, key: tuple, first: int, frames: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"request_id": [key[0]] * len(frames), "i": range(first, first + len(frames)), "frame": frames})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        buffer, chunks, frames, until = self.held.get() if self.held.exists() else ("", 0, 0, 0)
        for batch in rows:
            for seq, chunk, ts in zip(batch["seq"], batch["chunk"], batch["ts"], strict=True):
                self.early.updateValue((int(seq),), (chunk,))
                until = max(until, _micros(ts) // 1000 + self.idle)
        found: list[str] = []
        while self.early.containsKey((chunks,)):
            buffer += self.early.getValue((chunks,))[0]
            self.early.removeKey((chunks,))
            chunks += 1
        *found, buffer = _BREAK.split(buffer)
        self.held.update((buffer, chunks, frames + len(found), until))
        self.handle.registerTimer(until)
        if found:
            yield self._out(key, frames, found)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            buffer, chunks, frames, until = self.held.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= until:
                self.held.clear()
                if buffer:
                    yield self._out(key, frames, [buffer])


def frames(chunks: DataFrame, late: str = "10 seconds", idle: dt.timedelta = dt.timedelta(seconds=30)) -> DataFrame:
    """(request_id, model, prompt_tokens, ..., i, kind, text) of a stream of chunks (request_id, seq from 0, chunk, ts), a row a frame as soon as it is whole.

    Chunks may come in any order.  What is left of a request that has been idle is its last frame.
    """
    rows = chunks.select("request_id", F.col("seq").cast("long").alias("seq"), "chunk", "ts").withWatermark("ts", late).groupBy("request_id")
    kind = rows._df.schema["request_id"].dataType.simpleString()
    whole = rows.transformWithStateInPandas(
        statefulProcessor=_Frames(int(idle.total_seconds() * 1000)), outputStructType=f"request_id {kind}, i long, frame string", outputMode="Append", timeMode="EventTime"
    )
    return completions.read(whole)
