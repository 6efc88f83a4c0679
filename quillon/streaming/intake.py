"""Intake in rounds: what comes in waits, each round takes the newest of every source in line, and serves so many.

A round is a stretch of event time, of each shard on its own. When the watermark has passed its end, up to PER_SOURCE of the
newest waiting items of each source join the line, sources in the order of their names, and the first FLUSH of the line are
served; the rest of the line comes first in the next round, and what still waits may be taken later. So a burst is served over
many rounds, none is lost, and none is served twice.

State is two lists a shard, what waits and the line, and goes with what is served; a timer a shard stands at the end of the next
round that has something to do, so quiet rounds cost nothing. Results depend on event times only, not on how the items were
dealt into batches, as long as none is later than the watermark; one that is late, but still let in, waits for the next round.

Defined results: an item that comes again is served again; items without a time are left out. What waits after the last
watermark stays in the state, and is served when later items move the watermark on.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values of the platform's rules.
EVERY, PER_SOURCE, FLUSH = 45, 12, 16

#: Waiting items are packed: a row has up to CHUNK of a source's items, and their times unless these have come, as 64-bit numbers.
WAITING, LINE, TIMER = "source string, ready boolean, items binary, ats binary", "source string, item long", "round long"
CHUNK = 100_000
#: Rows of a result that a task gives out at once.
PIECE = 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Waiting:
    """The waiting items of one source: those whose time has come as runs, each with its greatest item first, and the others by
    time. An item is sorted twice, whatever the number of rounds that it waits."""

    def __init__(self, ready: list[np.ndarray], later: list[tuple[np.ndarray, np.ndarray]]):
        self.runs: list[tuple[np.ndarray, int]] = []
        self.heads: list[tuple[int, int]] = []
        self.items, self.ats = (np.concatenate(x) for x in zip(*later, strict=True)) if later else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(self.ats, kind="stable")
        self.items, self.ats, self.at = self.items[order], self.ats[order], 0
        if ready:
            self._run(np.concatenate(ready))

    def _run(self, items: np.ndarray) -> None:
        if len(items):
            run = np.sort(items)[::-1]
            heapq.heappush(self.heads, (-int(run[0]), len(self.runs)))
            self.runs.append((run, 0))

    def __bool__(self) -> bool:
        return bool(self.heads) or self.at < len(self.ats)

    def due(self) -> int | None:
        """The time of the first item that isn't ready, or null if one is."""
        return None if self.heads else int(self.ats[self.at])

    def newest(self, end: int, most: int) -> list[int]:
        """Take up to ``most`` of the items before a time, the greatest first."""
        until = int(np.searchsorted(self.ats, end))
        self._run(self.items[self.at : until])
        self.at, out = max(self.at, until), []
        while self.heads and len(out) < most:
            head, k = self.heads[0]
            run, place = self.runs[k]
            out.append(-head)
            self.runs[k] = run, place + 1
            if place + 1 < len(run):
                heapq.heapreplace(self.heads, (-int(run[place + 1]), k))
            else:
                heapq.heappop(self.heads)
        return out

    def packed(self, source: str) -> Iterator[tuple]:
        """Rows of WAITING."""
        rest = [run[place:] for run, place in self.runs if place < len(run)]
        items = np.concatenate([*rest, self.items[self.at :]])
        ready = sum(map(len, rest))
        for begin, end, is_ready in ((0, ready, True), (ready, len(items), False)):
            for i in range(begin, end, CHUNK):
                j = min(i + CHUNK, end)
                yield source, is_ready, items[i:j].tobytes(), b"" if is_ready else self.ats[self.at + i - ready : self.at + j - ready].tobytes()


def unpacked(rows: Iterator[tuple]) -> dict[str, Waiting]:
    """The waiting items by source, in the order of their names, from rows of WAITING."""
    ready, later = {}, {}
    numbers = lambda b: np.frombuffer(b, np.int64)
    for source, is_ready, items, ats in rows:
        if is_ready:
            ready.setdefault(source, []).append(numbers(items))
        else:
            later.setdefault(source, []).append((numbers(items), numbers(ats)))
    return {s: Waiting(ready.get(s, []), later.get(s, [])) for s in sorted(ready.keys() | later.keys())}


class Rounds(StatefulProcessor):
    """Rounds of a shard."""

    def __init__(self, shard: str, every: int, per_source: int, flush: int):
        self.shard, self.every, self.per_source, self.flush = shard, every * 1000, per_source, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.line, self.timer = handle.getListState("waiting", WAITING), handle.getListState("line", LINE), handle.getValueState("timer", TIMER)

    def _wait_for(self, due: int) -> None:
        """Stand the timer at the end of a round, unless it is there or before."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and old <= due:
            return
        if old is not None:
            self.handle.deleteTimer((old + 1) * self.every)
        self.timer.update((due,))
        self.handle.registerTimer((due + 1) * self.every)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame["ts"].astype("datetime64[ms]").astype("int64")
            item = frame["item"].astype("int64")
            self.waiting.appendList([(s, False, item.iloc[i].to_numpy().tobytes(), at.iloc[i].to_numpy().tobytes()) for s, i in frame.groupby("source").indices.items()])
            first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            # one that is late waits for the first round that the watermark hasn't closed
            self._wait_for(max(first, timerValues.getCurrentWatermarkInMs()) // self.every)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentWatermarkInMs(), self.timer.get()[0]
        waiting, line = unpacked(map(tuple, self.waiting.get())), deque(tuple(q) for q in self.line.get())
        out = []
        while (waiting or line) and (due + 1) * self.every <= now:
            end = (due + 1) * self.every
            for source, items in waiting.items():
                line.extend((source, i) for i in items.newest(end, self.per_source))
            out += [(key[0], due, k, *line.popleft()) for k in range(min(self.flush, len(line)))]
            waiting = {s: w for s, w in waiting.items() if w}
            first = [w.due() for w in waiting.values()]
            due = due + 1 if line or not waiting or None in first else max(due + 1, min(first) // self.every)
            if len(out) >= PIECE:
                yield self._rows(out)
                out = []
        for state, rows in ((self.waiting, [r for s, w in waiting.items() for r in w.packed(s)]), (self.line, list(line))):
            if rows:
                state.put(rows)
            else:
                state.clear()
        self.timer.clear()
        if waiting or line:
            self._wait_for(due)
        if out:
            yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[self.shard, "round", "place", "source", "item"]).astype({"source": object})

    def close(self) -> None:
        pass


def rounds(items: DataFrame, shard: str, every: int = EVERY, per_source: int = PER_SOURCE, flush: int = FLUSH, late: str = "10 minutes") -> DataFrame:
    """(shard, round, place, source, item): what each round of a stream of items (shard, source, item, ts) serves, in order.
    round counts stretches of ``every`` seconds since 1970."""
    # lists and timers need this store
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = items.schema[shard].dataType.simpleString()
    told = items.select(shard, F.coalesce("source", F.lit("")).alias("source"), "item", "ts").filter("ts IS NOT NULL").withWatermark("ts", late)
    out = f"`{shard}` {kind}, round long, place long, source string, item long"
    return told.groupBy(shard).transformWithStateInPandas(statefulProcessor=Rounds(shard, every, per_source, flush), outputStructType=out, outputMode="Append", timeMode="EventTime")
