"""Trailing windows by ticks of the event clock, as keyed state: every tick that a stream passes has its window."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PARTS = "sensor string, slot long, tick long, newest long, t_us binary, ord binary"
HELD = "t_us binary, ord binary"
CLOCK = "next long, ticks array<long>, newest array<long>"
OUTPUT = "sensor string, tick long, ord long, t_us long"
CHUNK = 1024  # events of a slot in a row
TOGETHER = 64  # chunks that are in memory at once
START_MS = 10**12  # Spark's clock at our time 0: its watermark begins at its own 0, and what is not after it counts as late


class Slots:
    """Events and ticks in numbers: a slot has the events after one tick and up to the next, whose number it bears."""

    def __init__(self, period_us: int, window_us: int) -> None:
        self.period, self.window = period_us, window_us
        self.reach = window_us // period_us + 1
        self.span = 2 * self.reach  # ticks after its own whose windows may have a slot's events

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (sensor, ord, t_us) as PARTS: the events of each slot by CHUNK, and what the slots before need of it, its latest event."""
        for batch in batches:
            t, ord = (batch.column(c).cast(pa.int64()).to_numpy() for c in ("t_us", "ord"))
            sensors = batch.column("sensor").dictionary_encode(null_encoding="encode")
            of = sensors.indices.to_numpy()
            slots = -(-t // self.period)
            order = np.lexsort((slots, of))
            t, ord, of, slots = t[order], ord[order], of[order], slots[order]
            ends = [*(np.flatnonzero((np.diff(of) != 0) | (np.diff(slots) != 0)) + 1), len(t)] if len(t) else []
            rows = []
            for begin, end in zip([0, *ends], ends):
                sensor, slot = sensors.dictionary[int(of[begin])].as_py(), int(slots[begin])
                for k in range(begin, end, CHUNK):
                    own = slice(k, min(end, k + CHUNK))
                    rows.append((sensor, slot, slot, int(t[own].max()), t[own].tobytes(), ord[own].tobytes()))
                newest = int(t[begin:end].max())
                rows += ((sensor, before, slot, newest, None, None) for before in range(slot - self.span, slot))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            names = [f.split(" ")[0] for f in PARTS.split(", ")]
            for some in batched(rows, 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some), kinds)], names)


class TickWindows(StatefulProcessor):
    """One row for each event and tick whose trailing window has it, as of operators.windows.tick_windows, a sensor's slot a key.

    Tick k comes k periods after 0 and is given when the watermark has passed it, so when no event of it can come any more: by an
    event-time timer, for all ticks that one batch passes. Its now is the latest event up to it, and its window reaches back from
    there; a tick later than that by more ticks than a window spans has none. Times, and so ticks, may be 0 and, by less than
    START_MS, below. A slot holds its events as they came, until the last tick that may have any, and the latest event of each slot
    up to that tick: no other key has to be asked.
    """

    def __init__(self, period_us: int, window_us: int) -> None:
        self.slots = Slots(period_us, window_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.clock = handle.getValueState("clock", CLOCK)

    def _wait(self, tick: int) -> None:
        self.handle.registerTimer(START_MS - (-tick * self.slots.period // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, ticks, newest = self.clock.get() if self.clock.exists() else (None, (), ())
        latest = dict(zip(ticks, newest))
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                latest[r.tick] = max(r.newest, latest.get(r.tick, r.newest))
                if r.t_us is not None:
                    self.held.appendValue((bytes(r.t_us), bytes(r.ord)))
        if following is None:
            self._wait(following := int(key[1]))
        self.clock.update((following, [int(k) for k in latest], [int(n) for n in latest.values()]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, last = self.slots, int(key[1]) + self.slots.span
        following, ticks, newest = self.clock.get()
        passed = min((timerValues.getCurrentWatermarkInMs() - START_MS) * 1000 // s.period, last)
        cuts = {}  # of the ticks to be given that have a window
        for tick in range(following, passed + 1):
            if upto := [n for k, n in zip(ticks, newest) if tick - s.reach <= k <= tick]:
                cuts[tick] = max(upto) - s.window
        for some in batched(self.held.get(), TOGETHER) if cuts else ():
            t, ord = (np.concatenate([np.frombuffer(c[of], np.int64) for c in some]) for of in (0, 1))
            for tick, cut in cuts.items():
                if (own := t >= cut).any():
                    yield pd.DataFrame({"sensor": key[0], "tick": tick, "ord": ord[own], "t_us": t[own]})
        if passed == last:
            self.held.clear()
            self.clock.clear()
        else:
            following = max(following, passed + 1)
            self.clock.update((following, list(ticks), list(newest)))
            self._wait(following)

    def close(self) -> None:
        pass


def tick_windows(events: DataFrame, period_us: int, window_us: int, late: str = "1 second") -> DataFrame:
    """sensor, tick, ord, t_us from streaming events (sensor, ord, t_us), no number null; events that come later than late are left
    out, unless their slot is still open and others of it come with them. Needs the RocksDB state store."""
    parts = events.select("sensor", "ord", "t_us").mapInArrow(Slots(period_us, window_us).parts, PARTS)
    rows = parts.withColumn("at", F.timestamp_micros(F.col("newest") + START_MS * 1000)).withWatermark("at", late)
    return rows.groupBy("sensor", "slot").transformWithStateInPandas(statefulProcessor=TickWindows(period_us, window_us), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
