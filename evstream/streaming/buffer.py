"""Buffers of recent packets as keyed state."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "packets binary"  # rows of COLUMNS as long, at most CHUNK
COLUMNS = ["packet_id", "latest", "arrival_us", "events"]
CHUNK = 4096
OUTPUT = "sensor string, tick long, packets long, events long, oldest_packet long, newest_packet long, latest long"


class PacketBuffer(StatefulProcessor):
    """Keeps packets by arrival time or by event time and at most max_packets; reports what it holds after each batch.

    By arrival: packets that arrived before the newest arrival less the history go. By event time: packets leave
    from the head only, while their latest event is before the newest packet's less the window. By clock: as by arrival, and
    packets also go when the history has passed since they came, though no other comes: a processing-time timer is set for the
    oldest, and what is left is reported when it fires.
    """

    def __init__(self, history_us: int, max_packets: int, by: str = "arrival") -> None:
        if by not in ("arrival", "event", "clock"):
            raise ValueError(f"by: {by}; arrival, event or clock")
        self.history_us, self.max_packets, self.by = history_us, max_packets, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packets = handle.getListState("packets", STATE)
        self.ticks = handle.getValueState("ticks", "tick long")

    def keep(self, held: list[tuple], new: list[tuple] = ()) -> list[tuple]:
        """What stays of packets in order of arrival, when new ones have come one by one. A packet is looked at when it comes and when it goes."""
        return self._by_event(held, new) if self.by == "event" else self._by_arrival(held, new)

    def _by_event(self, held: list[tuple], new: list[tuple]) -> list[tuple]:
        left = deque(held)
        for packet in new:
            left.append(packet)
            while left[0][1] < packet[1] - self.history_us:
                left.popleft()
            if self.max_packets and len(left) > self.max_packets:
                left.popleft()
        return list(left)

    def _by_arrival(self, held: list[tuple], new: list[tuple]) -> list[tuple]:
        left = OrderedDict(enumerate(held))
        oldest, newest = [(p[2], k) for k, p in left.items()], [(-p[2], k) for k, p in left.items()]
        heapify(oldest)
        heapify(newest)
        for k, packet in enumerate(new, len(held)):
            left[k] = packet
            heappush(oldest, (packet[2], k))
            heappush(newest, (-packet[2], k))
            while newest[0][1] not in left:
                heappop(newest)
            while oldest[0][0] < -newest[0][0] - self.history_us:
                left.pop(heappop(oldest)[1], None)
            if self.max_packets and len(left) > self.max_packets:
                left.popitem(last=False)
        return list(left.values())

    def _held(self) -> list[tuple]:
        return [tuple(p) for (chunk,) in self.packets.get() for p in np.frombuffer(chunk, np.int64).reshape(-1, len(COLUMNS)).tolist()]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted(tuple(p) for pdf in rows for p in pdf[COLUMNS].to_numpy(np.int64).tolist())
        yield self._hold(key, self.keep(self._held(), new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        yield self._hold(key, [p for p in self._held() if p[2] >= now - self.history_us])

    def _hold(self, key, held: list[tuple]) -> pd.DataFrame:
        if held:
            self.packets.put([(np.array(held[k : k + CHUNK], np.int64).tobytes(),) for k in range(0, len(held), CHUNK)])
        else:
            self.packets.clear()
        if self.by == "clock":
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:  # the first millisecond at which the oldest is too old
                self.handle.registerTimer((min(p[2] for p in held) + self.history_us) // 1000 + 1)
        tick = (self.ticks.get()[0] if self.ticks.exists() else 0) + 1
        self.ticks.update((tick,))
        ends = {"oldest_packet": held[0][0], "newest_packet": held[-1][0], "latest": held[-1][1]} if held else dict.fromkeys(("oldest_packet", "newest_packet", "latest"))
        return pd.DataFrame([{"sensor": key[0], "tick": tick, "packets": len(held), "events": sum(p[3] for p in held)} | ends]).astype(dict.fromkeys(ends, "Int64"))

    def close(self) -> None:
        pass


def buffered(packets: DataFrame, history_us: int, max_packets: int = 0, by: str = "arrival") -> DataFrame:
    """Streaming packets (sensor, packet_id, latest, arrival_us, events) to the state of each sensor's buffer after every micro-batch, and
    by clock whenever packets leave. Needs the RocksDB state store."""
    time = "ProcessingTime" if by == "clock" else "None"
    return packets.groupBy("sensor").transformWithStateInPandas(statefulProcessor=PacketBuffer(history_us, max_packets, by), outputStructType=OUTPUT, outputMode="Update", timeMode=time)


def packet_heads(packets: DataFrame, sensor: str = "camera") -> DataFrame:
    """What a buffer needs of decoded packets (see sources.packets): empty packets have no latest event and are left out."""
    time = F.transform("events", lambda e: e["sec"].cast("long") * 1_000_000 + e["ms"] * 1000 + e["us"])
    rows = packets.where("event_count > 0").select(F.lit(sensor).alias("sensor"), "packet_id", F.array_max(time).alias("latest"), F.col("event_count").alias("events"))
    return rows.withColumn("arrival_us", F.unix_micros(F.current_timestamp()))
