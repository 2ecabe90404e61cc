"""Recording a stream of packets, and starting and stopping streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import RecordingConfig
from ..operators.recording import recording_events, recording_packets
from ..scratch import exists
from ..sinks.recording import open_recording
from ..sources.packets import explode_packets
from .window import TrailingWindow


TOTALS = "packets long, events long, batch long"


class Recorder:
    """Appends each micro-batch to a recording, numbering packets and events on from what is committed.

    A batch is written under its own number, so one that runs again after a failure replaces itself, and its
    numbers go on from the batches before it only.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: RecordingConfig) -> None:
        self.spark, self.path, self.cfg = spark, path, cfg
        self.last = (-1, 0, 0)  # batch, packets and events up to its end

    def _before(self, batch: int) -> tuple[int, int]:
        """Packets and events recorded before a batch: remembered, or after a restart from the totals, a row a batch."""
        if not 0 <= self.last[0] < batch:
            row = (None, None, None)
            if exists(self.spark, f"{self.path}/totals"):
                done = self.spark.read.schema(TOTALS).parquet(f"{self.path}/totals").where(F.col("batch") < batch)
                row = done.agg(F.max("batch"), F.max("packets"), F.max("events")).first()
            self.last = (-1, 0, 0) if row[0] is None else tuple(row)
        return self.last[1:]

    def write(self, packets: DataFrame, batch: int) -> None:
        first_packet, first_event = self._before(batch)
        packets = packets.persist()  # decoded once for both tables
        try:
            self._write(packets, batch, first_packet, first_event)
        finally:
            packets.unpersist()

    def _write(self, packets: DataFrame, batch: int, first_packet: int, first_event: int) -> None:
        events = explode_packets(packets)
        time = lambda e: e["sec"].cast("long") * 1_000_000 + e["ms"] * 1000 + e["us"]
        some = F.col("event_count") > 0
        arrival = F.unix_micros(F.current_timestamp()) * 1000
        heads = packets.select("packet_id", "event_count", F.when(some, time(F.try_element_at("events", F.lit(1)))).alias("first_event_t_us"), F.when(some, time(F.try_element_at("events", F.lit(-1)))).alias("last_event_t_us"), arrival.alias("ros_t_ns"), arrival.alias("monotonic_t_ns"))
        rows = recording_packets(heads, first_packet, first_event)
        tables = {"events": recording_events(events, rows), "packets": rows.drop("packet_id")}
        for name, df in tables.items():
            df.write.mode("overwrite").options(**self.cfg.parquet).parquet(f"{self.path}/{name}/batch={batch}")
        row = packets.agg(F.count("*"), F.coalesce(F.sum("event_count"), F.lit(0))).first()
        total = (first_packet + row[0], first_event + row[1])
        self.spark.createDataFrame([total], "packets long, events long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        self.last = (batch, *total)


class Service:
    """A stream that can be started and stopped; each call says whether it did anything."""

    def __init__(self) -> None:
        self.query: StreamingQuery | None = None

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self, begin) -> bool:
        if self.running:
            return False
        try:
            self.query = begin()
        except Exception:
            self.query = None
            return False
        return True

    def stop(self, seconds: float = 2.0) -> bool:
        if self.query is None:
            return False
        self.query.stop()
        self.query.awaitTermination(int(seconds))
        self.query = None
        return True


class RecordingService(Service):
    def start_recording(self, packets: DataFrame, cfg: RecordingConfig, checkpoint: str, **trigger) -> bool:
        """False if one is running or its folder exists. flush_every_packets is the stream's batch size, set on its source."""
        spark = packets.sparkSession

        def begin() -> StreamingQuery:
            recorder = Recorder(spark, open_recording(spark, cfg), cfg)
            return packets.writeStream.foreachBatch(recorder.write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

        return self.start(begin)


class Pace:
    """At most a frame a period. The next period begins when a frame is due, not where the last would have ended, so that a late
    one is not followed by a burst of those it missed."""

    def __init__(self, fps: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.period, self.clock, self.last = 1.0 / fps, clock, float("-inf")

    def due(self) -> bool:
        now = self.clock()
        if now - self.last < self.period:
            return False
        self.last = now
        return True


class PublishingService(Service):
    """Frames to a sink function (frame, batch), of each micro-batch's packets or, with a window, of the latest events up to it.

    A start finds the window empty, whatever was in it when the stream was stopped; with resume it goes on, as after a failure.
    """

    def start_publishing(self, packets: DataFrame, render, sink, checkpoint: str, fps: float = 30.0, window: TrailingWindow | None = None, pace: Pace | None = None, resume: bool = False, **trigger) -> bool:
        pace = pace or Pace(fps)

        def publish(batch: DataFrame, number: int) -> None:
            events = explode_packets(batch)
            events = window.advance(events, number) if window else events
            if pace.due():
                sink(render(events), number)

        def begin() -> StreamingQuery:
            if window and not resume:
                window.clear(packets.sparkSession)
            return packets.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": f"{int(1000 / fps)} milliseconds"}).start()

        return self.start(begin)
