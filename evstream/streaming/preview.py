"""The decaying preview as keyed state: one accumulator and a ring of packets a pixel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import PreviewConfig, Sensor
from ..functions.scalars import in_bounds, polarity, quantize

OUTPUT = "y int, x int, epoch long, tick long, faded double, packets array<long>, deltas array<double>, acc double, level smallint"
DELTAS = "y int, x int, packet_id long, delta double, epoch long"
FOLD = 1 << 17  # rows that a task holds to fold them
STATE = "epoch long, tick long, faded double, packets array<long>, deltas array<double>"


class DecayingPixel(StatefulProcessor):
    """A pixel's accumulator as of its latest packet; rows are (y, x, packet_id, delta, epoch), one an event or summed.

    At every tick, one a packet, what there is fades by decay and the buffer of the last max_packets packets is added. A packet's
    sum is kept in the ring for as many ticks and counts by a geometric series; when it leaves the ring, it joins faded, which
    only fades from then on. A packet that comes late counts as if it had come in time. Rows of a later epoch find the pixel empty, rows
    of an earlier one are not looked at, so a new start clears every pixel without visiting it.
    """

    def __init__(self, decay: float, max_packets: int, contrast: float) -> None:
        self.decay, self.most, self.contrast = decay, max_packets, contrast

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pixel", STATE)

    def series(self, n: int) -> float:
        """1 + decay + ... of n terms."""
        return float(n) if self.decay == 1.0 else (1.0 - self.decay**n) / (1.0 - self.decay)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch, tick, faded, packets, deltas = self.state.get() if self.state.exists() else (-1, None, 0.0, (), ())
        new = pd.concat(list(rows))
        latest = int(new["epoch"].max())
        if latest > epoch:
            epoch, tick, faded, packets, deltas = latest, None, 0.0, (), ()
        new = new[new["epoch"] == epoch]
        if new.empty:
            return
        ring = dict(zip(packets, deltas))
        now = max([int(new["packet_id"].max())] + ([] if tick is None else [tick]))
        faded *= 1.0 if tick is None else self.decay ** (now - tick)
        for packet, delta in new.groupby("packet_id")["delta"].sum().items():
            ring[int(packet)] = ring.get(int(packet), 0.0) + float(delta)
        for packet in sorted(p for p in ring if now - p >= self.most):
            faded += ring.pop(packet) * self.series(self.most) * self.decay ** (now - packet - self.most + 1)
        packets, deltas = list(ring), list(ring.values())
        self.state.update((epoch, now, faded, packets, deltas))
        acc = faded + sum(d * self.series(now - p + 1) for p, d in ring.items())
        level = int(min(255.0, max(0.0, 128.0 + acc * self.contrast)))
        yield pd.DataFrame([{"y": key[0], "x": key[1], "epoch": epoch, "tick": now, "faded": faded, "packets": packets, "deltas": deltas, "acc": acc, "level": level}])

    def close(self) -> None:
        pass


def packet_deltas(events: DataFrame, cfg: PreviewConfig = PreviewConfig(), sensor: Sensor = Sensor(), epoch: int = 0) -> DataFrame:
    """y, x, packet_id, delta, epoch of the events inside the sensor: a row an event."""
    return events.where(in_bounds(sensor.width, sensor.height)).select("y", "x", "packet_id", polarity(cfg.step).alias("delta"), F.lit(epoch).cast("long").alias("epoch"))


def folded(rows: pd.DataFrame, decay: float, most: int) -> pd.DataFrame:
    """DELTAS rows with one a pixel for all packets that have left its ring by its last one: they only fade, so they may stand at the
    latest packet that has left."""
    left = rows.groupby(["y", "x", "epoch"])["packet_id"].transform("max") - most
    gone = (left - rows["packet_id"]).clip(lower=0)
    rows = rows.assign(packet_id=rows["packet_id"] + gone, delta=rows["delta"] * decay**gone)
    return rows.groupby(["y", "x", "packet_id", "epoch"], as_index=False)["delta"].sum()[["y", "x", "packet_id", "delta", "epoch"]]


def fold(batches: Iterator[pd.DataFrame], decay: float, most: int) -> Iterator[pd.DataFrame]:
    """All rows folded, FOLD in memory at once: what a task sends goes by its pixels, not by its events."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= FOLD:
            held = [folded(pd.concat(held), decay, most)]
            n = len(held[0])
            if n > FOLD // 2:
                yield held[0]
                held, n = [], 0
    if n:
        yield folded(pd.concat(held), decay, most)


def decaying_preview(deltas: DataFrame, cfg: PreviewConfig = PreviewConfig()) -> DataFrame:
    """Pixels that changed in a micro-batch, as of their latest packet. Needs the RocksDB state store."""
    decay, most = float(cfg.decay), cfg.max_packets
    deltas = deltas.select("y", "x", "packet_id", "delta", "epoch").mapInPandas(lambda batches: fold(batches, decay, most), DELTAS)
    return deltas.groupBy("y", "x").transformWithStateInPandas(statefulProcessor=DecayingPixel(float(cfg.decay), cfg.max_packets, float(cfg.contrast)), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def preview_frame(pixels: DataFrame, cfg: PreviewConfig = PreviewConfig(), order: str = "batch") -> DataFrame:
    """y, x, acc, level of the latest epoch after its last packet, from all that decaying_preview gave, by the order in which it came."""
    newest = pixels.agg(F.max(F.struct("epoch", "tick")).alias("last")).select("last.*").toDF("__epoch", "__last")
    latest = Window.partitionBy("y", "x").orderBy(F.desc(order))
    rows = pixels.withColumn("__nth", F.row_number().over(latest)).where("__nth = 1").join(F.broadcast(newest), F.col("epoch") == F.col("__epoch"))
    d = float(cfg.decay)
    series = (lambda n: n.cast("double")) if d == 1.0 else lambda n: (1.0 - F.pow(F.lit(d), n)) / (1.0 - d)

    def weight(packet):
        gone = F.greatest(F.lit(0), F.col("__last") - packet - (cfg.max_packets - 1))
        return F.pow(F.lit(d), gone) * series(F.col("__last") - packet - gone + 1)

    held = F.aggregate(F.zip_with("packets", "deltas", lambda p, v: v * weight(p)), F.lit(0.0), lambda a, v: a + v)
    acc = F.col("faded") * F.pow(F.lit(d), F.col("__last") - F.col("tick")) + held
    return rows.select("y", "x", acc.alias("acc")).withColumn("level", quantize(128.0 + F.col("acc") * float(cfg.contrast)))
