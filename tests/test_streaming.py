"""Streams replayed from files against the batch operators."""

import os
import socket
import termios
import threading
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evstream import queries as engine
from evstream.config import PreviewConfig, RecordingConfig
from evstream.operators import frames, recording, windows
from evstream.sources.adapter import camera_events
from evstream.sources.live import ByteSource, LiveReader, stream_live
from evstream.sources.packets import encode_packet, explode_packets, generate_capture, read_packets, stream_packets
from evstream.streaming.buffer import OUTPUT, PacketBuffer, buffered
from evstream.streaming import preview, ticks
from evstream.streaming.preview import DecayingPixel, decaying_preview, packet_deltas, preview_frame
from evstream.streaming.recorder import Pace, PublishingService, Recorder, RecordingService
from evstream.streaming.replay import replay, replayed_packets
from evstream.streaming.window import Epochs, TrailingWindow


@pytest.fixture
def captures(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        generate_capture(str(folder / f"{k}.bin"), packets=2, events=6, seed=k)
    (folder / "3.bin").write_bytes(encode_packet([]))
    return str(folder)


def run(query):
    query.awaitTermination(90)
    assert not query.isActive


def test_recording_a_stream_is_recording_the_batch(spark, captures, tmp_path):
    service, path = RecordingService(), str(tmp_path / "rec")
    packets = stream_packets(spark, captures)
    cfg = RecordingConfig(path=path)
    assert service.start_recording(packets, cfg, str(tmp_path / "cp"), processingTime="100 milliseconds")
    assert not service.start_recording(packets, cfg, str(tmp_path / "cp2"))
    service.query.processAllAvailable()
    assert service.stop() and not service.stop()
    assert not service.start_recording(packets, cfg, str(tmp_path / "cp3"))  # the folder is there
    got = spark.read.parquet(f"{path}/events").drop("batch").orderBy("event_idx").collect()
    want = recording.record(explode_packets(read_packets(spark, captures)))[0].orderBy("event_idx").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == 36
    rows = spark.read.parquet(f"{path}/packets").orderBy("packet_idx").collect()
    assert [(r.packet_idx, r.event_count) for r in rows] == [(0, 6), (1, 6), (2, 6), (3, 6), (4, 6), (5, 6), (6, 0)]
    assert rows[-1].first_event_t_us == rows[-1].last_event_t_us == -1


def test_buffers(spark, tmp_path):
    rows = [("a", k, t, k * 1000, 3) for k, t in enumerate([0, 900, 100, 1000])]
    folder = str(tmp_path / "heads")
    spark.createDataFrame(rows, "sensor string, packet_id long, latest long, arrival_us long, events long").write.parquet(folder)
    stream = spark.readStream.schema("sensor string, packet_id long, latest long, arrival_us long, events long").parquet(folder)
    for name, df, packets in (("event", buffered(stream, 500, by="event"), 3), ("arrival", buffered(stream, 1000), 2), ("capped", buffered(stream, 10**9, 1), 1)):
        run(df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
        assert [(r.packets, r.newest_packet) for r in spark.table(name).collect()] == [(packets, 3)]
    assert PacketBuffer(1, 1).keep([]) == []


@pytest.mark.parametrize("by", ["arrival", "event"])
@pytest.mark.parametrize("most", [0, 7])
def test_a_buffer_is_what_packets_leave_one_by_one(by, most):
    """Against a list that is gone through after every packet, over batches, with times in no order."""
    rng, buffer, held, want = np.random.default_rng(most), PacketBuffer(40, most, by), [], []
    for start in range(0, 300, 60):
        new = [(start + k, int(rng.integers(0, 100)) + start, int(rng.integers(0, 100)) + start, 1) for k in range(60)]
        for packet in new:
            want.append(packet)
            if by == "event":
                want = want[next(k for k, p in enumerate(want) if p[1] >= packet[1] - 40) :]
            else:
                want = [p for p in want if p[2] >= max(q[2] for q in want) - 40]
            want = want[-most:] if most else want
        held = buffer.keep(held, new)
        assert held == want


@pytest.mark.parametrize("by", ["arrival", "event"])
def test_a_buffer_of_many_packets_takes_time_in_proportion(by):
    begun = time.process_time()
    assert len(PacketBuffer(10**9, 0, by).keep([], [(k, k, k, 1) for k in range(100_000)])) == 100_000
    assert time.process_time() - begun < 20  # a list gone through after every packet: minutes


def test_a_buffer_empties_by_the_clock(spark, tmp_path):
    """No packet comes after the first three: they leave all the same, also when the stream is stopped and started between."""
    schema, folder = "sensor string, packet_id long, latest long, arrival_us long, events long", str(tmp_path / "heads")
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)

    def start():
        found = buffered(stream, 20_000_000, by="clock").writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"))
        return found.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    def held():
        rows = spark.read.schema(OUTPUT).parquet(f"{tmp_path}/out").orderBy("tick").collect() if os.path.exists(tmp_path / "out") else []
        return [(r.packets, r.oldest_packet) for r in rows]

    def until(done, seconds=80):
        end = time.time() + seconds
        while not done() and time.time() < end:
            time.sleep(0.3)
        assert done(), held()

    query = start()
    now = int(time.time() * 1e6)
    spark.createDataFrame([("a", k, 0, now + k * 6_000_000 - 12_000_000, 1) for k in range(3)], schema).write.mode("append").parquet(folder)
    until(lambda: (3, 0) in held() or (2, 1) in held())
    query.stop()
    assert held()[-1][0] > 0
    query = start()
    until(lambda: held()[-1] == (0, None))
    query.stop()
    assert [h for h in held() if h[0] == 1] == [(1, 2)]  # they left one by one


@pytest.mark.parametrize("files", [1, 3])
def test_the_preview_of_a_stream_is_that_of_the_table(spark, captures, tmp_path, files):
    cfg = PreviewConfig(max_packets=2)
    events = explode_packets(replayed_packets(spark, captures, batches=files))
    pixels = replay(decaying_preview(packet_deltas(events, cfg), cfg), "update")
    numbered = explode_packets(read_packets(spark, captures)).withColumn("packet_id", F.dense_rank().over(Window.orderBy("packet_id")))
    got = {(r.y, r.x): (r.acc, r.level) for r in preview_frame(pixels, cfg).collect()}
    want = {(r.y, r.x): (r.acc, r.level) for r in frames.decay_frame(numbered, cfg).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    assert pixels.agg(F.max(F.size("packets"))).first()[0] <= 2


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_ticks_of_a_stream_are_those_of_the_table(spark, tmp_path, batches):
    rng = np.random.default_rng(5)
    t = np.sort(rng.choice(4_000_000, 300, replace=False))
    t = t[(t < 1_200_000) | (t > 2_100_000)]  # a gap longer than a window
    rows = [("a", int(k), int(x)) for k, x in enumerate(t)] + [("b", int(k), int(x) + 7) for k, x in enumerate(t[::3])]
    events = spark.createDataFrame(rows, "sensor string, ord long, t_us long")
    folder = tmp_path / "in"
    for k in range(batches):  # files in order, the times inside a batch in none
        lo, hi = t[len(t) * k // batches], t[len(t) * (k + 1) // batches] if k + 1 < batches else 10**9
        events.where((F.col("t_us") >= int(lo)) & (F.col("t_us") < int(hi))).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = replay(ticks.tick_windows(stream, 33_333, 100_000, "100 milliseconds")).collect()
    clock = (int(t.max()) + 7) // 1000 * 1000 - 100_000
    for sensor in ("a", "b"):
        want = windows.tick_windows(events.where(F.col("sensor") == sensor), 33_333, 100_000).where(F.col("tick") * 33_333 <= clock).collect()
        assert sorted((r.tick, r.ord, r.t_us) for r in got if r.sensor == sensor) == sorted((r.tick, r.ord, r.t_us) for r in want) and len(want) > 100
    assert (len({r.batch for r in got}) > 1) == (batches > 1)


def test_ticks_where_the_tables_times_go_back(spark, tmp_path):
    """Two copies of a table, one after the other: events of the second are as old as those of the first."""
    own = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    own.unionByName(own.withColumn("event_id", F.col("event_id") + 1000)).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # some capture files, so some micro-batches
    try:
        got = engine.QUERIES["stream_tick_windows"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    events = camera_events(spark, str(tmp_path))
    clock = events.agg(F.max("t_us")).first()[0] // 1000 * 1000 - 1_000_000
    want = engine.QUERIES["tick_windows"](spark, str(tmp_path)).where(F.col("tick") * 33_333 <= clock).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 80


def test_ticks_of_events_at_time_0(spark, tmp_path):
    """A watermark begins at 0 too: an event of microsecond 0 is not late, and no tick is over before the stream has begun."""
    own = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    first = F.when(F.col("event_id") < 3, F.lit("2024-01-01 00:00:00.4").cast(own.schema["ts"].dataType)).otherwise(F.col("ts"))
    own.withColumn("ts", first).write.parquet(f"{tmp_path}/events.parquet")
    got = engine.QUERIES["stream_tick_windows"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = db.sql(engine.ORACLES["stream_tick_windows"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and min(want) == (0, 3, 0, 0)


def test_ticks_of_batches_that_meet_at_time_0(spark, tmp_path):
    batches = [[-250_000, -66_666, -40_000, -7, 0], [0, 0, 5, 33_333, 90_000, 400_000]]
    for k, times in enumerate(batches):
        rows = [("a", 10 * k + i, t) for i, t in enumerate(times)]
        spark.createDataFrame(rows, "sensor string, ord long, t_us long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema("sensor string, ord long, t_us long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = replay(ticks.tick_windows(stream, 33_333, 100_000, "100 milliseconds")).collect()
    t, want = np.concatenate(batches), []
    for tick in range(-10, 300_000 // 33_333 + 1):
        upto = t[t <= tick * 33_333]
        if (upto > (tick - 5) * 33_333).any():
            want += [(tick, x) for x in upto[upto >= upto.max() - 100_000]]
    assert sorted((r.tick, r.t_us) for r in got) == sorted(want) and sum(r.tick == 0 and r.t_us == 0 for r in got) == 3
    assert len({r.batch for r in got}) > 1


def test_a_key_of_the_ticks_is_a_slot():
    """However many events a sensor has, a key has those of one tick, in rows of bounded size, and of later slots one number each."""
    slots, rng = ticks.Slots(100, 250), np.random.default_rng(3)
    t, sensor = rng.integers(0, 1000, 9000), rng.choice(np.array(["a", None], object), 9000)
    batch = pa.RecordBatch.from_pydict({"sensor": pa.array(sensor, pa.string()), "ord": np.arange(9000), "t_us": t})
    rows = pa.Table.from_batches(slots.parts(iter([batch]))).to_pylist()
    found = []
    for r in rows:
        if r["t_us"] is None:
            own = t[(sensor == r["sensor"]) & (-(-t // 100) == r["tick"])]
            assert r["slot"] < r["tick"] <= r["slot"] + slots.span and r["newest"] == own.max()
            continue
        times, ords = np.frombuffer(r["t_us"], np.int64), np.frombuffer(r["ord"], np.int64)
        assert len(times) <= ticks.CHUNK and set(-(-times // 100)) == {r["slot"]} == {r["tick"]} and times.max() == r["newest"] and (t[ords] == times).all()
        found += [(r["sensor"], o) for o in ords]
    assert sorted(o for _, o in found) == list(range(9000)) and all(sensor[o] == s for s, o in found)


def test_live_packets_over_a_socket(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))
    data = b"noise" + encode_packet([(1, 0, 0, 1, 2, 3)]) + b"EV" + encode_packet([(0, 0, 0, 2, 4, 5)] * 3) + encode_packet([(1, 1, 1, 1, 1, 1)])[:-1]

    def serve():
        peer, _ = server.accept()
        for k in range(0, len(data), 7):  # packets arrive in pieces
            peer.sendall(data[k : k + 7])
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    packets = stream_live(spark, f"tcp://127.0.0.1:{server.getsockname()[1]}", timeout_s=2)
    query = packets.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.event_count for r in spark.table("live").collect()) == [1, 3]


def test_live_reader_replays_until_committed(tmp_path):
    pipe = str(tmp_path / "pipe")
    os.mkfifo(pipe)
    reader = LiveReader({"path": pipe, "timeout": "0.5", "maxPackets": "2"})
    reader.source = ByteSource(pipe)
    with open(pipe, "wb", buffering=0) as out:
        out.write(encode_packet([(1, 0, 0, 1, 2, 3)]) * 3)
        rows, end = reader.read({"packets": 0})
        assert end == {"packets": 2} and len(list(rows)) == 2
        assert [r[1] for r in reader.readBetweenOffsets({"packets": 0}, end)] == [0, 1]
        reader.commit(end)
        rows, end = reader.read(end)
        assert [r[1] for r in rows] == [2]
        assert reader.read(end)[1] == end  # a timeout


def test_live_numbers_go_on_after_a_restart(tmp_path):
    pipe = str(tmp_path / "pipe")
    os.mkfifo(pipe)
    reader = LiveReader({"path": pipe, "timeout": "0.5", "maxPackets": "50"})
    reader.source = ByteSource(pipe)
    with open(pipe, "wb", buffering=0) as out:
        out.write(encode_packet([(1, 0, 0, 1, 2, 3)]) * 4)
        assert list(reader.readBetweenOffsets({"packets": 3}, {"packets": 5})) == []  # read before the restart
        rows, end = reader.read({"packets": 5})
        assert end == {"packets": 9} and [r[1] for r in rows] == [5, 6, 7, 8]


def test_a_serial_port_is_set_and_flushed():
    main, port = os.openpty()
    name = os.ttyname(port)
    os.write(main, b"stale")
    source = ByteSource(name, 57_600)
    iflag, _, cflag, lflag, ispeed, ospeed, _ = termios.tcgetattr(source.fd)
    assert cflag & termios.CSIZE == termios.CS8 and not cflag & (termios.PARENB | termios.CSTOPB | termios.CRTSCTS)
    assert not iflag & (termios.IXON | termios.IXOFF) and not lflag & (termios.ICANON | termios.ECHO) and ospeed == termios.B57600
    os.write(main, b"EVT1\x00")
    assert source.read(2.0) == b"EVT1\x00"
    with pytest.raises(ValueError, match="baud"):
        ByteSource(name, 12_345)


def test_a_recorder_goes_on_from_its_totals(spark, captures, tmp_path):
    path, cfg = str(tmp_path / "rec"), RecordingConfig()
    files = sorted(os.listdir(captures))
    batches = [read_packets(spark, f"{captures}/{f}") for f in files]
    recorder = Recorder(spark, path, cfg)
    for k in (0, 1, 1):  # a batch that runs again replaces itself
        recorder.write(batches[k], k)
    Recorder(spark, path, cfg).write(batches[1], 1)
    again = Recorder(spark, path, cfg)
    assert again._before(2) == (4, 24) and again._before(1) == (2, 12) and again._before(0) == (0, 0)
    again.write(batches[2], 2)
    rows = spark.read.parquet(f"{path}/packets").orderBy("packet_idx").collect()
    assert [(r.packet_idx, r.start_event_idx) for r in rows] == [(k, 6 * k) for k in range(6)]
    assert spark.read.parquet(f"{path}/events").select("event_idx").distinct().count() == 36


def test_trailing_window_over_micro_batches(spark, tmp_path):
    rows = [(k, k * 10_000) for k in range(60)]
    events = spark.createDataFrame(rows, "ord long, t_us long")
    window = TrailingWindow(f"file://{tmp_path}/w", 100.0)
    for n, (a, b) in enumerate([(0, 5), (5, 30), (30, 30), (30, 60), (30, 60)]):
        number = min(n, 3)  # the last runs again
        got = window.advance(events.where(F.col("ord").between(a, b - 1)), number).collect()
        upto = [t for k, t in rows if k < b]
        assert sorted(r.t_us for r in got) == [t for t in upto if t >= max(upto) - 100_000]
    assert sorted(p.name for p in (tmp_path / "w").iterdir() if p.name.startswith("batch")) == ["batch-2", "batch-3"]


def test_pace_is_anchored_where_a_frame_was_due():
    now = [0.0]
    pace, due = Pace(10.0, lambda: now[0]), []
    for t in (0.0, 0.05, 0.1, 0.35, 0.4, 0.44, 0.46):  # late by 0.15 at 0.35: no frames are made up for
        now[0] = t
        due.append(pace.due())
    assert due == [True, False, True, True, False, False, True]


class Value:
    """A value state, or a handle that gives it."""

    held = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


@pytest.mark.parametrize("decay", [0.9, 1.0])
@pytest.mark.parametrize("most", [1, 4])
def test_a_pixel_is_what_its_ticks_add_up_to(decay, most):
    """Batches of packets, some late, against every tick fading what there is and adding the whole buffer."""
    pixel, rng, seen = DecayingPixel(decay, most, 10.0), np.random.default_rng(most), {}
    pixel.init(Value())
    for start in (0, 3, 10, 40, 41):
        packets = start + rng.integers(0, 9, 12) - rng.integers(0, 3, 12)
        batch = pd.DataFrame({"y": 1, "x": 2, "packet_id": packets, "delta": rng.normal(size=12), "epoch": 0})
        for p, d in zip(batch.packet_id, batch.delta):
            seen[p] = seen.get(p, 0.0) + d
        (out,) = pixel.handleInputRows((1, 2), iter([batch.iloc[:5], batch.iloc[5:]]), None)
        acc = 0.0
        for tick in range(min(seen), max(seen) + 1):
            acc = acc * decay + sum(d for p, d in seen.items() if tick - most < p <= tick)
        assert out.tick[0] == max(seen) and abs(out.acc[0] - acc) < 1e-9 and len(out.packets[0]) <= most


@pytest.mark.parametrize("decay", [0.9, 1.0])
def test_what_goes_to_a_pixel_is_its_ring_and_one_sum(decay, monkeypatch):
    """Of 20,000 events of 4 pixels, at most 5 rows each go to the state, and the pixels are what all events make them."""
    monkeypatch.setattr(preview, "FOLD", 1000)
    rng, n, most = np.random.default_rng(1), 20_000, 4
    rows = pd.DataFrame({"y": rng.integers(0, 2, n), "x": rng.integers(0, 2, n), "packet_id": np.arange(n) // 64, "delta": rng.normal(size=n), "epoch": 0})
    sent = pd.concat(preview.fold((rows[k : k + 300] for k in range(0, n, 300)), decay, most))
    assert len(sent) <= 4 * (most + 1)
    for at, all_rows in rows.groupby(["y", "x"]):
        found = []
        for given in (all_rows, sent[(sent.y == at[0]) & (sent.x == at[1])]):
            pixel = DecayingPixel(decay, most, 10.0)
            pixel.init(Value())
            (out,) = pixel.handleInputRows(at, iter([given]), None)
            found.append(out.iloc[0])
        assert found[0].tick == found[1].tick and abs(found[0].acc - found[1].acc) < 1e-9 and found[0].packets == found[1].packets


def test_an_epoch_outdates_a_pixel():
    pixel, row = DecayingPixel(0.5, 3, 10.0), lambda packet, delta, epoch: iter([pd.DataFrame({"packet_id": [packet], "delta": [delta], "epoch": [epoch]})])
    pixel.init(Value())
    (one,) = pixel.handleInputRows((1, 2), row(5, 1.0, 0), None)
    (two,) = pixel.handleInputRows((1, 2), row(6, 1.0, 1), None)
    assert one.acc[0] == two.acc[0] == 1.0 and two.epoch[0] == 1
    assert list(pixel.handleInputRows((1, 2), row(7, 1.0, 0), None)) == []  # of the epoch before
    (three,) = pixel.handleInputRows((1, 2), row(7, 1.0, 1), None)
    assert three.acc[0] == 1.0 * 0.5 + 2.0


def test_a_start_after_a_stop_begins_empty(spark, captures, tmp_path):
    """The window, and the preview by the epoch that a start gives its rows."""
    window, service, seen = TrailingWindow(f"file://{tmp_path}/w", 10_000.0), PublishingService(), []

    def publish(**more):
        assert service.start_publishing(stream_packets(spark, captures), lambda ev: ev, lambda frame, n: seen.append(frame.count()), str(tmp_path / "cp"), window=window, pace=Pace(1e6), **more)
        service.query.processAllAvailable()
        assert service.stop()

    publish()
    generate_capture(f"{captures}/4.bin", packets=2, events=6, seed=4)
    publish()
    generate_capture(f"{captures}/5.bin", packets=2, events=6, seed=5)
    publish(resume=True)  # as after a failure: what was held is held
    assert seen == [12, 24, 36, 36, 12, 24]
    with pytest.raises(FileNotFoundError, match="batch-8"):
        window.advance(spark.createDataFrame([(1, 1)], "ord long, t_us long"), 9)
    epochs = Epochs(f"file://{tmp_path}/epochs")
    assert [epochs.current(spark), epochs.begin(spark), epochs.begin(spark), epochs.current(spark)] == [0, 1, 2, 2]


def test_publishing_a_trailing_window(spark, captures, tmp_path):
    seen, service = [], PublishingService()
    window = TrailingWindow(f"file://{tmp_path}/w", 10_000.0)
    assert service.start_publishing(stream_packets(spark, captures), lambda ev: ev, lambda frame, n: seen.append(frame.count()), str(tmp_path / "cp"), window=window, pace=Pace(1e6))
    service.query.processAllAvailable()
    assert service.stop() and seen == [12, 24, 36, 36]  # the window reaches over all batches


def test_publishing(spark, captures, tmp_path):
    seen, service = [], PublishingService()
    assert service.start_publishing(stream_packets(spark, captures), frames.mono_frame, lambda frame, n: seen.append((n, frame.count())), str(tmp_path / "cp"))
    service.query.processAllAvailable()
    assert service.stop() and [n for n, _ in seen] == list(range(len(seen))) and any(c for _, c in seen)
