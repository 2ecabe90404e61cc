"""Captures, point files, recordings and frames on disk."""

import io
import os
import struct
import warnings
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evstream.config import RecordingConfig, Sensor
from evstream.operators import frames
from evstream.sinks import frames as frame_sink
from evstream.sinks.film import read_film, write_film
from evstream.sinks.recording import read_recording, recording_path, write_recording
from evstream.sources import packets as source
from evstream.sources.packets import HEADER, MAGIC, CaptureStream, decode_packets, encode_packet, explode_packets, generate_capture, group_packets, read_packets, scan_packets, write_packets
from evstream.sources.xyt import read_points

A = [(1, 0, 1, 2, 3, 4), (0, 0, 1, 3, 319, 65535)]
B = [(257, 1, 2, 3, 5, 6)]


def test_decoding_survives_junk_bad_headers_and_a_cut_tail():
    bad = MAGIC + HEADER.pack(1, 13)
    data = b"junk" + encode_packet(A) + b"EVT" + bad + encode_packet(B) + encode_packet([]) + encode_packet(A)[:-1]
    assert [e.tolist() for _, e in decode_packets(data)] == [list(map(list, A)), list(map(list, B)), []]
    with pytest.raises(ValueError):
        list(decode_packets(data, "FAILFAST"))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(0, 65535)] * 6), max_size=5), max_size=5), st.binary(max_size=20).filter(lambda b: b"E" not in b))
def test_round_trip_between_junk(packets, junk):
    data = junk + b"".join(encode_packet(p) + junk for p in packets)
    assert [list(map(tuple, e.tolist())) for _, e in decode_packets(data)] == packets


def test_packet_source(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(encode_packet(A) + encode_packet([]))
    (tmp_path / "b.bin").write_bytes(b"xx" + encode_packet(B))
    packets = read_packets(spark, str(tmp_path))
    assert sorted((r.packet_id, r.event_count) for r in packets.collect()) == [(0, 2), (1, 0), (1 << 32, 1)]
    rows = explode_packets(packets)
    assert sorted((r.packet_id, r.idx_in_packet, r.type, r.x, r.y, r.t_us) for r in rows.collect()) == [(0, 0, 1, 3, 4, 1002), (0, 1, 0, 319, 65535, 1003), (1 << 32, 0, 257, 5, 6, 1_002_003)]
    assert sorted(r.event_count for r in group_packets(rows).collect()) == [1, 2]
    with pytest.raises(Exception):
        read_packets(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("step", [7, 64, 1 << 20])
def test_ranges_of_a_file_have_its_packets_and_numbers(step):
    bad = MAGIC + HEADER.pack(1, 13)
    hidden = [(0x5645, 0x3154, 0, 0, 0, 0)]  # a magic inside a payload
    data = b"junk" + encode_packet(A) + b"EVT" + bad + encode_packet(hidden * 3) + encode_packet([]) + b"x" * 99 + encode_packet(B * 40) + encode_packet(A)[:-1]
    want = [(k, e.tolist()) for k, (_, e) in enumerate(decode_packets(data))]
    got = [(k, e.tolist()) for at in range(0, len(data), step) for k, e in scan_packets(io.BytesIO(data), len(data), "PERMISSIVE", at, at + step)]
    assert got == want and len(want) == 4
    with pytest.raises(ValueError):
        list(scan_packets(io.BytesIO(data), len(data), "FAILFAST"))


def ranges_of(data, step):
    """What index_packets makes of a file in memory: its ranges, settled, and how many headers were read for it."""
    reads = []

    class Counting(source._Bytes):
        def hop(self, at, n):
            reads.append(n > len(MAGIC))
            return super().hop(at, n)

    file = lambda: Counting(io.BytesIO(data), len(data))
    rows = []
    for begin in range(0, len(data), step):
        found = source.parse_range(file(), begin, min(len(data), begin + step))
        rows.append({"seq": 0, "before": 0, "begin": begin, "end": min(len(data), begin + step), "headers": len(found.places), "packets": int((found.counts >= 0).sum()), "exit": found.exit, "places": found.places.tolist(), "counts": found.counts.tolist()})
    heads = [r | {c: r[c][: source.HEAD] for c in ("places", "counts")} for r in rows]
    settled = list(source.settle(heads, file))
    return [r | f for r, f in zip(rows, settled)], sum(reads)


def placed(data, rows, mode="PERMISSIVE"):
    return [(k, e.tolist()) for r in rows for k, e in source._placed(source._Bytes(io.BytesIO(data), len(data)), r, mode)]


def whole(data):
    return [(k, e.tolist()) for k, (_, e) in enumerate(decode_packets(data))]


HIDDEN = tuple(int.from_bytes(MAGIC[k : k + 2], "little") for k in (0, 2))
#: Magics inside payloads: a header that agrees (with a packet of its own), one that disagrees, one that reaches past the end.
LURES = [[(*HIDDEN, 1, 0, 12, 0), (9, 9, 9, 9, 9, 9)], [(*HIDDEN, 1, 0, 13, 0)], [(*HIDDEN, 0, 4096, 0, 49152)], [(*HIDDEN, 0, 0, 0, 0)]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(LURES), st.just([]), st.just(A), st.just(B * 9), st.binary(max_size=9), st.just(MAGIC + HEADER.pack(1, 13)), st.just(MAGIC[:2])), max_size=14), st.integers(1, 90), st.integers(0, 30))
def test_ranges_settle_to_the_scan_of_the_whole_file(parts, step, cut):
    data = b"".join(p if isinstance(p, bytes) else encode_packet(p) for p in parts)
    data = data[: len(data) - cut]
    rows, _ = ranges_of(data, step)
    assert placed(data, rows) == whole(data)


def test_headers_are_read_once_at_any_number_of_ranges():
    rng = np.random.default_rng(2)
    data = b"".join(encode_packet(rng.integers(0, 65536, (rng.integers(0, 60), 6))) + (b"noise" if k % 7 == 0 else b"") for k in range(3000)) + encode_packet(A)[:-1]
    _, once = ranges_of(data, len(data))
    for n in (2, 16, 100):
        rows, reads = ranges_of(data, -(-len(data) // n))
        assert reads <= 1.2 * once and placed(data, rows) == whole(data)
    lured = b"".join(encode_packet(LURES[k % 4] * 5) for k in range(3000))  # every border falls into a payload full of false magics
    _, once = ranges_of(lured, len(lured))
    rows, reads = ranges_of(lured, len(lured) // 16 - 1)
    assert reads <= 1.2 * once and placed(lured, rows) == whole(lured)


def test_a_range_that_never_joins_is_parsed_again():
    false = encode_packet([(7, 7, 7, 7, 7, 7)])  # a train of packets inside one payload, parsed by every range but the first
    inner = false * 400
    data = encode_packet(np.frombuffer(inner[: len(inner) // 12 * 12], "<u2").reshape(-1, 6)) + encode_packet(B)
    rows, _ = ranges_of(data, 1000)
    assert placed(data, rows) == whole(data) and len(placed(data, rows)) == 2


@pytest.mark.parametrize("split", [50, 333, 10_000])
def test_captures_read_by_ranges(spark, tmp_path, split):
    rng = np.random.default_rng(split)
    for name in ("a.bin", "b.bin", "empty.bin"):
        parts = [LURES[k % 4] if k % 3 else rng.integers(0, 65536, (rng.integers(0, 9), 6)) for k in range(60)]
        (tmp_path / name).write_bytes(b"" if name == "empty.bin" else b"xx".join(map(encode_packet, parts)))
    want = {(k << 32) + n: e for k, name in enumerate(("a.bin", "b.bin", "empty.bin")) for n, e in whole((tmp_path / name).read_bytes())}
    got = read_packets(spark, str(tmp_path), split_bytes=split).collect()
    assert {r.packet_id: [list(e) for e in r.events] for r in got} == want and len(got) == len(want) == 120
    assert all(r.event_count == len(r.events) and r.payload_len == 12 * r.event_count for r in got)


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_bad_headers_end_the_read_only_if_asked(spark, tmp_path, split):
    (tmp_path / "a.bin").write_bytes(encode_packet(LURES[1] * 9) + MAGIC + HEADER.pack(1, 13) + encode_packet(B))
    assert read_packets(spark, str(tmp_path), split_bytes=split).count() == 2
    with pytest.raises(Exception, match="13 payload bytes for 1 events"):
        read_packets(spark, str(tmp_path), "FAILFAST", split).collect()
    (tmp_path / "a.bin").write_bytes(encode_packet(LURES[1] * 9) + encode_packet(B))  # only a payload looks like a bad header
    assert read_packets(spark, str(tmp_path), "FAILFAST", split).count() == 2


def test_scanning_holds_no_more_than_its_read_ahead(monkeypatch):
    monkeypatch.setattr(source._Bytes, "AHEAD", 64)
    data = (b"y" * 200 + encode_packet(A) + MAGIC[:3]) * 30
    reads = []

    class File(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    assert len(list(scan_packets(File(data), len(data)))) == 30 and max(reads) <= 64


def test_split_captures_and_writing_them(spark, tmp_path):
    capture, out = tmp_path / "c.bin", f"file://{tmp_path}/out"
    generate_capture(str(capture), packets=9, events=5)
    packets = read_packets(spark, str(capture), split_bytes=100)
    assert packets.rdd.getNumPartitions() > 3
    rows = sorted(map(str, packets.drop("file").collect()))
    assert len(rows) == 9
    write_packets(packets.repartitionByRange(3, "packet_id").sortWithinPartitions("packet_id"), out, noise="EVT")
    again = read_packets(spark, out)
    assert sorted(map(str, again.select("event_count", "payload_len", "events").collect())) == sorted(map(str, packets.select("event_count", "payload_len", "events").collect()))
    assert os.listdir(tmp_path / "out") and not (tmp_path / "out/_temporary").exists()


def test_files_are_taken_once_in_any_order(tmp_path):
    def put(name, age):
        (tmp_path / name).write_bytes(encode_packet(A))
        os.utime(tmp_path / name, ns=(0, 2_000_000_000_000_000_000 - age))

    def take(offset):
        rows, end = CaptureStream({"path": str(tmp_path), "maxFilesPerTrigger": "5"}).read(offset)  # a new reader, as after a restart
        return [(os.path.basename(path), number) for path, number, *_ in rows], end

    put("b.bin", 0)
    got, one = take(CaptureStream({"path": str(tmp_path)}).initialOffset())
    assert got == [("b.bin", 0)]
    put("a.bin", 10**9)  # comes late, with an older time
    put("c.bin", 0)
    got, two = take(one)
    assert got == [("a.bin", 1), ("c.bin", 2)] and take(two) == ([], two)
    assert [r[1] for r in CaptureStream({"path": str(tmp_path)}).readBetweenOffsets(one, two)] == [1, 2]
    put("old.bin", 30 * 86_400 * 10**9)
    got, three = take(two)  # no age is too old, unless one is given
    assert got == [("old.bin", 3)] and take(three) == ([], three)
    aged = CaptureStream({"path": str(tmp_path), "maxFilesPerTrigger": "5", "maxFileAgeDays": "7"})
    with pytest.warns(UserWarning, match="old.bin"):
        rows, end = aged.read(two)
    assert not list(rows) and end == two
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert aged.read(two)[1] == two  # told once


def test_recordings_take_level_and_chunk(spark, tmp_path):
    capture = tmp_path / "c.bin"
    generate_capture(str(capture), packets=40, events=500)
    events, sizes = explode_packets(read_packets(spark, str(capture))), []
    for level, chunk in ((1, 100_000), (9, 100_000), (9, 1000)):
        path = tmp_path / f"rec-{level}-{chunk}"
        write_recording(events.coalesce(1), RecordingConfig(path=str(path), compression_level=level, chunk_events=chunk))
        sizes.append(sum(f.stat().st_size for f in path.glob("events/*.parquet")))
    assert sizes[1] < sizes[0] and sizes[2] > sizes[1]
    assert RecordingConfig(compression="none").parquet["compression"] == "none"


def test_point_files(spark, tmp_path):
    good, empty, bad = tmp_path / "g.tsv", tmp_path / "e.tsv", tmp_path / "b.tsv"
    good.write_text("# x y t\n1\t2\t30\n\n4\t5\t6 # last\n")
    empty.write_text("")
    bad.write_text("1\t2\n")
    got = read_points(spark, str(good)).orderBy("ord").collect()
    assert [(r.x, r.y, r.t) for r in got] == [(1, 2, 30), (4, 5, 6)]
    assert read_points(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="three"):
        read_points(spark, str(bad)).collect()


def test_recording(spark, tmp_path):
    capture = tmp_path / "c.bin"
    generate_capture(str(capture), packets=5, events=7)
    path = str(tmp_path / "rec")
    write_recording(explode_packets(read_packets(spark, str(capture))), RecordingConfig(path=path))
    events, packets, meta = read_recording(spark, path)
    assert events.count() == 35 and meta.first().width == 320
    assert [(r.start_event_idx, r.end_event_idx) for r in packets.orderBy("packet_idx").collect()] == [(k * 7, k * 7 + 7) for k in range(5)]
    with pytest.raises(Exception, match="exist"):
        write_recording(explode_packets(read_packets(spark, str(capture))), RecordingConfig(path=path))
    assert recording_path(RecordingConfig()).startswith("raw_events_")


def test_a_film_has_a_file_for_every_frame(spark, tmp_path):
    rows = [("raw", 0, 1, 2, 200), ("filtered", 0, 3, 0, 90), ("raw", 2, 0, 0, 7), ("raw", 2, 3, 2, 255)]
    series = spark.createDataFrame(rows, "side string, frame_idx long, y int, x int, level smallint")
    spine = spark.range(4).selectExpr("id AS frame_idx", "explode(array('raw', 'filtered')) AS side")
    for where in (f"file://{tmp_path}/film", f"{tmp_path}/film2"):
        write_film(series, spine, where, Sensor(3, 4))
        folder = tmp_path / where.rpartition("/")[2]
        assert sorted(f.name for f in folder.iterdir() if f.suffix == ".png") == [f"frame-{k:08d}.png" for k in range(4)]
        assert not (folder / "_temporary").exists()
        assert sorted(tuple(r) for r in read_film(spark, where).collect()) == sorted(rows)
    image = frame_sink.decode_png(open(folder / "frame-00000000.png", "rb"))
    assert image.shape == (4, 6) and image[1, 2] == 200 and image[3, 3] == 90 and image.sum() == 290


def test_png_and_messages(spark, tmp_path):
    ev = spark.createDataFrame([(1, 2, 3, 10)], "type int, x int, y int, t_us long")
    frame = frames.mono_frame(ev)
    image = frame_sink.dense(frame)
    assert image[3, 2] == 255 and (image == 128).sum() == 320 * 320 - 1
    path = tmp_path / "f.png"
    frame_sink.write_png(image, str(path), 2)
    raw = path.read_bytes()
    assert struct.unpack(">II", raw[16:24]) == (640, 640)
    at = raw.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]]), np.uint8).reshape(640, 641)
    assert rows[7, 6] == 255
    assert len(frame_sink.frame_message(frame, 10).first().pixels) == 1
    assert frame_sink.frame_message(frame.where("y < 0"), 10).first().pixels == []
    with pytest.raises(ValueError):
        frame_sink.frame_message(frame, 10, encoding="bgr8")
