"""Captured packet streams as a Python data source, batch and streaming, and a generator of such captures.

A packet is a magic, two little-endian 32-bit numbers (events, payload bytes) and 12 bytes an event: six
little-endian 16-bit numbers. Bytes between packets are skipped up to the next magic. A header whose
numbers disagree is skipped (mode PERMISSIVE: scanning goes on behind it) or ends the read with an error
(FAILFAST). A packet cut off by the end of a file is not emitted.

A file of over split_bytes is read in ranges, each by a task of its own. Where a range's first packet begins is known only
from the packets before it, so every range is first parsed from its own first magic, as if nothing reached into it
(parse_range); settle then follows each file from range to range and finds, from where the scan of the range before ends,
which of the headers met stand in the scan of the whole file. That is all of them but for magics inside a payload
that crosses a border; only there a few headers are read once more, up to the place where both scans agree. Numbers are
sums over the ranges before. The payloads are then read at the places found, without looking at headers again.
"""

from __future__ import annotations

import os
import random
import struct
import uuid
import warnings
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from ..functions.scalars import int_div
from ..scratch import scratch_path

MAGIC = b"EVT1"
HEADER = struct.Struct("<LL")
EVENT_BYTES = 12
MAX_EVENTS = 8192
SPLIT_BYTES = 256 << 20
BATCH_EVENTS = 1 << 17
SCHEMA = "file string, packet_id long, event_count long, payload_len long, events array<struct<type:int,sec:int,ms:int,us:int,x:int,y:int>>"
FIELDS = ("type", "sec", "ms", "us", "x", "y")


def decode_packets(data: bytes, mode: str = "PERMISSIVE") -> Iterator[tuple[int, np.ndarray]]:
    """(position, events[n, 6]) of every whole packet in data."""
    pos = 0
    while (at := data.find(MAGIC, pos)) >= 0:
        body = at + len(MAGIC) + HEADER.size
        if body > len(data):
            return
        count, length = HEADER.unpack_from(data, at + len(MAGIC))
        if length != count * EVENT_BYTES:
            if mode.upper() == "FAILFAST":
                raise ValueError(f"packet at byte {at}: {length} payload bytes for {count} events")
            pos = body
            continue
        if body + length > len(data):
            return
        yield at, np.frombuffer(data, "<u2", count * 6, body).reshape(count, 6)
        pos = body + length


def encode_packet(events: Iterable[tuple[int, int, int, int, int, int]]) -> bytes:
    rows = np.asarray(events if isinstance(events, np.ndarray) else list(events)).astype("<u2").reshape(-1, 6)
    return MAGIC + HEADER.pack(len(rows), len(rows) * EVENT_BYTES) + rows.tobytes()


def generate_capture(path: str, packets: int = 10, events: int = 100, seed: int = 0) -> None:
    """Write a capture as the device would: batches of at most MAX_EVENTS events, none empty."""
    rng, t = random.Random(seed), 0
    with open(path, "wb") as out:
        for _ in range(packets):
            rows = []
            for _ in range(min(events, MAX_EVENTS)):
                t += rng.randint(0, 200)
                rows.append((rng.randint(0, 1), t // 1_000_000, t // 1000 % 1000, t % 1000, rng.randint(0, 319), rng.randint(0, 319)))
            if rows:
                out.write(encode_packet(rows))


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme or uri.startswith("/") else os.path.abspath(uri))


def _files(uri: str) -> list[tuple[str, int, int]]:
    """Path, size and time of change of a file or of all files below a folder."""
    system, path = _open(uri)
    info = system.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [(path, info.size, info.mtime_ns or 0)]
    infos = system.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((i.path, i.size, i.mtime_ns or 0) for i in infos if i.type == pafs.FileType.File and "/_temporary/" not in i.path)


def capture_files(uri: str) -> list[tuple[str, int]]:
    """Path and size of the capture files below a folder, by name."""
    return [(path, size) for path, size, _ in _files(uri)]


class _Bytes:
    """Random access to a file with a bounded read-ahead."""

    AHEAD = 1 << 20

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, self.AHEAD), self.size - at))
        return self.held[at - self.at : at - self.at + n]

    def hop(self, at: int, n: int) -> bytes:
        """A few bytes without reading ahead."""
        if self.at <= at <= at + n <= self.at + len(self.held):
            return self.get(at, n)
        self.file.seek(at)
        self.at, self.held = at, self.file.read(max(n, len(MAGIC) + HEADER.size))
        return self.held[:n]

    def find(self, mark: bytes, at: int, end: int | None = None) -> int:
        """The first place from at on, and before end, where mark stands; -1 if there is none."""
        if self.hop(at, len(mark)) == mark:
            return at
        while at + len(mark) <= self.size and (end is None or at < end):
            data = self.get(at, self.AHEAD)
            if (found := data.find(mark)) >= 0:
                return at + found if end is None or at + found < end else -1
            at += len(data) - len(mark) + 1
        return -1


def scan_packets(file, size: int, mode: str = "PERMISSIVE", start: int = 0, end: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number, events[n, 6]) of the packets that begin in a range of a file, numbered within the file.

    Packets before the range are hopped over by their lengths, so that every range finds the packets and the numbers
    that a scan of the whole file finds. Memory is a packet and the read-ahead.
    """
    data, pos, number, head = _Bytes(file, size), 0, 0, len(MAGIC) + HEADER.size
    while (at := data.find(MAGIC, pos)) >= 0 and (end is None or at < end):
        body = at + head
        if body > size:
            return
        count, length = HEADER.unpack(data.hop(at, head)[len(MAGIC) :])
        if length != count * EVENT_BYTES:
            if mode.upper() == "FAILFAST":
                raise ValueError(f"packet at byte {at}: {length} payload bytes for {count} events")
            pos = body
            continue
        if body + length > size:
            return
        if at >= start:
            yield number, np.frombuffer(data.get(body, length), "<u2", count * 6).reshape(count, 6)
        number += 1
        pos = body + length


HEAD = 16  # headers of a range that settling looks at before it parses the range itself
INDEX_ROWS = 1 << 16  # headers in a row of an index
DISAGREES, CUT_OFF = -1, -2  # in the place of a count: the header's numbers disagree, the file ends inside the packet


@dataclass
class RangeHeaders:
    """What a scan from begin meets before end: places of magics, their events (or DISAGREES or CUT_OFF), and where the scan goes on."""

    places: np.ndarray
    counts: np.ndarray
    exit: int


def parse_range(data: _Bytes, begin: int, end: int, joins: Callable[[int], bool] = lambda pos: False) -> RangeHeaders:
    """Parse headers from begin to end, or to a place at which the scan joins another one."""
    places, counts, pos, head = array("q"), array("q"), begin, len(MAGIC) + HEADER.size
    while pos < end and not joins(pos):
        if (at := data.find(MAGIC, pos, end)) < 0:
            pos = end
            break
        body, count, length = at + head, CUT_OFF, 0
        if body <= data.size:
            count, length = HEADER.unpack(data.hop(at, head)[len(MAGIC) :])
            if length != count * EVENT_BYTES:
                count, length = DISAGREES, 0
            elif body + length > data.size:
                count = CUT_OFF
        places.append(at)
        counts.append(count)
        pos = data.size if count == CUT_OFF else body + length
    return RangeHeaders(np.array(places), np.array(counts), pos)


def _after(place: int, count: int) -> int:
    return place + len(MAGIC) + HEADER.size + EVENT_BYTES * max(0, count)


def settle(ranges: Iterable[dict], file: Callable[[], _Bytes]) -> Iterator[dict]:
    """Which headers of a file's ranges the scan of the whole file meets, from the ranges in order, each as parsed on its own.

    Of a range: begin, end, headers (how many), packets, exit, and the first HEAD places and counts. Given of each: skip (of its headers,
    those that do not count), dropped (packets among them), own places and counts that come before, and the number of its first packet.
    """
    entry, number = 0, 0
    for r in ranges:
        found = {"skip": r["headers"], "dropped": r["packets"], "own_places": [], "own_counts": [], "first": number}
        if entry < r["end"]:
            # the scan of the whole file comes to header k, as the range's own did, if it enters between the header before and it
            gaps = list(zip([r["begin"], *map(_after, r["places"], r["counts"])], [*r["places"], r["end"]]))
            if r["headers"] > len(r["places"]) or CUT_OFF in r["counts"]:
                gaps.pop()  # what comes after the last place given is not known, or never looked at
            where = lambda pos: next((k for k, (low, high) in enumerate(gaps) if low <= pos <= high), None)
            own, exit = RangeHeaders(np.zeros(0, int), np.zeros(0, int), entry), r["exit"]
            if where(entry) is None:
                own = parse_range(file(), entry, r["end"], lambda pos: where(pos) is not None)
            if own.exit < r["end"] and (k := where(own.exit)) is not None:
                found |= {"skip": k, "dropped": sum(c >= 0 for c in r["counts"][:k])}
            else:
                exit = own.exit
            found |= {"own_places": own.places.tolist(), "own_counts": own.counts.tolist()}
            number += int((own.counts >= 0).sum()) + r["packets"] - found["dropped"]
            entry = exit
        yield found


EVENT = pa.struct([(f, pa.int32()) for f in FIELDS])
ARROW = pa.schema([("file", pa.string()), ("packet_id", pa.int64()), ("event_count", pa.int64()), ("payload_len", pa.int64()), ("events", pa.list_(EVENT))])


def _packed(packets: Iterable[tuple[int, np.ndarray]], path: str, number: int) -> Iterator[pa.RecordBatch]:
    """Packets (number within the file, events) as rows, some hundred thousand events a batch."""
    ids, parts, held = [], [], 0

    def batch() -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts], np.int64)
        events = np.concatenate([np.empty((0, 6), "<u2"), *parts]).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(events[:, c])) for c in range(6)], FIELDS))
        return pa.RecordBatch.from_arrays([pa.array([path] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(sizes), pa.array(sizes * EVENT_BYTES), rows.cast(ARROW.field("events").type)], schema=ARROW)

    for k, events in packets:
        ids.append((number << 32) + k)
        parts.append(events)
        held += len(events)
        if held >= BATCH_EVENTS or len(ids) >= 10_000:
            yield batch()
            ids, parts, held = [], [], 0
    yield batch()


def _batches(uri: str, mode: str, path: str, number: int, size: int) -> Iterator[pa.RecordBatch]:
    """The packets of a whole capture file."""
    with _open(uri)[0].open_input_file(path) as file:
        yield from _packed(scan_packets(file, size, mode), path, number)


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PacketReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PacketWriter(self.options)


class CaptureFile(InputPartition):
    def __init__(self, path: str, number: int, size: int) -> None:
        super().__init__(path)
        self.file = path, number, size


class PacketReader(DataSourceReader):
    """A partition for each capture file; ids count packets within a file, files being 2^32 apart. (read_packets splits large files.)"""

    def __init__(self, options) -> None:
        self.uri, self.mode = options["path"], options.get("mode", "PERMISSIVE")

    def partitions(self) -> list[InputPartition]:
        return [CaptureFile(path, k, size) for k, (path, size, _) in enumerate(_files(self.uri))]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return _batches(self.uri, self.mode, *partition.file)


EVENT_ROWS = pa.array([], EVENT)


@dataclass
class CaptureWritten(WriterCommitMessage):
    temporary: str
    final: str


class PacketWriter(DataSourceArrowWriter):
    """A capture file a task, named by its partition; input: rows of packet_id and events. Option noise: what stands before each packet."""

    def __init__(self, options) -> None:
        self.path, self.noise = options["path"], options.get("noise", "").encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> CaptureWritten:
        system, path = _open(self.path)
        part = TaskContext.get().partitionId()
        name = f"{path}/_temporary/{uuid.uuid4().hex}"
        system.create_dir(f"{path}/_temporary", recursive=True)
        with system.open_output_stream(name, compression=None, buffer_size=1 << 20) as out:
            for batch in iterator:
                for events in batch.column("events"):
                    rows = events.values if events.is_valid else EVENT_ROWS
                    fields = [rows.field(f).to_numpy(zero_copy_only=False) for f in FIELDS]
                    out.write(self.noise + encode_packet(np.stack(fields, 1)))
        return CaptureWritten(name, f"{path}/part-{part:06d}.bin")

    def commit(self, messages: list[CaptureWritten | None]) -> None:
        system, path = _open(self.path)
        for m in messages:
            if m:
                system.move(m.temporary, m.final)
        system.delete_dir(f"{path}/_temporary")

    def abort(self, messages: list[CaptureWritten | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m:
                system.delete_file(m.temporary)


class CaptureSource(DataSource):
    """New capture files as a stream; their bytes are read where the files are sent."""

    @classmethod
    def name(cls) -> str:
        return "event_captures"

    def schema(self) -> str:
        return "path string, number long, size long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return CaptureStream(self.options)


class CaptureStream(SimpleDataSourceStreamReader):
    """New capture files of a folder, some a micro-batch, by time of change and name, or with order=name by name.

    The offset names the files taken, with their numbers, so a file is taken once whatever order files come in. With
    maxFileAgeDays (none, unless given), names older than that against the newest file taken are let go, which keeps the
    offset small; a file that comes with so old a time cannot be told from one taken: it is left out, with a warning that names it.
    """

    def __init__(self, options) -> None:
        days = options.get("maxFileAgeDays", None)
        self.uri, self.most, self.age = options["path"], int(options.get("maxFilesPerTrigger", "1")), None if days is None else int(float(days) * 86_400e9)
        self.by_name = options.get("order", "time") == "name"
        self.known: set[str] = set()  # names let go, or told of, by this reader

    def initialOffset(self) -> dict:
        return {"files": 0, "newest": 0, "taken": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        oldest = 0 if self.age is None else start["newest"] - self.age
        files = [f for f in _files(self.uri) if f[0] not in start["taken"]]
        if left := sorted(path for path, _, changed in files if changed < oldest and path not in self.known):
            self.known.update(left)
            warnings.warn(f"older than maxFileAgeDays and not among the names remembered, so not read: {', '.join(left)}", stacklevel=2)
        new = sorted(((changed, path, size) for path, size, changed in files if changed >= oldest), key=lambda f: f[1] if self.by_name else f)[: self.most]
        if not new:
            return iter([]), start
        newest = max(start["newest"], *(changed for changed, _, _ in new))
        kept = {path: own for path, own in start["taken"].items() if self.age is None or own["changed"] >= newest - self.age}
        self.known.update(start["taken"].keys() - kept.keys())
        taken = kept | {path: {"number": start["files"] + k, "size": size, "changed": changed} for k, (changed, path, size) in enumerate(new)}
        end = {"files": start["files"] + len(new), "newest": newest, "taken": taken}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(sorted(((path, f["number"], f["size"]) for path, f in end["taken"].items() if start["files"] <= f["number"] < end["files"]), key=lambda r: r[1]))

    def commit(self, end: dict) -> None:
        pass


INDEX = "path string, number long, size long, k long, begin long, end long, seq int, before long, headers long, packets long, exit long, places array<long>, counts array<long>"
SETTLED = "number long, k long, skip long, dropped long, own_places array<long>, own_counts array<long>, first long"


def index_packets(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The packets' places in capture files, by ranges of split_bytes bytes: an INDEX row for INDEX_ROWS headers of a range, with what
    settling found of it (SETTLED). It is written once, to the shared folder."""
    files = [(p, number, size) for number, (p, size, _) in enumerate(_files(path))]
    tasks = sum(-(-size // split_bytes) for _, _, size in files)
    table = spark.createDataFrame(files, "path string, number long, size long").where("size > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), int_div(F.col("size") - 1, split_bytes))))
    table = table.withColumns({"begin": F.col("k") * split_bytes, "end": F.least(F.col("size"), (F.col("k") + 1) * split_bytes)}).repartition(tasks)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(path)[0].open_input_file(row["path"]) as file:
                    found = parse_range(_Bytes(file, row["size"]), row["begin"], row["end"])
                good = np.concatenate([[0], np.cumsum(found.counts >= 0)])
                starts = range(0, max(1, len(found.places)), INDEX_ROWS)
                rows = [row | {"seq": seq, "before": int(good[at]), "headers": len(found.places), "packets": int(good[-1]), "exit": found.exit, "places": found.places[at : at + INDEX_ROWS], "counts": found.counts[at : at + INDEX_ROWS]} for seq, at in enumerate(starts)]
                yield from _table(rows, INDEX).to_batches()

    def follow(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        with _open(path)[0].open_input_file(rows[0]["path"]) as file:
            found = list(settle(rows, lambda: _Bytes(file, rows[0]["size"])))
        return _table([{"number": r["number"], "k": r["k"]} | f for r, f in zip(rows, found)], SETTLED)

    at = scratch_path(spark, "capture-index")
    table.mapInArrow(parse, INDEX).write.parquet(at)
    index = spark.read.schema(INDEX).parquet(at)
    heads = index.where("seq = 0").withColumns({"places": F.slice("places", 1, HEAD), "counts": F.slice("counts", 1, HEAD)})
    settled = heads.groupBy("number").applyInArrow(follow, SETTLED)  # a row a range, of one file at a time
    return index.join(settled, ["number", "k"]).repartition(tasks, "number", "k", "seq")


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.Table.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))]))


def _placed(data: _Bytes, r: dict, mode: str) -> Iterator[tuple[int, np.ndarray]]:
    """(number, events[n, 6]) of the packets of an index row."""
    skip = max(0, r["skip"] - r["seq"] * INDEX_ROWS)  # of this row's headers
    headers = list(zip(r["places"], r["counts"]))
    number = r["first"] + r["before"] - r["dropped"] + sum(c >= 0 for _, c in headers[:skip])
    own = list(zip(r["own_places"], r["own_counts"]))
    if r["seq"]:
        number += sum(c >= 0 for _, c in own)
    else:
        number, headers, skip = r["first"], [*own, *headers[skip:]], 0
    for place, count in headers[skip:]:
        if count >= 0:
            yield number, np.frombuffer(data.get(place + len(MAGIC) + HEADER.size, count * EVENT_BYTES), "<u2", count * 6).reshape(count, 6)
            number += 1
        elif count == DISAGREES and mode.upper() == "FAILFAST":
            n, length = HEADER.unpack(data.hop(place, len(MAGIC) + HEADER.size)[len(MAGIC) :])
            raise ValueError(f"packet at byte {place}: {length} payload bytes for {n} events")


def _indexed(index: DataFrame, path: str, mode: str) -> DataFrame:
    """The packets at an index's places."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(path)[0].open_input_file(r["path"]) as file:
                    yield from _packed(_placed(_Bytes(file, r["size"]), r, mode), r["path"], r["number"])

    return index.mapInArrow(read, SCHEMA)


def read_packets(spark: SparkSession, path: str, mode: str = "PERMISSIVE", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of capture files. Where a file has over split_bytes bytes, an index of the packets' places is made first, and its ranges are read by tasks of their own."""
    if any(size > split_bytes for _, size, _ in _files(path)):
        return _indexed(index_packets(spark, path, split_bytes), path, mode)
    spark.dataSource.register(PacketSource)
    return spark.read.format("event_packets").option("mode", mode).load(path)


def write_packets(packets: DataFrame, path: str, noise: str = "") -> None:
    """Capture files of packets (packet_id, events), a file a partition: in the order of the partitions' packets."""
    packets.sparkSession.dataSource.register(PacketSource)
    packets.write.format("event_packets").option("noise", noise).mode("append").save(path)


def stream_packets(spark: SparkSession, path: str, mode: str = "PERMISSIVE", files_per_trigger: int = 1, order: str = "time") -> DataFrame:
    """Packets of a folder's capture files as they come, a file a task, numbered as read_packets does by the order in which files were taken."""
    spark.dataSource.register(CaptureSource)
    found = spark.readStream.format("event_captures").option("maxFilesPerTrigger", str(files_per_trigger)).option("order", order).load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _batches(path, mode, *row.values())

    return found.repartition("number").mapInArrow(decode, SCHEMA)


def explode_packets(packets: DataFrame) -> DataFrame:
    """Event rows of packets: packet_id, idx_in_packet, the six fields, t_us and ord (packets, then places in them)."""
    rows = packets.select("packet_id", F.posexplode("events").alias("idx_in_packet", "e")).select("packet_id", "idx_in_packet", "e.*")
    t = F.col("sec").cast("long") * 1_000_000 + F.col("ms") * 1000 + F.col("us")
    return rows.withColumns({"t_us": t, "ord": F.col("packet_id") * MAX_EVENTS + F.col("idx_in_packet")})


def group_packets(events: DataFrame) -> DataFrame:
    """Packets of event rows, the inverse of explode_packets for packets that hold events."""
    fields = F.struct("idx_in_packet", *FIELDS)
    rows = events.groupBy("packet_id").agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    events_only = F.transform("rows", lambda e: F.struct(*(e[f].alias(f) for f in FIELDS)))
    return rows.select("packet_id", F.size("rows").cast("long").alias("event_count"), (F.size("rows") * EVENT_BYTES).cast("long").alias("payload_len"), events_only.alias("events"))
