"""WARC archives as a PySpark Python data source.

Reading plans one partition for each group of archive files. A reader parses a record's headers first;
filters on record type, URI, digest and other header columns are pushed into it, and a record they
reject is hopped over by its length (uncompressed), its block headers (zstd) or its member (gzip)
without decoding the payload. Option `payload`: full (the default), verify (decode, check and count it,
return none of it) or headers (never decode it).

Writing puts one file a task under `_temporary` and the commit moves those of the tasks that count, so
a task lost and run again leaves no half archive. Every record is a member of its own.

Header values hold no control characters and no spaces at their ends: on writing, those are percent-encoded (an
URL's line break becomes %0D%0A), and they are read back as written. A null URL has no header and is read as null.

A file that ends inside a record (what a lost writer leaves elsewhere) ends the read with an error that names file and position, in
every compression. An empty table of pages makes archives without a response. Of pages, only page_id (of any type), url and html
are read, so that other columns cannot clash.

Paths are URIs that pyarrow's file systems open (file, s3, gs, hdfs); the folder must be shared.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import materialize, scratch_path, small_batches

SCHEMA = "file string, position long, record_id string, record_type string, record_date string, target_uri string, content_type string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Column of a WARC header, by header name in lower case.
HEADERS = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-date": "record_date", "warc-target-uri": "target_uri", "content-type": "content_type", "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to"}
ENDINGS = {"none": ".warc", "gzip": ".warc.gz", "zstd": ".warc.zst"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
BROADCAST_ROWS = 500_000
PAGE, NO_PAGE = "urn:page:", "urn:no-page"  # record ids of pages with an id of any type, percent-encoded, and without
_END = b"\r\n\r\n"
_UNFIT = re.compile(r"[\x00-\x1f\x7f]|^ +| +$")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


class _Window:
    """Random access with one read-ahead buffer."""

    def __init__(self, file, size: int, name: str = "") -> None:
        self.file, self.size, self.name, self.at, self.held = file, size, name, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, 1 << 18), self.size - at))
        return self.held[at - self.at : at - self.at + n]

    def cut(self, at: int) -> ValueError:
        return ValueError(f"{self.name}: the archive ends inside the record at {at}")


def zstd_frame_bytes(window: _Window, at: int) -> int:
    """Length of the zstd frame at a place, from its frame and block headers alone."""
    if window.size - at < 6:
        raise window.cut(at)
    flags = window.get(at, 5)[4]
    single = flags >> 5 & 1
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    last = 0
    while not last:
        if pos + 3 > window.size:
            raise window.cut(at)
        block = int.from_bytes(window.get(pos, 3), "little")
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        last = block & 1
    if (end := pos + 4 * (flags >> 2 & 1)) > window.size:
        raise window.cut(at)
    return end - at


@dataclass
class _Record:
    position: int
    end: int  # of the member in the file
    headers: dict[str, str]
    body: object  # a function that decodes the block


def header_value(value: str) -> str:
    """A value as a header can hold it: control characters, and spaces at the ends, percent-encoded."""
    return _UNFIT.sub(lambda m: quote(m[0], safe=""), value)


def _parse(raw: bytes) -> dict[str, str]:
    """Headers by name in lower case; of a repeated one the first. Folded lines are joined."""
    lines = re.sub("\r\n[ \t]+", " ", raw.decode("utf-8", "replace")).split("\r\n")
    out: dict[str, str] = {}
    for name, _, value in (line.partition(":") for line in lines[1:] if ":" in line):
        out.setdefault(name.strip(" \t").lower(), value.strip(" \t"))
    return out


def _length(headers: dict[str, str], window: _Window, at: int) -> int:
    if not headers.get("content-length", "").isdigit():
        raise ValueError(f"{window.name}: the record at {at} has no length")
    return int(headers["content-length"])


def records(window: _Window, compression: str) -> Iterator[_Record]:
    """All records of a file in order; blocks are decoded only when asked for. A file that ends inside a record is an error that names it."""
    at = 0
    while at < window.size:
        if compression == "none":
            n = 1024
            while (cut := (raw := window.get(at, min(n, window.size - at))).find(_END)) < 0:
                if n > window.size - at:
                    raise window.cut(at)
                n *= 4
            headers, first = _parse(raw[:cut]), at + cut + 4
            length = _length(headers, window, at)
            if first + length + 4 > window.size:
                raise window.cut(at)
            yield _Record(at, first + length + 4, headers, lambda a=first, n=length: window.get(a, n))
            at = first + length + 4
        elif compression == "zstd":
            size = zstd_frame_bytes(window, at)
            inflate, raw, fed = zstandard.ZstdDecompressor().decompressobj(), b"", 0
            while _END not in raw:
                if fed >= size:
                    raise ValueError(f"{window.name}: no end of the headers at {at}")
                n = min(4096, size - fed)
                raw += inflate.decompress(window.get(at + fed, n))
                fed += n
            cut = raw.find(_END)
            headers = _parse(raw[:cut])
            whole = lambda a=at, n=size, c=cut + 4, k=_length(headers, window, at): zstandard.ZstdDecompressor().decompressobj().decompress(window.get(a, n))[c : c + k]
            yield _Record(at, at + size, headers, whole)
            at += size
        else:  # a gzip member's end is known only by inflating it, which is done piece by piece and not kept unless asked for
            inflate, raw, pos = zlib.decompressobj(31), b"", at
            while _END not in raw:
                if inflate.eof:
                    raise ValueError(f"{window.name}: no end of the headers at {at}")
                if pos >= window.size:
                    raise window.cut(at)
                piece = window.get(pos, min(4096, window.size - pos))
                raw += inflate.decompress(piece)
                pos += len(piece)
            headers, cut, state = _parse(raw[: raw.find(_END)]), raw.find(_END) + 4, {"raw": raw}

            def rest(keep: bool, inflate=inflate, state=state, start=pos, at=at) -> int:
                pos = state.setdefault("pos", start)
                parts = [state["raw"]]
                while not inflate.eof:
                    if pos >= window.size:
                        raise window.cut(at)
                    piece = window.get(pos, min(1 << 16, window.size - pos))
                    part = inflate.decompress(piece)
                    pos += len(piece)
                    if keep:
                        parts.append(part)
                state.update(pos=pos, raw=b"".join(parts) if keep else state["raw"])
                return pos - len(inflate.unused_data)

            yield _Record(at, -1, headers, lambda rest=rest, state=state, c=cut, n=_length(headers, window, at): (rest(True), state["raw"][c : c + n])[1])
            at = rest(False)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


class WarcFiles(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what header columns alone decide; Spark applies the rest."""
        columns = set(HEADERS.values()) - {"payload_digest"}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in columns:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((name, "in", frozenset([f.value])))
            elif isinstance(f, In):
                self.wanted.append((name, "in", frozenset(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.wanted.append((name, "held", None))
            else:
                yield f

    def _takes(self, row: dict) -> bool:
        for name, how, value in self.wanted:
            got = row.get(name)
            if got is None or how == "in" and got not in value or how == "starts" and not got.startswith(value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        infos = system.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and "/_temporary/" not in i.path and i.path.endswith(tuple(ENDINGS.values())))
        parts: list[list[tuple[str, int]]] = []
        held = PARTITION_BYTES
        for file, size in files:
            if held + size > PARTITION_BYTES:
                parts.append([])
                held = 0
            parts[-1].append((file, size))
            held += size
        return [WarcFiles(p) for p in parts]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split(" ") for c in SCHEMA.split(", "))])
        system, _ = file_system(self.path)
        rows, held = [], 0
        for path, size in partition.files if partition else []:
            compression = next(k for k, e in ENDINGS.items() if path.endswith(e))
            with system.open_input_file(path) as file:
                for record in records(_Window(file, size, path), compression):
                    row = {HEADERS[k]: v for k, v in record.headers.items() if k in HEADERS}
                    for name in ("record_id", "refers_to"):
                        if name in row:
                            row[name] = row[name].strip("<>")
                    if not self._takes(row):
                        continue
                    row |= {"file": path, "position": record.position}
                    row["payload_digest"] = row.get("payload_digest", "").removeprefix("sha1:") or None
                    if self.payload != "headers":
                        self._decode(row, record)
                    rows.append(row)
                    held += 300 + len(row.get("payload") or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def _decode(self, row: dict, record: _Record) -> None:
        block = record.body()
        if not row.get("content_type", "").startswith("application/http"):
            row["payload_bytes"], row["payload"] = len(block), block if self.payload == "full" else None
            return
        head, _, payload = block.partition(_END)
        if row["record_type"] == "revisit":  # its payload is the other record's; the length is in the HTTP headers
            row["payload_bytes"] = int(_parse(head).get("content-length", 0))
            return
        if row["payload_digest"] and sha1_base32(payload) != row["payload_digest"]:
            raise ValueError(f"{row['record_id']}: the payload does not have its digest")
        row["payload_bytes"], row["payload"] = len(payload), payload if self.payload == "full" else None


@dataclass
class WarcWritten(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    """Input columns: record_type, record_id, target_uri, record_date, payload_digest, payload_bytes, refers_to, payload (binary)."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.compression, self.overwrite = options["path"], options.get("compression", "gzip"), overwrite
        if self.compression not in ENDINGS:
            raise ValueError(f"compression: {self.compression}; one of {', '.join(ENDINGS)}")

    def _member(self, headers: dict[str, str | None], block: bytes) -> bytes:
        lines = ["WARC/1.1", *(f"{k}: {header_value(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
        raw = "\r\n".join(lines).encode() + _END + block + _END
        if self.compression == "zstd":
            return self.zstd.compress(raw)
        if self.compression == "gzip":
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            return squeeze.compress(raw) + squeeze.flush()
        return raw

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcWritten:
        self.zstd = zstandard.ZstdCompressor(level=3)
        system, path = file_system(self.path)
        name = uuid.uuid4().hex + ENDINGS[self.compression]
        system.create_dir(f"{path}/_temporary", recursive=True)
        with system.open_output_stream(f"{path}/_temporary/{name}", compression=None, buffer_size=1 << 20) as out:
            out.write(self._member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            for batch in iterator:
                for row in zip(*(batch.column(n).to_pylist() for n in ("record_type", "record_id", "target_uri", "record_date", "payload_digest", "payload_bytes", "refers_to", "payload"))):
                    kind, record_id, uri, date, digest, size, refers, payload = row
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + _END
                    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=response"}
                    headers["WARC-Payload-Digest"] = f"sha1:{digest}"
                    if kind == "revisit":
                        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers}>"}
                    out.write(self._member(headers, http if kind == "revisit" else http + payload))
        return WarcWritten(f"{path}/_temporary/{name}", f"{path}/{name}")

    def commit(self, messages: list[WarcWritten | None]) -> None:
        system, path = file_system(self.path)
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(path)):
                if info.type == pafs.FileType.File:
                    system.delete_file(info.path)
        for m in messages:
            if m:
                system.move(m.temporary, m.final)
        system.create_dir(f"{path}/_temporary", recursive=True)
        system.delete_dir(f"{path}/_temporary")

    def abort(self, messages: list[WarcWritten | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m:
                system.delete_file(m.temporary)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_of_hex(digest):
    """Base32 of a 40-digit hexadecimal SHA-1: 32 letters of five bits, by SQL functions."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 2), 40, "0") for k in range(4)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.concat(*(F.substring(F.lit(letters), (F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + 1), F.lit(1)) for k in range(32)))


def page_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Records for WarcWriter, one for each page (page_id, url, html).

    Of equal payloads of at least min_revisit_bytes bytes that of the smallest page_id is a response and the others
    revisit it. Null html is an empty payload; a null page_id is never the response that others revisit (if a group
    has no other, all are responses). Rows that repeat page_id and payload are responses alike.
    """
    rows = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    groups = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1 and first is not null").select("sha", "first"), "equal-payloads")
    rows = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.coalesce(F.concat(F.lit(PAGE), F.url_encode(F.col(c).cast("string"))), F.lit(NO_PAGE))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), "target_uri", F.lit("1970-01-01T00:00:00Z").alias("record_date"),
        base32_of_hex(F.col("payload_digest")).alias("payload_digest"), "payload_bytes", F.when(again, urn("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records.sparkSession)
    small_batches(records.sparkSession, 4)
    records.write.format("warc").option("compression", compression).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, compression: str = "zstd") -> DataFrame:
    """Write pages to new archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(page_records(pages, min_revisit_bytes), path, compression)
    read = read_warc(pages.sparkSession, path, "verify").where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.when(F.startswith(F.col(c), F.lit(PAGE)), F.url_decode(F.substr(F.col(c), F.lit(len(PAGE) + 1)))).cast(pages.schema["page_id"].dataType)
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
