"""Packets from a device or socket as a stream.

The driver reads bytes and every micro-batch has the whole packets that came since the last, up to a number of
packets, which so is also how often a recording is flushed. Bytes are kept until the batch they were in is
committed, so a batch can run again. A device cannot send again: after the driver's own restart numbers go on from
the checkpoint's, and packets read but not committed before it are lost.
"""

from __future__ import annotations

import os
import select
import socket
import termios
import time
import tty
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .packets import EVENT_BYTES, FIELDS, HEADER, MAGIC, SCHEMA, decode_packets


class ByteSource:
    """A TCP peer (tcp://host:port) or a character device or pipe (a path). A serial port is set to eight data bits, no parity, one
    stop bit and no flow control at the baud rate, and what it had received before is dropped."""

    def __init__(self, uri: str, baud: int = 115_200) -> None:
        if uri.startswith("tcp://"):
            host, port = uri[6:].rsplit(":", 1)
            self.socket = socket.create_connection((host, int(port)))
            self.fd = self.socket.fileno()
        else:
            self.fd = os.open(uri, os.O_RDONLY | os.O_NONBLOCK | os.O_NOCTTY)
            if os.isatty(self.fd):
                self._set_port(baud)
        self.open = True

    def _set_port(self, baud: int) -> None:
        if (speed := getattr(termios, f"B{baud}", None)) is None:
            raise ValueError(f"baud: {baud}; not a rate of this system")
        tty.setraw(self.fd, termios.TCSANOW)
        iflag, oflag, cflag, lflag, _, _, cc = termios.tcgetattr(self.fd)
        iflag &= ~(termios.IXON | termios.IXOFF | termios.IXANY)
        cflag &= ~(termios.CSIZE | termios.PARENB | termios.CSTOPB | termios.CRTSCTS)
        termios.tcsetattr(self.fd, termios.TCSANOW, [iflag, oflag, cflag | termios.CS8 | termios.CREAD | termios.CLOCAL, lflag, speed, speed, cc])
        termios.tcflush(self.fd, termios.TCIFLUSH)

    def read(self, seconds: float) -> bytes:
        """What has come, waiting for something at most so long; empty after a timeout or the peer's end."""
        ready, _, _ = select.select([self.fd], [], [], seconds) if self.open else ([], [], [])
        if not ready:
            return b""
        data = os.read(self.fd, 1 << 20)
        self.open = bool(data)
        return data


def whole_packets(data: bytes, mode: str) -> tuple[list, int]:
    """Packets of data and how many bytes they and the junk before them take; an unfinished packet stays."""
    packets = list(decode_packets(data, mode))
    end = packets[-1][0] + len(MAGIC) + HEADER.size + len(packets[-1][1]) * EVENT_BYTES if packets else 0
    rest = data.find(MAGIC, end)
    return [e for _, e in packets], rest if rest >= 0 else max(end, len(data) - len(MAGIC) + 1)


class LivePackets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_event_packets"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return LiveReader(self.options)


class LiveReader(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.uri, self.mode = options["path"], options.get("mode", "PERMISSIVE")
        self.timeout, self.most = float(options.get("timeout", "3.0")), int(options.get("maxPackets", "50"))
        self.baud = int(options.get("baud", "115200"))
        self.source: ByteSource | None = None
        self.pending, self.rows, self.first = b"", [], 0

    def initialOffset(self) -> dict:
        return {"packets": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.source = self.source or ByteSource(self.uri, self.baud)
        if self.first + len(self.rows) < start["packets"]:  # the driver is another than the one that read those
            self.rows, self.first = [], start["packets"]
        until, have = time.monotonic() + self.timeout, self.first + len(self.rows)
        while have - start["packets"] < self.most and (left := until - time.monotonic()) > 0:
            data = self.source.read(min(left, 0.05))
            self.pending += data
            packets, used = whole_packets(self.pending, self.mode)
            self.pending = self.pending[used:]
            for events in packets:
                self.rows.append((self.uri, have, len(events), len(events) * EVENT_BYTES, [dict(zip(FIELDS, r)) for r in events.tolist()]))
                have += 1
            if not data and have > start["packets"] or not self.source.open:
                break
        end = {"packets": min(have, start["packets"] + self.most)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.rows[max(0, start["packets"] - self.first) : max(0, end["packets"] - self.first)])

    def commit(self, end: dict) -> None:
        gone = end["packets"] - self.first
        if gone > 0:
            self.rows, self.first = self.rows[gone:], end["packets"]


def stream_live(spark: SparkSession, uri: str, mode: str = "PERMISSIVE", timeout_s: float = 3.0, packets_per_batch: int = 50, baud: int = 115_200) -> DataFrame:
    spark.dataSource.register(LivePackets)
    options = {"mode": mode, "timeout": str(timeout_s), "maxPackets": str(packets_per_batch), "baud": str(baud)}
    return spark.readStream.format("live_event_packets").options(**options).load(uri)
