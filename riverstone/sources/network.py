"""Lines from a log over TCP that can be read again: a stream of them goes on after a restart without losing or repeating any.

The server keeps a log of lines and answers two requests, each one line, over a connection for each:

    END             the number of lines so far, and 1 if no more will come, else 0
    READ first end  the lines from `first` to before `end`

Offsets of a micro-batch are numbers of lines, so Spark's checkpoint is all the state there is, and a batch that is tried again reads the same
lines. A task reads its range while a thread fetches the next chunk; a connection that breaks is made again from where it was.
"""

from __future__ import annotations

import queue
import socket
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

CHUNK = 4096
RETRIES = 5


def end_of(host: str, port: int) -> tuple[int, bool]:
    """How many lines the log has, and whether that is all."""
    with socket.create_connection((host, port), timeout=30) as s:
        s.sendall(b"END\n")
        n, closed = s.makefile("rb").readline().split()
        return int(n), closed == b"1"


def lines_of(host: str, port: int, first: int, end: int, wait: float = 0.2) -> Iterator[list[str]]:
    """The lines from first to before end, in chunks; what a broken connection has not brought is asked for again."""
    at, left = first, RETRIES
    while at < end:
        try:
            with socket.create_connection((host, port), timeout=30) as s:
                s.sendall(f"READ {at} {end}\n".encode())
                chunk: list[str] = []
                for raw in s.makefile("rb"):
                    if not raw.endswith(b"\n"):
                        break  # cut off
                    chunk.append(raw[:-1].decode())
                    if len(chunk) == CHUNK:
                        yield chunk
                        at, chunk, left = at + CHUNK, [], RETRIES
                if chunk:
                    yield chunk
                    at, left = at + len(chunk), RETRIES
        except OSError:
            pass
        if at < end:
            left -= 1
            if not left:
                raise ConnectionError(f"{host}:{port} doesn't give the lines from {at} to {end}")
            time.sleep(wait)


def prefetched(chunks: Iterator[list[str]]) -> Iterator[list[str]]:
    """The same chunks, each fetched while the one before is worked on."""
    held: queue.Queue = queue.Queue(maxsize=1)
    stopped = threading.Event()

    def put(item: tuple) -> None:
        while not stopped.is_set():
            try:
                return held.put(item, timeout=0.2)
            except queue.Full:
                continue

    def fetch() -> None:
        try:
            for chunk in chunks:
                put((chunk, None))
            put((None, None))
        except BaseException as e:  # noqa: BLE001  goes to the reader
            put((None, e))

    threading.Thread(target=fetch, daemon=True).start()
    try:
        while True:
            chunk, error = held.get()
            if error:
                raise error
            if chunk is None:
                return
            yield chunk
    finally:
        stopped.set()


@dataclass
class Lines(InputPartition):
    first: int
    end: int


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options["host"], int(options["port"])
        self.each = int(options.get("linesPerPartition", 1_000_000))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"line": end_of(self.host, self.port)[0]}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return [Lines(at, min(at + self.each, end["line"])) for at in range(start["line"], end["line"], self.each)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        at = partition.first
        for chunk in prefetched(lines_of(self.host, self.port, partition.first, partition.end)):
            yield pa.record_batch([pa.array(range(at, at + len(chunk)), pa.int64()), pa.array(chunk, pa.string())], ["line", "value"])
            at += len(chunk)


class LineLog(DataSource):
    """Format line_log: line (its number) and value; options host, port and linesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "line_log"

    def schema(self) -> str:
        return "line long, value string"

    def streamReader(self, schema) -> LogReader:  # noqa: ANN001, N802
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    """Format line_log for spark.readStream; sources.streams.parsed_points() makes points of its lines."""
    spark.dataSource.register(LineLog)


def drain(stream: StreamingQuery, host: str, port: int, seconds: float = 600, wait: float = 0.2) -> int:
    """Stops a stream once the log is closed and the stream has committed all of it; the number of lines."""
    limit = time.monotonic() + seconds
    while time.monotonic() < limit:
        n, closed = end_of(host, port)
        if closed:
            stream.processAllAvailable()
            stream.stop()
            return n
        if stream.exception():
            raise stream.exception()
        time.sleep(wait)
    raise TimeoutError(f"the log at {host}:{port} wasn't closed in {seconds} s")
