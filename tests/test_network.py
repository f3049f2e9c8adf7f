import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from riverstone.sources import network
from riverstone.sources.streams import parsed_points


class Log(socketserver.ThreadingTCPServer):
    """A log in memory, for tests; the first reads are cut off in the middle of a line."""

    allow_reuse_address, daemon_threads = True, True

    def __init__(self, cuts=0):
        super().__init__(("127.0.0.1", 0), Handler)
        self.lines, self.closed, self.cuts, self.reads = [], False, cuts, []
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def at(self):
        return self.server_address


class Handler(socketserver.StreamRequestHandler):
    def handle(self):
        log, (verb, *numbers) = self.server, self.rfile.readline().split()
        if verb == b"END":
            self.wfile.write(f"{len(log.lines)} {int(log.closed)}\n".encode())
            return
        first, end = map(int, numbers)
        log.reads.append((first, end))
        raw = "".join(x + "\n" for x in log.lines[first:end]).encode()
        if log.cuts and len(raw) > 10:
            log.cuts -= 1
            raw = raw[: len(raw) // 2 + 1]
        self.wfile.write(raw)


@pytest.fixture
def log():
    server = Log(cuts=3)
    yield server
    server.shutdown()
    server.server_close()


def test_chunks_and_broken_connections(log, monkeypatch):
    monkeypatch.setattr(network, "CHUNK", 7)
    log.lines = [f"line {k} é" for k in range(100)]
    assert [x for c in network.prefetched(network.lines_of(*log.at, 5, 95, 0.01)) for x in c] == log.lines[5:95]
    assert len(log.reads) == 4 and network.end_of(*log.at) == (100, False)
    assert list(network.lines_of(*log.at, 3, 3)) == []
    with pytest.raises(ConnectionError):
        list(network.prefetched(network.lines_of(*log.at, 90, 110, 0.01)))
    next(network.prefetched(network.lines_of(*log.at, 0, 100)))  # a reader that stops early leaves nothing waiting


def test_a_table_through_the_network_and_restarts(spark, sf, tmp_path, log):
    """Stopped after each part and started again from the checkpoint; each row is there once, whatever connections break."""
    network.register(spark)
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").select("event_id", "user_id", "value").collect()
    host, port = log.at

    def run():
        lines = spark.readStream.format("line_log").option("host", host).option("port", port).option("linesPerPartition", 150).load()
        made = parsed_points(lines, F.col("value")).select("line", "features")
        return made.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}"))

    for a, b in ((0, 400), (400, 700)):
        log.lines += [f"{r.event_id},{r.user_id},{r.value}" for r in rows[a:b]]
        run().trigger(availableNow=True).start().awaitTermination()
    log.lines += ["not a point"] + [f"{r.event_id},{r.user_id},{r.value}" for r in rows[700:]]
    log.closed = True
    assert network.drain(run().start(), host, port, 60) == len(rows) + 1
    back = spark.read.schema("line long, features array<double>").parquet(f"{tmp_path}/out").collect()
    assert sorted(r.features for r in back) == [[float(r.event_id), float(r.user_id), r.value] for r in rows]
    assert len({r.line for r in back}) == len(rows) and max(r.line for r in back) == len(rows)
    assert all(b - a <= 150 for a, b in log.reads)


def test_a_log_that_stays_open(spark, log):
    class Stream:
        def exception(self):
            return None

    with pytest.raises(TimeoutError):
        network.drain(Stream(), *log.at, seconds=0.3)
