import json
import os
import socket
import struct
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riverstone.sources import binary, generate, streams, text


def test_files_of_other_programs(spark, tmp_path):
    """Points with more than two dimensions, labels whose header isn't their number, weighted points; many partitions."""
    binary.register(spark)
    data = np.arange(2 * 3 * 700, dtype="<f4").reshape(700, 2, 3)
    (tmp_path / "data.bin").write_bytes(struct.pack("<IIII", 3, *data.shape) + data.tobytes())
    got = spark.read.format("points_bin").option("rowsPerPartition", 64).load(str(tmp_path / "data.bin"))
    assert got.rdd.getNumPartitions() == 11
    assert {r.id: r.features for r in got.collect()} == {k: data[k].ravel().tolist() for k in range(700)}
    labels = np.arange(10, dtype="<u8")
    (tmp_path / "labels.bin").write_bytes(struct.pack("<Q", 1) + labels.tobytes())
    assert sorted(map(tuple, spark.read.format("labels_bin").load(f"file://{tmp_path}/labels.bin").collect())) == [(k, k) for k in range(10)]
    (tmp_path / "coreset.bin").write_bytes(struct.pack("<II", 2, 2) + np.array([[3, 1, 2], [4, 5, 6]], "<f4").tobytes())
    assert [(r.weight, r.features) for r in spark.read.format("coreset_bin").load(str(tmp_path / "coreset.bin")).collect()] == [(3.0, [1.0, 2.0]), (4.0, [5.0, 6.0])]


def test_bad_files(spark, tmp_path):
    binary.register(spark)
    (tmp_path / "short.bin").write_bytes(struct.pack("<III", 2, 10, 3) + b"\0" * 8)
    with pytest.raises(Exception, match="shorter than its header"):
        spark.read.format("points_bin").load(str(tmp_path / "short.bin")).count()
    with pytest.raises(Exception, match="missing.bin"):
        spark.read.format("points_bin").load(str(tmp_path / "missing.bin")).count()


def test_round_trips_append_and_overwrite(spark, tmp_path):
    binary.register(spark)
    points = generate.blobs(spark, 500, 4).select("id", "features")
    path = f"{tmp_path}/points"
    points.repartitionByRange(3, "id").write.format("points_bin").mode("overwrite").save(path)
    key = lambda df: sorted((r.id, tuple(r.features)) for r in df.collect())
    assert key(spark.read.format("points_bin").load(path)) == key(points)
    points.limit(10).coalesce(1).write.format("points_bin").mode("append").save(path)
    assert spark.read.format("points_bin").load(path).count() == 510
    points.limit(10).coalesce(1).write.format("points_bin").mode("overwrite").save(path)
    assert spark.read.format("points_bin").load(path).count() == 10


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, [0.1234567, 2.0]), (3.0, [-1.0, 4.0])], "weight double, features array<double>")
    path = f"{tmp_path}/coreset_2"
    text.write_coreset_csv(rows.coalesce(1), path, 2)
    raw = "".join(p.read_text() for p in (tmp_path / "coreset_2").glob("*.csv")).split()
    assert raw == ["w,x0,x1", "1.500000,0.123457,2.000000", "3.000000,-1.000000,4.000000"]
    back = text.read_coreset_csv(spark, path, 2).orderBy("weight").collect()
    assert [(r.weight, r.features, r.coreset_size) for r in back] == [(1.5, [0.123457, 2.0], 2), (3.0, [-1.0, 4.0], 2)]
    for _ in range(2):
        text.append_csv(rows.select("weight"), f"{tmp_path}/log")
    assert spark.read.csv(f"{tmp_path}/log", header=True).count() == 4


def test_generators(spark):
    a, b = (generate.blobs(spark, 2000, 2, 3, separation=50, n_partitions=p).orderBy("id").collect() for p in (2, 5))
    assert a == b
    centres = generate.centres(3, 2, 50, 42)
    off = np.array([np.array(r.features) - centres[r.label] for r in a])
    assert abs(off.mean()) < 0.1 and abs(off.std() - 1) < 0.05
    made = generate.classification(spark, 300, 10, 4, redundant=2, k=3)
    assert made.filter(F.size("features") != 10).count() == 0 and made.select("label").distinct().count() == 3


def test_append_after_tasks_without_rows(spark, tmp_path):
    """Names that have gaps, as empty tasks leave them, aren't taken again; a task's rows are cut into files."""
    binary.register(spark)
    path = f"{tmp_path}/labels"
    rows = lambda a, b: spark.range(a, b).select("id", (F.col("id") * 3).alias("label"))
    rows(0, 20).repartition(3, F.col("id") % 2).write.format("labels_bin").mode("overwrite").save(path)
    rows(20, 50).repartition(5, F.col("id") % 2).write.format("labels_bin").option("rowsPerFile", 4).mode("append").save(path)
    assert sorted(r.label for r in spark.read.format("labels_bin").load(path).collect()) == [3 * k for k in range(50)]
    rows(0, 7).coalesce(1).write.format("labels_bin").mode("overwrite").save(path)
    assert [r.label for r in spark.read.format("labels_bin").load(path).orderBy("id").collect()] == [3 * k for k in range(7)]


def test_coreset_folder(spark, tmp_path):
    for m in (3, 2):
        rows = spark.createDataFrame([(1.0, [float(m), 0.5])] * m, "weight double, features array<double>")
        text.write_coreset_csv(rows, f"{tmp_path}/all/coreset_{m}", 2)
    got = text.read_coreset_folder(spark, f"{tmp_path}/all", 2).collect()
    assert [(r.coreset_size, r.features[0]) for r in got] == [(3, 3.0)] * 3 + [(2, 2.0)] * 2
    with pytest.raises(ValueError, match="3 features"):
        text.read_coreset_folder(spark, f"{tmp_path}/all", 3)


def test_points_of_a_socket(spark, tmp_path):
    """Lines that a server sends, bad ones left out."""
    server = socket.create_server(("127.0.0.1", 0))

    def serve() -> None:
        for _ in range(2):  # the source may connect once to look and once to read
            try:
                with server.accept()[0] as c:
                    c.sendall(b"1.5,2\nnot a point\n-3e1, .5\n1,,2\n")
                    time.sleep(6)
            except OSError:
                return

    threading.Thread(target=serve, daemon=True).start()
    job = streams.socket_points(spark, "127.0.0.1", server.getsockname()[1]).writeStream.format("memory").queryName("from_socket").start()
    try:
        for _ in range(40):
            job.processAllAvailable()
            if spark.table("from_socket").count() == 2:
                break
            time.sleep(0.25)
        assert sorted(r.features for r in spark.table("from_socket").collect()) == [[-30.0, 0.5], [1.5, 2.0]]
    finally:
        job.stop()
        server.close()


def test_conditions_on_ids_are_read_by_range(spark, tmp_path):
    """The reader opens the rows between the least and the largest id only; Spark checks the rest of the condition."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

    binary.register(spark)
    path = f"{tmp_path}/p"
    spark.range(1000).select("id", F.array(F.col("id").cast("float")).alias("features")).repartitionByRange(3, "id").write.format("points_bin").mode("overwrite").save(path)

    def opened(*filters):
        reader = binary.BinaryReader("points_bin", {"path": path, "rowsPerPartition": "100"})
        assert len(list(reader.pushFilters(list(filters)))) == len(filters)
        return sum(p.count for p in reader.partitions())

    at = ("id",)
    assert opened() == 1000 and opened(EqualTo(at, 7)) == 1 and opened(In(at, (3, 12, 5))) == 10 and opened(EqualTo(("x",), 7)) == 1000
    assert opened(GreaterThanOrEqual(at, 990)) == 10 and opened(GreaterThan(at, 990), LessThanOrEqual(at, 995)) == 5 and opened(LessThan(at, 0)) == 0
    assert opened(GreaterThan(at, 10), LessThan(at, 5)) == 0 and opened(EqualTo(at, 5000)) == 0
    back = spark.read.format("points_bin").load(path)
    assert sorted(r.id for r in back.filter("id >= 340 and id < 345 and id <> 342").collect()) == [340, 341, 343, 344]
    assert [r.features for r in back.filter("id in (7, 993)").orderBy("id").collect()] == [[7.0], [993.0]]


def test_a_batch_is_committed_once(spark, tmp_path):
    """A batch that is tried again completes what its manifest says, and what it has written anew goes."""
    fs, path = binary.store(f"{tmp_path}/out")
    table = lambda n: [pa.record_batch([pa.array(range(n)), pa.array(range(n))], ["id", "label"])]

    def tried(n, task=0):
        writer = binary.BinaryStreamWriter("labels_bin", {"path": f"{tmp_path}/out"})
        parts = []
        fs.create_dir(path, recursive=True)
        part = f"{path}/{writer.job}-{task}.part"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(writer._raw(pa.Table.from_batches(table(n))))
        parts.append(part)
        return writer, [binary.Written(parts, task)]

    count = lambda: spark.read.format("labels_bin").load(f"{tmp_path}/out").count()
    binary.register(spark)
    writer, messages = tried(5)
    writer.commit(messages, 0)
    assert count() == 5
    writer, messages = tried(5)
    writer.commit(messages, 0)  # again
    assert count() == 5
    # A crash after the manifest: the files have no names yet.
    writer, messages = tried(3)
    lost = f"{path}/_batches/000000000001"
    with fs.open_output_stream(lost, compression=None) as f:
        f.write(json.dumps([(messages[0].parts[0], f"{path}/part-000000000001-000000-0000.bin")]).encode())
    assert count() == 5
    writer, messages = tried(3)
    writer.commit(messages, 1)
    assert count() == 8 and not [f for f in os.listdir(path) if f.endswith(".part")]
    writer, messages = tried(9)
    writer.abort(messages, 2)
    assert count() == 8
