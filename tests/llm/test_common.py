import numpy as np
import pyarrow as pa

from riverstone.llm import common


def test_slices_are_bounded_and_whole():
    texts = ["a" * 10, None, "é" * 30, "b" * 500, "", "c"]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    parts = list(common.row_slices(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), 1, max_bytes=64, max_rows=2))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts + texts[2:5]
    assert all(p.num_rows <= 2 for p in parts)
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 64 for p in parts)
    data, at = common.bytes_of(batch.slice(1, 3).column(1))
    assert [bytes(data[i:j]).decode() for i, j in zip(at[:-1], at[1:], strict=True)] == ["", "é" * 30, "b" * 500]
    assert common.bytes_of(pa.array([None], pa.string()))[1].tolist() == [0, 0] and np.size(common.bytes_of(pa.array([], pa.string()))[0]) == 0


def test_written_tables_go(spark):
    common.write_table(spark.range(3), "gone")
    assert common.drop_written(spark) > 0 and common.drop_written(spark) == 0


def test_tables_that_arent_kept_are_deleted(spark):
    before = common.written()
    with common.Tables(spark) as tables:
        tables.write(spark.range(3), "a")
        again = tables.write(spark.range(4), "a")
        kept = tables.write(again, "b", keep=True)
        assert len(common.written() - before) == 2 and again.count() == 4
    assert len(common.written() - before) == 1 and kept.count() == 4
