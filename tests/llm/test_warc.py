import gzip
import io
import zlib

import pytest
from pyspark.sql import functions as F

from riverstone.llm import warc as op
from riverstone.llm.common import new_path, read_table, write_table


def test_cases(spark):
    big = "<p>" + "é" * 60
    rows = [(3, "u", big), (1, "v\nx", big), (2, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", "x" * 3_000_000), (1, "again", big), (None, "n", big), (9, "u", "a\r\n\r\nb" * 40), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100), ((1 << 63) - 1, "last", "w" * 200), (None, "l", "w" * 200), (None, "no id", "v" * 200), (None, "none", "v" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    files = op.write_archives(pages, new_path(spark, "warc"), max_file_bytes=2000)
    found = {(r.page_id, r.url): r for r in op.read_archives(files).collect()}
    assert len(found) == len(rows) and files.count() > 1
    for page_id, url, html in rows:
        r = found[page_id, " ".join((url or "").splitlines())]
        raw = (html or "").encode()
        first = {big: 1, "z" * 100: 12, "w" * 200: (1 << 63) - 1}.get(html)
        refers = first if first is not None and page_id != first else None
        assert (r.refers_to, r.record_type, r.payload_bytes) == (refers, "revisit" if refers is not None else "response", len(raw))
        assert r.payload_digest == __import__("hashlib").sha256(raw).hexdigest()
        assert r.payload == (None if refers is not None else raw)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.read_archives(op.write_archives(none, new_path(spark, "warc"))).count() == 0


def test_no_html_is_shuffled(spark, sf, monkeypatch):
    """Whatever is joined or grouped after the scan has no column of payloads, even where the table of copies is too large to broadcast."""
    plans = []
    monkeypatch.setattr(op, "write_table", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write_table(df, label))[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = op.write_archives(read_table(spark, sf, "pages"), new_path(spark, "warc"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scan, rest = plans
    assert "html" in scan and "Exchange" not in scan
    assert "html" not in rest and "SortMergeJoin" in rest
    back = op.read_archives(files)
    assert back.rdd.getNumPartitions() == files.count()
    assert back.count() == read_table(spark, sf, "pages").count()


def record(k, body=b"x" * 500):
    return op.page_record(k, "u", body, __import__("hashlib").sha256(body).hexdigest(), None)


def test_reader_is_one_member_for_each_record():
    raw = record(1) + record(2, b"y" * 200_000) + record(3)
    found = list(op.read_records(io.BytesIO(raw)))
    assert [r.headers["WARC-Record-ID"] for r in found] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    assert [gzip.GzipFile(fileobj=io.BytesIO(raw[r.offset :])).read(10) for r in found] == [b"WARC/1.1\r\n"] * 3
    assert found[1].payload == b"y" * 200_000


@pytest.mark.parametrize("damage", [lambda r: r[:-9], lambda r: r[:40] + bytes([r[40] ^ 255]) + r[41:], lambda r: r + b"junk" * 10])
def test_damage_is_found(damage):
    with pytest.raises(op.WarcError):
        list(op.read_records(io.BytesIO(damage(record(1)))))


def test_wrong_digest_and_length():
    for headers, block in ((([("WARC-Type", "response"), ("WARC-Block-Digest", "sha256:00")]), b"b"),):
        with pytest.raises(op.WarcError):
            list(op.read_records(io.BytesIO(op.record_bytes(headers, block))))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = packer.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n") + packer.flush()
    with pytest.raises(op.WarcError):
        list(op.read_records(io.BytesIO(raw)))
