"""Archives: what is inflated, foreign archives, long payloads, odd tables."""

import gzip
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from millrace.llm import warc


def archive(folder, name, records, packed):
    folder.mkdir(exist_ok=True)
    data = b"".join(packed(warc.record_bytes(*r)) for r in records)
    (folder / name).write_bytes(data)
    return f"file://{folder}"


def records(n=40, size=300_000):
    out = []
    for i in range(n):
        block = bytes(str(i), "ascii") * (size // len(str(i))) if i % 4 == 0 else b"x"
        out.append(({"WARC-Type": "response" if i % 4 == 0 else "revisit", "WARC-Record-ID": f"<{i}>", "WARC-Target-URI": "http://h.io/\né"}, block))
    return out


def read(path, filters=(), **options):
    reader = warc.WarcReader({"path": path, **options})
    left = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    return left, rows


@pytest.mark.parametrize(("name", "packed"), [
    ("a.warc.gz", lambda r: warc.member_bytes(r, 1)), ("a.warc.gz", gzip.compress), ("a.warc", lambda r: r),
])
def test_filters_and_payloads(tmp_path, name, packed):
    path = archive(tmp_path / "a", name, records(), packed)
    left, rows = read(path, [EqualTo(("record_type",), "revisit"), EqualTo(("payload_bytes",), 1)])
    assert len(left) == 1 and [r["record_id"] for r in rows] == [f"<{i}>" for i in range(40) if i % 4] and rows[0]["payload"] == b"x"
    _, rows = read(path, [In(("record_id",), ("<0>", "<39>"))])
    assert [len(r["payload"]) for r in rows] == [300_000, 1] and rows[0]["target_uri"] == "http://h.io/ é"
    _, rows = read(path, payload="false")
    assert len(rows) == 40 and all(r["payload"] is None for r in rows) and rows[4]["payload_bytes"] == 300_000


def test_rejected_payloads_are_not_inflated(tmp_path, monkeypatch):
    import os

    big = [({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, os.urandom(500_000)) for i in range(10)] + [({"WARC-Type": "revisit"}, b"")]
    path = archive(tmp_path / "a", "a.warc.gz", big, lambda r: warc.member_bytes(r, 1))
    inflated, real = [0], warc.zlib.decompressobj

    class Counting:
        def __init__(self, *args):
            self.own = real(*args)

        def __getattr__(self, name):
            return getattr(self.own, name)

        def decompress(self, *args):
            out = self.own.decompress(*args)
            inflated[0] += len(out)
            return out

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    _, rows = read(path, [EqualTo(("record_type",), "revisit")])
    assert len(rows) == 1 and inflated[0] < 11 * 2 * warc.PEEK
    _, rows = read(path)
    assert len(rows) == 11 and inflated[0] > 5_000_000


def test_members_are_plain_gzip():
    record = warc.record_bytes({"WARC-Type": "response"}, b"abc" * 1000)
    both = warc.member_bytes(record, 1) + warc.member_bytes(record, 6)
    assert gzip.GzipFile(fileobj=io.BytesIO(both)).read() == record * 2


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, None, None), (3, "v", "é\x00\r\n\r\nWARC/1.1")], "page_id long, url string, html string")
    out = {r.page_id: r for r in warc.round_trip(df.withColumn("sha", F.lit("own")).select("page_id", "url", "html")).collect()}
    assert {i: r.payload_bytes for i, r in out.items()} == {1: 3_000_000, 2: 0, 3: len("é\x00\r\n\r\nWARC/1.1".encode())}
    assert out[3].payload_digest == warc.digest("é\x00\r\n\r\nWARC/1.1".encode())
    assert warc.round_trip(df.limit(0)).collect() == []
    same = spark.createDataFrame([(4, "a", "t"), (4, "b", "t"), (None, "c", "t")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(same).collect()) == [(0, "revisit", 4), (4, "response", None), (4, "response", None)]


def test_extra_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", "t", "own"), (2, "a", "t", "own")], "page_id long, url string, html string, first string")
    rows = warc.with_revisits(df.selectExpr("*", "'own' AS sha", "'own' AS hot", "'own' AS n"), F.encode(F.col("html"), "UTF-8"), F.col("page_id"))
    assert sorted((r.row.page_id, r.first, r.row.first, r.row.sha, r.row.n) for r in rows.collect()) == [(1, 2, "own", "own", "own"), (2, 2, "own", "own", "own")]
