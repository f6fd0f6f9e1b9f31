"""ARC files in both versions, their conversion, and the records read back."""

import hashlib
import io

import duckdb
import pytest

from lumenframe.llm.queries import ORACLE
from lumenframe.llm.warc import arc_records, arc_to_warc, op4_warc_convert, read_warc, split_http, warc_records, write_arc


def brute(rows):
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same, default=None)
        again = len(body) >= 100 and first is not None and page != first
        yield page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None


def test_query_and_sql(spark, sf_dir):
    got = sorted(map(tuple, op4_warc_convert(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{sf_dir}/pages.parquet'")
    assert got == sorted(con.execute(ORACLE["op4_warc_convert"]).fetchall())


@pytest.mark.parametrize("version", [1, 2])
def test_corners(spark, tmp_path, version):
    long = "<p>\r\n\r\nWARC/1.1\r\nfiledesc://x\n</p>" * 10
    rows = [(5, "http://a b/\tc", long), (3, "http://x", long), (3, "http://x", long), (9, None, None), (8, "", ""), (7, "http://é", "short"), (6, "u", "short"), (None, "http://n", long), (10, "http://big", "é" * 300_000), (11, "http://big2", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    write_arc(pages, f"{tmp_path}/arc", version)
    arc_to_warc(spark, [f"{tmp_path}/arc"], f"{tmp_path}/warc")
    found = read_warc(spark, f"{tmp_path}/warc").collect()
    assert all(r.sound for r in found)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=key) == sorted(brute(rows), key=key)
    assert {r.url for r in found if r.page_id in (5, 9)} == {"http://a%20b/%20c", "-"}
    write_arc(pages.limit(0), f"{tmp_path}/arc0", version)
    arc_to_warc(spark, [f"{tmp_path}/arc0"], f"{tmp_path}/warc0")
    assert read_warc(spark, f"{tmp_path}/warc0").count() == 0


@pytest.mark.parametrize("most", [100, 0])
def test_many_archives(spark, tmp_path, most):
    """Archives of two records, each with its block, in a session that asks for others; shared payloads by broadcast and by shuffle."""
    rows = [(i, f"http://h/{i}", ("hot" if i % 3 == 0 else f"page {i // 2}") * 60) for i in range(31)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        write_arc(pages, f"{tmp_path}/arc", 1, records=2)
        arc_to_warc(spark, [f"{tmp_path}/arc"], f"{tmp_path}/warc", records=2, most=most, least_hot=4)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "warc").glob("part-*"))) >= 16
    found = read_warc(spark, f"{tmp_path}/warc").collect()
    assert all(r.sound for r in found)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in found) == sorted(x[:4] for x in brute(rows))
    assert {r.page_id: r.refers_to for r in found} == {x[0]: x[4] for x in brute(rows)}


def test_header_lines():
    one = b"filedesc://f 0 20010203040506 text/plain 9\n1 0 me\nx\n\nhttp://a b 1.2.3.4 20010203040506 text/html 5\nhello\n"
    head, block = next(arc_records(io.BytesIO(one)))
    assert head["URL"] == "http://a b" and head["IP-address"] == "1.2.3.4" and block == b"hello"
    two = b"filedesc://f 0 20010203040506 text/plain 200 - - 0 f 9\n2 0 me\nx\n\nhttp://a 1.2.3.4 20010203040506 text/html 404 abc - 77 f.arc 2\nhi\n"
    head, block = next(arc_records(io.BytesIO(two)))
    assert head["Result-code"] == "404" and head["Offset"] == "77" and block == b"hi"
    for bad in (b"http://a 0 2001 t 3\nabc\n", one.replace(b"\n1 0 me", b"\n7 0 me"), one[:-4]):
        with pytest.raises(ValueError):
            list(arc_records(io.BytesIO(bad)))
    assert split_http(b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nxyz") == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"xyz")
    with pytest.raises(ValueError):
        list(warc_records(io.BytesIO(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")))
