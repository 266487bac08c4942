"""Archives written and read back: against SQL, against plain Python, and archives from elsewhere."""

import gzip
import hashlib

import pytest
from sqlcheck import mismatch

from storelytics import session
from storelytics.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) as sorted text."""
    keeper = {}
    for place, (page, _, html) in enumerate(rows):
        mine = (page is not None, page or 0, place)
        keeper[html or ""] = max(keeper.get(html or "", (False, 0, -1)), mine)
    out = []
    for place, (page, url, html) in enumerate(rows):
        data, best = (html or "").encode(), keeper[html or ""]
        again = len(data) >= 1000 and best[2] != place
        refers = rows[best[2]][0] if again else None
        out.append((page, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", refers))
    return sorted(map(str, out))


def test_the_sample_equals_sql(spark):
    assert mismatch(spark, "op12_warc") == []


BIG = "<p>" + "é" * 600 + "</p>"
ODD = [
    (1, "http://a.example/x?q=1#f", BIG), (9, "https://b.example", BIG), (4, None, BIG), (None, "http://c.example/", BIG),
    (5, "http://d.example/\r\nWARC-Type: fake é", None), (6, "no address", ""), (7, "http://e.example/", ""), (2, "", "x" * 999),
    (3, "", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (11, "u", "y" * 1000), (None, None, None),
    (12, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (13, "u", "\r\n\r\n\r\n\r\n" * 200), (14, "u", "long " * 1_000_000), (15, "u", "\x00\x1f 😀\n"),
]


def test_odd_pages_come_back(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame(ODD, SCHEMA).coalesce(1).write.parquet(path)
    assert sorted(str(tuple(r)) for r in warc.archived(spark.read.parquet(path)).collect()) == brute(ODD)


def test_payloads_and_files(spark):
    """Whole payloads come back, and files hold no more than their share."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " * 500) for i in range(40)], SCHEMA).coalesce(1)
    path = session.scratch_path(spark, "archive")
    warc.write(pages, path, file_bytes=8_000)
    found = warc.records(spark, path)
    assert len(found.inputFiles()) > 5
    whole = {bytes(r.payload).decode() for r in warc.assemble(found).collect()}
    assert whole == {f"{i} " * 500 for i in range(40)}
    assert [r.request.head.split("\r\n")[0] for r in warc.assemble(found).filter("target = 'http://h/3'").collect()] == ["GET /3 HTTP/1.1"]
    assert warc.unplaced(found).count() == 0


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns(spark):
    frame = spark.createDataFrame([(1, "u", "h")], SCHEMA).selectExpr("*", "1 AS row", "2 AS digest", "3 AS keeper", "'x' AS value", "4 AS bytes")
    assert [r.page_id for r in warc.archived(frame).collect()] == [1]


def _plain(kind, block, **fields):
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_archives_from_elsewhere(spark, tmp_path, packed):
    """Records of a transaction in any order, folded headers, several metadata, orphans, a member per record."""
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<html>"
    made = [
        _plain("warcinfo", b"software: x\r\n", WARC_Record_ID="<i>"),
        _plain("metadata", b"via: b\r\n", WARC_Record_ID="<m2>", WARC_Concurrent_To="<r>"),
        _plain("metadata", b"via: a\r\n", WARC_Record_ID="<m1>", WARC_Concurrent_To="<r>"),
        _plain("response", page, WARC_Record_ID="<r>", WARC_Target_URI="http://x/\r\n a", Content_Type="application/http; msgtype=response"),
        _plain("request", b"GET / HTTP/1.1\r\n\r\n", warc_record_id="<q>", warc_concurrent_to="<r>", Content_Type="application/http"),
        _plain("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<o>", WARC_Concurrent_To="<gone>", Content_Type="application/http"),
        _plain("revisit", b"", WARC_Record_ID="<v>", WARC_Refers_To="<r>", WARC_Payload_Digest="sha1:stated"),
        _plain("revisit", b"", WARC_Record_ID="<w>", WARC_Refers_To="<gone>", WARC_Payload_Digest="sha1:stated"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(gzip.compress(m) if packed else m for m in made[:4]))
    (tmp_path / "b.warc").write_bytes(b"".join(gzip.compress(m) if packed else m for m in made[4:]))
    found = warc.records(spark, str(tmp_path))
    rows = {r.capture_id: r for r in warc.assemble(found).collect()}
    sha = hashlib.sha1(b"<html>").hexdigest()
    assert {k: (r.payload_bytes, r.payload_digest) for k, r in rows.items()} == {"<r>": (6, sha), "<v>": (6, sha), "<w>": (None, "stated")}
    r = rows["<r>"]
    assert (r.target, r.request.record_id, r.metadata.fields, r.n_metadata, bytes(r.payload)) == ("http://x/ a", "<q>", "via: a\r\n", 2, b"<html>")
    assert sorted(x.record_id for x in warc.unplaced(found).collect()) == ["<m2>", "<o>"]


def test_a_torn_archive_is_an_error():
    whole = _plain("metadata", b"x" * 50, WARC_Record_ID="<m>")
    with pytest.raises(ValueError):
        list(warc.parsed(whole[:-20]))
