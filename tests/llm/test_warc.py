"""Exact round trip of the archive."""

import hashlib
import re

from sievewright.llm import warc

PAGES = "page_id long, url string, html string, header string"


def test_round_trip(spark):
    big, near = "x" * 1000, "x" * 999
    rows = [(1, "http://a", big, "h"), (9, "http://b\r\nX: y", big, "h"), (5, None, big, None), (2, "u", near, ""), (3, "u", near, ""), (4, "é", None, ""), (6, "u", "", ""), (None, "u", "é" * 600, ""), (7, "u", "\r\nWARC-Type: revisit\r\n", "")]
    found = warc.read_archive(spark, warc.write_archive(spark.createDataFrame(rows, PAGES))).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    for page_id, _, html, _ in rows:
        body, r = (html or "").encode(), by[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        if r.record_type == "response":
            head, http, payload = bytes(r.record).split(b"\r\n\r\n", 2)
            assert payload == body + b"\r\n\r\n" and r.refers_to is None
            assert f"Content-Length: {len(http) + 4 + len(body)}".encode() in head.split(b"\r\n")
    heads = [dict(x.split(b": ", 1) for x in bytes(r.record).split(b"\r\n\r\n")[0].split(b"\r\n")[1:]) for r in found]
    assert all(re.fullmatch(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h[b"WARC-Date"]) for h in heads)
    names = {h[b"WARC-Record-ID"] for h in heads}
    assert len(names) == len(rows) and all(h[b"WARC-Refers-To"] in names for h in heads if h[b"WARC-Type"] == b"revisit")
    assert all(bytes(r.record).endswith(b"\r\n\r\n\r\n\r\n") for r in found if r.record_type == "revisit")
    assert {k: v.refers_to for k, v in by.items() if v.record_type == "revisit"} == {1: 9, 5: 9}
    assert by[None].record_type == "response"


def test_store_holds_each_payload_once_and_repeated_ids_stay(spark):
    rows = [(i % 2, "u", "same " * 300, "") for i in range(6)]
    path = warc.write_archive(spark.createDataFrame(rows, PAGES))
    assert spark.read.parquet(f"{path}/payloads").count() == 1
    found = warc.read_archive(spark, path).collect()
    assert len({bytes(r.record).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for r in found}) == 6
    assert sorted(r.record_type for r in warc.read_archive(spark, path).collect()) == ["response"] * 3 + ["revisit"] * 3


def test_very_long_payload(spark):
    html = "<p>é</p>" * 400_000
    (r,) = warc.read_archive(spark, warc.write_archive(spark.createDataFrame([(1, "u", html, "")], PAGES))).collect()
    assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()


def test_empty(spark):
    path = warc.write_archive(spark.createDataFrame([], PAGES))
    assert warc.read_archive(spark, path).count() == 0
