"""Lossless round trip of stored payloads."""

import hashlib
import math
import tarfile
import zlib
from collections import Counter
from pathlib import Path

from sievewright.llm import media
from sievewright.llm.queries import op8_media


def pad(text):
    data = (text or "").encode()
    return data, data + bytes(-len(data) % 64 if data else 64)


def test_png_round_trip():
    for n in (64, 128, 6400):
        payload = bytes(i * 7 % 256 for i in range(n))
        png = media.to_png(payload)
        assert media.from_png(png) == payload and media.png_size(png[:33]) == (64, n // 64)


def test_rows(spark):
    texts = [None, "", "a" * 64, "a" * 65, "é\n" * 40, "a" * 64, "long " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, digest string").withColumnRenamed("digest", "text").selectExpr("*", "'x' as digest")
    listing, root = media.write_media(df, "doc_id", "text")
    rows = {r.key: r for r in media.read_media(listing, root).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, text in enumerate(texts):
        data, payload = pad(text)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        png = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        counts = Counter(payload)
        share = [n / len(payload) for n in counts.values()]
        entropy = -sum(p * math.log2(p) for p in share) + 0.0
        assert r.feature == f"64x{len(payload) // 64};mean={sum(payload) / len(payload):.4f};entropy={entropy:.4f};distinct={len(counts)}"
    assert rows[2].feature == rows[5].feature


def test_each_payload_is_stored_once_over_all_shards(spark):
    rows = [(f"k{i % 50}" if i % 7 else None, ["same", "other \0", f"own {i}", None][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, body string").repartition(5)
    listing, root = media.write_media(df, "name", "body")
    found = listing.collect()
    places = {(r.digest, r.shard, r.offset) for r in found}
    assert len(found) == 400 and len(places) == len({r.digest for r in found}) == 103
    names = [n for shard in Path(root.removeprefix("file:")).glob("*.tar") for n in tarfile.open(shard).getnames()]
    assert sorted(names) == sorted(f"{d}.png" for d, _, _ in places)
    assert Counter((r.key, r.n_bytes) for r in media.read_media(listing, root).collect()) == Counter((k, len((t or "").encode())) for k, t in rows)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_media(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        data, payload = pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_empty(spark):
    listing, root = media.write_media(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert media.read_media(listing, root).count() == 0
