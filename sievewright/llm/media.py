"""Content-addressed media payloads in tar shards.

Every payload becomes an 8-bit greyscale PNG of 64 samples a row and is appended to a tar shard under its SHA-256;
a row keeps digest, shard, offset and length. Metadata columns are filled by range reads of the first bytes of a
member (the PNG header), full reads verify the stored bytes by their digest and give back the payload.

Every payload is stored once over all shards: digests are counted first (slim rows), payloads that several rows share are reduced to one
row each and written apart, all others are written by the scan's own tasks, so that no payload but the shared ones is shuffled. The digests of
shared payloads are broadcast if there are ``MOST_BROADCAST`` of them at most, else joined by a shuffle. Shards go to the shared folder
through ``pyarrow.fs`` (any file system that it knows by URI). A shard's name holds a random part and rows become visible with the
table that lists them, so a task that runs again leaves at most an unreferenced shard. Shards roll over at ``SHARD_BYTES``;
a shard's bytes in memory are bounded by that and one payload.

Defined cases: null text is empty; the empty payload is 64 zero bytes; lengths that are a multiple of 64 get no
padding; equal texts give equal values in every column but shard, offset and the row's key; repeated rows are all
kept; payloads may have any length; ties do not arise; keys of any type, also null or repeated, are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from .memory import frugal

WIDTH = 64
SHARD_BYTES = 16 << 20
#: Digests of shared payloads that are broadcast, 32 bytes each.
MOST_BROADCAST = 200_000
#: Stored bytes that one task reads.
READ_BYTES = 16 << 20
LEVEL = 6
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "digest string, shard string, offset long, length long, n_bytes long"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = LEVEL) -> bytes:
    """A payload whose length is a positive multiple of 64, as PNG: 8-bit grey, no filter, no interlace."""
    rows = len(payload) // WIDTH
    raw = bytearray(rows * (WIDTH + 1))
    for i in range(WIDTH):
        raw[i + 1 :: WIDTH + 1] = payload[i::WIDTH]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height from the first ``HEADER_BYTES`` bytes."""
    if head[:8] != SIGNATURE or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">II", head[16:24])


def from_png(data: bytes) -> bytes:
    width, rows = png_size(data[:HEADER_BYTES])
    at, raw = 8, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            raw += data[at + 8 : at + 8 + n]
        at += n + 12
    raw = zlib.decompress(raw)
    out = bytearray(width * rows)
    for i in range(width):
        out[i::width] = raw[i + 1 :: width + 1]
    return bytes(out)


class _Shards:
    """Tar members appended to memory, flushed as whole shards."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = _file_system(root)
        self.begin()

    def begin(self) -> None:
        self.name, self.buffer, self.known = f"{uuid.uuid4().hex}.tar", io.BytesIO(), {}
        self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.USTAR_FORMAT)

    def add(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        if digest not in self.known:
            if self.buffer.tell() >= SHARD_BYTES:
                self.flush()
            png = to_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(png)
            self.tar.addfile(info, io.BytesIO(png))
            self.known[digest] = (self.buffer.tell() - len(png) - (-len(png)) % 512, len(png))
        return (self.name, *self.known[digest])

    def flush(self) -> None:
        if self.known:
            self.tar.close()
            with self.fs.open_output_stream(f"{self.root}/{self.name}") as out:
                out.write(self.buffer.getbuffer())
        self.begin()


def _writer(root: str):
    """Rows ``key, text, shared``: payloads that are not shared are stored; the others' rows have no shard yet."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shards = _Shards(root)
        for b in batches:
            rows = []
            for text, shared in zip(b.column("text").to_pylist(), b.column("shared").to_pylist(), strict=True):
                data = (text or "").encode()
                payload = data + bytes(max(-len(data) % WIDTH, WIDTH if not data else 0))
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((digest, *((None, None, None) if shared else shards.add(digest, payload)), len(data)))
            # rows whose shard is still open are safe to give out: the listing is read after the task has ended
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", "digest", "shard", "offset", "length", "n_bytes"])
        shards.flush()

    return run


def payload_digest(text: Column) -> Column:
    """SHA-256 of the padded payload, as 32 bytes."""
    body = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(body)
    padding = F.when(size == 0, WIDTH).otherwise((F.lit(WIDTH) - size % WIDTH) % WIDTH)
    return F.unhex(F.sha2(F.concat(body, F.unhex(F.repeat(F.lit("00"), padding))), 256))


def write_media(df: DataFrame, key: str, text: str, root: str | None = None) -> tuple[DataFrame, str]:
    """Store ``text`` of every row; returns the listing (key, digest, shard, offset, length, n_bytes) and the shards' folder."""
    root = root or scratch_path(df.sparkSession, "media")
    if root.startswith("file:") or "://" not in root:
        fs, path = _file_system(root)
        fs.create_dir(path, recursive=True)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), payload_digest(F.col(text)).alias("address"))
    kind = df.schema[key].dataType.simpleString()
    several = stored(rows.groupBy("address").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("address", F.lit(True).alias("shared")), "shared")
    few = F.broadcast(several) if several.count() <= MOST_BROADCAST else several.hint("merge")
    marked = rows.join(few, "address", "left").select("key", "text", F.coalesce("shared", F.lit(False)).alias("shared"))
    own = stored(marked.mapInArrow(_writer(root), f"key {kind}, {INDEX}"), "media-own")
    # of equal payloads one text is kept, combined before the shuffle
    once = rows.join(few, "address").groupBy("address").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(F.lit(None).cast(kind).alias("key"), "text", F.lit(False).alias("shared"))
    common = stored(once.mapInArrow(_writer(root), f"key {kind}, {INDEX}"), "media-shared").select("digest", "shard", "offset", "length")
    columns = ["key", "digest", "shard", "offset", "length", "n_bytes"]
    placed = own.filter("shard is null").select("key", "digest", "n_bytes").join(common.hint("merge"), "digest").select(*columns)
    return stored(own.filter("shard is not null").select(*columns).unionByName(placed), "media-index"), root


FEATURES = "width int, height int"


def with_header_metadata(listing: DataFrame, root: str) -> DataFrame:
    """Adds ``width`` and ``height`` from range reads of each member's header; no payload is read."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _file_system(root)
        name, f = None, None
        for b in batches:
            sizes = []
            for shard, offset in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True):
                if shard != name:
                    name, f = shard, fs.open_input_file(f"{path}/{shard}")
                f.seek(offset)
                sizes.append(png_size(f.read(HEADER_BYTES)))
            out = [pa.array([s[i] for s in sizes], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, "width", "height"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema) + f", {FEATURES}"
    return _by_shard(listing).mapInArrow(run, schema)


def _by_shard(listing: DataFrame) -> DataFrame:
    """Members that lie near each other together, in the order of their bytes; a task gets about ``READ_BYTES`` of them, and a member's rows are slim."""
    total = listing.agg(F.sum("length")).first()[0] or 0
    part = F.floor(F.col("offset") / (4 << 20))
    return listing.repartition(max(1, total // READ_BYTES), "shard", part).sortWithinPartitions("shard", "offset")


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(listing: DataFrame, root: str) -> DataFrame:
    """Header metadata, then every stored member read back, verified and described; a member is decoded once per run of rows."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        fs, path = _file_system(root)
        name, f, seen, row = None, None, None, None
        for b in batches:
            out = []
            for digest, shard, offset, length, width, height in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "width", "height")), strict=True):
                if shard != name:
                    name, f = shard, fs.open_input_file(f"{path}/{shard}")
                if (shard, offset) != seen:
                    f.seek(offset)
                    media = f.read(length)
                    payload = from_png(media)
                    if (found := hashlib.sha256(payload).hexdigest()) != digest or len(payload) != width * height:
                        raise ValueError(f"stored member {digest} does not match its address")
                    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    p = counts[counts > 0] / len(payload)
                    mean = int((counts * np.arange(256)).sum()) / len(payload)
                    feature = f"{width}x{height};mean={mean:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};distinct={len(p)}"
                    seen, row = (shard, offset), (len(payload), found, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                out.append(row)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*b.schema.names, *(x.split()[0] for x in READ.split(", "))])

    listed = with_header_metadata(listing, root)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema) + f", {READ}"
    return listed.mapInArrow(run, schema)
