"""Near-duplicates of embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one class, of which one row stands for all with its multiplicity. Each class has a code of ``bits`` signs in each
table; classes that share a code in a table are compared. A pair counts in the first table where its codes agree, so no list of
pairs is kept: a comparison gives each class's number of links and a spanning forest of them.

Buckets get vectors of one byte a component and the measured error of each, which bounds how far a cosine can be off. Cosines
that this settles count at once; the pairs that it leaves open, those very near the threshold, are joined with the exact
vectors and settled in double precision. So a link counts if and only if its cosine in double precision reaches the threshold. Buckets of more than ``BLOCK``
classes are dealt out in blocks and compared block against block, so that no task holds an unbounded bucket; there is no cap on partners.

``bits`` grows with the number of classes so that an average bucket stays small, and the number of tables follows from
the chance to miss a pair exactly at the threshold, ``MISS`` at most; pairs above it are missed less often. With sign hashing at 0.9
the rows dealt out grow with the 1.22th power of the classes, whatever the bucket.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of
different lengths do not link; rows that repeat an id count as vectors of their own, but
share a component, as an id is one node; rows with a null id are
kept, link with nothing and have a null component; ties do not arise (a component is named by its smallest id); vectors may have any number of
components; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import stored
from .memory import frugal

THRESHOLD = 0.9
MISS = 0.002
BUCKET = 512
BLOCK = 1024
SEED = 11


def plan_tables(classes: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a code and number of tables for so many classes."""
    bits = max(6, ceil(log2(max(1, classes) / BUCKET)))
    agree = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(miss) / log(1 - agree))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each usable vector as bytes of doubles with its 128-bit name; nulls for others."""
    import xxhash

    for b in batches:
        data, names = [], []
        for v in b.column("v").to_pylist():
            ok = v is not None and len(v) > 0 and None not in v
            x = np.array(v, np.float64) + 0.0 if ok else None
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            data.append(x.tobytes() if ok else None)
            names.append(xxhash.xxh3_128_hexdigest(data[-1]) if ok else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["id", "name", "v"])


def unit(x: np.ndarray) -> np.ndarray:
    """``x`` at length 1, whatever its exponent."""
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def shortened(x: np.ndarray) -> tuple[bytes, float, float]:
    """A vector at length 1 as whole numbers of one byte, their unit, and the length of the error."""
    u = unit(x)
    step = float(np.abs(u).max() / 127)
    q = np.rint(u / step).astype(np.int8)
    return q.tobytes(), step, float(np.linalg.norm(u - q * step)) + 1e-12


CODED = "t int, code long, id long, n long, q binary, step double, error double, codes binary"


def _coder(bits: int, tables: int, slim: bool = False):
    """A row for each vector and table, ``slim`` ones with ``t`` and ``code`` only."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                signs, short = [], []
                for v in part.column("v").to_pylist():
                    x = np.frombuffer(v, np.float64)
                    if len(x) not in planes:
                        planes[len(x)] = np.random.default_rng([SEED, len(x)]).standard_normal((len(x), tables * bits))
                    signs.append((x @ planes[len(x)]) > 0)
                    if not slim:
                        short.append(shortened(x))
                n = part.num_rows
                every = np.array(signs, bool).reshape(n, tables, bits)
                own = [pa.array(np.tile(np.arange(tables), n), pa.int32()), pa.array((every @ powers).ravel(), pa.int64())]
                if slim:
                    yield pa.RecordBatch.from_arrays(own, names=["t", "code"])
                    continue
                rep = pa.array(np.repeat(np.arange(n), tables))
                q, step, error = zip(*short, strict=True) if short else ([], [], [])
                more = [part.column("id"), part.column("n"), pa.array(q, pa.binary()), pa.array(step, pa.float64()), pa.array(error, pa.float64()), pa.array([np.packbits(c).tobytes() for c in every], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *(x.take(rep) for x in more)], names=[x.split()[0] for x in CODED.split(", ")])

    return run


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``size`` places."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


FOUND = "id long, n_links long, peer long, open boolean, n long, m long"


def _compare(threshold: float, bits: int, tables: int):
    """Rows sorted by bucket and blocks: numbers of links, a forest of them, and the pairs that are left open (``open``, with both multiplicities)."""

    def group(key: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        table, _, i, j = key
        ids, n, q, step, error, codes, block = (np.array(c) if k not in (2, 5) else c for k, c in enumerate(zip(*rows, strict=True)))
        size = np.array([len(x) for x in q])
        out = []
        for length in np.unique(size).tolist():  # one, as a rule
            own = np.flatnonzero(size == length)
            z = np.stack([np.frombuffer(q[k], np.int8) for k in own]).astype(np.float32 if length <= 1000 else np.float64)  # sums of products are exact
            left = np.flatnonzero(block[own] == i)
            right = left if i == j else np.flatnonzero(block[own] == j)
            if not len(left) or not len(right):
                continue
            s, e = step[own], error[own]
            c = (z[left] @ z[right].T).astype(np.float64) * s[left][:, None] * s[right][None, :]
            doubt = e[left][:, None] + (1 + e[left])[:, None] * e[right][None, :] + 1e-9
            near = c >= threshold - doubt
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            sure = c[a, b] >= threshold + doubt[a, b]
            a, b = left[a], right[b]
            code = np.stack([np.unpackbits(np.frombuffer(codes[k], np.uint8), count=tables * bits) for k in own]).reshape(len(own), tables, bits)[:, :table]
            code = np.packbits(code, axis=2) if table else code
            new = np.concatenate([np.zeros(0, bool), *(~(code[a[at : at + 16384]] == code[b[at : at + 16384]]).all(2).any(1) for at in range(0, len(a), 16384))])
            a, b, sure = own[a[new]], own[b[new]], sure[new]
            x, y = a[sure], b[sure]
            links = np.bincount(x, n[y], len(ids)) + np.bincount(y, n[x], len(ids))
            used = np.flatnonzero(links)
            out += [(int(ids[k]), int(links[k]), None, False, None, None) for k in used]
            out += [(int(ids[x]), 0, int(ids[y]), False, None, None) for x, y in _forest(x, y, len(ids))]
            out += [(int(ids[x]), 0, int(ids[y]), True, int(n[x]), int(n[y])) for x, y in zip(a[~sure].tolist(), b[~sure].tolist(), strict=True)]
        if out:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for t, code, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("t", "code", "i", "j", "id", "n", "q", "step", "error", "codes", "block")), strict=True):
                if (t, code, i, j) != key:
                    if len(rows) > 1:
                        yield from group(key, rows)
                    key, rows = (t, code, i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield from group(key, rows)

    return run


def _settled(threshold: float):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("v").to_pylist(), b.column("w").to_pylist(), strict=True)
            keep = [bool(unit(np.frombuffer(v, np.float64)) @ unit(np.frombuffer(w, np.float64)) >= threshold) for v, w in pairs]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "n", "m")], names=["a", "b", "n", "m"]).filter(pa.array(keep, pa.bool_()))

    return run


def _one_node_an_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of every id that has several vectors to the first ids of their classes."""
    several = usable.groupBy("id").agg(F.min("name").alias("low"), F.max("name").alias("high")).filter("low != high").select("id")
    named = usable.select("id", "name").join(several, "id").join(classes.select("name", F.col("id").alias("first_id")), "name")
    return named.select(F.col("id").alias("a"), F.col("first_id").alias("b"))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    clean = rows.mapInArrow(_clean, "id long, name string, v binary")
    named = stored(clean.select("id", "name", F.when(F.col("id").isNotNull(), F.col("v")).alias("v")), "vectors")
    usable = named.filter("id is not null and name is not null")
    classes = usable.groupBy("name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    # one row of each class, with its vector and a number of its own, which the written table fixes
    vectors = usable.join(classes.hint("merge"), ["name", "id"]).dropDuplicates(["name", "id"])
    vectors = stored(vectors.select("name", "n", "v", F.col("id").alias("first_id"), F.monotonically_increasing_id().alias("id")), "classes")
    bits, tables = plan_tables(vectors.count(), threshold)
    sizes = vectors.select("v").mapInArrow(_coder(bits, tables, slim=True), "t int, code long").groupBy("t", "code").count()
    blocks = sizes.filter(F.col("count") > BLOCK).select("t", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("g"))
    blocks = stored(blocks, "hot")
    dealt = vectors.mapInArrow(_coder(bits, tables), CODED)
    if not blocks.isEmpty():
        dealt = dealt.join(blocks, ["t", "code"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "q"), F.col("g")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    else:
        dealt = dealt.withColumn("block", F.lit(0)).withColumn("other", F.lit(0))
    dealt = dealt.select("t", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "n", "q", "step", "error", "codes", "block")
    grouped = dealt.repartition("t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j")
    found = stored(grouped.mapInArrow(_compare(threshold, bits, tables), FOUND), "found")
    # what the short vectors leave open is settled by the exact ones
    exact = vectors.select(F.col("id").alias("a"), "v"), vectors.select(F.col("id").alias("b"), F.col("v").alias("w"))
    doubtful = found.filter("open").select(F.col("id").alias("a"), F.col("peer").alias("b"), "n", "m")
    settled = stored(doubtful.join(exact[0].hint("merge"), "a").join(exact[1].hint("merge"), "b").mapInArrow(_settled(threshold), "a long, b long, n long, m long"), "settled")
    counts = found.select("id", "n_links").unionByName(settled.select(F.col("a").alias("id"), F.col("m").alias("n_links"))).unionByName(settled.select(F.col("b").alias("id"), F.col("n").alias("n_links")))
    links = counts.groupBy("id").agg(F.sum("n_links").alias("linked"))
    edges = found.filter("peer is not null and not open").select(F.col("id").alias("a"), F.col("peer").alias("b")).unionByName(settled.select("a", "b"))
    for end in ("a", "b"):  # from numbers of classes to their ids
        edges = edges.join(vectors.select(F.col("id").alias(end), F.col("first_id").alias(f"{end}_id")).hint("merge"), end)
    components = connected_components(_one_node_an_id(usable, classes).unionByName(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))))
    result = vectors.select("id", "name", "n", "first_id").join(links, "id", "left").join(components.select(F.col("node").alias("first_id"), "component"), "first_id", "left")
    result = result.select("name", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component_id"))
    out = named.select("id", F.when(F.col("id").isNotNull(), F.col("name")).alias("name"))
    linked = out.filter("name is not null").join(result.hint("merge"), "name").select("id", "n_links", "component_id")
    alone = out.filter("name is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
