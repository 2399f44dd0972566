"""Exact removal of repeated byte strings with suffix arrays sorted in two stages.

A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else, in the same document or another.

To keep suffix arrays to bounded blocks, every string ("window") of ``length`` bytes is sent to the block of its anchor: the
leftmost smallest hash among its ``GRAM``-byte grams. Equal windows have equal anchors, so windows that repeat meet. Windows
in a row with one anchor form one context, the bytes that they span. Anchors that occur once are done; where all contexts of an
anchor are equal, all their windows repeat; for the rest one copy of each distinct context goes to its anchor's block. There
the suffixes smaller than their successors are sorted directly, the others are induced by bucket scans, and windows whose common
prefix with a neighbour reaches ``length`` repeat. Anchors with more than ``MOST_CONTEXTS`` distinct contexts, say a passage
that very many documents share with changes, are dealt out further: windows by their distance to the anchor, ``STEP`` at a
time, and by the bytes that all windows of such a step have in common, to cells that are sorted like anchors. A cell that is
still too large is dealt out by the window itself: there equal strings alone are together, are counted with map-side
combine, and need no sorting.

Data movement: about one anchor row for every 85 bytes, combined before it is shuffled; texts go through one shuffle, used for cutting
contexts and for the result. Groups of copies collapse to one context with a count. The share of an anchor's rows that is joined
is split by AQE.

Defined cases: null text is empty; texts shorter than ``length`` stay; texts of any length are read whole; rows that repeat are
documents of their own, so their long enough texts are removed; rows that repeat an id with other texts are kept apart; a null id is kept; ties do not arise (every place of a string that
repeats is removed); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

LENGTH = 200
GRAM = 32
MOST_CONTEXTS = 512
#: Windows of a crowded anchor that are dealt out together.
STEP = 16
BLOCK_BYTES = 1 << 18
#: Added to the checksum of rows without an id.
NO_ID = 1 << 40

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(29))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes that start at each place; ``gram`` is a power of two."""
    h = (data.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    n = 1
    with np.errstate(over="ignore"):
        while n < gram:
            h = h[:-n] * U(0xC2B2AE3D27D4EB4F + 2 * n) + h[n:]
            h ^= h >> U(31)
            n *= 2
    return _mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return x if n == width else np.minimum(x[: len(x) - (width - n)], x[width - n :])


def anchors(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts of documents laid end to end: (document, first window, last window, anchor hash), windows as places in ``data``."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    h = gram_hashes(data, gram)
    # the place in the low half makes ties go to the left; only the order of the high half counts, which equal windows share
    least = sliding_min((h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U), length - gram + 1)
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(at)]
    inside = np.arange(len(at)) + length <= ends
    same = np.zeros(len(at), bool)
    same[1:] = inside[:-1] & (at[1:] == at[:-1])
    first = np.flatnonzero(inside & ~same)
    follows = np.zeros(len(at) + 1, bool)
    follows[: len(at)] = inside & same
    last = np.flatnonzero(inside & ~follows[1:])
    document = np.repeat(np.arange(len(sizes)), sizes)[first]
    return document, first, last, h[at[first]]


def _find(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            ids, tags, bodies = b.column("id"), b.column("tag"), b.column("body")
            part = np.cumsum(pc.binary_length(bodies).to_numpy()) // (2 << 20)
            for at, end in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]):
                texts = bodies.slice(at, end - at).to_pylist()
                whole = b"".join(texts)
                starts = np.cumsum([0, *map(len, texts)])
                doc, first, last, anchor = anchors(np.frombuffer(whole, np.uint8), np.diff(starts), length, gram)
                view = memoryview(whole)
                names = np.fromiter((xxhash.xxh3_64_intdigest(view[x : y + length]) for x, y in zip(first.tolist(), last.tolist(), strict=True)), U, len(first))
                where = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at).take(where), tags.slice(at, end - at).take(where), pa.array((first - starts[doc]).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(names.view(np.int64))],
                    names=["id", "tag", "first", "more", "anchor", "context"],
                )

    return run


def suffix_array(pieces: list[bytes], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes of the pieces by their first ``depth`` bytes.

    Returns the places of the suffixes in order, the common prefix of each with the one before (up to ``depth``), and
    where each piece begins; the pieces are laid end to end with one place between, so that no suffix leaves its piece.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\x00".join([*pieces, b""]) + bytes(depth + 8), np.uint8)
    n = int((sizes + 1).sum())
    x = raw[:n].astype(np.int16) + 1
    ends = begin + sizes
    x[ends] = 0
    left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes up to the end of the piece
    # which suffixes are smaller than their successors: told by the next byte that differs
    step = np.zeros(n, np.int64)
    step[:-1] = np.sign(x[1:].astype(np.int64) - x[:-1])
    step[ends] = 1
    differs = np.minimum.accumulate(np.where(step != 0, np.arange(n), n - 1)[::-1])[::-1]
    small = step[differs] > 0
    counts = np.bincount(x, minlength=257)
    bucket_end = np.cumsum(counts)
    head = bucket_end - counts  # next free place for induced suffixes
    order = np.empty(n, np.int64)
    # first stage: sort the small ones directly, behind the places of the induced ones of their bucket
    direct = np.flatnonzero(small & (x > 0))
    if len(direct):
        # shorter suffixes first, as bytes of value 0 compare like an end and the sort is stable
        direct = direct[np.argsort(np.minimum(left[direct], depth).astype(np.int16), kind="stable")]
        view = np.lib.stride_tricks.sliding_window_view(raw, depth)[direct]
        short = np.flatnonzero(left[direct] < depth)
        if len(short):
            view[short] = np.where(np.arange(depth) < left[direct[short], None], view[short], 0)
        direct = direct[np.argsort(np.ascontiguousarray(view).view(f"S{depth}").ravel(), kind="stable")]
    per = np.bincount(x[direct], minlength=257)
    from_direct = np.concatenate([[0], np.cumsum(per)])
    order[: len(ends)] = ends
    head[0] = 0

    def induce(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[(x[before] > 0) & ~small[before]]
        if not len(before):
            return
        c = x[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        many = np.bincount(c, minlength=257)
        rank = np.arange(len(c)) - (np.cumsum(many) - many)[c]
        order[head[c] + rank] = before
        head[:] += many

    # second stage: scan the buckets; what a suffix induces lies in its own bucket, further on, or in a later one
    induce(order[: len(ends)])
    for c in np.flatnonzero(counts[1:]) + 1:
        done = bucket_end[c] - counts[c]
        while done < head[c]:
            done, new = head[c], order[done : head[c]]
            induce(new.copy())
        order[head[c] : bucket_end[c]] = direct[from_direct[c] : from_direct[c + 1]]
        induce(order[head[c] : bucket_end[c]])
    return order, _common(raw, left, order, depth), begin


def _common(raw: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in the order with the one before, eight bytes at a time."""
    words = np.ndarray(len(raw) - 7, np.dtype("<u8"), raw, strides=(1,))
    most = np.zeros(len(order), np.int64)
    most[1:] = np.minimum(np.minimum(left[order[1:]], left[order[:-1]]), depth)
    common = most.copy()
    active = np.flatnonzero(most > 0)
    for at in range(0, depth, 8):
        differ = words[order[active] + at] ^ words[order[active - 1] + at]
        other = np.flatnonzero(differ)
        lowest = differ[other] & (~differ[other] + U(1))
        same = (np.log2(lowest.astype(np.float64)).astype(np.int64)) // 8
        common[active[other]] = np.minimum(common[active[other]], at + same)
        active = active[differ == 0]
        active = active[most[active] > at + 8]
        if not len(active):
            break
    return common


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Sorted distinct numbers as runs (first, last)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [len(places) - 1]])].tolist(), strict=True))


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each piece the runs of window starts whose window also starts elsewhere in the pieces."""
    order, common, begin = suffix_array(pieces, length)
    hit = np.flatnonzero(common >= length)
    places = np.unique(np.concatenate([order[hit], order[hit - 1]]))
    piece = np.searchsorted(begin, places, side="right") - 1
    at = np.searchsorted(piece, np.arange(len(pieces) + 1))
    return [_runs(places[a:b] - begin[k]) for k, (a, b) in enumerate(pairwise(at.tolist()))]


RUNS = "anchor long, context long, runs array<struct<first:int,last:int>>"


def _blocks(length: int):
    """Rows sorted by anchor: whole anchors are gathered to blocks of about ``BLOCK_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, names, pieces, size = None, [], [], 0

        def done() -> pa.RecordBatch:
            found = [(a, c, r) for (a, c), r in zip(names, repeated_windows(pieces, length), strict=True) if r] if pieces else []
            runs = [[{"first": x, "last": y} for x, y in r] for _, _, r in found]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=["anchor", "context", "runs"])

        for b in batches:
            for a, c, body in zip(*(b.column(k).to_pylist() for k in ("anchor", "context", "body")), strict=True):
                if a != anchor and size >= BLOCK_BYTES:
                    yield done()
                    names, pieces, size = [], [], 0
                anchor = a
                names.append((a, c))
                pieces.append(body)
                size += len(body)
        yield done()

    return run


def anchor_place(body: bytes, length: int = LENGTH, gram: int = GRAM) -> int:
    """Where in a context the gram lies that all its windows have as their anchor."""
    return int(np.argmin(gram_hashes(np.frombuffer(body[:length], np.uint8), gram) >> U(32)))


PIECES = "anchor long, context long, n long, place int, cell long, piece long, part binary"


def _pieces(length: int, gram: int, step: int):
    """Contexts of crowded anchors cut to pieces of up to ``step`` windows; ``cell`` names anchor, distance and common bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = []
                for anchor, context, n, body in zip(*(b.slice(at, 1000).column(c).to_pylist() for c in ("anchor", "context", "n", "body")), strict=True):
                    place, last = anchor_place(body, length, gram), len(body) - length
                    for j in range((place - last) // step if place > last else 0, place // step + 1):
                        high = place - j * step
                        low = high - step + 1
                        core = xxhash.xxh3_64_intdigest(body[high : low + length], seed=j)
                        part = body[max(low, 0) : min(high, last) + length]
                        rows.append((anchor, context, n, max(low, 0), _signed(core ^ (anchor & (2**64 - 1))), _signed(xxhash.xxh3_64_intdigest(part)), part))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _cells(length: int):
    """Each window of a piece by its 128-bit name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                name, row, place = [], [], []
                for k, body in enumerate(part.column("body").to_pylist()):
                    view = memoryview(body)
                    for i in range(len(body) - length + 1):
                        name.append(xxhash.xxh3_128_digest(view[i : i + length]))
                        row.append(k)
                        place.append(i)
                where = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(where) for c in ("anchor", "context", "n")), pa.array(name, pa.binary()), pa.array(place, pa.int32())], names=["anchor", "context", "n", "cell", "place"])

    return run


def _sorted_runs(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated windows of ``bodies(anchor, context, body)`` by suffix arrays of whole anchors."""
    return bodies.select("anchor", "context", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_blocks(length), RUNS)


def _counted_runs(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated windows of ``bodies(anchor, context, n, body)`` by counts of the windows."""
    cells = stored(bodies.select("anchor", "context", "n", "body").mapInArrow(_cells(length), "anchor long, context long, n long, cell binary, place int"), "cells")
    full = stored(cells.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").select("cell"), "full")
    return cells.join(full.hint("merge"), "cell").groupBy("anchor", "context").agg(F.collect_list(F.struct(F.col("place").alias("first"), F.col("place").alias("last"))).alias("runs"))


def _crowded_runs(bodies: DataFrame, length: int, gram: int, step: int, most: int) -> DataFrame:
    """Repeated windows of contexts of crowded anchors, by cells."""
    pieces = stored(bodies.select("anchor", "context", "n", "body").mapInArrow(_pieces(length, gram, step), PIECES), "pieces")
    distinct = pieces.groupBy("cell", "piece").agg(F.sum("n").alias("n"), F.min("part").alias("body"))
    distinct = stored(distinct.select(F.col("cell").alias("anchor"), F.col("piece").alias("context"), "n", "body"), "distinct")
    crowds = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")), "crowds")
    distinct = distinct.join(crowds.hint("merge"), "anchor")
    runs = _sorted_runs(distinct.filter(F.col("contexts") <= most), length).unionByName(_counted_runs(distinct.filter(F.col("contexts") > most), length))
    copied = distinct.filter("n > 1").select("anchor", "context", F.array(F.struct(F.lit(0).alias("first"), (F.octet_length("body") - length).alias("last"))).alias("runs"))
    every = runs.unionByName(copied).select(F.col("anchor").alias("cell"), F.col("context").alias("piece"), "runs")
    hit = pieces.drop("part").join(stored(every, "cell-runs").hint("merge"), ["cell", "piece"])
    return hit.select("anchor", "context", F.transform("runs", lambda r: F.struct((r["first"] + F.col("place")).alias("first"), (r["last"] + F.col("place")).alias("last"))).alias("runs"))


CUT = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<first:int,end:int>>, kept binary"


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, rows = b.slice(at, 1000), []
                for body, windows in zip(part.column("body").to_pylist(), part.column("windows").to_pylist(), strict=True):
                    spans: list[list[int]] = []
                    for w in sorted(windows or (), key=lambda w: (w["first"], w["last"])):
                        if spans and w["first"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], w["last"] + length)
                        else:
                            spans.append([w["first"], w["last"] + length])
                    keep, last = [], 0
                    for first, end in spans:
                        keep.append(body[last:first])
                        last = end
                    kept = b"".join([*keep, body[last:]])
                    rows.append((len(body), len(body) - len(kept), len(spans), [{"first": x, "end": y} for x, y in spans], kept))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in ("id", "n_bytes", "n_removed", "n_spans", "spans", "kept")])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS, step: int = STEP) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, spans, kept`` for every row; ``kept`` are the bytes that stay."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    docs = df.select(F.col(key).cast("long").alias("id"), F.coalesce(body, F.lit(b"")).alias("body"))
    # rows are told apart by id and a checksum of the text, those without an id by 96 bits of the text
    docs = docs.select(F.coalesce("id", F.xxhash64("body")).alias("id"), (F.crc32("body") + F.when(F.col("id").isNull(), NO_ID).otherwise(0)).alias("tag"), "body")
    found = docs.mapInArrow(_find(length, gram), "id long, tag long, first int, more int, anchor long, context long")
    found = stored(found, "anchors")
    groups = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).filter("n > 1")
    # written first, so that the join has an exchange of its own on either side, which AQE can split
    groups = stored(groups.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "groups")
    again = found.join(groups.hint("merge"), "anchor")
    again = stored(again, "repeated")
    equal = again.filter("not mixed").select("id", "tag", "first", (F.col("first") + F.col("more")).alias("last"))
    mixed = again.filter("mixed")
    contexts = mixed.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tag", "first", "more")).alias("r"))
    crowds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"))
    contexts = contexts.join(crowds.hint("merge"), "anchor")
    holders = contexts.select("anchor", "context", "n", "contexts", "r.*")
    bodies = docs.hint("merge").join(holders, ["id", "tag"])
    bodies = bodies.select("anchor", "context", "n", "contexts", F.substring(F.col("body"), F.col("first") + 1, F.col("more") + length).alias("body"))
    runs = _sorted_runs(bodies.filter(F.col("contexts") <= most_contexts), length)
    hit = _crowded_runs(bodies.filter(F.col("contexts") > most_contexts), length, gram, step, most_contexts)
    # contexts that occur more than once repeat as a whole
    copied = contexts.filter("n > 1").select("anchor", "context", F.array(F.struct(F.lit(0).alias("first"), F.col("r.more").alias("last"))).alias("runs"))
    every = runs.unionByName(hit).unionByName(copied).groupBy("anchor", "context").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    every = stored(every, "runs")  # as above: a context of very many copies can be split
    varied = mixed.join(every.hint("merge"), ["anchor", "context"]).select("id", "tag", F.explode("runs").alias("w"), F.col("first").alias("at"))
    varied = varied.select("id", "tag", (F.col("at") + F.col("w.first")).alias("first"), (F.col("at") + F.col("w.last")).alias("last"))
    windows = equal.unionByName(varied).groupBy("id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("windows"))
    out = docs.hint("merge").join(windows, ["id", "tag"], "left").select(F.when(F.col("tag") < NO_ID, F.col("id")).alias("id"), "body", "windows").mapInArrow(_cut(length), CUT)
    return out.select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "spans", "kept")
