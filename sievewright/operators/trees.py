"""Gradient-boosted trees over sparse rows, by histograms that Spark sums.

A row is a list of places and a list of weights; a place that it lacks is missing there. Each place's weights are cut into ``bins`` quantile bins
(every distinct weight is one where there are no more); a bin is known by its largest weight, the cut, which is infinite for the last one. A round fits a tree to the gradients and curvatures of
the logistic loss on a sample of the rows, with a sample of the places, level by level.

Data movement: rows are kept in blocks, each one table row with the places, bins and row numbers of its entries in the order of (place, bin), packed into four bytes each. A level is one pass. Each task sums
gradient and curvature by (node, place, bin) over its blocks, and gives one row of packed sums for each bucket of places, so that a shuffle by bucket carries sums and no rows; what is missing at a
place is the node's total less the sum over its bins. A round's totals and losses travel beside its first level. The best split of each node, one row, goes to the driver, and from there to the
tasks of the next level: the tree, ``2 ** depth`` nodes. Sums are integers (units of ``1 / UNIT``), so that trees do not depend on the order of tasks. Margins are written again every ``KEEP``
rounds; in between they come from the stored ones and the trees since.

That holds where tasks cannot run side by side. Where they can, entries are dealt out once by place: each task keeps all entries of its places, four bytes each and in a file beyond ``HELD``, and the rows' labels, margins and nodes,
and goes through all rounds in one stage. Of a level the tasks exchange their best splits and one bit a row, on which side it goes; no sums are moved. Both ways give the same trees.

Each split learns to which side missing rows go. Splits need ``least`` curvature on both sides and a positive gain
``GL^2/(HL+penalty) + GR^2/(HR+penalty) - G^2/(H+penalty)``; of equal gains the lowest place, then the lowest cut, then missing to the right wins. The first margin is the
log-odds of the training rows. If there are validation rows, fitting ends when their loss has not fallen for ``patience`` rounds.
"""

from __future__ import annotations

import json
import math
import secrets
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .ranges import running
from .together import Circle, slots

UNIT = 2.0**30
KEEP = 20
#: Rows that are looked at together in a task when margins are predicted, and entries that make a block full when trees are fitted.
SLICE, ENTRIES = 1024, 1 << 20
LEAST_GAIN = 1e-6
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class TreeConfig:
    rounds: int = 120
    depth: int = 4
    rate: float = 0.1
    rows: float = 0.8
    places: float = 0.8
    bins: int = 256
    patience: int = 20
    penalty: float = 1.0
    least: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number, the root 0, those below ``i`` at ``2i + 1`` and ``2i + 2``: splits ``(place, cut, missing_left)`` and values of leaves."""

    splits: dict[int, tuple[int, float, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)

    def places(self) -> set[int]:
        return {p for p, _, _ in self.splits.values()}


@dataclass
class Forest:
    start: float
    size: int
    trees: list[Tree]
    best_round: int | None = None
    losses: list[tuple[float, float | None]] = field(default_factory=list)

    def to_dict(self) -> dict:
        plain = [{"splits": [[n, *s] for n, s in t.splits.items()], "values": [[n, v] for n, v in t.values.items()], "gains": [[n, g] for n, g in t.gains.items()]} for t in self.trees]
        return {"start": self.start, "size": self.size, "best_round": self.best_round, "losses": self.losses, "trees": plain}

    @classmethod
    def from_dict(cls, d: dict) -> Forest:
        trees = [Tree({n: (p, c, bool(m)) for n, p, c, m in t["splits"]}, {n: v for n, v in t["values"]}, {n: g for n, g in t["gains"]}) for t in d["trees"]]
        return cls(d["start"], d["size"], trees, d["best_round"], [tuple(x) for x in d["losses"]])


def uniform(numbers: np.ndarray, *seeds: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on ``numbers`` and ``seeds`` alone."""
    with np.errstate(over="ignore"):
        x = numbers.astype(np.int64).view(np.uint64)
        for s in (*seeds, 0):
            x = x + np.uint64((s * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & int(MASK))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def places_of_round(size: int, share: float, seed: int, turn: int) -> np.ndarray:
    """Which of ``size`` places a round sees: the given share of them, one at least."""
    out = np.zeros(size, bool)
    out[np.argsort(uniform(np.arange(size), seed, 1, turn), kind="stable")[: max(1, math.floor(share * size))]] = True
    return out


@dataclass
class Slice:
    """Some rows in one run: places and weights side by side, and how many each row has."""

    margin: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    weights: np.ndarray

    def dense(self, wanted: np.ndarray, size: int) -> np.ndarray:
        """Weights of the ``wanted`` places, a column each; missing ones are NaN."""
        column = np.full(size, -1, np.int64)
        column[wanted] = np.arange(len(wanted))
        at = column[self.places]
        hit = at >= 0
        out = np.full((len(self.counts), len(wanted)), np.nan)
        out[np.repeat(np.arange(len(self.counts)), self.counts)[hit], at[hit]] = self.weights[hit]
        return out


def packed(v: np.ndarray, kind: type) -> bytes:
    """Whole numbers in the bytes of ``kind``, and those that do not fit beside them."""
    low = v.astype(kind)
    rest = v - low.astype(np.int64)
    at = np.flatnonzero(rest)
    return np.concatenate([[len(at)], at, rest[at]]).astype(np.int64).tobytes() + low.tobytes()


def unpacked(b: pa.BinaryScalar, kind: type) -> np.ndarray:
    b = b.as_buffer()
    n = int(np.frombuffer(b, np.int64, 1)[0])
    at, rest = np.frombuffer(b, np.int64, 2 * n, 8).reshape(2, n)
    out = np.frombuffer(b, kind, offset=8 + 16 * n).astype(np.int64)
    out[at] += rest
    return out


@dataclass(frozen=True)
class Codes:
    """One number for each (place, bin), in the order of (bucket, place, bin); a place's bucket is its rest by ``buckets``."""

    size: int
    bins: int
    buckets: int

    @property
    def span(self) -> int:
        return self.bins + 1  # bins count from 0 or from 1

    def first(self, buckets: np.ndarray) -> np.ndarray:
        """Where the codes of these buckets begin."""
        return (buckets * (self.size // self.buckets) + np.minimum(buckets, self.size % self.buckets)) * self.span

    def of(self, places: np.ndarray) -> np.ndarray:
        """The code of bin 0 of each place."""
        return self.first(places % self.buckets) + places // self.buckets * self.span

    def places(self) -> np.ndarray:
        """The places in the order of their codes."""
        places = np.arange(self.size)
        return places[np.argsort(self.of(places))]


#: A block: for each row its id, label and margin; for each entry how far its code lies after the one before, and its row.
BLOCK = "validation boolean, id binary, y binary, margin binary, step binary, row binary"


@dataclass
class Block:
    """Training rows or validation rows, whose entries lie in the order of their codes."""

    validation: bool
    id: np.ndarray
    y: np.ndarray
    margin: np.ndarray
    code: np.ndarray
    row: np.ndarray
    codes: Codes

    @classmethod
    def of(cls, b: pa.RecordBatch, i: int, codes: Codes) -> Block:
        plain = [np.frombuffer(b[name][i].as_buffer(), kind) for name, kind in (("id", np.int64), ("y", np.float64), ("margin", np.float64))]
        return cls(b["validation"][i].as_py(), *plain, np.cumsum(unpacked(b["step"][i], np.uint16)), unpacked(b["row"][i], np.uint16), codes)

    @classmethod
    def made(cls, validation: bool, id: np.ndarray, y: np.ndarray, counts: np.ndarray, places: np.ndarray, bins: np.ndarray, codes: Codes) -> Block:
        code = codes.of(places.astype(np.int64)) + bins
        order = np.argsort(code, kind="stable")
        return cls(validation, id, y, np.zeros(len(id)), code[order], np.repeat(np.arange(len(id)), counts)[order], codes)

    def batch(self) -> pa.RecordBatch:
        plain = {name: getattr(self, name).tobytes() for name in ("id", "y", "margin")}
        whole = {**plain, "step": packed(np.diff(self.code, prepend=0), np.uint16), "row": packed(self.row, np.uint16)}
        return pa.RecordBatch.from_pydict({"validation": pa.array([self.validation]), **{name: pa.array([b], pa.binary()) for name, b in whole.items()}})

    def dense(self, wanted: np.ndarray, size: int) -> np.ndarray:
        """Bins of the ``wanted`` places, a column each; missing ones are NaN."""
        out = np.full((len(self.id), len(wanted)), np.nan)
        first = self.codes.of(wanted)
        low, high = np.searchsorted(self.code, first), np.searchsorted(self.code, first + self.codes.span)
        for k, (i, j) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            out[self.row[i:j], k] = self.code[i:j] - first[k]
        return out


def blocks(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block.of(batch, i, codes)


def nodes_of(rows: Slice | Block, trees: list[Tree], size: int) -> list[np.ndarray]:
    """For each tree the node that each row comes to."""
    wanted = np.array(sorted(set().union(*[t.places() for t in trees])), np.int64) if trees else np.zeros(0, np.int64)
    x, column = rows.dense(wanted, size), {p: i for i, p in enumerate(wanted.tolist())}
    out = []
    for tree in trees:
        node = np.zeros(len(rows.margin), np.int64)
        for number, (place, cut, missing_left) in sorted(tree.splits.items()):
            here = np.flatnonzero(node == number)
            v = x[here, column[place]]
            left = np.where(np.isnan(v), missing_left, v <= cut)
            node[here] = 2 * number + np.where(left, 1, 2)
        out.append(node)
    return out


def margins_of(rows: Slice | Block, trees: list[Tree], size: int) -> np.ndarray:
    out = rows.margin.copy()
    for tree, node in zip(trees, nodes_of(rows, trees, size), strict=True):
        values = np.zeros(max(tree.values) + 1)
        values[list(tree.values)] = list(tree.values.values())
        out += values[node]
    return out


def slopes(rows: Block, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the loss, in units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - rows.y) * UNIT).astype(np.int64), np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT).astype(np.int64)


def sampled(rows: Block, config: TreeConfig, turn: int) -> np.ndarray:
    return uniform(rows.id, config.seed, 2, turn) < config.rows


def summed(key: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``g`` and ``h`` over equal keys, sorted by them."""
    if not len(key):
        return key, g, h
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.add.reduceat(g[order], starts), np.add.reduceat(h[order], starts)


def splits_of(key: np.ndarray, g: np.ndarray, h: np.ndarray, totals: list[tuple[int, int, int]], codes: Codes, config: TreeConfig) -> list[tuple]:
    """The best split of each node among these sums, which hold whole places: ``(node, gain, place, bin, missing_left, g_left, h_left)``.

    A key is a code, after those of all nodes before in ``totals(node, g, h)``.
    """
    key, g, h = summed(key, g, h)
    if not len(key):
        return []
    group = key // codes.span
    rank, place = group // codes.size, codes.places()[group % codes.size]
    first = np.append(True, group[1:] != group[:-1])
    starts, last, group = np.flatnonzero(first), np.append(first[1:], True), np.cumsum(first) - 1
    all_g, all_h = (np.array([t[k] for t in totals], np.int64)[rank] for k in (1, 2))
    missing_g, missing_h = (t - np.add.reduceat(v, starts)[group] for t, v in ((all_g, g), (all_h, h)))
    upto_g, upto_h = ((c := np.cumsum(v)) - (c[starts] - v[starts])[group] for v in (g, h))

    right, left = gains(upto_g, upto_h, all_g, all_h, config), np.where(last, -np.inf, gains(upto_g + missing_g, upto_h + missing_h, all_g, all_h, config))
    best = np.maximum(right, left)
    out = []
    for n in np.unique(rank).tolist():
        low, high = np.searchsorted(rank, [n, n + 1])
        top = low + np.flatnonzero(best[low:high] == best[low:high].max())
        i = top[place[top] == place[top].min()][0]  # several buckets may lie in one task
        if best[i] > 0:
            with_missing = bool(left[i] > right[i])
            out.append((totals[n][0], float(best[i]), int(place[i]), int(key[i] % codes.span), with_missing, int(upto_g[i] + with_missing * missing_g[i]), int(upto_h[i] + with_missing * missing_h[i])))
    return out


def bins_and_cuts(weights: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """``place, weight, bin`` of each distinct weight, and ``place, bin, cut``: a bin's largest weight; the last bin of a place has no end."""
    values = weights.groupBy("place", "weight").agg(F.count(F.lit(1)).alias("n"))
    run = running(values, ["place"], [F.col("weight")], {"upto": F.col("n"), "rank": F.lit(1).cast("long")})
    totals = values.groupBy("place").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    number = F.when(F.col("distinct") <= bins, F.col("rank")).otherwise(F.floor((F.col("upto") - F.col("n")) * bins / F.col("total")))
    numbered = stored(run.join(totals, "place").select("place", "weight", number.alias("bin")), "bins")
    cuts = numbered.groupBy("place", "bin").agg(F.max("weight").alias("cut"))
    last = cuts.groupBy("place").agg(F.max("bin").alias("last"))
    return numbered, cuts.join(last, "place").select("place", "bin", F.when(F.col("bin") == F.col("last"), float("inf")).otherwise(F.col("cut")).alias("cut"))


def with_cuts(weights: DataFrame, bins: int) -> DataFrame:
    """``id, place, cut`` from ``id, place, weight``: each weight's bin, known by its cut."""
    numbered, cuts = bins_and_cuts(weights, bins)
    return weights.join(numbered.join(cuts, ["place", "bin"]), ["place", "weight"]).select("id", "place", "cut")


def training_blocks(rows: DataFrame, weights: DataFrame, codes: Codes) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``rows(id, y, validation)`` and ``weights(id, place, weight)``, and the bins' cuts ``place, bin, cut``; a validation row's weight lies in the first bin whose cut is not below it."""
    own = stored(weights.join(rows.filter("not validation").select("id"), "id", "left_semi"), "weights")
    numbered, cuts = bins_and_cuts(own, codes.bins)
    cuts = stored(cuts, "cuts")
    ends = cuts.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("cut", "bin"))).alias("ends"))  # at most ``bins`` a place
    held = weights.join(rows.filter("validation").select("id"), "id", "left_semi").join(ends, "place")
    held = held.select("id", "place", F.filter("ends", lambda e: e["cut"] >= F.col("weight"))[0]["bin"].alias("bin"))
    entries = own.join(numbered, ["place", "weight"]).select("id", "place", "bin").unionByName(held)
    lists = entries.groupBy("id").agg(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("bin").cast("int").alias("bin"))).alias("w"))
    none = F.array().cast(lists.schema["w"].dataType)
    full = rows.join(lists, "id", "left").select(F.col("id").cast("long").alias("id"), F.col("y").cast("double").alias("y"), "validation", F.coalesce("w", none).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}

        def given(validation: bool) -> pa.RecordBatch:
            t = pa.Table.from_batches(held[validation]).combine_chunks().to_batches()[0]
            w = t["w"].flatten()
            held[validation] = []
            return Block.made(validation, t["id"].to_numpy(), t["y"].to_numpy(), np.diff(t["w"].offsets.to_numpy()), *[w.field(k).to_numpy() for k in range(2)], codes).batch()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for validation in (False, True):
                    some = piece.filter(pc.equal(piece["validation"], validation))
                    if some.num_rows:
                        held[validation].append(some)
                        if sum(len(x["w"].flatten()) for x in held[validation]) >= ENTRIES:
                            yield given(validation)
        for validation, parts in held.items():
            if parts:
                yield given(validation)

    # dealt out by id, so that blocks are of one size
    out = stored(full.repartition(codes.buckets, "id").mapInArrow(run, BLOCK), "training")
    discard(own, numbered)
    return out, cuts


FOUND = pa.schema([("node", pa.int64()), ("gain", pa.float64()), ("place", pa.int64()), ("bin", pa.int64()), ("missing_left", pa.bool_()), ("g", pa.int64()), ("h", pa.int64()), ("loss", pa.float64()), ("held", pa.float64()), ("n", pa.int64()), ("m", pa.int64())])


def _level(work: DataFrame, trees: list[Tree], tree: Tree, totals: dict[int, tuple[int, int]] | None, codes: Codes, config: TreeConfig, turn: int) -> tuple[list, tuple[int, int, float, float | None]]:
    """The best splits of the nodes in ``totals``, one row for each that has one; without ``totals`` those of the root.

    With them come totals of the round's sample, and the losses of all training and validation rows before it.
    """
    numbers, size, buckets = sorted(totals) if totals else [0], codes.size, codes.buckets

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = places_of_round(size, config.places, config.seed, turn)[codes.places()]
        ranks = np.full(2 * numbers[-1] + 3, -1, np.int64)
        ranks[numbers] = np.arange(len(numbers))
        parts: list[tuple] = []
        total, counts, losses = [0, 0], [0, 0], [0.0, 0.0]

        def given() -> Iterator[pa.RecordBatch]:
            key, g, h = parts[0] if len(parts) == 1 else summed(*[np.concatenate(x) for x in zip(*parts, strict=True)]) if parts else [np.zeros(0, np.int64)] * 3
            parts.clear()
            code, rank = key // len(numbers), (key % len(numbers)).astype(np.uint16)
            first = codes.first(np.arange(buckets + 1))
            ends = np.searchsorted(code, first)
            of = list(zip(first.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=False))
            columns = [[packed(np.diff(code[i:j], prepend=f), np.uint16) for f, i, j in of], [rank[i:j].tobytes() if len(numbers) > 1 else b"" for _, i, j in of], *[[packed(v[i:j], np.int32) for _, i, j in of] for v in (g, h)]]
            beside = [pa.array([x] * buckets, kind) for x, kind in ((total[0], pa.int64()), (total[1], pa.int64()), (losses[0], pa.float64()), (losses[1], pa.float64()), (counts[0], pa.int64()), (counts[1], pa.int64()))]
            total[:], counts[:], losses[:] = [0, 0], [0, 0], [0.0, 0.0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), *[pa.array(x, pa.binary()) for x in columns], *beside], names=["bucket", "step", "rank", "gs", "hs", "g", "h", "loss", "held", "n", "m"])

        for rows in blocks(batches, codes):
            margin = margins_of(rows, trees, size)
            if totals is None:
                v = int(rows.validation)
                losses[v] += float((np.logaddexp(0, margin) - rows.y * margin).sum())
                counts[v] += len(rows.id)
            if rows.validation:
                continue
            g, h = slopes(rows, margin)
            own = sampled(rows, config, turn)
            total[0], total[1] = total[0] + int(g[own].sum()), total[1] + int(h[own].sum())
            rank = ranks[nodes_of(rows, [tree], size)[0]]
            rank[~own] = -1
            # entries of sampled rows in open nodes, at places that the round sees
            fresh = np.append(True, rows.code[1:] != rows.code[:-1])[: len(rows.code)]
            at, code = np.cumsum(fresh) - 1, rows.code[fresh]
            pick = (rank >= 0)[rows.row] & seen[code // codes.span][at]
            row = rows.row[pick]
            to = at[pick] * len(numbers) + rank[row]
            width = len(code) * len(numbers)
            hit = np.zeros(width, bool)
            hit[to] = True
            hit = np.flatnonzero(hit)
            # whole numbers below 2 ** 53 are summed exactly
            one, two = (np.bincount(to, v[row], width)[hit].astype(np.int64) for v in (g, h))
            parts.append((code[hit // len(numbers)] * len(numbers) + hit % len(numbers), one, two))
            if len(parts) > 1 and sum(len(p[0]) for p in parts) > 4 * ENTRIES:  # bounds the task's memory
                parts[:] = [summed(*[np.concatenate(x) for x in zip(*parts, strict=True)])]
                if len(parts[0][0]) > 2 * ENTRIES:
                    yield from given()
        yield from given()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, beside, first = [], np.zeros(6), None
        whole = [0, 0, 0, 0]
        for b in batches:
            for i in range(b.num_rows):
                first = b["bucket"][i].as_py() if first is None else first
                code = codes.first(np.int64(b["bucket"][i].as_py())) + np.cumsum(unpacked(b["step"][i], np.uint16))
                rank = np.frombuffer(b["rank"][i].as_buffer(), np.uint16).astype(np.int64) if len(numbers) > 1 else 0
                parts.append([code + rank * (size * codes.span), unpacked(b["gs"][i], np.int32), unpacked(b["hs"][i], np.int32)])
                if b["bucket"][i].as_py() == first:  # every bucket has each task's totals
                    whole = [x + b[c][i].as_py() for x, c in zip(whole, ("g", "h", "n", "m"), strict=True)]
                    beside[:2] += b["loss"][i].as_py(), b["held"][i].as_py()
        if parts:
            of = [(n, *totals[n]) for n in numbers] if totals else [(0, whole[0], whole[1])]
            found = splits_of(*[np.concatenate(x) for x in zip(*parts, strict=True)], of, codes, config)
            out = [dict(zip(FOUND.names[:7], f, strict=True)) for f in found]
            state = {"g": whole[0], "h": whole[1], "loss": float(beside[0]), "held": float(beside[1]), "n": whole[2], "m": whole[3]}
            yield pa.RecordBatch.from_pylist([*out, state], schema=FOUND)

    dealt = work.mapInArrow(sums, "bucket int, step binary, rank binary, gs binary, hs binary, g long, h long, loss double, held double, n long, m long").repartition(buckets, "bucket")
    names = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    chosen, state = {}, None
    for r in dealt.mapInArrow(best, ", ".join(f"{f.name} {names[f.type]}" for f in FOUND)).collect():  # a row for each node and task at most, and one more
        if r.node is None:
            state = state or (r.g, r.h, r.loss / r.n if r.n else 0.0, r.held / r.m if r.m else None)
        elif r.node not in chosen or (r.gain, -r.place) > (chosen[r.node].gain, -chosen[r.node].place):
            chosen[r.node] = r
    return [chosen[n] for n in sorted(chosen)], state or (0, 0, 0.0, None)


def fit_tree(work: DataFrame, trees: list[Tree], found: list, total: tuple[int, int], codes: Codes, config: TreeConfig, turn: int) -> Tree:
    """A tree whose root splits as ``found`` says; its cuts are numbers of bins."""
    tree, sums = Tree(), {0: total}
    for level in range(config.depth):
        if level:
            found = _level(work, trees, tree, open_nodes, codes, config, turn)[0]
        open_nodes = {}
        for r in found:
            g, h = sums[r.node]
            tree.splits[r.node], tree.gains[r.node] = (r.place, r.bin, r.missing_left), r.gain
            open_nodes |= {2 * r.node + 1: (r.g, r.h), 2 * r.node + 2: (g - r.g, h - r.h)}
        sums |= open_nodes
        if not open_nodes:
            break
    tree.values = leaf_values(sums, tree, config)
    return tree


def _moved(work: DataFrame, trees: list[Tree], codes: Codes) -> DataFrame:
    """The blocks with the margins after ``trees``, written again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, codes):
            yield replace(rows, margin=margins_of(rows, trees, codes.size)).batch()

    return stored(work.mapInArrow(run, BLOCK), "training")


def _fit_blocks(rows: DataFrame, weights: DataFrame, start: float, size: int, config: TreeConfig) -> Forest:
    """The forest of ``rows(id, y, validation)`` and ``weights(id, place, weight)``, a few jobs a level."""
    codes = Codes(size, config.bins, rows.sparkSession.sparkContext.defaultParallelism)
    work, cuts = training_blocks(rows, weights, codes)
    # a tree of a single leaf: the first margin
    forest, since = Forest(start, size, []), [Tree(values={0: start})]
    for turn in range(config.rounds + 1):
        found, (g, h, loss, held) = _level(work, since, Tree(), None, codes, config, turn)
        if turn:
            forest.losses.append((loss, held))
            if held is not None:
                fallen = [x for _, x in forest.losses]
                forest.best_round = min(range(len(fallen)), key=lambda i: (fallen[i], i)) + 1
                if turn - forest.best_round >= config.patience:
                    break
        if turn == config.rounds:
            break
        tree = fit_tree(work, since, found, (g, h), codes, config, turn)
        forest.trees.append(tree)
        since.append(tree)
        if len(since) >= KEEP:
            moved = _moved(work, since, codes)
            discard(work)
            work, since = moved, []
    places = sorted(set().union(*[t.places() for t in forest.trees]))
    cut = {(r.place, r.bin): r.cut for r in cuts.filter(F.col("place").isin(places)).collect()}  # at most ``bins`` for each split
    for t in forest.trees:
        t.splits = {n: (place, cut[place, number], missing_left) for n, (place, number, missing_left) in t.splits.items()}
    discard(work, cuts)
    return forest


# ---- tasks that keep the entries of their places, side by side

#: A piece of rows: without a bucket the rows' ids, labels and marks, with one its entries by place and how many each place has.
PIECE = "task int, bucket int, piece long, id binary, y binary, validation binary, count binary, row binary, weight binary"
#: Buckets of places for each task, which are put in order one after the other; bytes of entries that a task holds in memory, the others lie in a file of its own.
FOLDS, HELD = 8, 1 << 28


def dealt(lists: DataFrame, size: int, tasks: int, buckets: int) -> DataFrame:
    """The entries of ``lists(id, y, validation, places, weights)``, each with the task that keeps its place; a place's bucket is its rest by ``buckets``. Every task gets the rows' labels."""
    width = -(-size // buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32

        def given() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            place, weight = (t[name].flatten().to_numpy() for name in ("places", "weights"))
            row = np.repeat(np.arange(t.num_rows, dtype=np.uint32), np.diff(t["places"].offsets.to_numpy()))
            bucket = place % buckets
            order = np.lexsort((place, bucket))
            place, row, weight, ends = place[order], row[order], weight[order].astype(np.float64), np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [t["id"].to_numpy().tobytes(), t["y"].to_numpy().tobytes(), t["validation"].to_numpy(zero_copy_only=False).tobytes()]
            parts = [(b % tasks, b, number, None, None, None, np.bincount(place[i:j] // buckets, minlength=width).astype(np.uint32).tobytes(), row[i:j].tobytes(), weight[i:j].tobytes()) for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False))]
            parts += [(k, -1, number, *own, None, None, None) for k in range(tasks)]
            number += 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*parts, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                held.append(batch.slice(at, SLICE))
                if sum(len(b["places"].flatten()) for b in held) >= ENTRIES:
                    yield given()
        if held:
            yield given()

    plain = lists.select(F.col("id").cast("long").alias("id"), F.col("y").cast("double").alias("y"), "validation", F.col("places").cast("array<int>").alias("places"), F.col("weights").cast("array<double>").alias("weights"))
    return plain.mapInArrow(run, PIECE).repartitionById(tasks, F.col("task")).sortWithinPartitions("bucket")


class Fold:
    """The entries of one bucket of places: rows in the order of (place, bin), training rows and validation rows apart. A code is a bin of a place that a training row has."""

    def __init__(self, place: np.ndarray, row: np.ndarray, weight: np.ndarray, validation: np.ndarray, bins: int, keep: Callable[[np.ndarray], Callable[[], np.ndarray]]) -> None:
        held = validation[row]
        own = np.flatnonzero(~held)
        own = own[np.lexsort((weight[own], place[own]))]
        p, w = place[own], weight[own]
        # each distinct weight of a place
        fresh = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (w[1:] != w[:-1]))[: len(p)])
        n, p, w = np.diff(np.append(fresh, len(p))), p[fresh], w[fresh]
        first = np.append(True, p[1:] != p[:-1])[: len(p)]
        starts, group = np.flatnonzero(first), np.cumsum(first) - 1
        before = np.cumsum(n) - n
        distinct, total = np.diff(np.append(starts, len(p))), np.add.reduceat(n, starts) if len(p) else n
        number = np.where((distinct <= bins)[group], np.arange(len(p)) - starts[group], np.floor((before - before[starts][group]) * bins / total[group])).astype(np.int64)
        new = np.append(True, (p[1:] != p[:-1]) | (number[1:] != number[:-1]))[: len(p)]
        at = np.flatnonzero(new)
        #: of each code its place and its largest weight, infinite for a place's last; where its entries begin
        self.place, self.cut = p[at], w[np.append(at[1:], len(w))[: len(at)] - 1]
        self.cut[np.append(self.place[1:] != self.place[:-1], True)[: len(at)]] = np.inf
        self.starts = np.append(before[at], len(own)).astype(np.int64)
        self.rows = keep(row[own])
        # a validation row's weight lies in the first bin whose cut is not below it
        other = np.flatnonzero(held)
        other = other[np.argsort(place[other], kind="stable")]
        vp, vw, code = place[other], weight[other], np.full(len(other), -1, np.int64)
        bounds = zip(*(np.searchsorted(x, np.unique(vp), side) for side in ("left", "right") for x in (vp, self.place)), strict=True)
        for i, a, j, b in bounds:
            if a < b:
                code[i:j] = a + np.searchsorted(self.cut[a:b], vw[i:j])
        order = np.argsort(code, kind="stable")
        order = order[code[order] >= 0]
        self.others, self.other_starts = row[other][order], np.searchsorted(code[order], np.arange(len(self.place) + 1))

    def best(self, rank: np.ndarray, g: np.ndarray, h: np.ndarray, totals: list[tuple[int, int]], seen: np.ndarray, config: TreeConfig) -> list[tuple | None]:
        """For each node ``(gain, place, cut, missing_left, g_left, h_left)`` or nothing; ``rank`` has each row's node, or the number of nodes; ``g`` and ``h`` are 0 there."""
        nodes, codes = len(totals), len(self.place)
        if not codes:
            return [None] * nodes
        row = self.rows()
        if nodes == 1:
            sums = [np.add.reduceat(v[row], self.starts[:-1])[None] for v in (g, h)]
        else:
            key = np.repeat(np.arange(codes) * (nodes + 1), np.diff(self.starts)) + rank[row]
            # whole numbers below 2 ** 53 are summed exactly
            sums = [np.bincount(key, v[row], codes * (nodes + 1)).astype(np.int64).reshape(codes, nodes + 1).T for v in (g, h)]
        out: list[tuple | None] = []
        for n, (all_g, all_h) in enumerate(totals):
            at = np.flatnonzero(((sums[0][n] != 0) | (sums[1][n] != 0)) & seen[self.place])
            out.append(None)
            if not len(at):
                continue
            place, g_own, h_own = self.place[at], sums[0][n][at], sums[1][n][at]
            first = np.append(True, place[1:] != place[:-1])
            starts, last, group = np.flatnonzero(first), np.append(first[1:], True), np.cumsum(first) - 1
            missing_g, missing_h = (t - np.add.reduceat(v, starts)[group] for t, v in ((all_g, g_own), (all_h, h_own)))
            upto_g, upto_h = ((c := np.cumsum(v)) - (c[starts] - v[starts])[group] for v in (g_own, h_own))
            right = gains(upto_g, upto_h, all_g, all_h, config)
            left = np.where(last, -np.inf, gains(upto_g + missing_g, upto_h + missing_h, all_g, all_h, config))
            best = np.maximum(right, left)
            i = int(best.argmax())  # of equal ones the lowest place and cut
            if best[i] > 0:
                with_missing = bool(left[i] > right[i])
                out[-1] = float(best[i]), int(place[i]), float(self.cut[at[i]]), with_missing, int(upto_g[i] + with_missing * missing_g[i]), int(upto_h[i] + with_missing * missing_h[i])
        return out

    def goes_left(self, place: int, cut: float, missing_left: bool, rows: int) -> np.ndarray:
        out = np.full(rows, missing_left)
        a, b = np.searchsorted(self.place, [place, place + 1])
        end = a + int(np.searchsorted(self.cut[a:b], cut, "right"))
        own, s, t = self.rows(), self.starts, self.other_starts
        for rows_of, (low, middle, high) in ((own, s[[a, end, b]]), (self.others, t[[a, end, b]])):
            out[rows_of[low:middle]] = True
            out[rows_of[middle:high]] = False
        return out


def gains(left_g: np.ndarray, left_h: np.ndarray, all_g: np.ndarray | int, all_h: np.ndarray | int, config: TreeConfig) -> np.ndarray:
    lg, lh, rg, rh, ag, ah = (x / UNIT for x in (left_g, left_h, all_g - left_g, all_h - left_h, all_g, all_h))
    value = lg**2 / (lh + config.penalty) + rg**2 / (rh + config.penalty) - ag**2 / (ah + config.penalty)
    return np.where((lh >= config.least) & (rh >= config.least) & (value > LEAST_GAIN), value, -np.inf)


class Columns:
    """What a task keeps: all rows' ids, labels and marks, in the order of their ids, and the entries of its places."""

    def __init__(self, batches: Iterator[pa.RecordBatch], buckets: int, bins: int, most: int) -> None:
        self.most, self.file, self.held, self.folds = most, tempfile.TemporaryFile(), 0, {}
        rows: dict[int, tuple] = {}
        waiting: list[tuple] = []
        ranks: dict[int, np.ndarray] = {}
        bucket = -1
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch[name][i] for name in batch.schema.names}
                b, piece = r["bucket"].as_py(), r["piece"].as_py()
                plain = lambda name, kind: np.frombuffer(r[name].as_buffer(), kind)  # noqa: B023, E731
                if b < 0:
                    rows[piece] = plain("id", np.int64).copy(), plain("y", np.float64).copy(), plain("validation", np.bool_).copy()
                    continue
                if b != bucket:
                    if bucket < 0:
                        ranks = self._ordered(rows)
                    self._fold(bucket, waiting, bins)
                    bucket = b
                count = plain("count", np.uint32)
                waiting.append((np.repeat(np.arange(len(count)) * buckets + b, count), ranks[piece][plain("row", np.uint32)], plain("weight", np.float64).copy()))
        if bucket < 0:
            self._ordered(rows)
        self._fold(bucket, waiting, bins)

    def _ordered(self, rows: dict[int, tuple]) -> dict[int, np.ndarray]:
        """Puts the rows in the order of their ids; each piece's rows in it."""
        self.id, self.y, self.validation = (np.concatenate([rows[p][k] for p in sorted(rows)]) for k in range(3))
        order = np.argsort(self.id, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        self.id, self.y, self.validation = self.id[order], self.y[order], self.validation[order]
        return dict(zip(sorted(rows), np.split(rank, np.cumsum([len(rows[p][0]) for p in sorted(rows)])[:-1]), strict=True))

    def _fold(self, bucket: int, waiting: list[tuple], bins: int) -> None:
        if waiting:
            parts = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting.clear()
            self.folds[bucket] = Fold(*parts, self.validation, bins, self._kept)

    def _kept(self, row: np.ndarray) -> Callable[[], np.ndarray]:
        if self.held + row.nbytes <= self.most:
            self.held += row.nbytes
            return lambda: row
        at, n = self.file.seek(0, 2), len(row)
        row.tofile(self.file)
        self.file.flush()

        def read() -> np.ndarray:
            self.file.seek(at)
            return np.fromfile(self.file, np.uint32, n)

        return read


def grown(own: Columns, circle: Circle, start: float, size: int, buckets: int, config: TreeConfig) -> Forest:
    """The forest, in every task; what decides comes from one of them."""
    forest, train, held = Forest(start, size, []), ~own.validation, own.validation
    margin = np.full(len(own.id), start)
    for turn in range(config.rounds + 1):

        def lost() -> list[float | None]:
            each = np.logaddexp(0, margin) - own.y * margin  # noqa: B023
            return [float(x.mean()) if len(x) else None for x in (each[train], each[held])]

        if turn:
            forest.losses.append(tuple(circle.said(lost)))
            if forest.losses[-1][1] is not None:
                fallen = [x for _, x in forest.losses]
                forest.best_round = min(range(len(fallen)), key=lambda i: (fallen[i], i)) + 1
                if turn - forest.best_round >= config.patience:
                    break
        if turn == config.rounds:
            break
        p = 1 / (1 + np.exp(-margin))
        mine = train & (uniform(own.id, config.seed, 2, turn) < config.rows)
        g, h = np.rint((p - own.y) * UNIT).astype(np.int64) * mine, np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT).astype(np.int64) * mine
        seen = places_of_round(size, config.places, config.seed, turn)
        tree, node = Tree(), np.zeros(len(margin), np.int16)
        open_nodes = {0: tuple(circle.said(lambda: [int(g.sum()), int(h.sum())]))}  # noqa: B023
        sums = dict(open_nodes)
        for _ in range(config.depth):
            # both sides of a split need ``least``
            numbers = [n for n in sorted(open_nodes) if open_nodes[n][1] / UNIT >= 2 * config.least]
            if not numbers:
                break
            ranks = np.full(2 ** (config.depth + 1), len(numbers), np.int64)
            ranks[numbers] = np.arange(len(numbers))
            rank = ranks[node]
            rank[~mine] = len(numbers)
            inside = rank < len(numbers)
            in_g, in_h = (v * inside if len(numbers) == 1 else v.astype(np.float64) for v in (g, h))
            best: dict[int, tuple] = {}
            for fold in own.folds.values():
                for n, found in zip(numbers, fold.best(rank, in_g, in_h, [open_nodes[n] for n in numbers], seen, config), strict=True):
                    if found and (n not in best or (found[0], -found[1]) > (best[n][0], -best[n][1])):
                        best[n] = found
            every = [json.loads(m) for m in circle.gathered(json.dumps([[n, *b] for n, b in best.items()]).encode())]
            chosen: dict[int, list] = {}
            for n, *found in (x for m in every for x in m):
                if n not in chosen or (found[0], -found[1]) > (chosen[n][0], -chosen[n][1]):
                    chosen[n] = found
            # the task that keeps a split's place says which of the node's rows go left
            told = []
            for n, (_, place, cut, missing_left, *_rest) in sorted(chosen.items()):
                if (fold := own.folds.get(place % buckets)) is not None:
                    told.append(np.int64(n).tobytes() + np.packbits(fold.goes_left(place, cut, missing_left, len(node))[node == n]).tobytes())
            sides = np.zeros(len(node), bool)
            lengths = {n: int((node == n).sum()) for n in chosen}
            for message in circle.gathered(b"".join(told)):
                at = 0
                while at < len(message):
                    n = int(np.frombuffer(message, np.int64, 1, at)[0])
                    long = (lengths[n] + 7) // 8
                    sides[node == n] = np.unpackbits(np.frombuffer(message, np.uint8, long, at + 8), count=lengths[n]).astype(bool)
                    at += 8 + long
            open_nodes, before = {}, node.copy()
            for n, (gain, place, cut, missing_left, left_g, left_h) in sorted(chosen.items()):
                tree.splits[n], tree.gains[n] = (place, cut, missing_left), gain
                here = before == n
                node[here] = np.where(sides[here], 2 * n + 1, 2 * n + 2)
                open_nodes |= {2 * n + 1: (left_g, left_h), 2 * n + 2: (sums[n][0] - left_g, sums[n][1] - left_h)}
            sums |= open_nodes
        tree.values = leaf_values(sums, tree, config)
        values = np.zeros(max(tree.values) + 1)
        values[list(tree.values)] = list(tree.values.values())
        margin += values[node]
        forest.trees.append(tree)
    return forest


def leaf_values(sums: dict[int, tuple[int, int]], tree: Tree, config: TreeConfig) -> dict[int, float]:
    return {n: -config.rate * (sums[n][0] / UNIT) / (sums[n][1] / UNIT + config.penalty) for n in sorted(set(sums) - set(tree.splits))}


def fit_together(lists: DataFrame, start: float, size: int, config: TreeConfig, tasks: int) -> Forest:
    """The forest of ``lists(id, y, validation, places, weights)`` by ``tasks`` tasks that run side by side."""
    buckets, secret = FOLDS * tasks, secrets.token_bytes(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Columns(batches, buckets, config.bins, HELD)
        with own.file, Circle(secret) as circle:
            forest = grown(own, circle, start, size, buckets, config)
            if circle.number == 0:
                yield pa.RecordBatch.from_pydict({"forest": [json.dumps(forest.to_dict())]})

    found = dealt(lists, size, tasks, buckets).mapInArrow(run, "forest string", barrier=True).collect()
    return Forest.from_dict(json.loads(found[0].forest))


def fit_forest(rows: DataFrame, weights: DataFrame, size: int, config: TreeConfig = TreeConfig()) -> Forest:
    """``fit_lists`` for ``rows(id, y, validation)``, whose features are ``weights(id, place, weight)``."""
    lists = weights.groupBy("id").agg(F.collect_list(F.struct("place", "weight")).alias("w"))
    return fit_lists(rows.join(lists, "id", "left").select("id", "y", "validation", F.col("w.place").alias("places"), F.col("w.weight").alias("weights")), size, config)


def fit_lists(lists: DataFrame, size: int, config: TreeConfig = TreeConfig()) -> Forest:
    """Boosted trees for ``lists(id, y, validation, places, weights)`` with places below ``size``, each once a row.

    Null validation marks count as training rows; rows without weights have all places missing; without a training row of each label the forest has no tree.
    """
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    rows = lists.select("id", "y", F.coalesce("validation", F.lit(False)).alias("validation"), none("places", "array<int>"), none("weights", "array<double>"))
    n, ones = rows.filter("not validation").agg(F.count(F.lit(1)), F.sum("y")).head()
    if not n or ones in (0, n):
        return Forest({0: -20.0}.get(ones, 20.0) if n else 0.0, size, [])
    start = math.log(ones / (n - ones))
    if tasks := slots(rows.sparkSession):
        return fit_together(rows, start, size, config, tasks)
    weights = rows.select("id", F.explode(F.arrays_zip("places", "weights")).alias("w")).select("id", F.col("w.places").alias("place"), F.col("w.weights").alias("weight"))
    return _fit_blocks(rows.select("id", "y", "validation"), weights, start, size, config)


def forest_margin(df: DataFrame, forest: Forest, places: Column, weights: Column, name: str = "margin") -> DataFrame:
    """``df`` with the forest's margin of each row's places (any order, each once) and weights."""
    fields, trees, size = df.columns, forest.trees, forest.size
    own = df.withColumn("_places", F.coalesce(places, F.array()).cast("array<int>")).withColumn("_weights", F.coalesce(weights, F.array()).cast("array<double>"))
    start = forest.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                n = piece.num_rows
                rows = Slice(np.full(n, start), np.diff(piece["_places"].offsets.to_numpy()), piece["_places"].flatten().to_numpy(), piece["_weights"].flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([*[piece[c] for c in fields], pa.array(margins_of(rows, trees, size))], names=[*fields, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return own.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))
