"""Conversation prefix trie, merged by families first.

A family is the conversations whose ids share a base, ``id - id % FAMILY``. Each is rebuilt: the first ``h`` turns of the conversation
whose id is the base, then its own turns after its first ``h``, where ``h`` is CRC-32 of its decimal id modulo ``FORKS``. Each distinct
sequence of first ``d`` rebuilt turns (role and text) is a node of depth ``d``; the root has none.

Data movement: texts do not leave the scan; a turn travels as a digest of 128 bits of role and text, its length and what
orders it. Turns are dealt by base and sorted by base and place, so that a task meets a family's turns side by side, holds
the first ``FORKS`` places of its conversations (of which there are ``2 * FAMILY - 1`` at most) and then goes on place by place: each
conversation's digest of its turns so far names its node. Nodes of a family are summed in the task (its small trie) and given out, before the family ends if there are
more than ``MOST_NODES``, as sums can be added later. Only these combined rows are shuffled for the global merge, which is an
aggregation by node with map-side sums. Sums over subtrees go back to families: the family of a node's smallest member, where all ancestors
are at hand, adds the node's leaf and saving up along its paths, deepest first, holding one depth at a time; the partial sums are added by node.

The ids that end in a node are joined by family; families are ranges of ids, so that their texts in the order of bases are in the order of
ids. They are joined to blocks in ranges of (node, base) first, so that a node where very many conversations end has few rows
when its digest is computed, which reads one block after the other.

Defined cases: rows without a conversation id are left out; null role or text is empty; turns are ordered by turn (null first), of equal turns by role,
by the first ``HEAD`` characters of the text, then by digest; equal rows are several turns; conversations without turns of their own after the
first ``h`` whose base is absent end in the root; ids may be negative, their remainder is too; texts of any length count whole; an
empty table gives no rows; columns of other names are not read. A single conversation's turns are read one after the other in one task, but not held.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stored
from .memory import frugal

FAMILY, FORKS = 100, 6
#: Characters of a text that order turns of one number.
HEAD = 32
#: Nodes that a family's trie holds at once, and rows of a batch.
MOST_NODES, BATCH = 100_000, 10_000
#: Bytes of ids joined to one block.
BLOCK = 1 << 16

ROOT = b""
NODES = "base long, node binary, parent binary, depth long, conv_id long, n_convs long, length long, ends string"


def _base(key: Column) -> Column:
    return key - key % FAMILY


def turns(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``base, conv_id, place, item, length``: slim turns, numbered from 1 in their conversation; a base's rows lie in one partition."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = df.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        role.alias("role"),
        F.substring(text, 1, HEAD).alias("head"),
        F.unhex(F.substring(digest, 1, 32)).alias("item"),
        F.char_length(text).cast("long").alias("length"),
    )
    dealt = slim.withColumn("base", _base(F.col("conv_id"))).repartition("base")
    order = Window.partitionBy("base", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "item")
    return dealt.select("base", "conv_id", F.row_number().over(order).cast("long").alias("place"), "item", "length")


def _forks(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % FORKS


class Family:
    """The small trie of one family, fed with its turns by place."""

    def __init__(self, base: int):
        self.base = base
        self.early: list[tuple[int, int, bytes, int]] = []  # the first turns, until all conversations are known
        self.at: dict[int, tuple[bytes, int]] | None = None  # a conversation's node so far and its depth
        self.nodes: dict[bytes, list] = {}

    def step(self, conv: int, item: bytes, length: int) -> None:
        parent, depth = self.at[conv]
        node = hashlib.blake2b(parent + item, digest_size=16).digest()
        self.at[conv] = node, depth + 1
        self.count(node, parent, depth + 1, conv, length)

    def count(self, node: bytes, parent: bytes | None, depth: int, conv: int, length: int) -> None:
        own = self.nodes.get(node)
        if own is None:
            self.nodes[node] = [parent, depth, conv, 1, length]
        else:
            own[2] = min(own[2], conv)
            own[3] += 1

    def turn(self, conv: int, place: int, item: bytes, length: int) -> None:
        if place <= FORKS:
            self.early.append((conv, place, item, length))
            return
        self.begin()
        self.step(conv, item, length)

    def begin(self) -> None:
        """All conversations are known: each starts with the base's first turns."""
        if self.at is not None:
            return
        first = [(item, length) for conv, _, item, length in self.early if conv == self.base]
        self.at = {}
        for conv in sorted({x[0] for x in self.early}):
            self.at[conv] = ROOT, 0
            self.count(ROOT, None, 0, conv, 0)
            for item, length in first[: _forks(conv)]:
                self.step(conv, item, length)
        for conv, place, item, length in self.early:
            if place > _forks(conv):
                self.step(conv, item, length)
        self.early = []

    def given(self) -> Iterator[tuple]:
        for node, (parent, depth, conv, n, length) in self.nodes.items():
            yield self.base, node, parent, depth, conv, n, length, None
        self.nodes = {}

    def ends(self) -> Iterator[tuple]:
        """One row for each node in which conversations end, with their ids and nothing to add."""
        last: dict[tuple[bytes, int], list[int]] = {}
        for conv, place in sorted(self.at.items()):
            last.setdefault(place, []).append(conv)
        for (node, depth), convs in last.items():
            yield self.base, node, None, depth, None, 0, 0, ",".join(map(str, convs))


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema=schema)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, BATCH).columns), strict=True)


B, L, S = pa.binary(), pa.int64(), pa.string()
FAMILY_NODES = pa.schema([("base", L), ("node", B), ("parent", B), ("depth", L), ("conv_id", L), ("n_convs", L), ("length", L), ("ends", S)])
SUMS = pa.schema([("node", B), ("n_leaves", L), ("saved", L)])
BLOCKS = pa.schema([("node", B), ("base", L), ("ends", S)])
DIGESTS = pa.schema([("node", B), ("ends_sha256", S)])


def family_nodes(sorted_turns: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """The combined nodes of all families, from turns that are sorted by base, place and conversation in each partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for base, own in groupby(_plain(batches), key=lambda r: r[0]):
            family = Family(base)
            for _, conv, place, item, length in own:
                family.turn(conv, place, item, length)
                if len(family.nodes) > most:
                    yield from family.given()
            family.begin()
            yield from family.given()
            yield from family.ends()

    return sorted_turns.select("base", "conv_id", "place", "item", "length").mapInArrow(frugal(lambda b: _packed(rows(b), FAMILY_NODES)), NODES)


def subtree_sums(owned: DataFrame) -> DataFrame:
    """``node, n_leaves, saved`` of each family and node, added up from the deepest; rows are sorted by base, depth (descending) and node in each partition.

    ``owned(base, depth, node, parent, leaf, saving)``; a node that was given out several times counts once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, own in groupby(_plain(batches), key=lambda r: r[0]):
            below: dict[bytes, list[int]] = {}
            for (_, node), same in groupby(own, key=lambda r: (r[1], r[2])):
                _, _, _, parent, leaf, saving = next(same)
                found = below.pop(node, None)
                leaves, saved = leaf + (found[0] if found else 0), saving + (found[1] if found else 0)
                if leaves or saved:
                    yield node, leaves, saved
                    if parent is not None:
                        up = below.setdefault(parent, [0, 0])
                        up[0] += leaves
                        up[1] += saved

    return owned.select("base", "depth", "node", "parent", "leaf", "saving").mapInArrow(frugal(lambda b: _packed(rows(b), SUMS)), "node binary, n_leaves long, saved long")


def end_digests(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """``node, ends_sha256`` of the joined ids of each node, from ``ends(node, base, ends)``."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for node, own in groupby(_plain(batches), key=lambda r: r[0]):
            held, size, first = [], 0, None
            for _, base, text in own:
                first = base if first is None else first
                held.append(text)
                size += len(text) + 1
                if size > block:
                    yield node, first, ",".join(held)
                    held, size, first = [], 0, None
            if held:
                yield node, first, ",".join(held)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for node, own in groupby(_plain(batches), key=lambda r: r[0]):
            sha, comma = hashlib.sha256(), b""
            for _, _, text in own:
                sha.update(comma + text.encode())
                comma = b","
            yield node, sha.hexdigest()

    ranged = ends.repartitionByRange("node", "base").sortWithinPartitions("node", "base")
    blocks = ranged.mapInArrow(frugal(lambda b: _packed(joined(b), BLOCKS)), "node binary, base long, ends string")
    dealt = blocks.repartition("node").sortWithinPartitions("node", "base")
    return dealt.mapInArrow(frugal(lambda b: _packed(digests(b), DIGESTS)), "node binary, ends_sha256 string")


def prefix_trie(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_nodes: int = MOST_NODES, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (sums over the
    subtree, of childless nodes and of ``(n_convs - 1) * length`` of the last text), and ``ends_sha256`` of the ascending ids that end there.
    """
    families = stored(family_nodes(turns(df, key, turn, role, text).sortWithinPartitions("base", "place", "conv_id"), most_nodes), "families")
    counted = families.filter("n_convs > 0")
    merged = counted.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("length").alias("length"))
    merged = stored(merged, "nodes")
    children = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, "node", "left").fillna(0, ["n_children"])
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(parents, "parent", "left"), "nodes")
    # the family of a node's smallest member adds it up
    values = nodes.select("node", _base(F.col("conv_id")).alias("base"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("length")).alias("saving"))
    owned = counted.select("base", "depth", "node", "parent").join(values, ["base", "node"], "left").fillna(0, ["leaf", "saving"])
    sums = subtree_sums(owned.repartition("base").sortWithinPartitions("base", F.desc("depth"), "node"))
    sums = sums.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    digests = end_digests(families.filter("ends is not null").select("node", "base", "ends"), block)
    out = nodes.join(sums, "node", "left").join(digests, "node", "left").fillna(0, ["n_leaves", "saved_tokens"])
    discard(merged)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
