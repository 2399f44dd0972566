"""Exact Jaccard self-join of word-shingle sets by partitioning the universe.

Sets are dealt to size bands, each ``BAND`` times as wide as the one before; a set is indexed in its own band and, where it
has smaller partners, in the band below. In a band the universe of shingles is hashed to segments, and pigeonholes give the
candidates: two similar sets differ in ``H`` shingles at most, and the weights of a band's segments add up to ``H + 1 + E``. A plain
segment has weight 1 and is indexed by its subset of the set; a segment with one-deletion neighbourhood has weight 2 and is
indexed by its subset and every subset with one shingle less. ``plan_band`` chooses the numbers of both sorts and ``E``.

Which plain segments a set leaves out is decided by cost, that is by how many sets hold a key: all keys are counted over all
documents, and in the order of these counts a set leaves out its most frequent ones, as many as its own sizes of partners allow. Both sets of
a similar pair agree on more weight than either leaves out; the rarest plain key on which they agree is left out
by neither, as both use one order. Keys that only one set holds need not be kept, so most sets drop out here, and passages that many
documents share give no candidates but where a set is little else.

The sets that share a kept key are candidates; of keys that the same sets hold one is enough. First every set of a key meets the key's
``HEADS`` smallest ones. Keys whose sets are then still in several components go on: there the sets outside the largest component meet
all others, by size and by the parities of hash buckets. What remains is compared by sketches (byte sums of buckets: more buckets that differ than similar sets may
differ in shingles exclude a pair), then by exact overlap: each set with its smallest partner, then one pair for each two groups,
and all pairs only where that one is unlike. So a group of near copies costs a few comparisons a set. Nothing is capped.

Equal sets are one class, of which one document stands for all. Texts are shingled once for keys and counts, candidates' texts
once more for their sets. Keys travel packed, those of a slice of texts together, to slots of bounded size.

Words are runs of bytes other than the six ASCII blanks, with A-Z lowered. Shingles are compared by 64-bit hashes of
their words; two different shingles of one pair of documents coincide with a chance below 1e-12.

Defined cases: a document with fewer words than a shingle is one shingle of all of them; without words, and for null text, the set
is empty and links with nothing; texts are read whole, whatever their length; any ``percent`` from 1 to 100 is exact, but below
50 many segments are empty in both sets and candidates grow towards all pairs; rows that repeat an id have that id's component, which links all groups that the
id has texts in (with a key of its own for every row, groups are of texts alone); rows with a null id are kept, link with nothing and have a null
component; ties do not arise (a component is named by its smallest id); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import discard, stored
from .memory import frugal

#: A band's last size by its first.
BAND = 2.0
#: Cost of a plan: chance of a shingle to be shared by two unrelated sets, and number of sets met under a key that says nothing.
SHARED, OTHERS = 0.02, 1000.0
#: A set can leave out this share of ``H`` at least.
LEAST_SPARE = 0.25
#: Under a key so many of its sets are compared with all others at first.
HEADS = 8
#: Text bytes whose keys make a slot, and that are packed together.
SLOT_BYTES, SLICE_BYTES = 32 << 20, 16 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@cache
def band_edges(percent: int, most: int) -> tuple[int, ...]:
    """First sizes of the bands up to ``most``; a set's partners are in its own band and the two next to it."""
    wide = max(BAND, 100 / percent)
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * wide))))
    return tuple(edges)


def _binomial(n: int, p: float, k: int) -> float:
    if p >= 1 or k > n:
        return float(k == n)
    return exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))


def _beyond(mean: float, most: int) -> float:
    """Expected excess over ``most`` of a Poisson number."""
    if mean <= 0:
        return 0.0
    below = [exp(-mean + k * log(mean) - lgamma(k + 1)) for k in range(most + 1)]
    return max(0.0, mean - most + sum((most - k) * p for k, p in enumerate(below)))


@cache
def plan_band(low: int, high: int, percent: int) -> tuple[int, int, int]:
    """``(plain, deleting, spare)``: segments of either sort and ``E`` for sets of ``low`` to ``high`` shingles.

    Costs are the keys made for the middle size, and the sets met under keys that say little and are more than ``E``.
    """
    differ = high * (100 - percent) // percent
    middle, best = (low + high) // 2, None
    least = int(np.ceil(LEAST_SPARE * differ))
    for deleting in range(min(3, (differ + 1) // 2) + 1 if differ else 1):
        for spare in sorted({least + k * max(1, differ // 16) for k in range(33)}):
            plain = differ + 1 + spare - 2 * deleting
            if plain < 0 or (plain == 0 and spare > least):
                continue
            m = plain + deleting
            few = [_binomial(middle, 1 / m, k) for k in range(3)]
            weak = _beyond(plain * (few[0] + few[1] * SHARED), spare)
            cost = m + deleting * middle / m + OTHERS * (weak + deleting * (few[0] + few[1] + few[2] * SHARED))
            if best is None or cost < best[0]:
                best = (cost, (plain, deleting, spare))
    return best[1]


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    places = coded.indices.to_numpy()
    blank = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    real = places != blank
    size = pc.list_value_length(split).to_numpy()
    owner = np.repeat(np.arange(len(size)), size)[real]
    n = np.bincount(owner, minlength=len(size))
    w = names[places[real]]
    ends = np.cumsum(n)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            x = w[a:b]
            k = min(words, len(x))
            if not k:
                out.append(np.zeros(0, np.uint64))
                continue
            h = np.full(len(x) - k + 1, U(k), np.uint64)
            for i in range(k):
                h = mix(h * U(0x9E3779B97F4A7C15) + x[i : len(x) - k + 1 + i])
            out.append(np.unique(h))
    return out


def keys_of(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray, int, np.ndarray]]:
    """For each band that a set is indexed in: the band, the keys of its plain segments, how many of them it leaves out, and its other keys.

    Empty plain segments come last in every set's order: they are left out first and, if there are more than
    it may leave out, the others are among the other keys, which every set keeps.
    """
    n = len(s)
    edges = band_edges(percent, 1 << (max(n, 1)).bit_length())
    own = int(np.searchsorted(edges, n, side="right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0:
            continue
        low, high = edges[band], edges[band + 1] - 1
        if high * (100 - percent) // percent == 0 or (band < own and high * 100 < percent * n):
            continue  # similar sets are equal: one class already; or no partner can lie there
        plain, deleting, _ = plan_band(low, high, percent)
        m = plain + deleting
        # so much may this set and a partner that meets it in this band differ
        partner = min(high, n * 100 // percent) if band < own else n * 100 // percent
        differ = (n + partner) * (100 - percent) // (100 + percent)
        with np.errstate(over="ignore"):
            salted = mix(s + U(((band + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)))
            segment = (salted >> U(33)).astype(np.int64) % m
            mass = mix(salted ^ U(0x2545F4914F6CDD1D))
            order = np.argsort(segment, kind="stable")
            count = np.bincount(segment, minlength=m)
            total = np.zeros(m, np.uint64)
            filled = np.flatnonzero(count)
            total[filled] = np.add.reduceat(mass[order], (np.cumsum(count) - count)[filled])
            tag = lambda mass, segment, count: mix(mass + mix((segment.astype(np.uint64) << U(32)) + count.astype(np.uint64) + (U(band) << U(52))))
            full = filled[filled < plain]
            empty = np.flatnonzero(count[:plain] == 0)
            spare = plain + 2 * deleting - 1 - differ
            drop = max(0, spare - len(empty))
            kept = [np.zeros(0, np.uint64)]
            if spare < len(empty):
                blank = np.sort(tag(total[empty], empty, count[empty]))
                kept.append(blank[spare:])
            if deleting:
                tail = np.arange(plain, m)
                inside = segment >= plain
                kept.append(tag(total[tail], tail, count[tail]))
                kept.append(tag(total[segment[inside]] - mass[inside], segment[inside], count[segment[inside]] - 1))
            out.append((band, tag(total[full], full, count[full]), drop, np.unique(np.concatenate(kept))))
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte for each of a power of two of buckets, at least half as many as shingles: the sum of its shingles' bytes.

    Adding both halves gives the sketch with half as many buckets; each bucket that differs between two sketches stands for
    at least one shingle that only one of the sets has.
    """
    width = 1 << max(3, (len(s) // 2).bit_length())
    mixed = mix(s ^ U(0x9FB21C651E98DF25))
    sums = np.bincount((mixed & U(width - 1)).astype(np.int64), (mixed >> U(56)).astype(np.float64), width)
    return sums.astype(np.int64).astype(np.uint8)


def _slices(b: pa.RecordBatch, text: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts add up to about ``size`` bytes."""
    part = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy()) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for at, end in zip(cuts, cuts[1:]):  # noqa: B905
        yield b.slice(at, end - at)


def parity(s: np.ndarray) -> list[int]:
    """A bit for each of a power of two of buckets, more than shingles: whether it has an odd number of them; as whole numbers of 64 bits.

    Where two such signatures differ, at least one shingle is in only one of the sets; either half may be added to the other.
    """
    width = 1 << max(6, len(s).bit_length())
    odd = np.bincount((mix(s ^ U(0xC2B2AE3D27D4EB4F)) & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def fold(x: np.ndarray, width: int) -> np.ndarray:
    """A sketch with ``width`` buckets, at most as many as it has."""
    return x.reshape(-1, width).sum(0, dtype=np.uint8)


INDEX = "slot long, kind int, id long, n long, name binary, grp long, amount long, keys binary, grps binary"
DESCRIBED, GROUP, KEY = 0, 1, 2


def _columns(size: int, **given) -> pa.RecordBatch:
    types = {"slot": pa.int64(), "kind": pa.int32(), "id": pa.int64(), "n": pa.int64(), "name": pa.binary(), "grp": pa.int64(), "amount": pa.int64(), "keys": pa.binary(), "grps": pa.binary()}
    return pa.RecordBatch.from_arrays([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(size, t) for c, t in types.items()], names=list(types))


def _index(words: int, percent: int, slots: int, slice_bytes: int):
    """One pass over the texts: a row for each document, a row for each group of keys (of a set in a band), and packed keys for each slot."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for part in _slices(b, 1, slice_bytes):
                keys, grps, groups, known = [], [], [], set()
                for small in _slices(part, 1):
                    sets = shingle_sets(small.column(1), words)
                    names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                    own = [0 if x is None else int.from_bytes(x[:4]) % slots for x in names]
                    yield _columns(len(sets), slot=own, kind=[DESCRIBED] * len(sets), id=small.column(0), n=[len(s) for s in sets], name=names)
                    for i, name, s in zip(small.column(0).to_pylist(), names, sets, strict=True):
                        if i is None or name is None or name in known:
                            continue
                        known.add(name)
                        for band, plain, drop, kept in keys_of(s, percent):
                            for sort, some, amount in (("p", plain, drop), ("k", kept, 0)):
                                if len(some) > amount:
                                    grp = xxhash.xxh3_64_intdigest(name + b"%d%s" % (band, sort.encode())) >> 1
                                    groups.append((grp, amount, name))
                                    keys.append(some)
                                    grps.append(np.full(len(some), grp, np.int64))
                if not groups:
                    continue
                grp, amount, name = zip(*groups, strict=True)
                yield _columns(len(groups), slot=[g % slots for g in grp], kind=[GROUP] * len(groups), grp=grp, amount=amount, name=name)
                key, grp = np.concatenate(keys), np.concatenate(grps)
                place = ((key >> U(32)) * U(slots) >> U(32)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                key, grp, place = key[order], grp[order], place[order]
                used, first = np.unique(place, return_index=True)
                ends = [*first[1:].tolist(), len(place)]
                cut = list(zip(first.tolist(), ends, strict=True))
                yield _columns(len(used), slot=used, kind=[KEY] * len(used), keys=[key[x:y].tobytes() for x, y in cut], grps=[grp[x:y].tobytes() for x, y in cut])

    return run


COUNTED = "kind int, id long, n long, name binary, grp long, amount long, `key` long"


@frugal
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot: keys that several groups hold, with their number of groups; other rows as they are."""
    names = [x.split()[0].strip("`") for x in COUNTED.split(", ")]
    slot, keys, grps = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        key, grp = np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(grps), np.int64)
        order = np.lexsort((grp, key))
        key, grp = key[order], grp[order]
        # copies of a set bring the same group again
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (grp[1:] != grp[:-1])]) if len(key) else np.zeros(0, bool)
        key, grp = key[new], grp[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        many = np.repeat(size, size)
        hit = many > 1
        for at in range(0, int(hit.sum()), 1 << 18):
            k, g, m = (x[hit][at : at + (1 << 18)] for x in (key, grp, many))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), KEY, np.int32)), *(pa.nulls(len(k), t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array(g), pa.array(m), pa.array(k)], names=names)

    for b in batches:
        plain = b.filter(pc.less(b.column("kind"), KEY))
        if plain.num_rows:
            yield pa.RecordBatch.from_arrays([*(plain.column(c) for c in names[:-1]), pa.nulls(plain.num_rows, pa.int64())], names=names)
        packed = b.filter(pc.equal(b.column("kind"), KEY))
        for s, k, g in zip(*(packed.column(c).to_pylist() for c in ("slot", "keys", "grps")), strict=True):
            if s != slot:
                yield from done()
                slot, keys, grps = s, [], []
            keys.append(k)
            grps.append(g)
    yield from done()


def _sets(words: int):
    """``id, n, body, sketch, signature`` of texts."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, 1):
                sets = shingle_sets(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "body", "sketch", "signature"])

    return run


def may_be_similar(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """False only if sets of ``n`` and ``m`` shingles with these sketches are not similar."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(a), len(b))
    differ = int((fold(a, width) != fold(b, width)).sum())
    return differ * (100 + percent) <= (100 - percent) * (n + m)


def similar(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int, exact: bool):
    columns = ("a_body", "b_body") if exact else ("a_n", "a_sketch", "b_n", "b_sketch")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = zip(*(part.column(c).to_pylist() for c in columns), strict=True)
                keep = pa.array([(similar if exact else may_be_similar)(*r, percent) for r in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(keep)

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """A set is joined to each of its pairs; both sides are plain tables, so AQE splits sets of very many pairs."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]).hint("merge"), end)
    return pairs


def _screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return stored(_with_sets(pairs, sets, ["n", "sketch"]).mapInArrow(_verify(percent, False), "a long, b long"), "screened")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return stored(_with_sets(pairs, sets, ["body"]).mapInArrow(_verify(percent, True), "a long, b long"), "links")


def _links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Similar ones of screened ``pairs(a, b)``, b < a, enough to connect all that are connected by them.

    Each ``a`` is first compared with its smallest ``b``; of the pairs that this leaves between two groups one is compared, and only
    where that one is not similar all others of these groups.
    """
    first = stored(pairs.groupBy("a").agg(F.min("b").alias("b")), "first")
    found = _similar(first, sets, percent)
    roots = _roots(found)
    rest = pairs.join(first.hint("merge"), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")).hint("merge"), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    rest = rest.filter("a_root != b_root").select("a", "b", F.least("a_root", "b_root").alias("x"), F.greatest("a_root", "b_root").alias("y"))
    rest = stored(rest, "rest")
    one = stored(rest.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*", "x", "y"), "one")
    second = _similar(one.select("a", "b"), sets, percent)
    done = stored(one.join(second.hint("merge"), ["a", "b"]).select("x", "y"), "done")
    third = _similar(rest.join(one.hint("merge"), ["a", "b"], "left_anti").join(done.hint("merge"), ["x", "y"], "left_anti").select("a", "b"), sets, percent)
    discard(first, roots, rest, one, done)
    return found.unionByName(second).unionByName(third)


def _roots(links: DataFrame, doublings: int = 3) -> DataFrame:
    """``node, root`` from one link to a smaller node for each: what lies up to ``2 ** doublings`` links on. Nodes with one root are connected."""
    up = stored(links.groupBy("a").agg(F.min("b").alias("b")), "up")
    for _ in range(doublings):
        further = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
        up, before = stored(up.join(further.hint("merge"), "b", "left").select("a", F.coalesce("c", "b").alias("b")), "up"), up
        discard(before)
    return up.select(F.col("a").alias("node"), F.col("b").alias("root"))


def candidates(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``docs(id, text)``: ``described(id, n, name)`` of every row, ``classes(name, rep, n)``, and ``met(key, rep, n)``, the classes under kept keys that several hold."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = 1 + size // SLOT_BYTES
    packed = docs.mapInArrow(_index(words, percent, slots, SLICE_BYTES), INDEX).repartition("slot").sortWithinPartitions("slot")
    counted = stored(packed.mapInArrow(_count, COUNTED), "keys")
    described = counted.filter(F.col("kind") == DESCRIBED).select("id", "n", "name")
    classes = described.filter("id is not null and name is not null").groupBy("name").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    classes = stored(classes, "classes")
    # a group leaves out its most frequent keys, as many as its row tells; keys held once are rarest and not even here
    groups = counted.filter(F.col("kind") == GROUP).groupBy("grp").agg(F.max("amount").alias("drop"), F.max("name").alias("name"))
    ranked = counted.filter(F.col("kind") == KEY).select("grp", "key", "amount").join(groups.hint("merge"), "grp")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("amount"), F.desc("key"))))
    kept = ranked.filter(F.col("rank") > F.col("drop")).select("key", "name")
    held = stored(kept.join(classes.hint("merge"), "name").select("key", "rep", "n"), "held")
    # of keys that the same classes hold one says all; equal numbers, sums and parities of 64-bit hashes stand for the same classes
    groups = held.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("parity"))
    several = stored(groups.filter("many > 1").groupBy("many", "sum", "parity").agg(F.min("key").alias("key")).select("key"), "several")
    met = stored(held.join(several.hint("merge"), "key").select("key", "rep", "n"), "met")
    discard(held, several)
    return described, classes, met


def _first_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Every class of a key with the ``HEADS`` smallest classes of that key, if their sizes allow."""
    smallest = Window.partitionBy("key").orderBy("rep")
    heads = met.withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= HEADS)
    heads = stored(heads.select("key", F.col("rep").alias("b"), F.col("n").alias("bn")), "heads")
    pairs = met.join(heads.hint("merge"), "key").filter((F.col("rep") > F.col("b")) & _sizes_allow(F.col("n"), F.col("bn"), percent))
    out = stored(pairs.select(F.col("rep").alias("a"), "b").distinct(), "first-pairs")
    discard(heads)
    return out


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _signatures_allow(x: Column, n: Column, y: Column, m: Column, percent: int) -> Column:
    """False only if sets with these signatures differ in more shingles than similar ones may; signatures of very unlike widths say nothing."""
    half = lambda v, k: F.slice(v, F.lit(1) + k * F.floor(F.size(v) / 2).cast("int"), F.floor(F.size(v) / 2).cast("int"))
    folded = lambda v: F.zip_with(half(v, 0), half(v, 1), lambda p, q: p.bitwiseXOR(q))
    differ = lambda v, w: F.aggregate(F.zip_with(v, w, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, c: a + c)
    count = F.when(F.size(x) == F.size(y), differ(x, y)).when(F.size(x) == 2 * F.size(y), differ(folded(x), y)).when(2 * F.size(x) == F.size(y), differ(x, folded(y))).otherwise(F.lit(0))
    return count * (100 + percent) <= (n + m) * (100 - percent)


def _other_pairs(met: DataFrame, sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Classes of a key that are still apart: those outside its largest component with all others, if sizes and signatures allow."""
    owned = met.join(components.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    owned = stored(owned, "owned")
    parts = owned.groupBy("key", "component").agg(F.count(F.lit(1)).alias("many")).groupBy("key").agg(F.sum("many").alias("all"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("many", "component")).alias("top"))
    # keys of few classes have had all their pairs
    parts = stored(parts.filter((F.col("parts") > 1) & (F.col("all") > HEADS + 1)).select("key", F.col("top.component").alias("top")), "parts")
    open_keys = owned.join(parts.hint("merge"), "key").join(sets.select(F.col("id").alias("rep"), "signature").hint("merge"), "rep")
    open_keys = stored(open_keys, "open")
    discard(owned, parts)
    few = open_keys.filter("component != top").select("key", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("component").alias("ac"), F.col("signature").alias("sa"))
    rest = open_keys.select("key", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("component").alias("bc"), F.col("signature").alias("sb"), "top")
    # two classes outside the largest component come up once
    apart = (F.col("ac") != F.col("bc")) & ((F.col("bc") == F.col("top")) | (F.col("a") > F.col("b")))
    near = _sizes_allow(F.col("an"), F.col("bn"), percent) & _signatures_allow(F.col("sa"), F.col("an"), F.col("sb"), F.col("bn"), percent)
    pairs = few.join(rest.withColumnRenamed("key", "same").hint("merge"), (F.col("key") == F.col("same")) & apart & near)
    out = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "other-pairs")
    discard(open_keys)
    return out


def _shared_ids(described: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of every id that has several sets to the documents that stand for them."""
    known = described.filter("id is not null")
    several = known.groupBy("id").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.count("name").alias("sets"), F.count(F.lit(1)).alias("rows"))
    several = stored(several.filter("low != high or (sets > 0 and sets < rows)").select("id"), "several")
    named = known.join(several, "id").select("id", "name").join(classes.select("name", "rep"), "name")
    return named.select(F.col("id").alias("a"), F.col("rep").alias("b"))


def similar_sets(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` for every row: documents link when ``100 * intersection >= percent * union``."""
    if not 1 <= percent <= 100 or words < 1:
        raise ValueError("percent must be 1 to 100 and words 1 at least")
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    described, classes, met = candidates(docs, words, percent)
    wanted = stored(met.select(F.col("rep").alias("id")).distinct(), "wanted")
    sets = stored(docs.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(_sets(words), "id long, n long, body binary, sketch binary, signature array<long>"), "sets")
    pairs = _first_pairs(met, percent)
    near = _screened(pairs, sets, percent)
    links = _links_of(near, sets, percent)
    discard(pairs, near, wanted)
    pairs = _other_pairs(met, sets, connected_components(links), percent)
    near = _screened(pairs, sets, percent)
    more = _links_of(near, sets, percent)
    discard(pairs, near, met, sets)
    components = connected_components(links.unionByName(more).unionByName(_shared_ids(described, classes)))
    named = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("name", F.coalesce("component", "rep").alias("component_id"))
    linked = described.filter("id is not null and name is not null").join(named.hint("merge"), "name").select("id", "n", "component_id")
    empty = described.filter("id is not null and name is null").join(components.withColumnRenamed("node", "id"), "id", "left")
    empty = empty.select("id", "n", F.coalesce("component", "id").alias("component_id"))
    alone = described.filter("id is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(empty).unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
