"""Bounded-space online packing of token sequences.

Every scan task packs on its own with a fixed number of open windows. Whole windows of a document are emitted at
once. What is left of it goes to the open window where it fits best, that is where the least room stays; if it fits
nowhere, the fullest window is emitted and its place taken. Gaps of at least ``MIN_FILL`` tokens in an emitted window are filled by
cutting the document that did not fit, so that little is padded. At the end leftover windows of all tasks, which
carry their ids, are merged in the same way by fewer tasks, and each window that is still not full is cut to
sequences whose lengths are powers of two (these need no padding).

Pieces are written to the shared folder before the merge, so the rows of both steps come from one run. Memory is
bounded by the open windows, ``BATCH_BYTES`` of texts (or one longer text) and ``CACHE_BYTES`` of chunks that the
tokenizer remembers, which it forgets when the task ends. Sequence ids are unique, not dense.

Defined cases: null text is empty; an empty document is its end id alone; a document of any length is cut into
windows; repeated rows are packed each; of open windows that fit equally well the oldest gets the piece, of equally full ones the
oldest is emitted; an empty table gives an empty result; extra columns are ignored. A vocabulary whose ids depend on what lies beyond white space is refused.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .memory import frugal

WINDOW = 2048
OPEN_WINDOWS = 64
MIN_FILL = 8
END_ID = 1
#: When a tokenizing task's chunks take more bytes, it forgets them and starts anew with the next batch.
CACHE_BYTES = 96 << 20
#: What the index of chunks takes for each of them, besides its text and ids.
CHUNK_BYTES = 150
BATCH_BYTES = 2 << 20
#: The ids of these must be those of their chunks, one after the other.
PROBES = ["a b", " Don't  stop\tat 12.5 %, \u00e9t\u00e9!\n\n3rd line... ", "x\ny \u4f60\u597d z_1 <a> (b) -c- \u0130. d"]
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


@cache
def loose_letters() -> str:
    """A class of the letters that are not all letters once the tokenizer has normalized them (NFC, lower case)."""
    letters = (c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha())
    return "[" + "".join(c for c in letters if not unicodedata.normalize("NFC", c).lower().isalpha()) + "]"


class ChunkTokenizer:
    """Ids of whole texts for a vocabulary whose pre-tokenizer never joins across ASCII white space.

    Texts are cut at ASCII white space and their chunks dictionary-encoded. The ids of a chunk do not depend on its
    neighbours, so each distinct chunk is tokenized once and looked up afterwards. The ids equal those of the library on the whole text.
    """

    #: A chunk of letters, then marks of which none starts a contraction. The pre-tokenizer cuts there where the letters are
    #: still letters once normalized; chunks with other letters (``loose_letters``) are looked up whole.
    APART = r"^(?P<stem>\pL+)(?P<marks>[.,;:!?#$%&*|]+)$"

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), cache_bytes
        self.tok.no_truncation()
        self.tok.no_padding()
        for probe in PROBES:
            if (whole := self.encode([probe])[0]) != [i for ids in self.encode(probe.split()) for i in ids]:
                raise ValueError(f"{path}: the ids of a text are not those of its chunks between white space, {whole} for {probe!r}")
        self.clear()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def learn(self, chunks: list[str]) -> None:
        for first in range(0, len(chunks), 2000):  # an encoding holds far more than its ids: few at a time
            part = chunks[first : first + 2000]
            new = self.encode(part)
            size = np.fromiter(map(len, new), np.int64, len(new))
            ids = np.fromiter(chain.from_iterable(new), np.uint32, int(size.sum()))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            n = len(self.index)
            while n + len(part) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            self.starts[n : n + len(part)] = self.used + np.cumsum(size) - size
            self.sizes[n : n + len(part)] = size
            self.index.update(zip(part, range(n, n + len(part)), strict=True))
            self.used += len(ids)
            self.held += sum(map(len, part)) + 4 * len(ids) + CHUNK_BYTES * len(part)

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where the ids of distinct chunks are kept; new ones are learned."""
        words = chunks.to_pylist()
        fresh = [w for w in words if w not in self.index]
        if fresh:
            self.learn(fresh)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts (none null) and the number of ids of each."""
        if self.held > self.limit:
            self.clear()
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        # letters and the marks after them are looked up apart, so that there are fewer distinct chunks
        apart = pc.extract_regex(coded.dictionary, self.APART)
        stem = pc.struct_field(apart, "stem")
        cut_there = pc.fill_null(pc.invert(pc.match_substring_regex(stem, loose_letters())), False)
        stems = pc.if_else(cut_there, stem, coded.dictionary).dictionary_encode()
        marks = pc.if_else(cut_there, pc.struct_field(apart, "marks"), "").dictionary_encode()
        two = np.stack([self.places(stems.dictionary)[stems.indices.to_numpy()], self.places(marks.dictionary)[marks.indices.to_numpy()]], 1)
        place = two[coded.indices.to_numpy()].ravel()
        size, start = self.sizes[place], self.starts[place]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cut = 2 * np.cumsum(pc.list_value_length(words).to_numpy())
        return ids, np.diff(np.concatenate([[0], ends])[cut], prepend=0)


#: A worker's tokenizers by path; they outlive a task, the chunks that they know do not.
KNOWN: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    if path not in KNOWN:
        KNOWN[path] = ChunkTokenizer(path)
    return KNOWN[path]


class Packer:
    """Open windows of one task. ``emit`` gets (rows of pieces, sequence number)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.limit, self.next = window, open_windows, first_sequence
        self.open: list[list] = []  # [fill, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, self.next, at))
            at += len(ids)
        self.next += 1

    def put(self, fill: int, pieces: list[tuple]) -> bool:
        """Best fit among the open windows, or a new one; false if neither is possible."""
        best = min((w for w in self.open if w[0] + fill <= self.window), key=lambda w: self.window - w[0], default=None)
        if best is None:
            if len(self.open) >= self.limit:
                return False
            self.open.append(best := [0, []])
        best[0] += fill
        best[1] += pieces
        if best[0] == self.window:
            self.open.remove(best)
            self.emit(best[1])
        return True

    def add(self, doc: int, ids: np.ndarray, start: int = 0, tokens: int | None = None) -> None:
        tokens = len(ids) if tokens is None else tokens
        end = start + len(ids)
        while end - start >= self.window:
            self.emit([(doc, start, ids[len(ids) - (end - start) :][: self.window], tokens)])
            start += self.window
        rest = ids[len(ids) - (end - start) :]
        while len(rest) and not self.put(len(rest), [(doc, end - len(rest), rest, tokens)]):
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            gap = self.window - fullest[0]
            if gap >= MIN_FILL:
                fullest[1].append((doc, end - len(rest), rest[:gap], tokens))
                rest = rest[gap:]
            self.emit(fullest[1])

    def close(self, window: list) -> None:
        """Cut a window that is not full to sequences whose lengths are powers of two."""
        fill, pieces = window
        while fill:
            size, taken = 1 << (fill.bit_length() - 1), []
            if self.window - fill < MIN_FILL:  # less padding than a further sequence is worth
                size = fill
            need = size
            while need:
                doc, start, ids, tokens = pieces.pop(0)
                taken.append((doc, start, ids[:need], tokens))
                if len(ids) > need:
                    pieces.insert(0, (doc, start + need, ids[need:], tokens))
                need -= min(need, len(ids))
            self.emit(taken)
            fill -= size


def _first(step: int) -> int:
    from pyspark import TaskContext

    return (step << 62) | (TaskContext.get().partitionId() << 36)


def _rows(rows: list[tuple], left: list[tuple] = ()) -> pa.RecordBatch:
    both = [*((*r, None) for r in rows), *left]
    columns = list(zip(*both, strict=True)) if both else [[]] * 8
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.list_(pa.int64()))], names=[*NAMES, "ids"])


def _pack(path: str, batch_bytes: int = BATCH_BYTES):
    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = chunk_tokenizer(path), Packer(_first(0))

        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            # so many documents at a time that their text stays near the limit
            part = np.cumsum(pc.binary_length(texts).to_numpy()) // batch_bytes
            for at, end in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]):
                ids, sizes = tok(texts.slice(at, end - at))
                first = 0
                for doc, n in zip(b.column(0).slice(at, end - at).to_pylist(), sizes.tolist(), strict=True):
                    packer.add(doc, np.append(ids[first : first + n], np.uint32(END_ID)))
                    first += n
            yield _rows(packer.rows)
            packer.rows = []
        left = []
        for k, (fill, pieces) in enumerate(packer.open):
            at = 0
            for doc, start, ids, tokens in pieces:
                left.append((doc, start, len(ids), fill, tokens, packer.next + k, at, ids.astype(np.int64)))
                at += len(ids)
        yield _rows([], left)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from pack_all(batches)
        finally:
            chunk_tokenizer(path).clear()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows arrive whole, sorted by sequence and offset; they are placed best-fit and closed at the end."""
    packer, name, pieces = Packer(_first(1)), None, []

    def place() -> None:
        fill = sum(len(p[2]) for p in pieces)
        while pieces and not packer.put(fill, list(pieces)):
            fullest = max(packer.open, key=lambda w: w[0])
            packer.open.remove(fullest)
            packer.close(fullest)

    for b in batches:
        for doc, start, tokens, sequence, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "sequence_id", "ids")), strict=True):
            if sequence != name:
                place()
                name, pieces = sequence, []
            pieces.append((doc, start, np.array(ids, np.uint32), tokens))
        yield _rows(packer.rows)
        packer.rows = []
    place()
    for window in packer.open:
        packer.close(window)
    yield _rows(packer.rows)


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stored(docs.mapInArrow(_pack(tokenizer_path), f"{PIECE}, ids array<long>"), "pieces")
    left = pieces.filter("ids is not null")
    windows = left.agg(F.countDistinct("sequence_id")).first()[0]
    # so many windows to a task that the few it closes at its end are a small share, and so few that a task stays small
    merged = left.repartition(max(1, windows // 4096), "sequence_id").sortWithinPartitions("sequence_id", "offset")
    merged = stored(merged.mapInArrow(_merge, f"{PIECE}, ids array<long>"), "merged")
    return pieces.filter("ids is null").unionByName(merged).select(*NAMES)
