"""Best-fit packing of tokenised documents into sequences.

Best-fit decreasing puts each piece, longest first, into the open sequence with the least room that still takes it. Pieces of one length
are interchangeable and so are sequences with the same room, hence the counts of pieces by length (at most ``capacity`` numbers, whatever
the size of the corpus) settle the whole packing. A segment tree over remaining capacities finds the tightest open
sequences in logarithmic time and a run of equal pieces moves at once. The plan is a table of runs, "pieces a to b of length l
go to sequences s to s + b - a at offset o"; its size depends on the capacity, not on the corpus. Spark counts, numbers the pieces of
each length and looks their places up.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .text import PIECE_BYTES, pieces, string_hashes

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, seat long"
#: Words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 2_000_000
WORDS_AT_ONCE = 20_000
#: Punctuation that may be taken off the end of a word before it is tokenised: it forms a token group of its own there.
TAIL = ".,;:!?"

_WORKER: dict = {}


class OpenSequences:
    """Segment tree over remaining capacities; each leaf holds runs (first sequence, count) in order of arrival."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)
        self.runs: list[deque] = [deque() for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        i = room + self.size
        while i and not self.open[i]:
            self.open[i] = 1
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` with an open sequence."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:  # up to the first right neighbour that has any, then down its left edge
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        first, count = self.runs[room][0]
        if count > most:
            self.runs[room][0] = (first + most, count - most)
            return first, most
        self.runs[room].popleft()
        if not self.runs[room]:
            i = room + self.size
            self.open[i] = 0
            while i > 1 and not self.open[i ^ 1]:
                i >>= 1
                self.open[i] = 0
        return first, count


def plan_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) of best-fit decreasing, and the number of sequences."""
    free, sequences, out = OpenSequences(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = free.tightest(length) if length <= capacity else None
            if room is None:
                # new sequences: each takes as many of these pieces as fit, unless fewer are left
                fit = capacity // length
                many = left // fit
                if many:
                    for k in range(fit):
                        out.append((length, rank, many, sequences, k * length))
                        rank += many
                    if capacity - fit * length:
                        free.add(capacity - fit * length, sequences, many)
                    left -= many * fit
                    sequences += many
                if left:
                    for k in range(left):
                        out.append((length, rank + k, 1, sequences, k * length))
                    if capacity - left * length:
                        free.add(capacity - left * length, sequences, 1)
                    sequences, left = sequences + 1, 0
                break
            first, n = free.take(room, left)
            out.append((length, rank, n, first, capacity - room))
            if room > length:
                free.add(room - length, first, n)
            rank, left = rank + n, left - n
    return np.array(out, dtype=np.int64).reshape(-1, 5), sequences


class KnownWords:
    """Ids of words that a worker has seen, in arrays: about 40 bytes a word. Words are found by hash and compared in full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words = pa.array([], type=pa.large_string())
        self.flat, self.first, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], []
        for at in range(0, len(words), WORDS_AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[at: at + WORDS_AT_ONCE].to_pylist(), add_special_tokens=False)]
            counts += map(len, found)
            ids.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32))
        return np.concatenate(ids), np.array(counts, dtype=np.int64)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: ids end to end, where each word's begin and how many it has."""
        if len(self.words) > REMEMBERED:
            self.clear()
        hashes = string_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(words), dtype=bool)
        row = self.rows[at] if len(self.hashes) else at
        there = np.flatnonzero(known)
        known[there] = pc.equal(words.take(pa.array(there)), self.words.take(pa.array(row[there]))).to_numpy(zero_copy_only=False)
        fresh = np.flatnonzero(~known)
        new = words.take(pa.array(fresh))
        flat, counts = self.encode(new)
        row[fresh] = len(self.words) + np.arange(len(fresh))
        first = np.cumsum(counts) - counts + len(self.flat)
        self.words = pa.concat_arrays([self.words, new])
        self.flat, self.first, self.counts = (np.concatenate(x) for x in ((self.flat, flat), (self.first, first), (self.counts, counts)))
        # a word whose hash another one has already is encoded again when it comes again
        own, which = np.unique(hashes[fresh], return_index=True)
        place = np.searchsorted(self.hashes, own)
        free = np.append(self.hashes, 0)[place] != own if len(self.hashes) else np.ones(len(own), dtype=bool)
        free |= place == len(self.hashes)
        own, which, place = own[free], which[free], place[free]
        self.rows = np.insert(self.rows, place, row[fresh[which]])
        self.hashes = np.insert(self.hashes, place, own)
        return self.flat, self.first[row], self.counts[row]


def _known_words(path: str) -> KnownWords:
    if _WORKER.get("path") != path:
        _WORKER.update(path=path, known=KnownWords(path))
    return _WORKER["known"]


def token_ids(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each with ``end_id`` after it, and the texts' id counts.

    The tokenizer never joins characters over white space, so each distinct word of the piece is encoded once. A-Z
    are lower-cased first and punctuation at a word's end is a word of its own; both leave the ids as they are, and words that
    may hold a special token are left alone.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy()
    words = split.flatten()
    # splitting leaves an empty word where a text begins or ends with white space
    coded = words.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    plain = pc.invert(pc.match_substring(distinct, "<"))
    low = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
    stem = pc.ascii_rtrim(low, TAIL)
    splits = pc.and_(plain, pc.match_substring_regex(stem, "[a-z0-9]$"))
    stem = pc.if_else(splits, stem, low)
    tail = pc.if_else(splits, pc.struct_field(pc.extract_regex(low, f"(?P<tail>[{TAIL}]*)$"), "tail"), "")
    parts = pa.concat_arrays([stem, pc.fill_null(tail, "")]).dictionary_encode()
    flat, first, n = _known_words(path).ids(parts.dictionary)
    of = parts.indices.to_numpy()
    a, b = of[: len(distinct)][codes], of[len(distinct):][codes]
    order = np.stack([a, b], axis=1).ravel()
    lengths = n[order]
    ends = np.concatenate([[0], np.cumsum(lengths)])[2 * offsets]  # ids before each text
    at = np.repeat(first[order], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.insert(flat[at], ends[1:], end_id), np.diff(ends) + 1


def _cut_pieces(path: str, end_id: int, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seats = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for some in pieces(batch, "text", PIECE_BYTES):
                ids, counts = token_ids(some.column("text"), path, end_id)
                per_doc = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), per_doc)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = (np.cumsum(counts) - counts)[doc] + start
                raw = ids.astype("<u4").tobytes()
                chunks = [raw[4 * a: 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
                # how many pieces of the same length this task had before
                order = np.argsort(length, kind="stable")
                sorted_lengths = length[order]
                begins = np.flatnonzero(np.diff(sorted_lengths, prepend=-1))
                seat = np.empty(len(length), dtype=np.int64)
                seat[order] = seats[sorted_lengths] + np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
                seats += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(c) for c in chunks], type=pa.int64()),
                    pa.array(chunks, type=pa.binary()) if with_ids else pa.nulls(len(chunks), pa.binary()),
                    pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(seat),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "seat"])
    return stream


def _place(runs: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Look up where the piece of a length and rank goes. ``runs`` is sorted by length and first rank."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {int(n): (int(a), int(b)) for n, a, b in _spans(runs[:, 0])}
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                a, b = firsts[int(n)]
                mine = length == n
                at[mine] = a + np.searchsorted(runs[a:b, 1], rank[mine], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")),
                 pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])
    return stream


def _spans(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    starts = np.flatnonzero(np.diff(values, prepend=-1))
    yield from zip(values[starts], starts, np.append(starts[1:], len(values)))


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1,
         with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``: one row per piece of a document.

    A document is its text's ids (a null text is empty) and ``end_id``. Documents longer than ``capacity`` are cut into pieces of
    that length, the last one may be shorter. Pieces fill sequences from offset 0 without gaps. ``ids`` holds the piece's ids as
    little-endian unsigned 32-bit numbers (null without ``with_ids``), ``ids_crc32`` their checksum. Repeated rows and null identifiers are packed
    like any other. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = cut(rows.mapInArrow(_cut_pieces(tokenizer_path, end_id, capacity, with_ids), PIECE_SCHEMA))
    by_task = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per length
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = found.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("seat") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(_place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
