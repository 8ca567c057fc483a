"""SimHash near-dedup with anchor points.

A covering code supplies the anchors: bits 0 to 22 and 23 to 45 of a fingerprint are two words of the perfect binary Golay code, each of
which lies within 3 bits of exactly one codeword. A fingerprint is at home at its nearest pair of codewords and is replicated to every
pair within 3 plus what is left of the threshold, so two fingerprints that differ in at most ``threshold`` bits meet at the home of
either. Work per anchor is one comparison of its home fingerprints with all that came there. There are 2 ** 24 anchors, and equal
fingerprints count once, so a large group of copies is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import weak_components
from ..plans.lineage import cut
from .text import LOWER_BYTES

#: Length and covering radius of the Golay code, and its generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
LENGTH, RADIUS, GENERATOR = 23, 3, 0b110001110101
#: Comparisons made at once within a task.
BLOCK_PAIRS = 2_000_000
SHINGLES_AT_ONCE = 100_000


def shingle_fingerprint(text: str, words_per_shingle: int) -> int:
    """64 bits: bit i is 1 if it is set in over half of the shingles' XXH64 values (seed 42); 0 without words.

    Words are runs of other than ASCII white space, A-Z in lower case. A text with fewer words is one shingle.
    """
    words = text.encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined, width = b" ".join(words), words_per_shingle
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1:]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        span = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[span].tolist(), ends[span].tolist())], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: one row per row; ``fp`` holds the 64 bits as a signed long. A null text counts as empty."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_fingerprint(t.as_py() or "", words_per_shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(stream, "doc_id long, fp long")


class Golay:
    """For each syndrome the error patterns with at most ``RADIUS + threshold`` bits, in order of what they exceed the radius by."""

    def __init__(self, threshold: int):
        powers = np.zeros(LENGTH, dtype=np.int64)
        rest = 1
        for i in range(LENGTH):
            powers[i] = rest
            rest <<= 1
            if rest >> 11:
                rest ^= GENERATOR
        self.powers = powers
        patterns, excess = [], []
        for weight in range(RADIUS + threshold + 1):
            at = np.array(list(combinations(range(LENGTH), weight)), dtype=np.int64).reshape(comb(LENGTH, weight), weight)
            patterns.append((1 << at).sum(axis=1))
            excess.append(np.full(len(at), max(0, weight - RADIUS)))
        patterns, excess = np.concatenate(patterns), np.concatenate(excess)
        found = self.syndrome(patterns)
        order = np.lexsort((excess, found))
        self.patterns, self.excess = patterns[order], excess[order]
        # first pattern of a syndrome, and how many of its patterns exceed the radius by at most e
        self.first = np.searchsorted(found[order], np.arange(1 << 11))
        self.upto = np.stack([np.bincount(found[excess <= e], minlength=1 << 11) for e in range(threshold + 1)])

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        for i in range(LENGTH):
            out ^= np.where((words >> i) & 1, self.powers[i], 0)
        return out

    def near(self, words: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, codewords and excess: for each word all codewords within the radius plus its entry of ``left``."""
        s = self.syndrome(words)
        counts = self.upto[left, s]
        row = np.repeat(np.arange(len(words)), counts)
        at = np.repeat(self.first[s], counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        return row, words[row] ^ self.patterns[at], self.excess[at]


def anchors(fps: np.ndarray, golay: Golay, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, anchors (46 bits) and whether the anchor is the row's home."""
    bits = fps.view(np.uint64)
    low, high = ((bits >> np.uint64(k)).astype(np.int64) & ((1 << LENGTH) - 1) for k in (0, LENGTH))
    row, first, used = golay.near(low, np.full(len(fps), threshold))
    again, second, more = golay.near(high[row], threshold - used)
    return row[again], first[again] | (second << LENGTH), (used[again] + more) == 0


def _replicate(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay(threshold)
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 4096):
                part = fps[at: at + 4096]
                row, anchor, home = anchors(part, golay, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"])
    return stream


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a and b; every set is named by its smallest member."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _link_group(fps: np.ndarray, home: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Roots of the rows: linked rows of one anchor share the smallest row."""
    parent = np.arange(len(fps))
    owner = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(home & (sizes[owner] > 1))
    total = np.cumsum(sizes[owner[at]])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK_PAIRS, side="right")))
        mine = at[lo:hi]
        n = sizes[owner[mine]]
        left = np.repeat(mine, n)
        right = np.repeat(starts[owner[mine]], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count((fps[left] ^ fps[right]).view(np.uint64)) <= threshold
        parent = merge(parent, left[near], right[near])
        lo = hi
    return parent


def _compare(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Star edges (fp, smallest linked fp) for each anchor, from rows sorted by anchor."""

    def edges(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
        sizes = np.diff(np.append(starts, len(anchor)))
        parent = _link_group(fps, home, starts, sizes, threshold)
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[parent[moved]])], names=["src", "dst"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the anchor that may go on in the next batch
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "home")]
            if not len(now[0]):
                continue
            if held and held[0][0][0] == now[0][-1]:
                held.append(now)
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            ready = [np.concatenate(x) for x in zip(*held, [x[:last] for x in now])]
            if len(ready[0]):
                yield edges(*ready)
            held = [[x[last:] for x in now]]
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held)))

    return stream


def linked(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """``uid, comp`` for every fingerprint that has another one within ``threshold`` bits, directly or over others."""
    distinct = fps.select("fp").distinct()
    met = distinct.mapInArrow(_replicate(threshold), "anchor long, fp long, home boolean")
    edges = cut(met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(threshold), "src long, dst long").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("uid"))
    return weak_components(nodes, edges, edges_inside=True)


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3, threshold: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``.

    Fingerprints link if they differ in at most ``threshold`` bits; all empty texts have fingerprint 0. ``component_id`` is the
    smallest identifier reachable over links, the row's own included; null identifiers get one too if any row of the component has
    one. Repeated rows stay. Other columns are not read. An empty table gives an empty result.
    """
    found = cut(fingerprints(docs, key, text, words_per_shingle))
    lowest = found.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = linked(found, threshold)
    joined = lowest.join(groups.withColumnRenamed("uid", "fp"), "fp", "left").select("fp", "low", F.coalesce("comp", "fp").alias("comp"))
    named = joined.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_fp = joined.select("fp", "comp").join(named, "comp").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
