"""Groups of near copies by SimHash: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity a fingerprint of 64 bits differs in about ten, far more than anchors can cover. So the jobs of a fingerprint are
parted. Several short fingerprints of the document's *words* find candidates: where a fifth of the shingles differ only a few
words in a hundred do, so these bits hardly change. Each is covered by anchors: 23 bits by the Golay code, with one bit beyond its
radius, times plain bits. A sketch of the *shingles* discards candidates at each anchor: with a share p of differing bits the cosine
is about cos(pi p), and the Jaccard similarity cosine / (2 - cosine); its limit is generous. Sizes that rule the similarity out are discarded too.

What is left only says which documents may belong together: tasks give merges of parts, never pairs. First the documents meet at their homes alone,
which joins nearly all of a large group; then they are replicated, and only documents of different parts are compared. In each
part the whole sets of shingles decide (``set_links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .set_links import components_of, links_in_groups
from .simhash import BLOCK_PAIRS, LENGTH, Golay, merge
from .text import Words, mix, pieces

#: Short fingerprints per document, plain bits of each, bits beyond the code's radius, and the sketch's bits.
TABLES, PLAIN, BEYOND, SKETCH_BITS = 24, 4, 1, 128
#: Words of a text that are weighed at once, and rows at anchors that a task looks at in one go.
ROWS_AT_ONCE, MET_AT_ONCE = 4_000, 300_000
#: Standard deviations by which the sketches of a pair may differ in more bits than the mean pair of the least similarity.
SIGMAS = 3.5
_PRINTS = "doc_id long, text_hash long, n long, key long, short binary, sketch binary"
_MET = "anchor long, part long, n int, sketch binary, home boolean"


def distance_limit(similarity: float, sigmas: float = 0.0) -> int:
    """Bits in which the sketches of two sets with this Jaccard similarity differ on average, and so many deviations more."""
    share = float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    return round(SKETCH_BITS * share + sigmas * (SKETCH_BITS * share * (1 - share)) ** 0.5)


def _signs(hashes: np.ndarray, weights: np.ndarray, words: int) -> np.ndarray:
    """Bytes of ``64 * words`` bits: each is 1 if the weights of the hashes that set it are over half."""
    total = np.zeros(64 * words, dtype=np.float64)
    for at in range(0, len(hashes), ROWS_AT_ONCE):
        h, w = hashes[at: at + ROWS_AT_ONCE], weights[at: at + ROWS_AT_ONCE].astype(np.float32)
        many = np.stack([mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(words)], axis=1)
        total += w @ np.unpackbits(np.ascontiguousarray(many).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    return np.packbits(2 * total > weights.sum(), bitorder="little")


def shingle_set(hashes: np.ndarray, words_per_shingle: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted, for one document's word hashes; a document with fewer words is one shingle."""
    n = max(1, len(hashes) - words_per_shingle + 1) if len(hashes) else 0
    shingles = np.zeros(n, dtype=np.uint64)
    for j in range(min(words_per_shingle, len(hashes))):
        shingles = mix(shingles * np.uint64(0x9E3779B97F4A7C15) + hashes[j: j + n])
    return np.unique(shingles)


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a sorted set."""
    return int(mix(np.array([mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)]) + np.uint64(len(tokens))).view(np.int64)[0])


def document_bits(hashes: np.ndarray, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of shingles, the short fingerprints' bytes and the sketch's bytes for one document's word hashes."""
    words, times = np.unique(hashes, return_counts=True)
    short = _signs(words, np.sqrt(times), -(-TABLES * (LENGTH + PLAIN) // 64))
    distinct = shingle_set(hashes, words_per_shingle)
    return distinct, short, _signs(distinct, np.ones(len(distinct)), SKETCH_BITS // 64)


def _table_bits(short: np.ndarray) -> np.ndarray:
    """(documents, TABLES) numbers of LENGTH + PLAIN bits."""
    width = LENGTH + PLAIN
    bits = np.unpackbits(short, axis=1, bitorder="little")[:, : TABLES * width].reshape(len(short), TABLES, width)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    flat = column.cast(pa.binary(width))
    return np.frombuffer(flat.buffers()[1], dtype=np.uint8)[flat.offset * width:][: len(flat) * width].reshape(-1, width)


def _prints(words_per_shingle: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                words = Words(some.column("text"))
                hashes, ends = words.hashes(), np.cumsum(words.counts)
                found = [document_bits(hashes[b - n: b], words_per_shingle) for b, n in zip(ends, words.counts)]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("text_hash"), pa.array([len(x[0]) for x in found], pa.int64()), pa.array([set_key(x[0]) for x in found], pa.int64()),
                     *(_binary(np.stack([x[k] for x in found])) for k in (1, 2))], names=["doc_id", "text_hash", "n", "key", "short", "sketch"])
    return stream


def document_sets(words_per_shingle: int, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of the batch's rows with the sorted distinct shingle hashes of each text."""
    for some in pieces(batch, "text"):
        words = Words(some.column("text"))
        hashes, ends = words.hashes(), np.cumsum(words.counts)
        yield some, [shingle_set(hashes[b - n: b], words_per_shingle) for b, n in zip(ends, words.counts)]


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def sets_of(rows: DataFrame, wanted: DataFrame, words_per_shingle: int) -> DataFrame:
    """``key, shingles``, one row per key, of the rows ``doc_id, text, text_hash`` that are in ``wanted`` (``row.doc_id, row.text_hash``)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in document_sets(words_per_shingle, batch):
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), lists_of(sets)], names=["key", "shingles"])

    these = wanted.select(F.col("row.doc_id").alias("_doc"), F.col("row.text_hash").alias("_hash"))
    texts = rows.join(these, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left_semi").select("text")
    return cut(texts.mapInArrow(stream, "key long, shingles array<long>").groupBy("key").agg(F.first("shingles").alias("shingles")))


def _at_anchors(replicate: bool):
    """Rows at the anchors of all short fingerprints: the home of each, or all within reach."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay(BEYOND)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                keys = _table_bits(_bytes(batch.column("short"), -(-TABLES * (LENGTH + PLAIN) // 64) * 8))
                sketches = _bytes(batch.column("sketch"), SKETCH_BITS // 8)
                table = np.tile(np.arange(TABLES), len(keys))
                key = keys.ravel()
                row, code, excess = golay.near(key & ((1 << LENGTH) - 1), np.full(len(key), BEYOND if replicate else 0))
                anchor = (table[row] << (LENGTH + PLAIN)) | (key[row] >> LENGTH << LENGTH) | code
                of = pa.array(row // TABLES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), batch.column("part").take(of), batch.column("n").take(of), _binary(sketches[row // TABLES]), pa.array(excess == 0)],
                    names=["anchor", "part", "n", "sketch", "home"])
    return stream


def merges(limit: int, similarity: Fraction, anchor: np.ndarray, part: np.ndarray, size: np.ndarray, sketch: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts (a, b) to merge: at least one document at home at the anchor, sketches within ``limit`` bits, sizes that allow the similarity.

    Rows are sorted by anchor. The merges connect what any such pair of rows connects.
    """
    names, label = np.unique(part, return_inverse=True)
    starts = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
    sizes = np.diff(np.append(starts, len(anchor)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    parent = np.arange(len(names))

    def take(left: np.ndarray, right: np.ndarray) -> None:
        nonlocal parent
        can = (home[left] | home[right]) & (parent[label[left]] != parent[label[right]])
        left, right = left[can], right[can]
        small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
        can = small * similarity.denominator >= large * similarity.numerator
        left, right = left[can], right[can]
        near = np.bitwise_count(sketch[left] ^ sketch[right]).sum(axis=1, dtype=np.int64) <= limit
        parent = merge(parent, label[left[near]], label[right[near]])

    every = np.arange(len(anchor))
    take(every, starts[owner])  # the first row of an anchor joins most of a large group
    now = parent[label]
    # then every row outside the anchor's commonest part meets all rows there
    order = np.lexsort((now, owner))
    new = np.flatnonzero(np.diff(owner[order], prepend=-1) | np.diff(now[order], prepend=-1))
    n = np.diff(np.append(new, len(order)))
    best = np.lexsort((n, owner[order[new]]))
    last = np.append(np.flatnonzero(np.diff(owner[order[new]][best])), len(best) - 1)
    commonest = now[order[new[best[last]]]]
    at = np.flatnonzero(now != commonest[owner])
    total, lo = np.cumsum(sizes[owner[at]]), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK_PAIRS // 4, side="right")))
        n = sizes[owner[at[lo:hi]]]
        left = np.repeat(at[lo:hi], n)
        take(left, np.repeat(starts[owner[at[lo:hi]]], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n))
        lo = hi
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return names[moved], names[parent[moved]]


def _merge_stream(limit: int, similarity: Fraction):
    def found(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, b = merges(limit, similarity, *(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column("anchor").to_numpy(), batch.column("part").to_numpy(), batch.column("n").to_numpy().astype(np.int64),
                   _bytes(batch.column("sketch"), SKETCH_BITS // 8).view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)]
            if rows >= MET_AT_ONCE and held[-1][0][-1] != now[0][0]:
                yield found(held)
                held, rows = [], 0
            elif rows >= MET_AT_ONCE and now[0][0] != now[0][-1]:
                first = int(np.searchsorted(now[0], now[0][0], side="right"))
                yield found([*held, [x[:first] for x in now]])
                held, rows, now = [], 0, [x[first:] for x in now]
            held.append(now)
            rows += len(now[0])
        if held:
            yield found(held)

    return stream


def _merged(nodes: DataFrame, replicate: bool, similarity: Fraction) -> DataFrame:
    met = nodes.select("short", "sketch", F.col("n").cast("int").alias("n"), "part").mapInArrow(_at_anchors(replicate), _MET)
    limit = distance_limit(float(similarity), SIGMAS)
    return cut(met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merge_stream(limit, similarity), "src long, dst long").distinct())


def _document_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """``doc_id, text_hash, component_id, kept`` for documents that have a near copy, directly or over others; others have no row.

    A document is an identifier with a text (``text_hash``: Spark's xxhash64 of the text); rows that share both are one, rows that share only the identifier
    are not, and rows with a null identifier take part. Every link is a pair of documents whose sets of shingles have the similarity; equal sets are linked, so
    texts without words are near copies of each other. ``component_id`` is the smallest identifier of the group, null if it has none. One document of a group is
    ``kept``: that with the smallest identifier (nulls last), then the smallest hash. A null text counts as empty. Other columns are not read. An empty table gives an empty result.
    """
    share = Fraction(similarity).limit_denominator(10_000)
    rows = _document_rows(docs, key, text)
    prints = cut(rows.mapInArrow(_prints(words_per_shingle), _PRINTS))
    nodes = cut(prints.groupBy("key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row"), F.max("n").alias("n"), F.first("short").alias("short"), F.first("sketch").alias("sketch"))
        .withColumn("part", F.monotonically_increasing_id()))
    at_home = _merged(nodes, False, share)
    parts = cut(nodes.join(components_of(at_home).withColumnRenamed("key", "part"), "part", "left").withColumn("node", F.col("part")).withColumn("part", F.coalesce("comp", "part")).drop("comp"))
    away = _merged(parts, True, share)
    groups = parts.join(components_of(away).withColumnRenamed("key", "part"), "part", "left").select("key", "row", "n", F.coalesce("comp", "part").alias("grp"))
    several = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("grp")
    members = cut(groups.join(several, "grp", "left_semi"))
    links = links_in_groups(members.select("grp", "key", "n"), sets_of(rows, members, words_per_shingle), share)
    found = prints.select("doc_id", "text_hash", "key").distinct().join(components_of(links), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    best = found.groupBy("comp").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return found.join(best, "comp").select("doc_id", "text_hash", "component_id", kept.alias("kept"))


def one_of_each_group(docs: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that ``near_copies`` does not keep."""
    others = groups.filter("NOT kept").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    same = docs[key].cast("long").eqNullSafe(others["_doc"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == others["_hash"])
    return docs.join(others, same, "left_anti")
