"""Interpolated modified Kneser-Ney bigram model, counted in Spark, and the log probability of every text under it.

Documents become chunks: word hashes and, per token, the number of its word. From then on only numbers move. Each
chunk sends its distinct bigram hashes, sorted and cut at ranges of the hash, to one shard per range. A shard keeps all hashes of its range
and their training counts as sorted arrays in a file that it maps into memory, and looks every chunk's hashes up there. The answers
go back to the chunks, which sum per word what the lower order needs (distinct words before it, and how many words follow it once,
twice or more often), and words are counted in shards in the same way. No part of the model is on the driver, in one task or broadcast: shards
grow in number, not in size. The chunks are bucketed on their number, so they stay where they are while answers join them.

A bigram with training count T is seen T times in training, so adding 1 / T for each time counts it once; the sums are rounded.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, scratch_root
from .text import Words, crc_fold, mix, pieces

FOLDS, HELD_OUT = 7, 2
#: Tokens of a chunk, and about how many entries a shard has.
CHUNK_TOKENS, SHARD_ENTRIES = 1_000_000, 1_000_000
#: Hashes of the marks before and after a text; no word has them but by chance.
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)

_CHUNKS = "chunk long, tokens long, doc_id array<long>, sizes array<int>, trains array<boolean>, words binary, codes binary"
_ROUTED = "shard int, chunk long, n int, hashes binary, values binary"
_ANSWERS = "chunk long, shard int, n int, data binary, stats array<long>"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _spread(data: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(kind).ravel()


def _to_chunks(most: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            ids, trains, counts, hashes = pa.chunked_array([h[0] for h in held]), np.concatenate([h[1] for h in held]), *(np.concatenate([h[k] for h in held]) for k in (2, 3))
            ends = np.cumsum(counts)
            tokens = np.insert(hashes, np.repeat(ends, 2), np.tile([END, BEGIN], len(ends)))
            tokens = np.concatenate([[BEGIN], tokens[:-1]]) if len(ends) else tokens
            words, codes, times = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # small numbers for frequent words
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order))
            out = pa.RecordBatch.from_arrays([
                pa.array([(part << 32) | made]), pa.array([len(tokens)]), pa.array([ids.to_pylist()], type=pa.list_(pa.int64())),
                pa.array([counts.astype(np.int32)], type=pa.list_(pa.int32())), pa.array([trains], type=pa.list_(pa.bool_())),
                pa.array([words[order].tobytes()], type=pa.binary()), pa.array([_squeeze(rank[codes])], type=pa.binary())],
                names=["chunk", "tokens", "doc_id", "sizes", "trains", "words", "codes"])
            held, made = [], made + 1
            return out

        waiting = 0
        for batch in batches:
            for some in pieces(batch, "text"):
                words = Words(some.column("text"))
                held.append((some.column("doc_id"), some.column("trains").to_numpy(zero_copy_only=False), words.counts, words.hashes()))
                waiting += len(words.start) + some.num_rows
                if waiting >= most:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    return stream


class Chunk:
    """A chunk's distinct bigrams in order of their hash, with what each token is."""

    def __init__(self, words: bytes, codes: bytes, tokens: int, sizes: np.ndarray, trains: np.ndarray):
        self.words = np.frombuffer(words, dtype=np.uint64)
        self.word_order = np.argsort(self.words)
        codes = _spread(codes, "<u4", tokens).astype(np.int64)
        place = np.ones(tokens, dtype=bool)  # all but the marks before a text are predicted
        place[np.cumsum(sizes + 2) - sizes - 2] = False
        at = np.flatnonzero(place)
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        before, self.word = codes[at - 1], codes[at]
        self.train = trains[self.doc]
        h = mix(self.words[before] * np.uint64(0xD6E8FEB86659FD93) + self.words[self.word])
        self.pairs, first, self.pair = np.unique(h, return_index=True, return_inverse=True)
        self.pair_before, self.pair_word = before[first], self.word[first]
        self.times = np.bincount(self.pair[self.train], minlength=len(self.pairs))


def _chunk(row: dict) -> Chunk:
    return Chunk(row["words"], row["codes"], row["tokens"], np.array(row["sizes"], dtype=np.int64), np.array(row["trains"], dtype=bool))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _route(chunk: int, hashes: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted hashes and their rows of values, cut by the first bits of the hash."""
    shard = (hashes >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(starts[1:], len(hashes))
    return pa.RecordBatch.from_arrays([
        pa.array(shard[starts]), pa.array(np.full(len(starts), chunk)), pa.array((ends - starts).astype(np.int32)),
        pa.array([_squeeze(np.diff(hashes[a:b], prepend=np.uint64(0))) for a, b in zip(starts, ends)], type=pa.binary()),
        pa.array([_squeeze(np.ascontiguousarray(values[a:b].T).ravel()) for a, b in zip(starts, ends)], type=pa.binary())],
        names=["shard", "chunk", "n", "hashes", "values"])


def _send_pairs(bits: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _chunk(row)
            yield _route(row["chunk"], c.pairs, c.times[:, None].astype("<f8"), bits)
    return stream


def _mapped(file, array: np.ndarray) -> np.ndarray:
    """The array as memory mapped from the end of an open, nameless file."""
    at = file.seek(0, 2)
    file.write(np.ascontiguousarray(array).tobytes())
    file.flush()
    return np.memmap(file, dtype=array.dtype, mode="r", offset=at, shape=array.shape) if array.size else array


def _answer(columns: int, stats: Callable[[np.ndarray], list[int]]):
    """For rows sorted by shard: sum the values of equal hashes, then look each chunk's hashes up."""
    def settle(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            parts = [_mapped(file, np.cumsum(_spread(r["hashes"], "<u8", r["n"]), dtype=np.uint64)) for r in rows]
            hashes = np.unique(np.concatenate(parts))
            total = np.zeros((columns, len(hashes)))
            for part, r in zip(parts, rows):
                total[:, np.searchsorted(hashes, part)] += _spread(r["values"], "<f8", columns * r["n"]).reshape(columns, -1)
            total = np.rint(total).astype("<i8")
            figures = stats(total)
            model, counts = _mapped(file, hashes), _mapped(file, total)
            for part, r in zip(parts, rows):
                found = np.ascontiguousarray(counts[:, np.searchsorted(model, part)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["chunk"]]), pa.array([shard], type=pa.int32()), pa.array([r["n"]], type=pa.int32()),
                    pa.array([_squeeze(found.ravel())], type=pa.binary()), pa.array([figures], type=pa.list_(pa.int64()))],
                    names=["chunk", "shard", "n", "data", "stats"])
                figures = None  # once per shard
            del parts, model, counts

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and held[0]["shard"] != row["shard"]:
                yield from settle(held[0]["shard"], held)
                held = []
            held.append(row)
        if held:
            yield from settle(held[0]["shard"], held)

    return stream


def _how_many(values: np.ndarray) -> list[int]:
    """How many values are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5].tolist()


def _pair_stats(total: np.ndarray) -> list[int]:
    return _how_many(total[0])


def _word_stats(total: np.ndarray) -> list[int]:
    """Tokens, distinct words, sum of distinct predecessors; words by distinct predecessors: 1, 2, 3, 4, 3 and more."""
    return [int(total[0].sum()), int((total[0] > 0).sum()), int(total[1].sum()), *_how_many(total[1]), int((total[1] >= 3).sum())]


def _found(parts: list[dict], columns: int) -> np.ndarray:
    """Answers of all shards end to end: shards are ranges of the hash, so this is the order of the chunk's sorted hashes."""
    return np.concatenate([_spread(p["data"], "<i8", columns * p["n"]).reshape(columns, -1) for p in sorted(parts, key=lambda p: p["shard"])], axis=1)


def _send_words(bits: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _chunk(row)
            total = _found(row["pairs"], 1)[0]
            share = np.divide(c.times, total, out=np.zeros(len(total)), where=total > 0)
            by = lambda column, value: np.bincount(column, value, minlength=len(c.words))
            values = np.stack([
                by(c.pair_word, c.times), by(c.pair_word, share), by(c.pair_before, c.times),
                by(c.pair_before, share * (total == 1)), by(c.pair_before, share * (total == 2)), by(c.pair_before, share * (total >= 3))], axis=1)
            yield _route(row["chunk"], c.words[c.word_order], values[c.word_order], bits)
    return stream


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more: the usual estimates, kept between 0 and the count itself."""
    y = ones / (ones + 2 * twos) if ones + 2 * twos else 0.5
    rate = lambda k, n, more: k - (k + 1) * y * more / n if n else k * y
    return np.array([0.0, *(float(np.clip(rate(k, n, more), 0, k)) for k, n, more in ((1, ones, twos), (2, twos, threes), (3, threes, fours)))])


def _score(pair_stats: list[int], word_stats: list[int]):
    n, v, before_sum, m1, m2, m3, m4, m3_more = word_stats
    upper, lower = discounts(*pair_stats), discounts(m1, m2, m3, m4)
    left_over = (lower[1] * m1 + lower[2] * m2 + lower[3] * m3_more) / before_sum if before_sum else 1.0

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _chunk(row)
            total = _found(row["pairs"], 1)[0]
            stats = np.empty((6, len(c.words)), dtype=np.int64)
            stats[:, c.word_order] = _found(row["words_found"], 6)
            count, before, den, n1, n2, n3 = stats
            unigram = left_over / (v + 1) + np.maximum(before - lower[np.minimum(before, 3)], 0) / max(before_sum, 1)
            b, w = c.pair_before, c.pair_word
            seen = np.maximum(den[b], 1)
            rest = np.where(den[b] > 0, (upper[1] * n1[b] + upper[2] * n2[b] + upper[3] * n3[b]) / seen, 1.0)
            p = np.where(den[b] > 0, np.maximum(total - upper[np.minimum(total, 3)], 0) / seen, 0) + rest * unigram[w]
            docs = len(row["sizes"])
            sums = lambda x: np.bincount(c.doc, x, minlength=docs)
            base = np.log10((count[c.word] + 1) / (n + v + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_id"], type=pa.int64()), pa.array(~np.array(row["trains"], dtype=bool)),
                pa.array(np.array(row["sizes"], dtype=np.int64) + 1), pa.array(sums(count[c.word] > 0).astype(np.int64)),
                pa.array(np.full(docs, n)), pa.array(sums(base)), pa.array(sums(np.log10(p)[c.pair]))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return stream


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """Write to the shared folder in buckets by chunk; later joins on it leave this side in place."""
    spark = df.sparkSession
    name = f"lm_chunks_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}"
    df.write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry in the catalog only; the files stay
    return table


def _by_chunk(answers: DataFrame, name: str, buckets: int) -> DataFrame:
    return answers.select("chunk", "shard", "n", "data").repartition(buckets, "chunk").groupBy("chunk").agg(
        F.collect_list(F.struct("shard", "n", "data")).alias(name))


def _sum_stats(answers: DataFrame, n: int) -> list[int]:
    sums = answers.filter(F.col("stats").isNotNull()).agg(*(F.sum(F.get("stats", F.lit(i))) for i in range(n))).first()
    return [int(x or 0) for x in sums]


def score_texts(docs: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", shard_entries: int = SHARD_ENTRIES,
                chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per row of ``docs``.

    The model learns from the rows for which ``trains`` holds (a null counts as true) and scores all. Tokens are runs of other than ASCII white space,
    A-Z in lower case, and one end mark per text; a null text is empty. ``n_known`` counts tokens seen in training, ``train_tokens`` all of those.
    ``score`` is the log10 probability of the text, ``base_score`` that of unigrams with one added to every count. Repeated rows
    count as often as they occur; other columns are not read. An empty table gives an empty result; without training rows each
    token has probability 1 (there is nothing but the unknown word).
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(trains, F.lit(True)).alias("trains"), F.col(text).alias("text"))
    chunks = _bucketed(rows.mapInArrow(_to_chunks(chunk_tokens), _CHUNKS), buckets)
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, tokens / shard_entries)))))

    def settled(routed: DataFrame, columns: int, stats: Callable[[np.ndarray], list[int]]) -> DataFrame:
        return cut(routed.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(_answer(columns, stats), _ANSWERS))

    pairs = settled(chunks.mapInArrow(_send_pairs(bits), _ROUTED), 1, _pair_stats)
    with_pairs = chunks.join(_by_chunk(pairs, "pairs", buckets), "chunk")
    words = settled(with_pairs.mapInArrow(_send_words(bits), _ROUTED), 6, _word_stats)
    with_words = with_pairs.join(_by_chunk(words, "words_found", buckets), "chunk")
    return with_words.mapInArrow(_score(_sum_stats(pairs, 4), _sum_stats(words, 8)), _SCORES)


def score_documents(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, key: str = "doc_id") -> DataFrame:
    """:func:`score_texts`, learning from the rows whose identifier's CRC-32 fold is not ``held_out``."""
    return score_texts(docs, crc_fold(key, folds) != held_out, key)
