"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's score is a sigmoid of w0 + sum(w x) + sum over pairs (v_i . v_j) x_i x_j. The pair term costs no more than the linear
one: it is half of (sum v x) squared minus sum (v x) squared, per dimension. The model is fitted in numpy on a bounded sample;
its size is fixed by the number of hash buckets. Spark computes the features of the sample and scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import labelled_sample
from .text import Words, crc_fold, pieces

#: Fold of the identifiers' CRC-32 that never trains, and how many folds there are.
FOLDS, HELD_OUT = 3, 1
#: At most so many labelled rows of either class train the model.
SAMPLE_PER_CLASS = 5000
BUCKETS, RANK, EPOCHS, BATCH, RATE, DECAY = 1 << 17, 6, 6, 128, 0.08, 2e-5

_CLASSES = {"letter": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "stop": ".!?", "comma": ",;:", "blank": " \t\r\x0b\x0c",
            "bar": "|", "symbol": "#$%&*+-/<=>@[\\]^_`{}~\"'()", "line": "\n"}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_chars.encode())] = _k
#: Shares of the byte classes, other bytes last, then word and line figures.
STATISTICS = [*_CLASSES, "other", "words", "mean_word", "word_spread", "distinct", "repeated", "top_word", "lines", "mean_line", "chars"]


@dataclass
class Features:
    """Hashed words of documents in row order: document, bucket, value; and a row of statistics per document."""

    doc: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    statistics: np.ndarray


def features(texts: pa.Array, chars: np.ndarray) -> Features:
    """``chars``: the documents' length as the table has it (0 if unknown)."""
    n = len(texts)
    words = Words(texts)
    hashes = words.hashes()
    doc = np.repeat(np.arange(n), words.counts)
    length = words.end - words.start
    count = words.counts.astype(np.float64)
    some = np.maximum(count, 1)
    # distinct words of each document with their counts
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    fresh = np.ones(len(d), dtype=bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(d))).astype(np.float32)
    owner, bucket = d[at], (h[at] % np.uint64(BUCKETS)).astype(np.int64)
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
    value = (value / norm[owner]).astype(np.float32) if len(owner) else value

    sizes = np.diff(words.text_end, prepend=0).astype(np.float64)  # with the blank at the end
    place = np.repeat(np.arange(n), sizes.astype(np.int64))
    kinds = len(_CLASSES) + 1
    share = np.bincount(place * kinds + _CLASS_OF[words.bytes], minlength=n * kinds).reshape(n, kinds) / np.maximum(sizes, 1)[:, None]
    mean = np.bincount(doc, length, minlength=n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(doc, length.astype(np.float64) ** 2, minlength=n) / some - mean ** 2))
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    lines = share[:, list(_CLASSES).index("line")] * sizes + 1
    figures = np.stack([
        np.log1p(count), mean, np.log1p(spread), np.bincount(owner, minlength=n) / some, np.bincount(doc, same, minlength=n) / some,
        top / some, np.log(lines), np.log1p(sizes / lines), np.log1p(np.maximum(chars, 0))], axis=1)
    return Features(owner, bucket, value, np.concatenate([share, figures], axis=1).astype(np.float32))


@dataclass
class FactorisationMachine:
    """Weights of buckets and statistics: ``bias``, ``linear`` and ``factors``; statistics are centred and scaled first."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, feature and value of all inputs: words, then the statistics as features after the buckets."""
        n, k = f.statistics.shape
        figures = np.clip((f.statistics - self.centre) / self.scale, -4, 4) / np.sqrt(k)
        kind = np.int32 if f.bucket.dtype == np.int32 else np.int64  # the sample comes in half the width
        return (np.concatenate([f.doc, np.repeat(np.arange(n, dtype=kind), k)]), np.concatenate([f.bucket, np.tile(BUCKETS + np.arange(k, dtype=kind), n)]),
                np.concatenate([f.value, figures.ravel()]).astype(np.float32))

    def margin(self, n: int, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums v x per document and dimension."""
        out = self.bias + np.bincount(doc, self.linear[feature] * value, minlength=n)
        sums = np.empty((n, self.factors.shape[1]))
        for r in range(self.factors.shape[1]):
            vx = self.factors[:, r][feature] * value
            sums[:, r] = np.bincount(doc, vx, minlength=n)
            out += 0.5 * (sums[:, r] ** 2 - np.bincount(doc, vx * vx, minlength=n))
        return out, sums

    def score(self, f: Features) -> np.ndarray:
        return sigmoid(self.margin(len(f.statistics), *self.inputs(f))[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(f: Features, labels: np.ndarray, seed: int = 11) -> FactorisationMachine:
    """Adagrad over mini-batches; classes weigh the same. Without both classes the score is the share of ones (0.5 without rows)."""
    rng = np.random.default_rng(seed)
    k = len(STATISTICS)
    width = BUCKETS + k
    model = FactorisationMachine(0.0, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), np.zeros(k, np.float32), np.ones(k, np.float32))
    ones = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < ones < 1:
        model.bias = float(np.clip(2 * ones - 1, -1, 1) * 4)
        return model
    model.centre = f.statistics.mean(axis=0)
    model.scale = np.maximum(f.statistics.std(axis=0), 1e-3)
    model.factors = rng.normal(0, 0.02, model.factors.shape).astype(np.float32)
    doc, feature, value = model.inputs(f)
    order = np.argsort(doc, kind="stable")
    doc, feature, value = doc[order], feature[order], value[order]
    start = np.searchsorted(doc, np.arange(len(labels) + 1))
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones))
    g_bias, g_linear, g_factors = 1e-6, np.full(width, 1e-6), np.full(model.factors.shape, 1e-6)
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(labels))
        for at in range(0, len(labels), BATCH):
            rows = shuffled[at: at + BATCH]
            take = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
            own = np.repeat(np.arange(len(rows)), start[rows + 1] - start[rows])
            x, which = value[take], feature[take]
            margin, sums = model.margin(len(rows), own, which, x)
            slope = (sigmoid(margin) - labels[rows]) * weight[rows] / len(rows)
            used, back = np.unique(which, return_inverse=True)
            gx = slope[own] * x
            step = np.bincount(back, gx, minlength=len(used)) + DECAY * model.linear[used]
            g_linear[used] += step ** 2
            model.linear[used] -= (RATE * step / np.sqrt(g_linear[used])).astype(np.float32)
            gx2 = np.bincount(back, gx * x, minlength=len(used))
            for r in range(RANK):
                step = np.bincount(back, gx * sums[own, r], minlength=len(used)) - gx2 * model.factors[used, r] + DECAY * model.factors[used, r]
                g_factors[used, r] += step ** 2
                model.factors[used, r] -= (RATE * 0.3 * step / np.sqrt(g_factors[used, r])).astype(np.float32)
            g_bias += slope.sum() ** 2
            model.bias -= RATE * slope.sum() / np.sqrt(g_bias)
    return model


_FEATURES = "doc_id long, label int, bucket array<int>, value array<float>, statistics array<float>"


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch, "text"):
            f = features(some.column("text"), some.column("chars").to_numpy(zero_copy_only=False))
            at = np.searchsorted(f.doc, np.arange(some.num_rows + 1)).astype(np.int32)
            k = f.statistics.shape[1]
            yield pa.RecordBatch.from_arrays([
                some.column("doc_id"), some.column("label"), pa.ListArray.from_arrays(at, pa.array(f.bucket.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(f.value)),
                pa.ListArray.from_arrays(np.arange(0, k * some.num_rows + 1, k, dtype=np.int32), pa.array(f.statistics.ravel()))],
                names=["doc_id", "label", "bucket", "value", "statistics"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT,
                per_class: int = SAMPLE_PER_CLASS) -> FactorisationMachine:
    """Fit on labelled rows outside the held-out fold; ``per_class`` bounds what comes to the driver."""
    docs = with_chars(docs)
    rows = labelled_sample(docs, labels, label, folds, held_out, per_class, ("chars",)).select("doc_id", "label", "chars", "text")
    got = rows.mapInArrow(_featurise, _FEATURES).toArrow().sort_by("doc_id").combine_chunks()
    if not len(got):
        return train(Features(*(np.zeros(0, np.int64),) * 2, np.zeros(0, np.float32), np.zeros((0, len(STATISTICS)), np.float32)), np.zeros(0))
    lists = got["bucket"].combine_chunks()
    counts = pc.list_value_length(lists).to_numpy()
    f = Features(np.repeat(np.arange(len(got), dtype=np.int32), counts), lists.flatten().to_numpy(), got["value"].combine_chunks().flatten().to_numpy(),
                 got["statistics"].combine_chunks().flatten().to_numpy().reshape(len(got), -1))
    marks = got["label"].to_numpy()
    del got, lists  # the training copies what it sorts
    return train(f, marks)


def with_chars(docs: DataFrame) -> DataFrame:
    """The metadata that is used: the length in characters as the table has it, if it has one."""
    known = F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if "n_chars" in docs.columns else F.lit(0.0)
    return docs.select("doc_id", "text", known.alias("chars"))


def score_quality(docs: DataFrame, model: FactorisationMachine, key: str = "doc_id") -> DataFrame:
    """``doc_id, score``: one row per row of ``docs``. A null text counts as empty; other columns than text and n_chars are no input."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and RANK

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                f = features(some.column("text"), some.column("chars").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sent.value.score(f))], names=["doc_id", "score"])

    return with_chars(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "chars", "text").mapInArrow(stream, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``; a null identifier is in no fold (``held_out`` false).

    ``predicted`` is 1 if the score is at least 0.5. An empty table gives an empty result; without any label the score is 0.5.
    """
    scored = score_quality(docs, fit_quality(docs, labels, "quality", folds, held_out, per_class))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as in score_quality

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                chars = pc.fill_null(some.column("n_chars").cast(pa.float64()), 0.0) if "n_chars" in some.schema.names else pa.array(np.zeros(some.num_rows))
                f = features(some.column("text"), chars.to_numpy(zero_copy_only=False))
                yield some.filter(pa.array(sent.value.score(f) >= threshold))

    return docs.mapInArrow(stream, docs.schema)
