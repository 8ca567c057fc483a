"""Toxicity: a convolutional text classifier with hashed word embeddings.

A word's vector is the sum of rows of hashed tables, one for the word and two for its first letters. Filters of several widths slide over the whole text, each
keeps its largest response, and a logistic layer weighs the responses. All labelled rows take part: Spark counts the buckets' documents by class,
from which the first embedding dimension and filter start (the rest at random); in each round tasks train a net on their rows, and Spark takes the
mean of what they changed; thresholds by language come from Spark's counts of the calibration rows by score. The net's size is fixed by the number of hash buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .labels import labelled_ids
from .quality import sigmoid
from .text import Words, crc_fold, pieces

#: Fold of the identifiers' CRC-32 that never trains, and how many folds there are.
FOLDS, HELD_OUT = 5, 0
#: Up to so many labelled rows all of them train in each of the EPOCHS rounds; above, rounds share the rows out, down to one pass over all.
ROWS_EACH_ROUND = 6000
#: Labels that are broadcast to the texts at once; more take the join that Spark chooses.
BROADCAST_LABELS = 5_000_000
#: Scores are counted in so many steps of their log-odds, which are between -30 and 30.
SCORE_STEPS = 1 << 16
WORD_BUCKETS, HEAD_BUCKETS, HEAD_BYTES, DIM = 1 << 18, 1 << 16, (4, 6), 8
WIDTHS, FILTERS, EPOCHS, BATCH, RATE = (1, 2, 3), 8, 5, 32, 0.05
#: One of so many labelled rows is kept from the trial net; thresholds are calibrated on it, the common one if it has so many rows of either class.
CALIBRATION, LEAST_CALIBRATION = 5, 5
TABLES = 1 + len(HEAD_BYTES)
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:!?\"'()[]")] = True


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and for each word its buckets, one per table; punctuation at a word's end is left out."""
    words = Words(texts)
    start, end = words.start, words.end.copy()
    for _ in range(3):
        cut = (end - start > 1) & _PUNCTUATION[words.bytes[end - 1]]
        end[cut] -= 1
    whole = words.span_hashes(start, end) % np.uint64(WORD_BUCKETS)
    heads = [words.span_hashes(start, np.minimum(end, start + n)) % np.uint64(HEAD_BUCKETS) for n in HEAD_BYTES]
    return words.counts, np.stack([whole, *heads], axis=1).astype(np.int32)


@dataclass
class TextNet:
    """Embeddings (0: words, then heads), filters by width as (width, DIM, FILTERS), their biases, and the logistic layer."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def embed(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all words with room between texts for the widest filter, and where each text begins."""
        gap = WIDTHS[-1]
        begin = np.cumsum(counts + gap) - counts - gap
        place = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(len(codes))
        x = np.zeros((int((counts + gap).sum()), DIM), dtype=np.float32)
        x[place] = sum(table[column] for table, column in zip(self.tables, codes.T))
        return x, begin

    def responses(self, x: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """For each width the filters' sums at every place; beyond a text's end the vectors are zero."""
        out = []
        for w, filters in zip(WIDTHS, self.filters):
            sums = x @ filters[0]
            for j in range(1, w):
                sums[:-j] += x[j:] @ filters[j]
            for j in range(1, w):
                sums[begin[1:] - j] = 0  # would look into the next text
            out.append(sums)
        return out

    def pooled(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        sums = self.responses(x, begin)
        top = np.concatenate([np.maximum.reduceat(s, begin, axis=0) + b for s, b in zip(sums, self.biases)], axis=1)
        return np.maximum(top, 0), sums

    def score(self, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        top, _ = self.pooled(*self.embed(codes, counts))
        return sigmoid((top @ self.weights).astype(np.float64) + self.bias)


def _start(rng: np.random.Generator) -> TextNet:
    tables = [rng.normal(0, 0.05, (n, DIM)).astype(np.float32) for n in (WORD_BUCKETS, *(HEAD_BUCKETS for _ in HEAD_BYTES))]
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    return TextNet(tables, filters, biases, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


#: First rows of the tables, one below the other; the other parameters follow, DIM a row, then their accumulators.
_OFFSETS = np.cumsum([0, WORD_BUCKETS, *(HEAD_BUCKETS for _ in HEAD_BYTES)])


class Learner:
    """A net and the accumulators of Adagrad, one for each row of the tables."""

    def __init__(self, net: TextNet):
        self.net = net
        self.g_tables = [np.full((len(t), 1), 1e-4, np.float32) for t in net.tables]
        self.g_filters, self.g_biases = [np.full(f.shape, 1e-4) for f in net.filters], [np.full(b.shape, 1e-4) for b in net.biases]
        self.g_weights, self.g_bias = np.full(net.weights.shape, 1e-4), 1e-4

    def state(self) -> np.ndarray:
        """All numbers as rows of DIM and an accumulator."""
        net, plain = self.net, lambda *parts: np.concatenate([np.ravel(x) for x in parts])
        small = np.concatenate([plain(*net.filters, *net.biases, net.weights, net.bias), plain(*self.g_filters, *self.g_biases, self.g_weights, self.g_bias)])
        rest = np.zeros((-(-len(small) // DIM), DIM + 1), np.float32)
        padded = np.zeros(len(rest) * DIM, np.float32)
        padded[: len(small)] = small
        rest[:, :DIM] = padded.reshape(-1, DIM)
        return np.concatenate([*(np.concatenate([t, g], axis=1) for t, g in zip(net.tables, self.g_tables)), rest])

    def load(self, state: np.ndarray) -> None:
        for t, (low, high) in enumerate(zip(_OFFSETS, _OFFSETS[1:])):
            self.net.tables[t], self.g_tables[t] = state[low:high, :DIM].copy(), state[low:high, DIM:].copy()
        small, at = state[_OFFSETS[-1]:, :DIM].ravel(), 0
        for filters, biases, weights in ((self.net.filters, self.net.biases, self.net.weights), (self.g_filters, self.g_biases, self.g_weights)):
            for x in (*filters, *biases, weights):
                x[...] = small[at: at + x.size].reshape(x.shape)
                at += x.size
            if weights is self.net.weights:
                self.net.bias = float(small[at])
            else:
                self.g_bias = float(small[at])
            at += 1

    def learn(self, counts: np.ndarray, codes: np.ndarray, labels: np.ndarray, ones: float, rate: float) -> None:
        """A pass over the rows in mini-batches of whole texts; the classes, with this share of ones, weigh the same."""
        first = np.cumsum(counts) - counts
        shuffled = np.random.default_rng(len(labels)).permutation(len(labels))
        for at in range(0, len(shuffled), BATCH):
            rows = shuffled[at: at + BATCH]
            words = codes[np.concatenate([np.arange(first[r], first[r] + counts[r]) for r in rows])]
            self._step(counts[rows], words, labels[rows], np.where(labels[rows] == 1, 0.5 / ones, 0.5 / (1 - ones)), rate)

    def _step(self, n: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        net = self.net
        x, begin = net.embed(words, n)
        top, sums = net.pooled(x, begin)
        slope = (sigmoid(top @ net.weights + net.bias) - y) * weight / len(y)
        back = np.outer(slope, net.weights) * (top > 0)
        step = top.T @ slope + 1e-4 * net.weights
        self.g_weights += step ** 2
        net.weights -= (rate * step / np.sqrt(self.g_weights)).astype(np.float32)
        self.g_bias += slope.sum() ** 2
        net.bias -= rate * slope.sum() / np.sqrt(self.g_bias)
        gx = np.zeros_like(x)
        end = np.append(begin[1:], len(x))
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS: (k + 1) * FILTERS]
            # only the place of the largest response passes anything back
            place = np.stack([a + sums[k][a:b].argmax(axis=0) for a, b in zip(begin, end)])
            gf = np.zeros(net.filters[k].shape)
            for j in range(w):
                seen = np.minimum(place + j, len(x) - 1)
                gf[j] = np.einsum("df,dfe->ef", g, x[seen])
                np.add.at(gx, seen.ravel(), (g[:, :, None] * net.filters[k][j].T[None]).reshape(-1, DIM))
            self.g_filters[k] += gf ** 2
            net.filters[k] -= (rate * gf / np.sqrt(self.g_filters[k])).astype(np.float32)
            gb = g.sum(axis=0)
            self.g_biases[k] += gb ** 2
            net.biases[k] -= (rate * gb / np.sqrt(self.g_biases[k])).astype(np.float32)
        place = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(words))
        moved = np.flatnonzero(np.abs(gx[place]).sum(axis=1) > 0)
        for t in range(len(net.tables)):
            used, which = np.unique(words[moved, t], return_inverse=True)
            total = np.zeros((len(used), DIM), np.float32)
            np.add.at(total, which, gx[place[moved]])
            self.g_tables[t][used] += (total ** 2).mean(axis=1, keepdims=True)
            net.tables[t][used] -= rate * total / np.sqrt(self.g_tables[t][used])


def _first_net(ones: np.ndarray, zeros: np.ndarray, n_ones: int, n_zeros: int, seed: int = 5) -> TextNet:
    """The net before training, from the documents of each class that hold a bucket. Without both classes the score is constant."""
    net = _start(np.random.default_rng(seed))
    if not n_ones or not n_zeros:
        net.weights[:] = 0
        net.bias = 4.0 if n_ones else -4.0 if n_zeros else 0.0
        return net
    odds = np.log((ones + 2) / (n_ones + 4)) - np.log((zeros + 2) / (n_zeros + 4))  # buckets seen in few documents stay near 0
    for table, low, high in zip(net.tables, _OFFSETS, _OFFSETS[1:]):
        table[:, 0] = 0.8 / len(net.tables) * np.clip(odds[low:high], -4, 4)
    net.filters[0][0, :, 0] = 0
    net.filters[0][0, 0, 0] = 1
    net.weights[0] = 0.5
    return net


def best_cut(step: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> float | None:
    """The log-odds in the middle of the gap at which the F1 measure is highest; rows and ones are counted by step. None without both classes."""
    if not 0 < ones.sum() < rows.sum():
        return None
    order = np.argsort(-step)
    step, ones, rows = step[order], ones[order], rows[order]
    k = int(np.argmax(2 * np.cumsum(ones) / (np.cumsum(rows) + ones.sum())))
    below = step[k + 1] + 1 if k + 1 < len(step) else 0
    return float((step[k] + below) / 2 * (60 / SCORE_STEPS) - 30)


def _texts(docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """``label, lang, apart, text`` of all rows of ``labels`` (doc_id, text_hash, label)."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == CALIBRATION - 1
    return rows.join(F.broadcast(labels) if n <= BROADCAST_LABELS else labels, ["doc_id", "text_hash"]).select("label", "lang", apart.alias("apart"), "text")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for some in pieces(batch, "text"):
            yield *word_buckets(some.column("text")), some.column("label").to_numpy(), some.column("apart").to_numpy(zero_copy_only=False)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a slot (a row of the tables; last, any) by class, and those outside the calibration rows."""
    held = np.zeros((int(_OFFSETS[-1]) + 1, 4), np.int64)
    for counts, codes, y, apart in _coded(batches):
        kind = np.where(apart, 2, 0) + y
        held[-1] += np.bincount(kind, minlength=4)
        doc = np.repeat(np.arange(len(counts)), counts)
        for t, low in enumerate(_OFFSETS[:-1]):
            pairs = np.unique(doc * WORD_BUCKETS + codes[:, t])
            np.add.at(held, (low + pairs % WORD_BUCKETS, kind[pairs // WORD_BUCKETS]), 1)
    slots = np.flatnonzero(held.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(slots), *(pa.array(held[slots, k]) for k in range(4))], names=["slot", "k0", "k1", "k2", "k3"])


_CHANGES = "net int, slot long, " + ", ".join(f"d{k} float" for k in range(DIM + 1))


def _round(rows: DataFrame, learners: list[Learner], shares: list[float], rate: float) -> None:
    """Tasks train copies of both nets, the first without calibration rows; each number takes the mean change of the tasks that changed its row."""
    sent = rows.sparkSession.sparkContext.broadcast(learners)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for counts, codes, y, apart in _coded(batches):
            if own is None:
                own = [Learner(_start(np.random.default_rng(0))) for _ in sent.value]
                for mine, given in zip(own, sent.value):
                    mine.load(given.state())
            keep = ~apart
            own[0].learn(counts[keep], codes[np.repeat(keep, counts)], y[keep], shares[0], rate)
            own[1].learn(counts, codes, y, shares[1], rate)
        for k, mine in enumerate(own or ()):
            change = mine.state() - sent.value[k].state()
            slots = np.flatnonzero(change.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), k, np.int32)), pa.array(slots), *(pa.array(change[slots, d]) for d in range(DIM + 1))],
                                             names=["net", "slot", *(f"d{d}" for d in range(DIM + 1))])

    names = [f"d{d}" for d in range(DIM + 1)]
    mean = rows.mapInArrow(stream, _CHANGES).groupBy("net", "slot").agg(*(F.avg(c).cast("float").alias(c) for c in names)).toArrow()  # as many rows as the nets have
    for k, learner in enumerate(learners):
        here = mean.filter(pc.equal(mean["net"], k))
        state = learner.state()
        state[here["slot"].to_numpy()] += np.stack([here[c].to_numpy() for c in names], axis=1)
        learner.load(state)
    sent.unpersist()


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT) -> TextNet:
    """Fit and calibrate on all labelled rows outside the held-out fold. What comes to the driver is as large as the net."""
    chosen = cut(labelled_ids(docs, labels, label, folds, held_out))
    n = chosen.count()
    got = _texts(docs, chosen, n).mapInArrow(_class_counts, "slot long, k0 long, k1 long, k2 long, k3 long").groupBy("slot").agg(*(F.sum(f"k{k}").alias(f"k{k}") for k in range(4))).toArrow()
    held = np.zeros((int(_OFFSETS[-1]) + 1, 4), np.int64)
    held[got["slot"].to_numpy()] = np.stack([got[f"k{k}"].to_numpy() for k in range(4)], axis=1)
    learners, shares = [], []
    for zeros, ones in ((held[:, 0], held[:, 1]), (held[:, 0] + held[:, 2], held[:, 1] + held[:, 3])):
        learners.append(Learner(_first_net(ones[:-1], zeros[:-1], int(ones[-1]), int(zeros[-1]))))
        shares.append(float(ones[-1] / max(1, ones[-1] + zeros[-1])))
    trial, net = (x.net for x in learners)
    if not 0 < shares[1] < 1:
        return net
    if not 0 < shares[0] < 1:  # only calibration rows have one of the classes: there is nothing to calibrate with
        learners[0], shares[0] = Learner(_start(np.random.default_rng(5))), 0.5
    parts = min(EPOCHS, max(1, n // ROWS_EACH_ROUND))
    rounds = parts * -(-EPOCHS // parts)
    for k in range(rounds):
        own = chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(parts)) == k % parts)
        _round(_texts(docs, own, -(-n // parts)), learners, shares, RATE / (1 + k * EPOCHS / rounds))
    # one net is calibrated on rows it has not seen; the other, trained alike on all of them, takes its thresholds over
    trial, net = (x.net for x in learners)
    sent = docs.sparkSession.sparkContext.broadcast(trial)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                score = sent.value.score(*word_buckets(some.column("text")))
                at = np.floor((np.log(score) - np.log1p(-score) + 30) * (SCORE_STEPS / 60)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([some.column("lang"), pa.array(at), some.column("label")], names=["lang", "step", "label"])

    apart = _texts(docs, chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == CALIBRATION - 1), n)
    scored = apart.mapInArrow(steps, "lang string, step long, label int").groupBy("lang", "step").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("rows")).toArrow()
    lang, step, ones, rows = np.array(scored["lang"].to_pylist(), dtype=object), *(scored[c].to_numpy() for c in ("step", "ones", "rows"))
    shift = 0.0
    values, which = np.unique(step, return_inverse=True)
    found = best_cut(values, np.bincount(which, ones), np.bincount(which, rows))
    if found is not None and min(ones.sum(), (rows - ones).sum()) >= LEAST_CALIBRATION:
        shift = found  # the common threshold becomes 0.5
        net.bias -= shift
    for name in sorted({x for x in lang if x is not None}):
        own = lang == name
        if (found := best_cut(step[own], ones[own], rows[own])) is not None:
            net.thresholds[name] = float(sigmoid(found - shift))
    return net


def score_toxicity(docs: DataFrame, net: TextNet, key: str = "doc_id") -> DataFrame:
    """``doc_id, lang, score``: one row per row of ``docs``. A null text counts as empty; the text is the score's only input."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by the buckets and DIM

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("lang"), pa.array(sent.value.score(*word_buckets(some.column("text"))))], names=["doc_id", "lang", "score"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), lang.alias("lang"), "text").mapInArrow(stream, "doc_id long, lang string, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged``: one row per row of ``docs``; a null identifier is in no fold.

    ``predicted`` is 1 if the score is at least 0.5; ``flagged`` compares it with the threshold of the row's language, or the common one where
    a language had no calibration rows of both classes. An empty table gives an empty result; without labels the score is 0.5.
    """
    net = fit_toxicity(docs, labels, "toxic", folds, held_out)
    limit = F.lit(net.threshold)
    for name, value in net.thresholds.items():
        limit = F.when(F.col("lang") == name, F.lit(value)).otherwise(limit)
    return score_toxicity(docs, net).select(
        "doc_id", F.coalesce(crc_fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
