"""Hard-negative mining with an inverted multi-index.

Vectors are cut in two halves; each half has a codebook of its own, and a pair of codewords is a cell. For an anchor, the score that a row of a cell can have
lies between bounds that are sums over the halves: codeword times anchor, plus and minus the codeword's radius times the anchor's norm. A heap
walks the two sorted lists of half bounds and gives cells by falling bound (multi-sequence). A first walk takes cells until they hold enough rows; what
is found there certifies a window of scores, and a second walk goes on until the bound leaves that window. So results are exact: the
codebooks, fitted on a bounded sample, decide only how much is visited.

Rows stay in Spark: blocks of a cell meet the anchors that visit it in one group, and only the best of each block and anchor leave it. Cells of any size
are split into blocks by a hash, and anchors into slices.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Components are floor(GRID * x); larger ones than LARGEST count as not finite.
GRID, LARGEST = 256, float(1 << 22)
#: Codewords of a half, sampled rows they are fitted on, and rounds of fitting.
CODEWORDS, SAMPLE, ROUNDS = 12, 4096, 12
#: Rows of a block, anchors of a slice, rows that the first walk takes, and anchors that are scored at once.
BLOCK_ROWS, SLICE_ANCHORS, FIRST_ROWS, ANCHORS_AT_ONCE = 4096, 16_384, 2048, 256
_ROW = "uid long, id long, label long, q binary, cell int, r0 double, r1 double"


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST)), F.lit(False))


def _quantised(vectors: pa.Array, width: int) -> np.ndarray:
    return np.floor(GRID * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, width)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).reshape(-1, width)


def codebook(x: np.ndarray, words: int, seed: int = 7) -> np.ndarray:
    """At most ``words`` centres by Lloyd's rounds; centres that lose all rows go."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:words]].astype(np.float64)
    for _ in range(ROUNDS):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


@dataclass
class MultiIndex:
    """Codebooks and radii of the two halves, and how many rows each cell holds; all of a size fixed by CODEWORDS."""

    width: int
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray

    @property
    def halves(self) -> tuple[slice, slice]:
        return slice(0, self.width // 2), slice(self.width // 2, self.width)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of each row, and its distances to the codewords of the two halves."""
        found = [nearest(x[:, h], c) for h, c in zip(self.halves, self.centres)]
        far = [np.linalg.norm(x[:, h] - c[of], axis=1) for h, c, of in zip(self.halves, self.centres, found)]
        return found[0] * len(self.centres[1]) + found[1], far

    def bounds(self, anchor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Lower and upper half bounds of each codeword for the anchor, a little wide so that rounding cannot matter."""
        low, high = [], []
        for h, c, r in zip(self.halves, self.centres, self.radii):
            reach = np.linalg.norm(anchor[h]) * r
            middle, slack = c @ anchor[h], 1e-9 * (np.linalg.norm(anchor[h]) * (np.linalg.norm(c, axis=1) + r)) + 1e-6
            low.append(middle - reach - slack)
            high.append(middle + reach + slack)
        return low, high

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """Cells with rows as (cell, lower, upper bound), by falling upper bound."""
        low, high = self.bounds(anchor)
        order = [np.argsort(-h, kind="stable") for h in high]
        sums = lambda i, j: -(high[0][order[0][i]] + high[1][order[1][j]])
        heap, taken = [(sums(0, 0), 0, 0)], np.zeros((len(order[0]) + 1, len(order[1]) + 1), dtype=bool)
        taken[-1] = taken[:, -1] = True  # what is before the first row and column
        while heap:
            bound, i, j = heapq.heappop(heap)
            taken[i, j] = True
            a, b = int(order[0][i]), int(order[1][j])
            cell = a * len(order[1]) + b
            if self.rows[cell]:
                yield cell, low[0][a] + low[1][b], -bound
            # a pair enters when both its predecessors are out
            if i + 1 < len(order[0]) and taken[i + 1, j - 1]:
                heapq.heappush(heap, (sums(i + 1, j), i + 1, j))
            if j + 1 < len(order[1]) and taken[i - 1, j + 1]:
                heapq.heappush(heap, (sums(i, j + 1), i, j + 1))

    def first(self, anchor: np.ndarray, high: float) -> list[int]:
        """Cells of the first walk: of those that can hold scores up to ``high``, until they hold FIRST_ROWS rows."""
        found, rows = [], 0
        for cell, low, _ in self.walk(anchor):
            if low <= high:
                found.append(cell)
                rows += self.rows[cell]
                if rows >= FIRST_ROWS:
                    break
        return found

    def rest(self, anchor: np.ndarray, windows: list[tuple[float, float]]) -> list[int]:
        """The other cells that can hold a score of one of the windows (closed)."""
        if not windows:
            return []
        seen = set(self.first(anchor, max(h for _, h in windows)))
        found, least = [], min(l for l, _ in windows)
        for cell, low, high in self.walk(anchor):
            if high < least:
                break
            if cell not in seen and any(low <= h and high >= l for l, h in windows):
                found.append(cell)
        return found


def fit_index(rows: DataFrame, width: int) -> tuple[MultiIndex, DataFrame]:
    """The index and all rows with their cells; ``rows``: uid, id, label, vector."""
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("vector").toArrow()
    x = _quantised(sample.column("vector").combine_chunks(), width)
    index = MultiIndex(width, (np.zeros((0, 0)),) * 2, (np.zeros(0),) * 2, np.zeros(0, np.int64))
    index.centres = tuple(codebook(x[:, h], CODEWORDS) for h in index.halves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _quantised(batch.column("vector"), width)
            cell, far = index.cells(q)
            data = q.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in data], pa.binary()), pa.array(cell.astype(np.int32)), *map(pa.array, far)],
                names=["uid", "id", "label", "q", "cell", "r0", "r1"])

    placed = cut(rows.mapInArrow(place, _ROW))
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max("r0").alias("r0"), F.max("r1").alias("r1")).collect()  # CODEWORDS ** 2 rows at most
    n = [len(c) for c in index.centres]
    index.radii, index.rows = (np.zeros(n[0]), np.zeros(n[1])), np.zeros(n[0] * n[1], np.int64)
    for r in counted:
        index.rows[r.cell] = r.m
        for half, (at, far) in enumerate(((r.cell // n[1], r.r0), (r.cell % n[1], r.r1))):
            index.radii[half][at] = max(index.radii[half][at], far)
    return index, placed


_REQUEST = "anchor long, label long, q binary, windows array<struct<w:int,low:double,high:double>>, cell int, parts int"


def _visits(index: MultiIndex, again: bool):
    """Requests of anchors: one per anchor and cell that it visits."""
    parts = -(-index.rows // BLOCK_ROWS)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), index.width).astype(np.float64)
            found = []
            for k, windows in enumerate(batch.column("windows").to_pylist()):
                if windows:
                    wanted = [(w["low"], w["high"]) for w in windows]
                    found.append(index.rest(q[k], wanted) if again else index.first(q[k], max(h for _, h in wanted)))
                else:
                    found.append([])
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            cell = np.array([c for f in found for c in f], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(of) for c in ("anchor", "label", "q", "windows")), pa.array(cell), pa.array(parts[cell].astype(np.int32))],
                names=["anchor", "label", "q", "windows", "cell", "parts"])
    return stream


_FOUND = "anchor long, w int, score long, uid long, id long"


def _scored(width: int, same_label: bool, most: int):
    """The best ``most`` rows of a block for each anchor and window: scores in the window, ties by smaller id."""

    def score(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        uid, ids, label = (rows.column(c).to_numpy() for c in ("uid", "id", "label"))
        anchor, own = asked.column("anchor").to_numpy(), asked.column("label").to_numpy()
        windows = asked.column("windows").to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        if len(uid) and len(anchor):
            x, a = _matrix(rows.column("q"), width), _matrix(asked.column("q"), width)
            # exact in double precision if no sum can pass 2 ** 53
            kind = np.float64 if float(np.abs(x.astype(np.int64)).max(initial=0)) * float(np.abs(a.astype(np.int64)).max(initial=0)) * width < 2.0 ** 53 else np.int64
            x = x.astype(kind).T
            for at in range(0, len(a), ANCHORS_AT_ONCE):
                scores = a[at: at + ANCHORS_AT_ONCE].astype(kind) @ x
                for k, s in enumerate(scores, start=at):
                    fit = ((label == own[k]) & (uid != anchor[k])) if same_label else label != own[k]
                    fit &= (s >= min(w["low"] for w in windows[k])) & (s <= max(w["high"] for w in windows[k]))
                    rest = np.flatnonzero(fit)
                    rest = rest[np.lexsort((uid[rest], ids[rest], -s[rest]))]
                    value = s[rest]
                    for w in windows[k]:
                        first = int(np.searchsorted(-value, -w["high"]))
                        last = min(first + most, int(np.searchsorted(-value, -w["low"], side="right")))
                        if last > first:
                            chosen = rest[first:last]
                            for held, x_ in zip(out, (np.full(len(chosen), anchor[k]), np.full(len(chosen), w["w"]), s[chosen], uid[chosen], ids[chosen])):
                                held.append(x_)
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int64)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *h]).astype(t)) for h, t in zip(out, kinds)], names=["anchor", "w", "score", "uid", "id"])

    return score


def _best(found: DataFrame, most: int) -> DataFrame:
    """With ``rank`` from 1 in each anchor's window."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _search(index: MultiIndex, placed: DataFrame, anchors: DataFrame, slices: int, same_label: bool, most: int) -> DataFrame:
    """``anchor, w, score, uid, id, rank``: the best rows of all for each anchor and window; ``anchors``: anchor, label, q, windows."""
    parts = F.create_map(*(F.lit(int(x)) for c in np.flatnonzero(index.rows) for x in (c, -(-index.rows[c] // BLOCK_ROWS))))
    blocks = placed.select("uid", "id", "label", "q", "cell", F.pmod(F.xxhash64("uid"), parts[F.col("cell")]).cast("int").alias("part"),
                           F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    where = ["cell", "part", "slice"]

    def visit(them: DataFrame, again: bool) -> DataFrame:
        asked = them.select("anchor", "label", "q", "windows").mapInArrow(_visits(index, again), _REQUEST)
        asked = asked.select("anchor", "label", "q", "windows", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("anchor"), F.lit(slices)).cast("int").alias("slice"))
        return cut(blocks.groupBy(*where).cogroup(asked.groupBy(*where)).applyInArrow(_scored(index.width, same_label, most), _FOUND))

    first = visit(anchors, False)
    # the last of a full window certifies that nothing below it is needed
    last = _best(first, most).filter(F.col("rank") == most).select("anchor", F.struct("w", F.col("score").cast("double").alias("low")).alias("c"))
    certified = last.groupBy("anchor").agg(F.map_from_entries(F.collect_list("c")).alias("least"))  # one entry a window
    narrow = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["low"], F.coalesce(F.element_at("least", w["w"]), w["low"])).alias("low"), w["high"].alias("high")))
    second = visit(anchors.join(certified, "anchor", "left").withColumn("windows", narrow), True)
    return cut(_best(first.unionByName(second), most))


def mine_hard_negatives(docs: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                        positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of the components floor(256 x). An anchor's positives are its ``positives`` best other rows of its label; for each, ``rank`` counts the
    best ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive. Ties go to the smaller identifier. Rows with a null identifier,
    label or vector, with null or non-finite components, or of another length than the commonest (the longest of these) take no part. Rows
    that repeat are rows of their own: each is an anchor, a positive, a negative. ``is_anchor`` is a condition on the columns of ``docs``; other columns are not read. Anchors without a
    positive, and positives without a negative, have no rows; so has an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("is_anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("width")).first()
    if widths is None:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return docs.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == widths.width)
    index, placed = fit_index(rows.select("uid", "id", "label", "vector"), widths.width)
    chosen = placed.join(rows.filter("is_anchor").select("uid"), "uid", "left_semi")
    anchors = cut(chosen.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"), "label", "q"))
    slices = max(1, -(-anchors.count() // SLICE_ANCHORS))
    window = lambda w, l, h: F.struct(F.lit(w).cast("int").alias("w") if isinstance(w, int) else w.alias("w"), l.cast("double").alias("low"), h.cast("double").alias("high"))
    anywhere = window(0, F.lit(float("-inf")), F.lit(float("inf")))
    good = _search(index, placed, anchors.withColumn("windows", F.array(anywhere)), slices, True, positives)
    good = good.select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    whole = lambda x: (x - F.pmod(x, F.lit(100))) / 100  # noqa: E731  rounded down; a double holds it
    asked = good.select("anchor", window(F.col("w"), -whole(-p * low), whole(p * high)).alias("x")).filter("x.low <= x.high")
    windows = asked.groupBy("anchor").agg(F.collect_list("x").alias("windows"))  # one entry a positive
    bad = _search(index, placed, anchors.join(windows, "anchor"), slices, False, negatives)
    return (
        bad.join(good, ["anchor", "w"]).join(anchors.select("anchor", "anchor_id"), "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
