"""Search for shapes in series: distances, non-overlapping matches, features.

Series are cut into blocks of positions; a block also gets the few rows after it, so every window
lies whole in one block. Blocks have a fixed size, however long the series is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import template, z_normalised
from ..plans.lineage import cut
from ..plans.positions import with_position
from .temporal import within

BLOCK = 4096
#: Values of windows that are copied at a time, and windows of a series that are ranked together first.
COPIED, STRETCH = 1_000_000, 65_536
#: Distance that counts as no match by default, and distance of zero similarity.
POOR_MATCH, ZERO_SIMILARITY = 3.0, 4.0
#: Fixed value: relative error up to which a window feature matches.
FEATURE_TOLERANCE = 0.2


def pattern_values(pattern) -> list[float]:
    return template(pattern) if isinstance(pattern, str) else [float(v) for v in pattern]


def _in_blocks(positions: DataFrame, length: int) -> DataFrame:
    """Copy each row into its block and into the blocks whose last windows reach it."""
    first = F.floor(F.greatest(F.lit(0), F.col("idx") - (length - 1)) / BLOCK)
    return positions.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("idx") / BLOCK))))


def window_distances(m: DataFrame, pattern, normalize: bool = True) -> DataFrame:
    """Distance of every window to the pattern: ``ts_id, idx, start_ts, end_ts, distance``."""
    target = pattern_values(pattern)
    length = len(target)
    target = np.array(z_normalised(target) if normalize else target)

    @F.pandas_udf("array<double>")
    def distances(blocks: pd.Series) -> pd.Series:
        def one(values):
            if len(values) < length:
                return []
            windows = np.lib.stride_tricks.sliding_window_view(np.asarray(values, dtype=float), length)
            out = np.empty(len(windows))
            at_once = max(1, COPIED // length)  # windows are views; only so many are copied at a time
            for at in range(0, len(windows), at_once):
                w = windows[at: at + at_once]
                if normalize:
                    std = w.std(axis=1, keepdims=True)
                    w = (w - w.mean(axis=1, keepdims=True)) / np.where(std == 0, 1.0, std)
                out[at: at + at_once] = np.sqrt(((w - target) ** 2).sum(axis=1))
            return out
        return blocks.map(one)

    rows = _in_blocks(with_position(m, ["ts_id"], "ts"), length)
    blocks = rows.groupBy("ts_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("idx", "ts", "value"))).alias("r"))  # at most BLOCK + length rows
    return (
        blocks.select("ts_id", F.col("r.idx").alias("i"), F.col("r.ts").alias("t"), distances("r.value").alias("d"))
        .select("ts_id", "i", "t", F.posexplode("d").alias("at", "distance"))
        .select("ts_id", F.element_at("i", F.col("at") + 1).alias("idx"),
                F.element_at("t", F.col("at") + 1).alias("start_ts"),
                F.element_at("t", F.col("at") + length).alias("end_ts"), "distance")
    )


def best_without_overlap(windows: DataFrame, score: str, reach: int, top_k: int) -> DataFrame:
    """The best ``top_k`` windows of each series, none within ``reach`` positions of a better one.

    A chosen window rules out at most ``2 * reach + 1`` windows, so the choice only ever looks at that many of the best
    per pick. Ranks are taken in stretches of a series first, so no task sorts a whole long series.
    """
    needed = (top_k - 1) * (2 * reach + 1) + 1
    others = [c for c in windows.columns if c not in ("ts_id", "idx", score)]
    candidates = windows.withColumn("_stretch", F.floor(F.col("idx") / max(STRETCH, 4 * needed)))
    for keys in (["ts_id", "_stretch"], ["ts_id"]):
        best_first = Window.partitionBy(*keys).orderBy(score, "idx")
        candidates = candidates.withColumn("_rank", F.row_number().over(best_first)).filter(F.col("_rank") <= needed)
    row = F.struct(F.col(score).alias("s"), "idx", *others)
    per_series = candidates.groupBy("ts_id").agg(F.array_sort(F.collect_list(row)).alias("c"))  # at most ``needed`` windows

    def take(chosen, c):
        free = ~F.exists(chosen, lambda o: F.abs(o["idx"] - c["idx"]) <= reach)
        return F.when((F.size(chosen) < top_k) & free, F.concat(chosen, F.array(c))).otherwise(chosen)

    none = F.filter("c", lambda c: F.lit(False))
    chosen = per_series.select("ts_id", F.posexplode(F.aggregate("c", none, take)).alias("rank", "w"))
    return chosen.select("ts_id", "w.idx", F.col("w.s").alias(score), *[f"w.{c}" for c in others], (F.col("rank") + 1).alias("rank"))


def all_without_overlap(windows: DataFrame, score: str, reach: int, block: int | None = None) -> DataFrame:
    """Every window, best first, unless it lies within ``reach`` of an already chosen one.

    Whether a window is chosen depends only on better windows near it. Each round settles, in
    blocks with a margin, all windows whose better neighbours are settled; blocks shift by half
    between rounds so that those left at a border are inside the next time.
    """
    block = block or max(64 * reach, 65536)
    state = cut(windows.select("ts_id", "idx", F.col(score).cast("double").alias("s"), F.lit(0).alias("state")))
    round_no = 0
    while True:
        shift = (round_no % 2) * (block // 2)
        home = F.floor((F.col("idx") + shift) / block)
        around = F.sequence(F.floor((F.col("idx") + shift - reach) / block), F.floor((F.col("idx") + shift + reach) / block))
        spread = state.withColumn("home", home).withColumn("b", F.explode(around))

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            low, high = pdf.b.iloc[0] * block - shift - reach, (pdf.b.iloc[0] + 1) * block - shift + reach
            pdf = pdf.sort_values("idx", ignore_index=True)
            idx, state, s = pdf.idx.to_numpy(), pdf.state.to_numpy().copy(), pdf.s.to_numpy()
            for r in np.lexsort((idx, s)):
                if state[r] != 0:
                    continue
                a, z = np.searchsorted(idx, idx[r] - reach), np.searchsorted(idx, idx[r] + reach, "right")
                near = state[a:z]
                if (near == 1).any():
                    state[r] = 2
                    continue
                better = (s[a:z] < s[r]) | ((s[a:z] == s[r]) & (idx[a:z] < idx[r]))
                if low <= idx[r] - reach and idx[r] + reach < high and not (better & (near == 0)).any():
                    state[r] = 1
            return pdf.assign(state=state)[pdf.b == pdf.home][["ts_id", "idx", "s", "state"]]

        state = cut(spread.groupBy("ts_id", "b").applyInPandas(settle, "ts_id string, idx long, s double, state int")
                    .filter(F.col("state") < 2))
        round_no += 1
        if state.filter(F.col("state") == 0).isEmpty():
            break
    return windows.join(state.select("ts_id", "idx"), ["ts_id", "idx"])


def similarity(distance) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - distance / ZERO_SIMILARITY)))


def find_pattern(m: DataFrame, pattern, top_k: int = 5, threshold: float | None = None, mode: str = "topk",
                 exclusion_zone: int | None = None, normalize: bool = True, time_window: tuple | None = None) -> DataFrame:
    """Non-overlapping matches: ``ts_id, idx, start_ts, end_ts, distance, similarity``."""
    values = pattern_values(pattern)
    if time_window:
        m = within(m, *time_window)
    windows = window_distances(m, values, normalize)
    gap = len(values) // 2 if exclusion_zone is None else exclusion_zone
    reach = len(values) - 1 + gap
    if mode == "topk":
        matches = best_without_overlap(windows, "distance", reach, top_k).drop("rank")
    elif mode == "threshold":
        if threshold is not None:
            windows = windows.filter(F.col("distance") <= threshold)
        matches = all_without_overlap(windows, "distance", reach)
    else:
        raise ValueError("mode is 'topk' or 'threshold'")
    return matches.withColumn("similarity", similarity(F.col("distance")))


def match_summary(matches: DataFrame, m: DataFrame) -> DataFrame:
    """Frequency, frequency per day, best and worst match of each series with a match."""
    span = m.groupBy("ts_id").agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000).alias("days"))
    found = matches.groupBy("ts_id").agg(
        F.count(F.lit(1)).alias("frequency"), F.min("distance").alias("best_distance"),
        F.max("distance").alias("worst_distance"), F.min_by("start_ts", "distance").alias("best_start"),
        F.max_by("start_ts", "distance").alias("worst_start"),
    )
    return found.join(span, "ts_id").withColumn(
        "per_day", F.when(F.col("days") > 0, F.col("frequency") / F.col("days")).otherwise(0.0))


def contains_pattern(m: DataFrame, pattern, threshold: float | None = None, normalize: bool = True) -> DataFrame:
    """Series whose best window lies within the threshold."""
    limit = POOR_MATCH if threshold is None else threshold
    best = window_distances(m, pattern, normalize).groupBy("ts_id").agg(F.min("distance").alias("best_distance"))
    return best.filter(F.col("best_distance") <= limit)


def window_features(m: DataFrame, length: int, names: list[str]) -> DataFrame:
    rows = _in_blocks(with_position(m, ["ts_id"], "ts"), length)
    over = Window.partitionBy("ts_id", "block").orderBy("idx").rowsBetween(0, length - 1)
    stats = {
        "mean": F.avg("value").over(over), "std": F.stddev_pop("value").over(over),
        "min": F.min("value").over(over), "max": F.max("value").over(over),
        "sum": F.sum("value").over(over), "range": F.max("value").over(over) - F.min("value").over(over),
        "first": F.first("value").over(over), "last": F.last("value").over(over),
    }
    return (
        rows.withColumns({n: stats[n] for n in names} | {"end_ts": F.last("ts").over(over)})
        .filter((F.floor(F.col("idx") / BLOCK) == F.col("block")) & (F.col("idx") <= F.col("n") - length))
        .select("ts_id", "idx", F.col("ts").alias("start_ts"), "end_ts", *names)
    )


def find_features(m: DataFrame, features: dict[str, float], length: int = 10, top_k: int = 5,
                  exclusion_zone: int | None = None) -> DataFrame:
    """Windows whose features all lie within 20 % of the wanted ones, least total error first."""
    w = window_features(m, length, list(features))
    score, ok = F.lit(0.0), F.lit(True)
    for name, wanted in features.items():
        error = F.abs(F.col(name) - wanted) / (abs(wanted) if wanted else 1.0)
        score, ok = score + error, ok & (error <= FEATURE_TOLERANCE)
    gap = length // 2 if exclusion_zone is None else exclusion_zone
    return best_without_overlap(w.filter(ok).withColumn("score", score), "score", length - 1 + gap, top_k).drop("rank")


def pairs_with_pattern(m: DataFrame, pairs: DataFrame, threshold: float = POOR_MATCH) -> DataFrame:
    """Pairs ``left_ts, right_ts`` where some window of the left looks like the whole right series.

    The pattern may be as long as any series, so it is cut into blocks like the series itself: the
    products of each two blocks add to the windows they touch, and windows sum up across blocks.
    """
    ids = pairs.select(F.explode(F.array("left_ts", "right_ts")).alias("ts_id")).distinct()
    rows = with_position(m.join(ids, "ts_id", "left_semi"), ["ts_id"], "ts")
    stats = rows.groupBy("ts_id").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    blocks = rows.groupBy("ts_id", F.floor(F.col("idx") / BLOCK).alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("r"))  # at most BLOCK rows
    blocks = blocks.join(stats, "ts_id").select("ts_id", "b", "mu", "sd", "n", F.col("r.value").alias("v"))
    left = blocks.select(F.col("ts_id").alias("left_ts"), F.col("b").alias("lb"), F.col("n").alias("ln"), F.col("mu").alias("lm"), F.col("sd").alias("ls"), F.col("v").alias("lv"))
    right = blocks.select(F.col("ts_id").alias("right_ts"), F.col("b").alias("rb"), F.col("n").alias("rn"), F.col("mu").alias("rm"), F.col("sd").alias("rs"), F.col("v").alias("rv"))

    @F.pandas_udf("array<struct<dot:double,s1:double,s2:double>>")
    def products(lv: pd.Series, lm: pd.Series, rv: pd.Series, rm: pd.Series, rs: pd.Series) -> pd.Series:
        out = []
        for x, c, q, mu, sd in zip(lv, lm, rv, rm, rs):
            x, q = np.asarray(x, float) - c, (np.asarray(q, float) - mu) / (sd or 1.0)
            ones = np.ones(len(q))
            table = [np.correlate(x, q, "full"), np.correlate(x, ones, "full"), np.correlate(x * x, ones, "full")]
            out.append([{"dot": a, "s1": b, "s2": d} for a, b, d in zip(*table)])
        return pd.Series(out)

    touched = pairs.select("left_ts", "right_ts").distinct().join(left, "left_ts").join(right, "right_ts").filter("rn >= 2 AND ln >= rn AND rb <= lb")
    partial = touched.select("left_ts", "right_ts", "ln", "rn", "ls", "rs", "lb", "rb", F.size("rv").alias("rsize"),
                             F.posexplode(products("lv", "lm", "rv", "rm", "rs")).alias("at", "p"))
    start = F.col("lb") * BLOCK - F.col("rb") * BLOCK + F.col("at") - (F.col("rsize") - 1)
    n, length = F.col("ln"), F.col("rn")
    windows = (partial.withColumn("i", start).filter((F.col("i") >= 0) & (F.col("i") <= n - length))
               .groupBy("left_ts", "right_ts", "ln", "rn", "ls", "rs", "i")
               .agg(F.sum("p.dot").alias("dot"), F.sum("p.s1").alias("s1"), F.sum("p.s2").alias("s2")))
    var = F.col("s2") / length - F.pow(F.col("s1") / length, 2)
    flat = var <= 1e-14 * F.pow("ls", 2)
    own = F.when(F.col("rs") > 0, length).otherwise(0)
    squared = F.when(flat, own).otherwise(length + own - 2 * F.try_divide(F.col("dot"), F.sqrt(var)))
    best = windows.groupBy("left_ts", "right_ts").agg(F.min(F.sqrt(F.greatest(F.lit(0.0), squared.cast("double")))).alias("best"))
    return best.filter(F.col("best") <= threshold).select("left_ts", "right_ts")


PROFILE_BLOCK = 1024


def window_profile(m: DataFrame, length: int, separation: int | None = None) -> DataFrame:
    """Nearest other window of every window: ``ts_id, idx, start_ts, neighbour, distance``.

    Windows closer than ``separation`` positions are not compared (default: a quarter of the
    length, plus one); series shorter than two windows give nothing. Exact for series of any length:
    windows are ordered by their projection on one direction, in which two windows are never
    farther apart than in full, and cut into blocks of that order. Neighbouring blocks are compared
    first; two other blocks only if their gap is below the best distances found so far.
    """
    separation = separation or -(-length // 4) + 1
    direction = np.array(z_normalised([float(i) for i in range(length)]))
    direction = direction / (np.linalg.norm(direction) or 1.0)

    @F.pandas_udf("array<struct<w:array<double>,p:double>>")
    def shapes(blocks: pd.Series) -> pd.Series:
        def one(values):
            if len(values) < length:
                return []
            w = np.lib.stride_tricks.sliding_window_view(np.asarray(values, dtype=float), length)
            std = w.std(axis=1, keepdims=True)
            z = (w - w.mean(axis=1, keepdims=True)) / np.where(std == 0, 1.0, std)
            return [{"w": row, "p": float(p)} for row, p in zip(z, z @ direction)]
        return blocks.map(one)

    rows = _in_blocks(with_position(m, ["ts_id"], "ts").filter(F.col("n") >= 2 * length), length)
    pieces = rows.groupBy("ts_id", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "ts", "value"))).alias("r"))  # at most BLOCK + length rows
    windows = pieces.select("ts_id", F.col("r.idx").alias("i"), F.col("r.ts").alias("t"), F.posexplode(shapes("r.value")).alias("at", "s")).select(
        "ts_id", F.element_at("i", F.col("at") + 1).alias("widx"), F.element_at("t", F.col("at") + 1).alias("start_ts"), F.col("s.w").alias("w"), F.col("s.p").alias("p"))
    windows = cut(windows)
    ranked = with_position(windows.select("ts_id", "widx", "w", "p"), ["ts_id"], "p")
    blocks = cut(ranked.groupBy("ts_id", F.floor(F.col("idx") / PROFILE_BLOCK).alias("b")).agg(
        F.collect_list(F.struct("widx", "w")).alias("r"), F.min("p").alias("low"), F.max("p").alias("high"))  # at most PROFILE_BLOCK rows
        .select("ts_id", "b", "low", "high", F.col("r.widx").alias("ids"), F.flatten("r.w").alias("ws")))

    @F.pandas_udf("array<struct<idx:bigint,neighbour:bigint,distance:double>>")
    def nearest(ids1: pd.Series, ws1: pd.Series, ids2: pd.Series, ws2: pd.Series) -> pd.Series:
        def best(ia, a, ib, b):
            far = np.abs(ia[:, None] - ib[None, :]) >= separation
            d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
            d = np.where(far, d, np.inf)
            j = d.argmin(axis=1)
            exact = np.sqrt(((a - b[j]) ** 2).sum(axis=1))
            ok = far[np.arange(len(ia)), j]
            return [{"idx": int(i), "neighbour": int(k), "distance": float(x)} for i, k, x in zip(ia[ok], ib[j][ok], exact[ok])]
        out = []
        for i1, w1, i2, w2 in zip(ids1, ws1, ids2, ws2):
            i1, i2 = np.asarray(i1), np.asarray(i2)
            a, b = np.asarray(w1, float).reshape(len(i1), length), np.asarray(w2, float).reshape(len(i2), length)
            same = len(i1) == len(i2) and (i1 == i2).all()
            out.append(best(i1, a, i2, b) + ([] if same else best(i2, b, i1, a)))
        return pd.Series(out)

    def compared(block_pairs: DataFrame) -> DataFrame:
        one = blocks.select("ts_id", F.col("b").alias("b1"), F.col("ids").alias("ids1"), F.col("ws").alias("ws1"))
        two = blocks.select("ts_id", F.col("b").alias("b2"), F.col("ids").alias("ids2"), F.col("ws").alias("ws2"))
        both = block_pairs.join(one, ["ts_id", "b1"]).join(two, ["ts_id", "b2"])
        return both.select("ts_id", F.explode(nearest("ids1", "ws1", "ids2", "ws2")).alias("x")).select("ts_id", "x.*")

    close = F.struct("distance", "neighbour")
    near = blocks.select("ts_id", F.col("b").alias("b1"), F.explode(F.array("b", F.col("b") + 1)).alias("b2"))
    found = cut(compared(near).groupBy("ts_id", "idx").agg(F.min(close).alias("x")).select("ts_id", "idx", "x.*"))
    # how far a block's windows still have to look
    homes = blocks.select("ts_id", "b", F.explode("ids").alias("idx"))
    reach = homes.join(found, ["ts_id", "idx"], "left").groupBy("ts_id", "b").agg(F.max(F.coalesce("distance", F.lit(float("inf")))).alias("reach"))
    extent = blocks.select("ts_id", "b", "low", "high").join(reach, ["ts_id", "b"])
    a, b = extent.alias("a"), extent.alias("b")
    open_pairs = a.join(b, (F.col("a.ts_id") == F.col("b.ts_id")) & (F.col("b.b") >= F.col("a.b") + 2)
                        & (F.col("b.low") - F.col("a.high") < F.greatest(F.col("a.reach"), F.col("b.reach"))))
    far = compared(open_pairs.select(F.col("a.ts_id").alias("ts_id"), F.col("a.b").alias("b1"), F.col("b.b").alias("b2")))
    result = found.unionByName(far).groupBy("ts_id", "idx").agg(F.min(close).alias("x")).select("ts_id", "idx", "x.*")
    starts = windows.select("ts_id", F.col("widx").alias("idx"), "start_ts")
    return result.join(starts, ["ts_id", "idx"]).select("ts_id", "idx", "start_ts", "neighbour", "distance")


def motifs(m: DataFrame, length: int, top_k: int = 5, separation: int | None = None, profile: DataFrame | None = None) -> DataFrame:
    """Closest pairs of windows, at least ``separation`` apart, no window in two pairs: ``ts_id, idx, neighbour, distance, rank``.

    One round per rank: the best pair left of every series at once.
    """
    separation = separation or length
    profile = window_profile(m, length) if profile is None else profile
    left = cut(profile.filter(F.abs(F.col("idx") - F.col("neighbour")) >= separation))
    picked = None
    for rank in range(1, top_k + 1):
        best = left.groupBy("ts_id").agg(F.min(F.struct("distance", "idx", "neighbour")).alias("x")).select("ts_id", "x.*")
        best = cut(best.withColumn("rank", F.lit(rank)))
        picked = best if picked is None else picked.unionByName(best)
        used = best.select("ts_id", F.explode(F.array("idx", "neighbour")).alias("u"))
        for end in ("idx", "neighbour"):
            left = left.join(used.withColumnRenamed("u", end), ["ts_id", end], "left_anti")
        left = cut(left) if rank < top_k else left
    first, second = F.least("idx", "neighbour"), F.greatest("idx", "neighbour")
    return picked.select("ts_id", first.alias("idx"), second.alias("neighbour"), "distance", "rank")


def discords(m: DataFrame, length: int, top_k: int = 5, profile: DataFrame | None = None) -> DataFrame:
    """Windows with the largest distance to their nearest neighbour, not overlapping."""
    profile = window_profile(m, length) if profile is None else profile
    return best_without_overlap(profile.withColumn("score", -F.col("distance")), "score", length - 1, top_k).drop("score")
