"""Which change may have led to which: a graph over nodes with a time of change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import greatest_depth, hops
from ..plans.lineage import cut

DAY_MICROS = 86_400_000_000


class Propagation:
    """An edge u -> v where u and v are adjacent either way and u changed strictly before v.

    ``times`` has ``uid, transition_ts``; ``adjacency`` has ``src, dst``; a delay limit is closed.
    """

    def __init__(self, times: DataFrame, adjacency: DataFrame, max_delay_days: float | None = None):
        self.times, self.adjacency, self.max_delay_days = times, adjacency, max_delay_days
        self._edges: DataFrame | None = None

    def edges(self) -> DataFrame:
        """``src, dst, delay_days``, one per ordered pair."""
        if self._edges is None:
            ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
            pairs = self.adjacency.select(F.explode(ends).alias("e")).select("e.src", "e.dst").distinct()
            at = lambda end: self.times.select(F.col("uid").alias(end), F.col("transition_ts").alias(f"{end}_ts"))
            delay = (F.unix_micros("dst_ts") - F.unix_micros("src_ts")) / DAY_MICROS
            timed = pairs.join(at("src"), "src").join(at("dst"), "dst").withColumn("delay_days", delay).filter("delay_days > 0")
            if self.max_delay_days is not None:
                timed = timed.filter(F.col("delay_days") <= self.max_delay_days)
            self._edges = cut(timed.select("src", "dst", "src_ts", "dst_ts", "delay_days"))
        return self._edges

    def roots(self) -> DataFrame:
        """Nodes that nothing led to, earliest first."""
        return self.times.join(self.edges().select(F.col("dst").alias("uid")), "uid", "left_anti").orderBy("transition_ts", "uid")

    def leaves(self) -> DataFrame:
        """Nodes that led to nothing, latest first."""
        return self.times.join(self.edges().select(F.col("src").alias("uid")), "uid", "left_anti").orderBy(F.desc("transition_ts"), "uid")

    def depths(self) -> DataFrame:
        """``root, uid, hop``: breadth-first distance from every root."""
        start = self.roots().select(F.col("uid").alias("root"))
        return hops(start, self.edges()).select("root", "uid", "hop")

    def paths(self, top_k: int | None = None, max_hops: int | None = None) -> DataFrame:
        """Paths from a root to a leaf with an edge: ``path, n_hops, total_delay_days``, shortest delay first, then by path.

        All of them, or the first ``top_k``, of at most ``max_hops`` edges. Times strictly increase along edges, so no path meets a node
        twice and the loop ends. With ``top_k`` a hop keeps that many ways to each node: what begins with another way of as many hops is
        preceded by ``top_k`` paths that end alike. So a hop holds at most ``top_k`` rows per node, however many paths there are.
        """
        leaves = self.leaves().select(F.col("uid").alias("src"))
        steps = self.edges().select("src", "dst", (F.unix_micros("dst_ts") - F.unix_micros("src_ts")).alias("step"))
        rows = cut(self.roots().select(F.array("uid").alias("path"), F.col("uid").alias("src"), F.lit(0).cast("long").alias("delay")))
        ended, hop = [], 0
        while (max_hops is None or hop < max_hops) and not rows.isEmpty():
            rows = rows.join(steps, "src").select(
                F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"), (F.col("delay") + F.col("step")).alias("delay"))
            if top_k is not None:
                place = F.row_number().over(Window.partitionBy("src").orderBy("delay", "path"))
                rows = rows.withColumn("_place", place).filter(F.col("_place") <= top_k).drop("_place")
            rows, hop = cut(rows), hop + 1
            ended.append(rows.join(leaves, "src", "left_semi"))
        done = (reduce(DataFrame.unionByName, ended) if ended else rows.limit(0)).select(
            "path", (F.size("path") - 1).alias("n_hops"), (F.col("delay") / DAY_MICROS).alias("total_delay_days"), "delay").orderBy("delay", "path")
        return (done if top_k is None else done.limit(top_k)).drop("delay")

    def path_counts(self, max_hops: int | None = None) -> DataFrame:
        """``uid, n_hops, n_paths``: how many of the ``paths`` end at each leaf after how many edges, without listing them."""
        steps = self.edges().select("src", "dst")
        rows = cut(self.roots().select(F.col("uid").alias("src"), F.lit(0).alias("n_hops"), F.lit(1).cast("decimal(38,0)").alias("n_paths")))
        levels, hop = [rows.limit(0)], 0
        while (max_hops is None or hop < max_hops) and not rows.isEmpty():
            hop += 1
            rows = cut(rows.join(steps, "src").groupBy(F.col("dst").alias("src")).agg(F.sum("n_paths").alias("n_paths"))
                       .select("src", F.lit(hop).alias("n_hops"), "n_paths"))
            levels.append(rows)
        reached = reduce(DataFrame.unionByName, levels).withColumnRenamed("src", "uid")
        return reached.join(self.leaves().select("uid"), "uid", "left_semi")

    def timeline(self) -> DataFrame:
        return self.times.orderBy("transition_ts", "uid")

    def summary(self) -> DataFrame:
        one = lambda df, *aggs: df.agg(*aggs)
        n = one(self.times, F.count(F.lit(1)).alias("cpg_nodes"))
        e = one(self.edges(), F.count(F.lit(1)).alias("cpg_edges"), F.coalesce(F.avg("delay_days"), F.lit(0.0)).alias("cpg_avg_delay_days"))
        r = one(self.roots(), F.count(F.lit(1)).alias("cpg_roots"))
        lv = one(self.leaves(), F.count(F.lit(1)).alias("cpg_leaves"))
        depth = F.lit(greatest_depth(self.roots(), self.edges())).alias("cpg_max_depth")  # without a row per root and node
        return n.crossJoin(e).crossJoin(r).crossJoin(lv).select("*", depth)  # one row each
