"""Metrics of one graph, or of many at once when ``keys`` tell them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import property_number
from ..plans.fixpoint import hops, strong_components, weak_components
from ..plans.lineage import cut
from .scans import edge_ends, edges_among, with_label


def density_column(n, m, directed: bool = True) -> Column:
    pairs = n * (n - 1)
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.try_divide((m if directed else 2 * m).cast("double"), pairs.cast("double")))


def density(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return n.crossJoin(m).withColumn("density", density_column(F.col("n_nodes"), F.col("n_edges"), directed))  # one row each


def label_induced(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    nodes = with_label(nodes, label)
    return nodes, edges_among(edges, nodes)


def components(nodes: DataFrame, edges: DataFrame, directed: bool = False, keys: list[str] = ()) -> DataFrame:
    return (strong_components if directed else weak_components)(nodes, edges, keys)


def component_sizes(comps: DataFrame, keys: list[str] = ()) -> DataFrame:
    return comps.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("size"))


def component_summary(comps: DataFrame, keys: list[str] = ()) -> DataFrame:
    return component_sizes(comps, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_components"), F.max("size").alias("biggest"), F.min("size").alias("smallest"))


def component_of(comps: DataFrame, uid: str) -> DataFrame:
    mine = comps.filter(F.col("uid") == uid).select("comp")
    return comps.join(mine, "comp", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame, direction: str = "both", weight: str | None = None,
            self_loop: int = 2, keys: list[str] = ()) -> DataFrame:
    """Degree of every node, 0 for nodes without edges; a missing weight counts as 0."""
    amount = F.lit(1) if weight is None else F.coalesce(property_number(edges, weight), F.lit(0.0))
    ends = edge_ends(edges.withColumn("_w", amount).select(*keys, "src", "dst", "_w"), direction, self_loop)
    counted = ends.groupBy(*keys, F.col("node").alias("uid")).agg(F.sum("_w").alias("degree"))
    zero = F.lit(0) if weight is None else F.lit(0.0)
    return nodes.select(*keys, "uid").join(counted, [*keys, "uid"], "left").withColumn("degree", F.coalesce("degree", zero))


def degree_distribution(nodes: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """How many nodes have each degree; here a self loop counts once."""
    return degrees(nodes, edges, direction, self_loop=1).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The nodes of a shortest directed path with their position; no rows where there is none."""
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(source).alias("root"))
    seen = hops(start, edges, until=target)
    at = cut(seen.filter(F.col("uid") == target).select("hop", "uid", "parent"))
    row = at.select("hop").first()
    path = at
    for _ in range(row.hop if row else 0):
        at = cut(seen.join(at.select(F.col("parent").alias("uid")), "uid", "left_semi").select("hop", "uid", "parent"))
        path = path.unionByName(at)
    return path.select(F.col("hop").alias("position"), "uid")
