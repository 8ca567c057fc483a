"""Subgraphs by node ids, saved id sets, and membership in a subgraph's time line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TemporalGraph
from .scans import edges_among
from .series import catalogue
from .temporal import time_column


def subgraph(g: TemporalGraph, node_ids: DataFrame) -> TemporalGraph:
    """The nodes, the edges with both ends among them, and the series of either."""
    ids = node_ids.select("uid").distinct()
    nodes = g.nodes.join(ids, "uid", "left_semi")
    edges = edges_among(g.edges, nodes)
    series = catalogue(nodes, edges).select("ts_id").distinct()
    return g.with_(nodes=nodes, edges=edges, measurements=g.measurements.join(series, "ts_id", "left_semi"), named_series=g.named_series)


def save_members(node_ids: DataFrame, root: str, name: str) -> None:
    node_ids.select("uid").distinct().withColumn("subgraph", F.lit(name)).write.mode("overwrite").parquet(f"{root}/subgraph={name}")


def load_members(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    saved = spark.read.option("recursiveFileLookup", "true").parquet(root)
    return saved if name is None else saved.filter(F.col("subgraph") == name)


def list_subgraphs(spark: SparkSession, root: str) -> DataFrame:
    return load_members(spark, root).groupBy("subgraph").agg(F.count(F.lit(1)).alias("n_nodes"))


def missing_members(g: TemporalGraph, node_ids: DataFrame) -> DataFrame:
    return node_ids.select("uid").distinct().join(g.nodes, "uid", "left_anti")


def covers(df: DataFrame, start=None, end=None) -> DataFrame:
    """Elements whose validity contains an interval; open ends of either pass."""
    if start is not None:
        df = df.filter(F.col("start_time").isNull() | (F.col("start_time") <= time_column(start)))
    if end is not None:
        df = df.filter(F.col("end_time").isNull() | (F.col("end_time") >= time_column(end)))
    return df
