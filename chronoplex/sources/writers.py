"""Graphs as parquet tables laid out for pruning: elements by label, samples by day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import EDGE_SCHEMA, MEASUREMENT_SCHEMA, NODE_SCHEMA, TemporalGraph
from ..operators.temporal import time_column, within


def write_graph(g: TemporalGraph, root: str, mode: str = "errorifexists") -> None:
    """Elements are partitioned by label and samples by day, sorted by series inside.

    Typed property columns (``add_property_columns``) are written beside the map: their statistics let later reads skip row groups.
    Samples are spread over tasks by day, series and time, so one day or one series of any
    size is written by many tasks.
    """
    g.nodes.write.mode(mode).partitionBy("label").parquet(f"{root}/nodes")
    g.edges.write.mode(mode).partitionBy("label").parquet(f"{root}/edges")
    dated = g.measurements.withColumn("day", F.to_date("ts"))
    spread = dated.repartitionByRange("day", "ts_id", "ts").sortWithinPartitions("day", "ts_id", "ts")
    spread.write.mode(mode).partitionBy("day").parquet(f"{root}/measurements")


def _elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements with the typed property columns that the files hold; a table without rows has no files."""
    core = StructType.fromDDL(schema)
    try:
        stored = spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        stored = core
    typed = [f for f in stored if f.metadata.get("property") == f.name]
    return spark.read.schema(StructType([*core, *typed])).parquet(path)


def read_graph(spark: SparkSession, root: str, start=None, end=None) -> TemporalGraph:
    """The tables of :func:`write_graph`; only the folders of days in the closed range are read for samples."""
    nodes, edges = _elements(spark, f"{root}/nodes", NODE_SCHEMA), _elements(spark, f"{root}/edges", EDGE_SCHEMA)
    samples = spark.read.schema(f"{MEASUREMENT_SCHEMA}, day DATE").parquet(f"{root}/measurements")
    if start is not None:
        samples = samples.filter(F.col("day") >= F.to_date(time_column(start)))
    if end is not None:
        samples = samples.filter(F.col("day") <= F.to_date(time_column(end)))
    return TemporalGraph(nodes, edges, within(samples.drop("day"), start, end))
