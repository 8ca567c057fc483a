"""Graphs from JSON or CSV folders: one file per label, series embedded or in ``measurements.csv``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TemporalGraph
from ..operators.scans import edges_among

#: Texts that read as true.
TRUE_TEXTS = ("true", "1", "yes")
_TYPES = {"int": "long", "float": "double", "str": "string"}

#: Names under which a field of a source may be found.
NODE_FIELDS = {"id": ("id", "node_id", "uid"), "start": ("start_time", "start"), "end": ("end_time", "end")}
EDGE_FIELDS = NODE_FIELDS | {"source": ("source", "src", "from", "start_id"), "target": ("target", "dst", "to", "end_id")}


def cast_value(column: Column, kind: str) -> Column:
    """A text as int, float, bool, json or str; what does not fit is NULL."""
    if kind == "bool":
        return F.when(column.isNotNull(), F.lower(F.trim(column)).isin(*TRUE_TEXTS))
    if kind == "json":
        return F.try_parse_json(column)
    return column.try_cast(_TYPES[kind])


def _label_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)


def _first(df: DataFrame, names) -> Column:
    present = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _time(column: Column) -> Column:
    return column.try_cast("timestamp")


def synthetic_edge_id(label: Column, src: Column, dst: Column, start: Column) -> Column:
    return F.concat_ws("_", label, src, dst, start)


def _property_maps(df: DataFrame, core: set[str]) -> tuple[Column, Column]:
    """Static properties, and series references from columns ending in ``_ts_id``; empty cells are dropped."""
    def mapping(pairs):
        if not pairs:
            return F.create_map().cast("map<string,string>")
        m = F.create_map(*[x for name, c in pairs for x in (F.lit(name), c)])
        return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))

    rest = [c for c in df.columns if c not in core]
    static = [(c, F.col(f"`{c}`").cast("string") if not isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(f"`{c}`"))
              for c in rest if not c.endswith("_ts_id") and c != "ts"]
    series = [(c.removesuffix("_ts_id"), F.col(f"`{c}`").cast("string")) for c in rest if c.endswith("_ts_id")]
    return mapping(static), mapping(series)


def _elements(df: DataFrame, fields: dict, is_edge: bool, label: Column) -> DataFrame:
    core = {n for names in fields.values() for n in names} | {"label", "start_vertex_type", "end_vertex_type", "_label"}
    props, ts_ids = _property_maps(df, core)
    start = _first(df, fields["start"])
    columns = [label.alias("label"), _time(start).alias("start_time"), _time(_first(df, fields["end"])).alias("end_time"), props.alias("props"), ts_ids.alias("ts_ids")]
    if not is_edge:
        return df.select(_first(df, fields["id"]).alias("uid"), *columns)
    src, dst = _first(df, fields["source"]), _first(df, fields["target"])
    uid = F.coalesce(_first(df, fields["id"]), synthetic_edge_id(label, src, dst, start))
    return df.select(uid.alias("uid"), src.alias("src"), dst.alias("dst"), *columns)


def read_csv_graph(spark: SparkSession, root: str, node_labels: list[str], edge_labels: list[str]) -> TemporalGraph:
    """``nodes/<Label>.csv``, ``edges/<Label>.csv`` and ``measurements.csv`` with headers."""
    def part(folder: str, name: str, fields: dict, is_edge: bool) -> DataFrame:
        df = spark.read.csv(f"{root}/{folder}/{name}.csv", header=True)
        return _elements(df, fields, is_edge, F.lit(name))

    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    nodes = union([part("nodes", n, NODE_FIELDS, False) for n in node_labels])
    edges = union([part("edges", n, EDGE_FIELDS, True) for n in edge_labels])
    return TemporalGraph(nodes, edges, read_measurements(spark, f"{root}/measurements.csv"))


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Samples ``ts_id, variable, timestamp, value``; of equal keys the last line of the last file wins."""
    raw = spark.read.schema("ts_id STRING, variable STRING, timestamp STRING, value DOUBLE").csv(path, header=True)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.withColumn("_order", order).groupBy("ts_id", "variable", _time(F.col("timestamp")).alias("ts")).agg(F.max_by("value", "_order").alias("value"))


def read_json_graph(spark: SparkSession, root: str, node_labels: list[str], edge_labels: list[str],
                    node_fields: dict | None = None, edge_fields: dict | None = None, multi_line: bool = True) -> TemporalGraph:
    """``nodes/<Label>.json`` and ``edges/<Label>.json``: arrays of objects with embedded series in ``ts``.

    One array is read by one task; ``multi_line=False`` reads one object per line, which splits.

    ``ts`` maps a variable to samples of ``start`` (or ``time``) and ``value``; zeros are kept. The id of the source stays as
    property ``node_id``; edges with an unknown end are dropped.
    """
    nodes, samples = _json_part(spark, f"{root}/nodes", node_labels, NODE_FIELDS | (node_fields or {}), False, multi_line)
    edges, edge_samples = _json_part(spark, f"{root}/edges", edge_labels, EDGE_FIELDS | (edge_fields or {}), True, multi_line)
    edges = edges_among(edges, nodes)
    m = samples.unionByName(edge_samples)
    return TemporalGraph(nodes, edges, m.groupBy("ts_id", "variable", "ts").agg(F.max_by("value", "_order").alias("value")))


def _json_part(spark: SparkSession, folder: str, labels: list[str], fields: dict, is_edge: bool, multi_line: bool):
    elements, samples = [], []
    for label in labels:
        df = spark.read.option("multiLine", multi_line).json(f"{folder}/{label}.json")
        rows = _elements(df, fields, is_edge, F.lit(label))
        if not is_edge:
            rows = rows.withColumn("props", F.map_concat("props", F.create_map(F.lit("node_id"), F.col("uid"))))
        if "ts" in df.columns:
            blocks = _embedded(df, fields, is_edge, label)
            names = blocks.groupBy("uid").agg(F.map_from_entries(F.collect_set(F.struct("variable", "ts_id"))).alias("_ids"))  # one per variable
            rows = rows.join(names, "uid", "left").withColumn("ts_ids", F.map_concat("ts_ids", F.coalesce("_ids", F.create_map().cast("map<string,string>")))).drop("_ids")
            samples.append(blocks.select("ts_id", "variable", "ts", "value", "_order"))
        elements.append(rows)
    empty = spark.range(0).select(F.lit("").alias("ts_id"), F.lit("").alias("variable"), F.current_timestamp().alias("ts"), F.lit(0.0).alias("value"), F.lit(0).alias("_order"))
    return reduce(lambda a, b: a.unionByName(b), elements), reduce(lambda a, b: a.unionByName(b), samples or [empty])


def _embedded(df: DataFrame, fields: dict, is_edge: bool, label: str) -> DataFrame:
    """The ``ts`` objects as rows, whatever the spelling of their fields."""
    uid = _first(df, fields["id"]) if not is_edge else F.coalesce(
        _first(df, fields["id"]), synthetic_edge_id(F.lit(label), _first(df, fields["source"]), _first(df, fields["target"]), _first(df, fields["start"])))
    per_variable = F.from_json(F.to_json("ts"), "map<string,array<map<string,string>>>")
    rows = (df.select(uid.alias("uid"), F.explode(per_variable).alias("variable", "points"))
            .select("uid", "variable", F.posexplode("points").alias("_order", "p")))
    at = F.coalesce(*[F.col("p").getItem(n) for n in ("Start", "start", "time")])
    value = F.coalesce(*[F.col("p").getItem(n) for n in ("Value", "value")]).try_cast("double")
    return (rows.select("uid", "variable", F.concat(F.lit("ts_"), "variable", F.lit("_"), "uid").alias("ts_id"), _time(at).alias("ts"), value.alias("value"), "_order")
            .filter(F.col("ts").isNotNull() & F.col("value").isNotNull()))


def dense_ids(nodes: DataFrame) -> DataFrame:
    """Optional sequential ids by ``(label, uid)``: ``uid, dense_id``; ranges are numbered in parallel."""
    from pyspark.sql import Window

    ordered = nodes.select("label", "uid").repartitionByRange("label", "uid").sortWithinPartitions("label", "uid").withColumn("_part", F.spark_partition_id())
    from ..plans.lineage import cut

    ordered = cut(ordered)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    in_part = Window.partitionBy("_part").orderBy("label", "uid")
    return ordered.withColumn("_i", F.row_number().over(in_part)).join(offsets, "_part").select("uid", (F.col("_i") + F.col("_offset")).alias("dense_id"))
