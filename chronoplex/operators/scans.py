"""Lookups on elements: labels, neighbours, pairs, counts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import compare_property, property_column
from ..model import TemporalGraph
from ..plans.positions import with_position


def with_label(df: DataFrame, label: str | None) -> DataFrame:
    return df if label is None else df.filter(F.col("label") == label)


def by_id(df: DataFrame, uid: str) -> DataFrame:
    return df.filter(F.col("uid") == uid)


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def id_contains(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.lower("uid").contains(text.lower()))


def where_static(df: DataFrame, name: str, op: str, value) -> DataFrame:
    return df.filter(compare_property(df, name, op, value))


def edges_where(edges: DataFrame, label: str | None = None, source: str | None = None,
                target: str | None = None) -> DataFrame:
    edges = with_label(edges, label)
    if source is not None:
        edges = edges.filter(F.col("src") == source)
    if target is not None:
        edges = edges.filter(F.col("dst") == target)
    return edges


def edge_ends(edges: DataFrame, direction: str = "both", self_loop: int = 2) -> DataFrame:
    """One row per edge end: ``uid`` (the near end), ``other``, and all edge columns.

    ``self_loop`` says whether a loop has one or two ends when both directions count. The ends
    come from one pass over the edges, not from a union of two scans.
    """
    if direction == "out":
        return edges.withColumns({"node": F.col("src"), "other": F.col("dst")})
    if direction == "in":
        return edges.withColumns({"node": F.col("dst"), "other": F.col("src")})
    if direction != "both":
        raise ValueError("direction is 'out', 'in' or 'both'")
    out_end = F.struct(F.col("src").alias("node"), F.col("dst").alias("other"))
    in_end = F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))
    ends = F.array(out_end, in_end)
    if self_loop == 1:
        ends = F.when(F.col("src") == F.col("dst"), F.array(out_end)).otherwise(ends)
    return edges.withColumn("_end", F.explode(ends)).withColumns(
        {"node": F.col("_end.node"), "other": F.col("_end.other")}).drop("_end")


def neighbours(edges: DataFrame, of: DataFrame | str | None = None, direction: str = "both",
               label: str | None = None) -> DataFrame:
    """Distinct neighbours of one node, of a table of nodes (column ``uid``), or of all nodes."""
    ends = edge_ends(with_label(edges, label), direction).select(F.col("node").alias("uid"), F.col("other").alias("neighbour"))
    if isinstance(of, str):
        ends = ends.filter(F.col("uid") == of)
    elif of is not None:
        ends = ends.join(of.select("uid"), "uid", "left_semi")
    return ends.distinct()


def between_pair(edges: DataFrame, a: str, b: str, label: str | None = None, directed: bool = True) -> DataFrame:
    forward = (F.col("src") == a) & (F.col("dst") == b)
    backward = (F.col("src") == b) & (F.col("dst") == a)
    return with_label(edges, label).filter(forward if directed else forward | backward)


def label_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.select(F.lit("node").alias("kind"), "label").unionByName(
        edges.select(F.lit("edge").alias("kind"), "label"))
    return kinds.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") == F.col("dst"))


def edges_among(edges: DataFrame, members: DataFrame, member: str = "uid") -> DataFrame:
    ids = members.select(F.col(member).alias("_member")).distinct()
    return (
        edges.join(ids, edges.src == ids._member, "left_semi")
        .join(ids, edges.dst == ids._member, "left_semi")
    )


#: Names under which coordinates are looked up.
LATITUDE, LONGITUDE = ("lat", "latitude"), ("lng", "lon", "long", "longitude")


def geographic_centre(nodes: DataFrame) -> DataFrame:
    def first_of(names) -> Column:
        return F.coalesce(*[property_column(nodes, n).cast("string").try_cast("double") for n in names])

    both = nodes.select(first_of(LATITUDE).alias("lat"), first_of(LONGITUDE).alias("lng")).dropna()
    return both.agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def to_documents(df: DataFrame) -> DataFrame:
    """Each element as one JSON text."""
    return df.select("uid", F.to_json(F.struct(*df.columns)).alias("document"))


def from_documents(documents: DataFrame, schema: str) -> DataFrame:
    return documents.select(F.from_json("document", schema).alias("e")).select("e.*")


#: Samples in time that a series document holds at most; a longer series has several documents.
PART_LENGTH = 4096
_ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def series_to_documents(g: TemporalGraph, part_length: int = PART_LENGTH) -> DataFrame:
    """``ts_id, part, document``: series as JSON texts with their moments, variables, a row of values per moment, and their owner.

    A series of any length is cut into parts of ``part_length`` moments by position. A moment has a value of each variable of its series,
    null where there is none. Of several owners of a shared series the first by kind and uid is named; a series without owner has nulls.
    """
    m = g.measurements
    variables = m.groupBy("ts_id").agg(F.sort_array(F.collect_set("variable")).alias("variables"))
    moments = m.groupBy("ts_id", "ts").agg(F.sort_array(F.collect_list(F.struct("variable", "value"))).alias("cells"))
    placed = with_position(moments, ["ts_id"], "ts").withColumn("part", F.floor(F.col("idx") / part_length))
    row = F.transform("variables", lambda v: F.get(F.filter("cells", lambda c: c["variable"] == v), F.lit(0))["value"])
    blocks = (placed.join(variables, "ts_id").select("ts_id", "part", "variables", F.struct("idx", "ts", row.alias("row")).alias("m"))
              .groupBy("ts_id", "part", "variables").agg(F.sort_array(F.collect_list("m")).alias("m")))
    of = lambda kind: g.elements(kind).select(F.struct(F.lit(kind).alias("element_type"), F.col("uid").alias("owner_id")).alias("metadata"),
                                              F.explode(F.map_values("ts_ids")).alias("ts_id"))
    owners = of("node").unionByName(of("edge")).groupBy("ts_id").agg(F.min("metadata").alias("metadata"))
    body = F.struct(F.col("ts_id").alias("tsid"), "part", F.col("m.ts").alias("timestamps"), "variables", F.col("m.row").alias("data"), "metadata")
    return blocks.join(owners, "ts_id", "left").select("ts_id", "part", F.to_json(body, {**_ISO, "ignoreNullFields": "false"}).alias("document"))


def series_from_documents(documents: DataFrame) -> DataFrame:
    """The samples of series documents, in any order of parts: ``ts_id, variable, ts, value``."""
    schema = "tsid STRING, timestamps ARRAY<TIMESTAMP>, variables ARRAY<STRING>, data ARRAY<ARRAY<DOUBLE>>"
    d = documents.select(F.from_json("document", schema, _ISO).alias("d"))
    moments = d.select("d.tsid", "d.variables", F.explode(F.arrays_zip("d.timestamps", "d.data")).alias("m"))
    cells = moments.select("tsid", F.col("m.timestamps").alias("ts"), F.explode(F.arrays_zip("variables", "m.data")).alias("c"))
    return cells.select(F.col("tsid").alias("ts_id"), F.col("c.variables").alias("variable"), "ts", F.col("c.data").alias("value"))
