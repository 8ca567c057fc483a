"""Batch changes: tables of new or changed elements, properties and samples are merged in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import promote, promoted, promoted_again
from ..model import TemporalGraph, validate
from .scans import edges_among
from .temporal import time_column


SAMPLE_KEY = ["ts_id", "variable", "ts"]


def _last_of(changes: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key: the last in ``order``; without an order, or at a tie, the greatest by its other columns.

    A batch may hold a key several times; the choice must not depend on how its rows are spread. Maps do not sort, so they
    are compared as sorted entries.
    """
    kinds = dict(changes.dtypes)
    rest = [c for c in changes.columns if c not in keys and c != order]
    sortable = lambda c: F.array_sort(F.map_entries(c)) if kinds[c].startswith("map<") else F.col(c)
    rank = F.struct(*([F.col(order)] if order else []), *(sortable(c).alias(f"_{i}") for i, c in enumerate(rest)))
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")) if rest else changes.select(*keys).distinct()
    return best.select(*keys, *(f"_row.{c}" for c in rest))


def upsert_samples(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Merge samples by ``ts_id, variable, ts``; new values replace old ones, the last of a key in ``order`` wins.

    Old rows pass through an anti join, which does not move them when the new ones are few.
    """
    new = _last_of(new.select(*SAMPLE_KEY, "value", *([order] if order else [])), SAMPLE_KEY, order)
    return old.select(*SAMPLE_KEY, "value").join(new, SAMPLE_KEY, "left_anti").unionByName(new)


def upsert_elements(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Merge elements by uid; a new row replaces the old one whole, the last of a uid in ``order`` wins."""
    new = promote(new, promoted(old))  # typed property columns follow from the map
    new = _last_of(new.select(*old.columns, *([order] if order else [])), ["uid"], order)
    return old.join(new.select("uid"), "uid", "left_anti").select(*old.columns).unionByName(new)


def series_id(variable, uid) -> Column:
    """The one convention for series ids: ``ts_<variable>_<uid>``."""
    return F.concat(F.lit("ts_"), variable, F.lit("_"), uid)


def _with_series_ids(elements: DataFrame, series: DataFrame | None) -> DataFrame:
    if series is None:
        return elements
    names = series.groupBy("uid").agg(F.collect_set("variable").alias("_vars"))  # one entry per variable of an element
    ids = F.map_from_entries(F.transform("_vars", lambda v: F.struct(v, series_id(v, F.col("uid")))))
    merged = F.map_concat(F.map_filter("ts_ids", lambda k, v: ~F.array_contains("_vars", k)), ids)
    return elements.join(names, "uid", "left").withColumn("ts_ids", F.when(F.col("_vars").isNull(), F.col("ts_ids")).otherwise(merged)).drop("_vars")


def _samples_of(series: DataFrame) -> DataFrame:
    return series.select(series_id(F.col("variable"), F.col("uid")).alias("ts_id"), "variable", "ts", F.coalesce("value", F.lit(0.0)).alias("value"))


def create_nodes(g: TemporalGraph, nodes: DataFrame, series: DataFrame | None = None) -> tuple[TemporalGraph, DataFrame]:
    """Add valid nodes with their series (``uid, variable, ts, value``); also gives the rejects."""
    good, bad = validate(nodes)
    out = g.with_(nodes=upsert_elements(g.nodes, _with_series_ids(good, series)))
    if series is not None:
        out = out.with_(measurements=upsert_samples(g.measurements, _samples_of(series.join(good, "uid", "left_semi"))))
    return out, bad


def create_edges(g: TemporalGraph, edges: DataFrame, series: DataFrame | None = None) -> tuple[TemporalGraph, DataFrame]:
    """Add valid edges whose both ends exist."""
    good, bad = validate(edges, is_edge=True)
    linked = edges_among(good, g.nodes)
    lost = good.join(linked.select("uid"), "uid", "left_anti").withColumn("reason", F.lit("unknown source or target"))
    out = g.with_(edges=upsert_elements(g.edges, _with_series_ids(linked, series)))
    if series is not None:
        out = out.with_(measurements=upsert_samples(g.measurements, _samples_of(series.join(linked, "uid", "left_semi"))))
    return out, bad.unionByName(lost)


def flatten_series(wide: DataFrame, variables: list[str]) -> DataFrame:
    """Series given as arrays ``ts_id, ts[], <variable>[]`` to long rows; a missing value is 0."""
    steps = wide.select("ts_id", F.posexplode("ts").alias("i", "ts"), *variables)
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.coalesce(F.get(F.col(v), F.col("i")).cast("double"), F.lit(0.0)).alias("value")) for v in variables])
    return steps.withColumn("c", F.explode(cells)).select("ts_id", "c.variable", "ts", "c.value")


def set_properties(elements: DataFrame, changes: DataFrame, mode: str = "merge", order: str | None = None) -> DataFrame:
    """``changes`` has ``uid, props``; merge into the properties or replace them. Of several rows of a uid the last in ``order`` counts."""
    new = _last_of(changes.select("uid", "props", *([order] if order else [])), ["uid"], order).withColumnRenamed("props", "_new")
    keep = F.map_filter("props", lambda k, v: ~F.array_contains(F.map_keys("_new"), k)) if mode == "merge" else None
    merged = F.map_concat(keep, F.col("_new")) if mode == "merge" else F.col("_new")
    return promoted_again(elements.join(new, "uid", "left").withColumn("props", F.when(F.col("_new").isNull(), F.col("props")).otherwise(merged)).drop("_new"))


def add_series(g: TemporalGraph, kind: str, series: DataFrame) -> TemporalGraph:
    """Append or overwrite samples (``uid, variable, ts, value``) and register their series on the elements."""
    known = series.join(g.elements(kind), "uid", "left_semi")
    changed = _with_series_ids(g.elements(kind), known)
    return g.with_(**{f"{kind}s": changed}, measurements=upsert_samples(g.measurements, _samples_of(known)))


def change_validity(elements: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """``changes`` has ``uid, start_time, end_time``; a NULL leaves that end as it is. Of several rows of a uid the last in ``order`` counts."""
    new = _last_of(changes.select("uid", "start_time", "end_time", *([order] if order else [])), ["uid"], order).toDF("uid", "_s", "_e")
    return elements.join(new, "uid", "left").withColumns({
        "start_time": F.coalesce("_s", "start_time"), "end_time": F.coalesce("_e", "end_time")}).drop("_s", "_e")


def extend_validity(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """Move the end of validity; ``changes`` has ``uid, end_time``."""
    return change_validity(elements, changes.select("uid", F.lit(None).cast("timestamp").alias("start_time"), "end_time"))


def soft_delete(elements: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    gone = ids.select("uid", F.lit(True).alias("_gone")).distinct()
    return elements.join(gone, "uid", "left").withColumn(
        "end_time", F.when(F.col("_gone"), time_column(as_of)).otherwise(F.col("end_time"))).drop("_gone")


def delete_nodes(g: TemporalGraph, ids: DataFrame) -> TemporalGraph:
    """Remove nodes, their edges, and the samples of both."""
    gone = ids.select("uid").distinct()
    nodes = g.nodes.join(gone, "uid", "left_anti")
    edges = g.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("uid", end), end, "left_anti")
    edges = edges.select(*g.edges.columns)
    return _drop_samples(g, nodes, edges)


def delete_edges(g: TemporalGraph, ids: DataFrame) -> TemporalGraph:
    return _drop_samples(g, g.nodes, g.edges.join(ids.select("uid").distinct(), "uid", "left_anti"))


def _drop_samples(g: TemporalGraph, nodes: DataFrame, edges: DataFrame) -> TemporalGraph:
    ids = lambda n, e: n.select(F.explode(F.map_values("ts_ids")).alias("ts_id")).unionByName(e.select(F.explode(F.map_values("ts_ids")).alias("ts_id"))).distinct()
    lost = ids(g.nodes, g.edges).join(ids(nodes, edges), "ts_id", "left_anti")
    return g.with_(nodes=nodes, edges=edges, measurements=g.measurements.join(lost, "ts_id", "left_anti"), named_series=g.named_series)


def delete_samples(m: DataFrame, ids: list[str] | None = None, variables: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Remove the samples that meet all given conditions; a range is closed."""
    doomed = F.lit(True)
    if ids:
        doomed = doomed & F.col("ts_id").isin(ids)
    if variables:
        doomed = doomed & F.col("variable").isin(variables)
    if start is not None:
        doomed = doomed & (F.col("ts") >= time_column(start))
    if end is not None:
        doomed = doomed & (F.col("ts") <= time_column(end))
    return m.filter(~doomed)


def attach_series(g: TemporalGraph, kind: str, members: DataFrame, points: DataFrame, variable: str, copies: bool = False,
                  shared_id: str | None = None) -> TemporalGraph:
    """Attach one series (``ts, value``), e.g. a generated one, to every member (``uid``).

    The samples are stored once, under ``shared_id`` (``ts_<variable>_shared`` if None), and all members refer to them: later changes
    of the series are seen by each. With ``copies`` every member has its own, which is what independent changes need.
    """
    owners = members.select("uid").distinct().join(g.elements(kind), "uid", "left_semi")
    if copies:
        every = owners.crossJoin(points.select("ts", "value"))  # the product is the result: a copy per member
        return add_series(g, kind, every.select("uid", F.lit(variable).alias("variable"), "ts", "value"))
    name = F.lit(shared_id) if shared_id else series_id(F.lit(variable), F.lit("shared"))
    elements = g.elements(kind)
    others = F.map_filter("ts_ids", lambda k, v: k != variable)
    referring = F.map_concat(F.coalesce(others, F.create_map().cast("map<string,string>")), F.create_map(F.lit(variable), name))
    changed = (elements.join(owners.withColumn("_owner", F.lit(True)), "uid", "left")
               .withColumn("ts_ids", F.when(F.col("_owner"), referring).otherwise(F.col("ts_ids"))).drop("_owner"))
    samples = points.select(name.alias("ts_id"), F.lit(variable).alias("variable"), "ts", F.coalesce("value", F.lit(0.0)).alias("value"))
    return g.with_(**{f"{kind}s": changed}, measurements=upsert_samples(g.measurements, samples))


def attach_graph_series(g: TemporalGraph, points: DataFrame, variable: str, owner: str = "__graph__") -> TemporalGraph:
    rows = points.select(F.lit(owner).alias("uid"), F.lit(variable).alias("variable"), "ts", "value")
    return g.with_(measurements=upsert_samples(g.measurements, _samples_of(rows)))


def append_samples(m: DataFrame, new: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Append samples later than the last one of their series, in the batch's ``order`` (that of time if None).

    Rejects come back: samples that are not later than the table's last one, or than one that stands before them in the batch. At
    equal times the first in ``order`` is appended; without an order the one with the smallest value.
    """
    last = m.groupBy("ts_id", "variable").agg(F.max("ts").alias("_last"))
    if order:
        earlier = F.max("ts").over(Window.partitionBy("ts_id", "variable").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    else:  # in order of time only rows at the same time compete
        earlier = F.lag("ts").over(Window.partitionBy(*SAMPLE_KEY).orderBy("value"))
    checked = new.withColumn("_before", earlier).join(last, ["ts_id", "variable"], "left")
    late = F.col("ts") > F.greatest("_last", "_before")  # null for the first sample of a new series
    accepted = checked.filter(F.coalesce(late, F.lit(True)) & F.col("ts").isNotNull()).select(*m.columns)
    return m.unionByName(accepted), checked.filter(~F.coalesce(late, F.lit(True)) | F.col("ts").isNull()).drop("_last", "_before")


def update_samples(m: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Change values of existing samples; others are ignored. Of several changes of a sample the last in ``order`` counts."""
    fresh = _last_of(new.select(*SAMPLE_KEY, "value", *([order] if order else [])), SAMPLE_KEY, order).withColumnRenamed("value", "_new")
    return m.join(fresh, ["ts_id", "variable", "ts"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def remove_property(elements: DataFrame, name: str, kind: str = "any") -> DataFrame:
    """Drop a static property, a series reference, or both of a name."""
    changes = {}
    if kind in ("static", "any"):
        changes["props"] = F.map_filter("props", lambda k, v: k != name)
    if kind in ("temporal", "any"):
        changes["ts_ids"] = F.map_filter("ts_ids", lambda k, v: k != name)
    return promoted_again(elements.withColumns(changes)) if "props" in changes else elements.withColumns(changes)


def add_tags(elements: DataFrame, tags: list[str]) -> DataFrame:
    return elements.withColumn("tags", F.array_union(_tags(elements), F.array(*[F.lit(t) for t in tags])))


def remove_tag(elements: DataFrame, tag: str) -> DataFrame:
    return elements.withColumn("tags", F.array_remove(_tags(elements), tag))


def has_tag(elements: DataFrame, tag: str) -> DataFrame:
    return elements.filter(F.array_contains(_tags(elements), tag))


def _tags(elements: DataFrame) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.col("tags"), empty) if "tags" in elements.columns else empty


def set_computed(elements: DataFrame, name: str, value: Column) -> DataFrame:
    """A computed value in the element's metadata map."""
    empty = F.create_map().cast("map<string,string>")
    meta = F.coalesce(F.col("meta"), empty) if "meta" in elements.columns else empty
    kept = F.map_filter(meta, lambda k, v: k != name)
    return elements.withColumn("meta", F.map_concat(kept, F.create_map(F.lit(name), value.cast("string"))))


def get_computed(name: str) -> Column:
    return F.col("meta").getItem(name)
