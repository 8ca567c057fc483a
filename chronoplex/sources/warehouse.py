"""Star-schema tables as two temporal graphs: orders between suppliers and customers, and signals of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TemporalGraph
from ..plans.positions import exact_percentiles

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE"
ORDER_SCHEMA = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP"
LINE_SCHEMA = ("l_orderkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
               "l_shipdate TIMESTAMP")


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of the warehouse; an explicit schema reads its times as instants, which filters can reach."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _text_map(*pairs) -> Column:
    return F.map_filter(
        F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))]),
        lambda k, v: v.isNotNull(),
    )


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def order_graph(spark: SparkSession, sf_dir: str) -> TemporalGraph:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    orders = table(spark, sf_dir, "orders", ORDER_SCHEMA)
    lines = table(spark, sf_dir, "lineitem", LINE_SCHEMA)

    active = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("start_time"),
        (F.max("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("end_time"),
    )
    customers = customer.join(active, customer.c_custkey == active.o_custkey).select(
        F.concat(F.lit("C"), "c_custkey").alias("uid"), F.lit("Customer").alias("label"),
        "start_time", "end_time",
        _text_map(("acctbal", F.col("c_acctbal")), ("segment", F.col("c_mktsegment")),
                  ("nationkey", F.col("c_nationkey"))).alias("props"),
        empty_map().alias("ts_ids"),
    )
    suppliers = supplier.select(
        F.concat(F.lit("S"), "s_suppkey").alias("uid"), F.lit("Supplier").alias("label"),
        F.lit(None).cast("timestamp").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"),
        _text_map(("acctbal", F.col("s_acctbal")), ("nationkey", F.col("s_nationkey"))).alias("props"),
        empty_map().alias("ts_ids"),
    )
    per_pair = lines.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"),
        F.count(F.lit(1)).alias("lines"), F.max("l_shipdate").alias("shipped"),
    )
    start = F.col("o_orderdate")
    edges = per_pair.join(orders, per_pair.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("O"), "o_orderkey", F.lit("_S"), "l_suppkey").alias("uid"),
        F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst"),
        F.lit("Supplies").alias("label"), start.alias("start_time"),
        F.when(F.col("shipped") > start, F.col("shipped")).otherwise(start + F.expr("INTERVAL 90 DAYS")).alias("end_time"),
        _text_map(("quantity", F.col("quantity")), ("price", F.col("price")), ("lines", F.col("lines"))).alias("props"),
        empty_map().alias("ts_ids"),
    )
    return TemporalGraph(customers.unionByName(suppliers), edges, _signals(spark, sf_dir).limit(0))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", EVENT_SCHEMA)
    return events.select(
        F.concat(F.lit("ts_"), "event_type", F.lit("_"), "user_id").alias("ts_id"),
        F.col("event_type").alias("variable"), "ts", "value",
    )


def daily(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("ts_id", "variable", F.date_trunc("day", "ts").alias("ts")).agg(
        F.avg("value").alias("value"))


def signal_graph(spark: SparkSession, sf_dir: str, by_day: bool = True, with_base: bool = False) -> TemporalGraph:
    """Users linked to near peers; measurements raw or averaged per day.

    ``with_base`` adds ``base_<type>``, the exact 95th percentile of the user's daily values.
    """
    events = table(spark, sf_dir, "events", EVENT_SCHEMA)
    customer = table(spark, sf_dir, "customer")
    raw = _signals(spark, sf_dir)
    measurements = daily(raw) if by_day else raw
    kinds = events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))  # at most five entries
    people = customer.join(kinds, customer.c_custkey == kinds.user_id)
    props = _text_map(("acctbal", F.col("c_acctbal")), ("nationkey", F.col("c_nationkey")))
    if with_base:
        per_day = events.groupBy("user_id", "event_type", F.date_trunc("day", "ts").alias("d")).agg(F.avg("value").alias("v"))
        p95 = exact_percentiles(per_day, ["user_id", "event_type"], "v", {"p95": 0.95})
        bases = p95.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(  # at most five entries
            F.concat(F.lit("base_"), "event_type"), F.col("p95").cast("string")))).alias("bases"))
        people = people.join(bases, "user_id", "left")
        props = F.map_concat(props, F.coalesce("bases", empty_map()))
    ids = F.map_from_entries(F.transform("kinds", lambda k: F.struct(k, F.concat(F.lit("ts_"), k, F.lit("_"), F.col("c_custkey").cast("string")))))
    nodes = people.select(
        F.concat(F.lit("U"), "c_custkey").alias("uid"), F.lit("User").alias("label"),
        F.lit(None).cast("timestamp").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"),
        props.alias("props"), ids.alias("ts_ids"),
    )
    return TemporalGraph(nodes, _peers(spark, sf_dir, events, customer), measurements, named_series=True)


def _peers(spark: SparkSession, sf_dir: str, events: DataFrame, customer: DataFrame, reach: int = 50) -> DataFrame:
    """Pairs u < v <= u + reach of one nation, by an equi-join on id bands of that width."""
    users = customer.join(events.select("user_id").distinct(), F.col("c_custkey") == F.col("user_id"), "left_semi")
    band = F.floor(F.col("c_custkey") / reach)
    low = users.select("c_nationkey", F.col("c_custkey").alias("u"), F.explode(F.array(band, band + 1)).alias("band"))
    high = users.select("c_nationkey", F.col("c_custkey").alias("v"), band.alias("band"))
    pairs = low.join(high, ["c_nationkey", "band"]).filter((F.col("u") < F.col("v")) & (F.col("v") - F.col("u") <= reach))
    turned = (F.col("u") + F.col("v")) % 3 == 0
    u, v = F.concat(F.lit("U"), "u"), F.concat(F.lit("U"), "v")
    return pairs.select(
        F.concat(F.lit("P"), "u", F.lit("_"), "v").alias("uid"),
        F.when(turned, v).otherwise(u).alias("src"), F.when(turned, u).otherwise(v).alias("dst"),
        F.lit("Peer").alias("label"),
        F.lit(None).cast("timestamp").alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"),
        _text_map(("weight", F.try_divide(F.lit(1.0), (F.col("v") - F.col("u")).cast("double")))).alias("props"), empty_map().alias("ts_ids"),
    )
