"""Positions and order statistics inside groups of any size.

A plain ``row_number`` over a group sends the whole group to one task. Here rows are dealt out by ranges of (keys, order) instead, with
splitters that Spark samples, so a long group goes over as many partitions as it fills, however its order values are spread. Each
partition numbers its own rows; what a group has in earlier partitions is added from a table with one row per group and partition.
There is one plan for all sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: ``monotonically_increasing_id`` holds the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def in_ranges(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows sorted by keys and order over all partitions, written once, with ``_part`` and ``_place`` in it."""
    ranged = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("_id", F.monotonically_increasing_id())
    return cut(ranged).withColumns({
        "_part": F.shiftrightunsigned("_id", _PLACE_BITS), "_place": F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("_id")


def with_position(df: DataFrame, keys: list[str], order: str, weight: str | None = None) -> DataFrame:
    """Add ``idx`` (0-based position, or weight before the row) and ``n`` (group total).

    ``order`` must be unique within a group; it may be of any type that sorts.
    """
    rows = in_ranges(df, keys, order)
    unit = F.col(weight) if weight else F.lit(1)
    mine = ["_part", *keys]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*mine).agg(F.sum(unit).alias("_size"), F.min("_place").alias("_first"))
        .withColumns({"_offset": F.coalesce(F.sum("_size").over(before), F.lit(0)), "n": F.sum("_size").over(Window.partitionBy(*keys)).cast("long")})
        .drop("_size")
    )
    if weight:
        running = Window.partitionBy(*mine).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_local", F.sum(unit).over(running) - unit)
        local = F.col("_local")
    else:
        local = F.col("_place") - F.col("_first")
    columns = [c for c in df.columns if c not in ("idx", "n")]
    # keys may be null: such rows are a group too
    matched = rows.alias("r").join(offsets.alias("o"), [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in mine])
    return matched.select(*[F.col(f"r.{c}") for c in columns], (local + F.col("_offset")).cast("long").alias("idx"), "n")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one output column per entry of ``shares``.

    Equal values are counted together before they are ordered, and a group is never held in memory.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = with_position(counted, keys, "_v", weight="_c")
    outputs = []
    for name, share in shares.items():
        rank = F.lit(float(share)) * (F.col("n") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        covers = lambda r: (F.col("idx") <= r) & (r < F.col("idx") + F.col("_c"))
        at_low, at_high = F.max(F.when(covers(low), F.col("_v"))), F.max(F.when(covers(high), F.col("_v")))
        fraction = F.max(rank - low)
        outputs.append((at_low + (at_high - at_low) * fraction).alias(name))
    return ranked.groupBy(*keys).agg(*outputs)
