"""Aggregates over the steps of a grid by dyadic ranges.

A range of steps is the union of at most 2 log2(steps) aligned ranges of a power-of-two length. Each element adds its value to its ranges, which an
ordinary aggregate combines before the shuffle; a step then takes what its own ranges, one per length, hold. Unlike running totals this also gives minima
and maxima, and takes nothing back, so sums of fractions leave no residue. No row is made per element and step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import Grid

_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def levels(grid: Grid) -> int:
    """Lengths of ranges: 1, 2, 4, ... up to one that holds the whole grid."""
    return max(1, (grid.size - 1).bit_length() + 1)


def cover(low: Column, high: Column, n_levels: int) -> Column:
    """Structs ``level, block`` of the ranges whose union is the closed range of steps."""
    found = []
    for k in range(n_levels):
        size = 1 << k
        first = F.floor((low + (size - 1)) / size).cast("long")  # the first whole range of this length, and the one after the last
        after = F.floor((high + 1) / size).cast("long")
        here = first < after
        found.append(F.when(here & (F.pmod(first, F.lit(2)) == 1), F.struct(F.lit(k).alias("level"), first.alias("block"))))
        found.append(F.when(here & (F.pmod(after, F.lit(2)) == 1), F.struct(F.lit(k).alias("level"), (after - 1).alias("block"))))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def ancestors(grid: Grid, spark) -> DataFrame:
    """``step, level, block``: the ranges that hold each step."""
    own = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("step", k).alias("block")) for k in range(levels(grid))))
    return grid.frame(spark).select("step", F.inline(own))


def over_steps(df: DataFrame, grid: Grid, amounts: dict[str, tuple[str, Column]]) -> DataFrame:
    """``step`` and an aggregate per entry over the rows whose steps ``_lo`` to ``_hi`` hold it; steps without rows have none."""
    ranges = df.select(F.explode(cover(F.col("_lo"), F.col("_hi"), levels(grid))).alias("_r"), *[c.alias(n) for n, (_, c) in amounts.items()])
    held = ranges.groupBy("_r.level", "_r.block").agg(*[_FIRST[kind](n).alias(n) for n, (kind, _) in amounts.items()])
    return ancestors(grid, df.sparkSession).join(held, ["level", "block"]).groupBy("step").agg(*[_COMBINE[kind](n).alias(n) for n, (kind, _) in amounts.items()])
