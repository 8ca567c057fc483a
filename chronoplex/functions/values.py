"""Property access and comparisons with the library's NULL and tolerance rules."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: numeric = and != hold within this tolerance.
EQUALITY_TOLERANCE = 1e-9

#: Column metadata that marks a typed property, types whose own order is that of their numbers, and texts that never read as a number.
_MARK = "property"
_SCANNED_NUMBERS = ("tinyint", "smallint", "int", "bigint", "double")
_WORDS, _NUMBER_WORDS = re.compile(r"[A-Za-z_ -]*[A-Za-z][A-Za-z_ -]*"), ("inf", "infinity", "nan", "d", "f")

_NUMERIC = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "=": lambda a, b: F.abs(a - b) < EQUALITY_TOLERANCE,
    "!=": lambda a, b: F.abs(a - b) >= EQUALITY_TOLERANCE,
}
_ALIASES = {"==": "=", "eq": "=", "<>": "!=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def operator_name(op: str) -> str:
    name = _ALIASES.get(op, op)
    if name not in _NUMERIC and name not in ("contains", "starts_with"):
        raise ValueError(f"unknown comparison {op!r}")
    return name


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def compare_numbers(left: Column, op: str, right) -> Column:
    """``left op right`` on doubles; NULL on either side is false."""
    test = _NUMERIC[operator_name(op)](left, as_column(right))
    return F.coalesce(test, F.lit(False))


def compare_values(left: Column, op: str, right) -> Column:
    """Static comparison: numeric when both sides read as numbers, else text for = and !=.

    A NULL on either side is false, for every operator.
    """
    op = operator_name(op)
    right = as_column(right)
    left_text, right_text = left.cast("string"), right.cast("string")
    if op == "contains":
        return F.coalesce(left_text.contains(right_text), F.lit(False))
    if op == "starts_with":
        return F.coalesce(left_text.startswith(right_text), F.lit(False))
    left_num, right_num = left_text.try_cast("double"), right_text.try_cast("double")
    numeric = left_num.isNotNull() & right_num.isNotNull()
    text = {"=": left_text == right_text, "!=": left_text != right_text}.get(op, F.lit(False))
    return F.coalesce(F.when(numeric, _NUMERIC[op](left_num, right_num)).otherwise(text), F.lit(False))


def property_column(df: DataFrame, name: str) -> Column:
    """A static property: a promoted typed column if the table has one, else the map entry."""
    if name in df.columns:
        return F.col(name)
    return F.col("props").getItem(name)


def property_number(df: DataFrame, name: str) -> Column:
    return property_column(df, name).cast("string").try_cast("double")


def property_or(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(property_column(df, name), F.lit(default).cast("string"))


def promote(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed columns made of map entries, beside the map; what does not read as the type is NULL.

    The columns know that they are properties, also after a graph was written and read, and filters on them reach its files.
    """
    return df.withColumns({k: F.col("props").getItem(k).try_cast(t).alias(k, metadata={_MARK: k}) for k, t in types.items()})


def promoted(df: DataFrame) -> dict[str, str]:
    """The typed property columns of a table with their types."""
    return {f.name: f.dataType.simpleString() for f in df.schema if f.metadata.get(_MARK) == f.name}


def promoted_again(df: DataFrame) -> DataFrame:
    """The table with its typed columns brought up to its map, after the map was changed."""
    return promote(df, promoted(df))


def compare_property(df: DataFrame, name: str, op: str, value, column: Column | None = None) -> Column:
    """:func:`compare_values` of a property, or of ``column`` by that name, in a form that the scan can use where the column is typed.

    Numbers against typed numeric columns and plain words against text columns compare as they are, without a cast around the column.
    All other comparisons of a typed property look at the map, which also holds what did not read as the type.
    """
    left = property_column(df, name) if column is None else column
    kind = promoted(df).get(name)
    op_name = operator_name(op)
    if kind in _SCANNED_NUMBERS and op_name in _NUMERIC and op_name != "!=" and isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
        exact = _NUMERIC[op_name](left, F.lit(value))
        if op_name == "=":  # a range around the tolerance for the scan
            margin = 2 * EQUALITY_TOLERANCE
            exact = (left >= value - margin) & (left <= value + margin) & exact
        return left.isNotNull() & exact
    if kind == "string" and op_name in ("=", "!=") and isinstance(value, str) and _WORDS.fullmatch(value) and value.strip().lower() not in _NUMBER_WORDS:
        return left.isNotNull() & ((left == value) if op_name == "=" else (left != value))
    return compare_values(F.col("props").getItem(name) if kind and "props" in df.columns else left, op, value)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL where either side is constant or there are under two pairs.

    ``corr`` itself fails on a constant side in ANSI mode, before any condition around it counts.
    """
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, 1))
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.when((n >= 2) & (sx > 0) & (sy > 0), F.try_divide(F.covar_pop(x, y), sx * sy))
