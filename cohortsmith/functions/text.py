"""Small scalar text helpers shared by the operators (FN-08…13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(x: Column) -> Column:
    """FN-10: ``{:.1}`` formatting — round half to even on the exact binary value.

    ``format_number`` with a ``DecimalFormat`` pattern does exactly that (and never adds
    grouping separators with the pattern ``0.0``); ``format_string('%.1f')`` does not.
    """
    return F.call_function("format_number", x.cast("double"), F.lit("0.0"))


def option_debug(x: Column) -> Column:
    """FN-13: debug text of an optional value, ``Some(v)`` or ``None``."""
    return F.coalesce(F.concat(F.lit("Some("), x, F.lit(")")), F.lit("None"))


def join_or(arr: Column, sep: str, empty: str) -> Column:
    """FN-08 + fallback: ``array_join`` or a fixed text when the array is empty."""
    return F.when(F.size(arr) == 0, F.lit(empty)).otherwise(F.array_join(arr, sep))


def zero_padded_id(prefix: str, n: Column, width: int = 9) -> Column:
    """FN-09 / GEN-09: ``P%09d`` (wider numbers widen, never truncate)."""
    return F.format_string(f"{prefix}%0{width}d", n.cast("long"))


def sql_string(x: str) -> str:
    """A Spark SQL string literal (backslash escapes are on by default)."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def str_array(items) -> Column:
    """A literal ``array<string>`` as one SQL expression (one JVM call instead of one per item)."""
    return F.expr("array(" + ", ".join(sql_string(x) for x in items) + ")")
