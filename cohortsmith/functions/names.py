"""Person-name struct and its text formats (GEN-20…23) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_struct(first: Column, last: Column, middle_initial: Column | None = None,
                suffix: Column | None = None) -> Column:
    """GEN-23: ``struct(first_name, last_name, middle_initial, name_suffix)``."""
    null = F.lit(None).cast("string")
    return F.struct(
        first.alias("first_name"),
        last.alias("last_name"),
        (middle_initial if middle_initial is not None else null).alias("middle_initial"),
        (suffix if suffix is not None else null).alias("name_suffix"),
    )


def _parts(name: Column):
    return name["first_name"], name["last_name"], name["middle_initial"], name["name_suffix"]


def full_name(name: Column) -> Column:
    """GEN-20: ``First M. Last, Suffix`` (middle initial and suffix optional)."""
    first, last, mi, suffix = _parts(name)
    return F.concat(
        first,
        F.coalesce(F.concat(F.lit(" "), mi, F.lit(".")), F.lit("")),
        F.lit(" "),
        last,
        F.coalesce(F.concat(F.lit(", "), suffix), F.lit("")),
    )


def sort_key(name: Column) -> Column:
    """GEN-21: ``Last, First M`` (no suffix)."""
    first, last, mi, _ = _parts(name)
    return F.concat(last, F.lit(", "), first, F.coalesce(F.concat(F.lit(" "), mi), F.lit("")))


def initials(name: Column) -> Column:
    """GEN-22: ``J. A. Smith``; a blank first name contributes a space."""
    first, last, mi, _ = _parts(name)
    first_init = F.coalesce(F.nullif(F.substring(first, 1, 1), F.lit("")), F.lit(" "))
    return F.concat(first_init, F.lit(". "), F.coalesce(F.concat(mi, F.lit(". ")), F.lit("")), last)
