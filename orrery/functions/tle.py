"""Fields of two-line element sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres of an Earth radius, for the drag term.
EARTH_KM = 6378.137


def bstar(line1: Column) -> Column:
    """Drag term of a first line: sign, five digits after the point and an exponent, in columns 54 to 61.

    A corrupt field is 0; a null line is null.
    """
    field = F.substring(line1, 54, 8)
    sign = F.when(F.substring(field, 1, 1) == "-", -1.0).otherwise(1.0)
    digits = F.substring(field, 2, 5).try_cast("double") * F.lit(1e-5)
    exponent = F.substring(field, 7, 2).try_cast("int")
    whole = F.when(F.length(field) == 8, sign * digits * F.pow(F.lit(10.0), exponent)).otherwise(F.trim(field).try_cast("double"))
    return F.when(line1.isNotNull(), F.coalesce(whole, F.lit(0.0)))


def usable(line1: Column, line2: Column) -> Column:
    """Both lines are there and look like lines of an element set."""
    return F.coalesce(line1.startswith("1 ") & line2.startswith("2 ") & (F.length(line1) >= 61) & (F.length(line2) >= 63), F.lit(False))


def drag_per_metre(bstar: Column) -> Column:
    """From 1 / Earth radii to 1 / metres."""
    return bstar / F.lit(EARTH_KM) / F.lit(1000.0)
