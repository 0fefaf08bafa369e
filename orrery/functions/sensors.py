"""Rules for ground sensors: what a sheet leaves open, and what a sensor can see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sensor_type(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return F.when(t == "PHASED ARRAY RADAR", "PHASED_ARRAY_RADAR").otherwise(t)


def aperture_m(remarks: Column) -> Column:
    """The first length in metres that remarks give, if a telescope can have it (0.1 to 10)."""
    found = F.regexp_extract(F.coalesce(remarks, F.lit("")), r"(\d+\.?\d*)\s*m\b", 1).try_cast("double")
    return F.when(found.between(0.1, 10.0), found)


def estimates(kind: Column, remarks: Column) -> Column:
    """A struct of MIN_RANGE_KM, MAX_RANGE_KM, ALT_M and SENSITIVITY; an unknown kind counts as optical.

    Sensitivity is the least cross-section in m2 of a radar, the limiting magnitude of others.
    """
    t, says = F.upper(kind), F.lower(F.coalesce(remarks, F.lit("")))
    has = lambda *words: F.greatest(*[F.contains(says, F.lit(w)) for w in words], F.lit(False))
    wide = aperture_m(remarks)
    # Key words of each kind with greatest range and sensitivity; least range and altitude.
    known = [
        (t == "RADAR", [(has("64m", "34m"), 5000.0, 0.01), (has("trajectography", "satam"), 1500.0, 0.1), (has("600m ring"), 3000.0, 0.1), (None, 2000.0, 0.5)], 200.0, 500.0),
        (t == "PHASED_ARRAY_RADAR", [(has("vhf"), 6000.0, 0.1), (has("l-band"), 3000.0, 0.05), (None, 3000.0, 0.1)], 200.0, 500.0),
        (t == "LASER", [(None, 40000.0, 18.0)], 300.0, 800.0),
        (None, [(wide.isNull(), 36000.0, 18.0), (wide >= 2.0, 42000.0, 21.0), (wide >= 1.0, 40000.0, 20.0), (wide >= 0.5, 36000.0, 18.0), (None, 2000.0, 16.0)], 200.0, 1000.0),
    ]

    def tree(rows: list[tuple[Column | None, Column]]) -> Column:
        out = rows[-1][1]
        for test, value in reversed(rows[:-1]):
            out = F.when(test, value).otherwise(out)
        return out

    def pick(i: int) -> Column:
        return tree([(test, tree([(when, F.lit(row[i])) for when, *row in rules])) for test, rules, _, _ in known])

    return F.struct(tree([(k[0], F.lit(k[2])) for k in known]).alias("MIN_RANGE_KM"), pick(0).alias("MAX_RANGE_KM"), tree([(k[0], F.lit(k[3])) for k in known]).alias("ALT_M"), pick(1).alias("SENSITIVITY"))


def or_default(value: Column, default: float) -> Column:
    """The default stands in for zero, too, as it does in the sheets' reader."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def azimuth_open(az: Column, lo: Column, hi: Column) -> Column:
    """Within a mask that may run through north."""
    return F.when(lo <= hi, az.between(lo, hi)).otherwise((az >= lo) | (az <= hi))


def passes_gate(slant: Column, az: Column, el: Column, max_range: Column, az_min: Column, az_max: Column, min_el: Column) -> Column:
    """The gate of tasking: range, azimuth mask and least elevation."""
    return (slant <= max_range) & azimuth_open(az, az_min, az_max) & (el >= min_el)


def visible(el: Column, slant: Column, min_el: Column, max_range: Column) -> Column:
    """The gate of passes: least elevation and range alone."""
    return (el >= min_el) & (slant <= max_range)


def least_altitude(min_range: Column, min_el_deg: Column) -> Column:
    """Altitude below which nothing is within a sensor's reach."""
    return F.greatest(F.lit(0.0), min_range * F.sin(F.radians(min_el_deg)))
