"""Labels of events, and how missing values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(miss_km: Column, red_km: float = 5.0, warn_km: float = 25.0) -> Column:
    return F.when(miss_km <= red_km, "RED").when(miss_km <= warn_km, "WARN")


def disturbed(kp: Column, threshold: float = 5.0) -> Column:
    """A missing index is not disturbed: comparisons with NaN are true in Spark, so NaN counts as missing."""
    return F.coalesce(F.nanvl(kp, F.lit(None).cast("double")) >= threshold, F.lit(False))


def above(value: Column, threshold: Column) -> Column:
    """Strictly above, never for a missing or infinite value."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.coalesce(finite & (value > threshold), F.lit(False))


def classification(likely: Column, bad_weather: Column) -> Column:
    return F.when(likely & ~bad_weather, "confirmed").when(likely & bad_weather, "uncertain")


def shown(text: Column, width: int | None = None, default: str = "?") -> Column:
    """Text for a report: a default for null and blank, cut to a width."""
    out = F.coalesce(F.nullif(text, F.lit("")), F.lit(default))
    return F.substring(out, 1, width) if width else out
