"""Column expressions for densities, distances, relative differences and factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradearea.schemas import MAX_DISTANCE

EARTH_RADIUS_MILES = 3958.7613


def per_capita(count: Column, population: Column) -> Column:
    """Count per head; NULL where the population is missing or zero."""
    return F.try_divide(count.cast("double"), population.cast("double"))


def finite_or(value: Column, default: float) -> Column:
    """NULL, NaN and infinities become the default."""
    wide = value.cast("double")
    usable = wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf"))
    return F.when(usable, wide).otherwise(F.lit(float(default)))


def closeness(distance: Column, limit: float = MAX_DISTANCE) -> Column:
    """Miles left to the limit: larger is nearer."""
    return F.lit(limit) - distance


def relative_difference(actual: Column, predicted: Column) -> Column:
    return F.try_divide(actual, predicted) - 1


def percent_of(part: Column, whole: Column) -> Column:
    """Part as a percentage of the whole; NULL for a zero whole."""
    return F.try_divide(part, whole) * 100


def online_contribution(online_sales: Column, factor: Column) -> Column:
    return F.abs(online_sales * factor)


def negative_only(factor: Column) -> Column:
    """Non-negative factors are clipped to 0 (and later dropped)."""
    return F.when(factor < 0, factor).otherwise(F.lit(0.0))


def closure_factor(pre: Column, baseline: Column, post: Column) -> Column:
    """Change against the expected level, relative to sales before the closure."""
    return F.try_divide(post - baseline, pre)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    chord = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
