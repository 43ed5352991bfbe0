"""Standard scores within groups and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.operators.grouped import join_on

DIGITS = 9


def spread_by(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per group (0 where all values are equal)."""
    stats = []
    for c in cols:
        stats.append(F.avg(c).alias(f"{c}_mean"))
        stats.append(F.when(F.min(c) == F.max(c), 0.0).otherwise(F.stddev_pop(c)).alias(f"{c}_sd"))
    return df.groupBy(*by).agg(*stats)


def scale_by(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Add z_<col>, mean and spread columns; a group without spread gets 0.

    The statistics are one partial aggregate joined back, not a window, so a group with most of the
    rows is still read by many tasks. Scores are rounded so that the order of addition cannot
    change a later distance test.
    """
    scored = {
        f"z_{c}": F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_sd")), F.lit(0.0)), DIGITS)
        for c in cols
    }
    return join_on(df, spread_by(df, cols, by), by).withColumns(scored)


def unscale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add raw_<col> from z_<col>, mean and spread."""
    return df.withColumns({
        f"raw_{c}": F.col(f"z_{c}") * F.col(f"{c}_sd") + F.col(f"{c}_mean") for c in cols
    })
