"""Forecast without the shock years, set beside what happened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.functions.codes import month_date
from tradearea.functions.measures import relative_difference
from tradearea.operators.series import forecast_monthly, split_years, train_tail, wape
from tradearea.schemas import FORECAST_PERIODS, TEST_YEARS

KEY = ["store_nbr"]


def with_month(sales: DataFrame) -> DataFrame:
    return sales.select(
        F.col("store_number").alias("store_nbr"), "yearss",
        month_date(F.col("yearss"), F.col("months")).alias("month"), F.col("f0_").alias("sales"))


def forecast_vs_actual(sales: DataFrame, test_years: Sequence[int] = TEST_YEARS,
                       periods: int = FORECAST_PERIODS, relative: bool = True) -> DataFrame:
    """(store_nbr, month, predicted, lower, upper, actual[, relative_difference]).

    Only months with an actual value remain; the closed cohort is asked for without the difference.
    """
    train, test = split_years(with_month(sales), "yearss", test_years)
    ahead = forecast_monthly(train, KEY, "month", "sales", periods)
    actual = test.groupBy(*KEY, "month").agg(F.sum("sales").alias("actual"))
    out = ahead.join(actual, [*KEY, "month"]).select(
        *KEY, "month", F.col("yhat").alias("predicted"), "lower", "upper", "actual")
    if relative:
        out = out.withColumn("relative_difference", relative_difference(F.col("actual"), F.col("predicted")))
    return out


def forecast_with_tail(sales: DataFrame, test_years: Sequence[int] = TEST_YEARS,
                       periods: int = FORECAST_PERIODS) -> DataFrame:
    """Forecast months with the last training values beside them by position (for comparison only)."""
    train, _ = split_years(with_month(sales), "yearss", test_years)
    ahead = forecast_monthly(train, KEY, "month", "sales", periods)
    tail = train_tail(train, KEY, "month", "sales", periods)
    return ahead.join(tail, [*KEY, "position"], "left").select(*KEY, "position", "month", "yhat", "train_tail")


def forecast_error(compared: DataFrame) -> DataFrame:
    return compared.groupBy(*KEY).agg(wape("actual", "predicted").alias("wape"), F.count(F.lit(1)).alias("months"))


def mean_error(errors: DataFrame) -> DataFrame:
    return errors.agg(F.avg("wape").alias("mean_wape"), F.count(F.lit(1)).alias("stores"))
