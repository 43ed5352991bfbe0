"""How much of a store's online sales depends on the store: training, scoring, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.functions.codes import fill_gaps, holiday_flag, keep_columns
from tradearea.functions.measures import negative_only, online_contribution, percent_of
from tradearea.operators.encoding import corr_with, encode, numeric_columns, top_correlated, vocabulary
from tradearea.operators.models import feature_importance, fit_forest, score
from tradearea.plans.overlap import overlap_population, overlap_tracts, total_population
from tradearea.schemas import (
    FEATURES, HOLIDAY_WEEKS, LAST_WEEK, OUTLIER_FACTOR, TOP_CORRELATED, TOP_IMPORTANT,
)

TARGET = "store_online_gross_sales"
CATEGORIES = ("calendar_season_cd", "store_volume_cd", "fashion_attribute_cd")
NOT_FEATURES = ("store_nbr", "closure_factor", "mod_closure_factor", TARGET)


def negative_factors(factors: DataFrame) -> DataFrame:
    """Stores whose closing lost sales; the others are clipped to 0 and dropped."""
    return factors.withColumn("closure_factor", negative_only(F.col("closure_factor"))).filter("closure_factor < 0")


def with_overlap(weekly: DataFrame, areas: DataFrame, shared: DataFrame, tracts: DataFrame) -> DataFrame:
    """Population of the whole area and of its shared tracts, NULL for stores without an area."""
    total = total_population(areas, tracts).withColumnRenamed("population", "pop_25_years_over")
    return weekly.join(overlap_population(areas, shared, tracts), "store_nbr", "left").join(total, "store_nbr", "left")


def training_base(weekly: DataFrame, factors: DataFrame, closed_areas: DataFrame, open_areas: DataFrame,
                  competitors: DataFrame, tracts: DataFrame) -> DataFrame:
    """Weeks of the closed stores with target, overlap, competitors and holiday flag."""
    shared = overlap_tracts(open_areas.select("store_nbr", "geoid").unionByName(closed_areas.select("store_nbr", "geoid")))
    known = weekly.join(negative_factors(factors), "store_nbr").withColumn(
        TARGET, online_contribution(F.col("online_gross_sales"), F.col("closure_factor")))
    full = with_overlap(known, closed_areas, shared, tracts).join(competitors, "store_nbr")
    return fill_gaps(full).withColumn("holiday_ind", holiday_flag(F.col("week"))).withColumn(
        "mod_closure_factor", F.col("closure_factor"))


def scoring_base(weekly: DataFrame, open_areas: DataFrame, competitors: DataFrame, tracts: DataFrame) -> DataFrame:
    """Weeks of the open stores; stores without competitor data stay, with zeros."""
    shared = overlap_tracts(open_areas)
    full = with_overlap(weekly, open_areas, shared, tracts).join(competitors, "store_nbr", "left")
    return fill_gaps(full).withColumn("holiday_ind", holiday_flag(F.col("week")))


def vocabularies(training: DataFrame, scoring: DataFrame) -> dict[str, DataFrame]:
    """Season codes from training only; volume and fashion codes from both tables."""
    return {
        "calendar_season_cd": vocabulary("calendar_season_cd", training),
        "store_volume_cd": vocabulary("store_volume_cd", training, scoring),
        "fashion_attribute_cd": vocabulary("fashion_attribute_cd", training, scoring),
    }


def closure_sets(training: DataFrame, scoring: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the category codes added."""
    codes = vocabularies(training, scoring)
    return encode(training, codes), encode(scoring, codes)


def correlations(training: DataFrame) -> DataFrame:
    """Correlation of every numeric feature with the target; the factor itself is not a feature."""
    return corr_with(training, TARGET, numeric_columns(training, NOT_FEATURES))


def select_features(training: DataFrame, top: int = TOP_CORRELATED, keep: int = TOP_IMPORTANT, **options) -> DataFrame:
    """(column_name, importance) of the best features among the most correlated ones.

    Only the short list of column names comes to the driver.
    """
    names = [r.column_name for r in top_correlated(correlations(training), top).collect()]
    return feature_importance(training, names, TARGET, **options).limit(keep)


def feature_table(training: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    return keep_columns(training, [*names, TARGET])


def closure_forecast(training: DataFrame, scoring: DataFrame, features: Sequence[str] = FEATURES, **options) -> DataFrame:
    """Scoring rows with the forecast store-driven online sales."""
    return score(fit_forest(training, features, TARGET, **options), scoring)


def with_factor(scored: DataFrame) -> DataFrame:
    """Forecast as a percentage of online sales; NULL without online sales."""
    return scored.withColumn("closure_factor", percent_of(F.col("forecast"), F.col("online_gross_sales")))


def quiet_weeks(scored: DataFrame, holidays: Sequence[int] = HOLIDAY_WEEKS, last: int = LAST_WEEK) -> DataFrame:
    return scored.filter(~F.col("week").isin(*holidays) & (F.col("week") <= last))


def closure_report(scored: DataFrame) -> DataFrame:
    """Mean closure factor per store over the quiet weeks."""
    return quiet_weeks(with_factor(scored)).groupBy("store_nbr").agg(F.avg("closure_factor").alias("closure_factor"))


def closure_summary(report: DataFrame, limit: float = OUTLIER_FACTOR) -> DataFrame:
    """Mean over stores with and without the outliers."""
    factor = F.col("closure_factor")
    return report.agg(
        F.avg(factor).alias("mean_factor"), F.avg(F.when(factor < limit, factor)).alias("mean_without_outliers"),
        F.count(F.lit(1)).alias("stores"))


def closure_outliers(report: DataFrame, limit: float = OUTLIER_FACTOR) -> DataFrame:
    return report.filter(F.col("closure_factor") >= limit)


def closure_top(report: DataFrame, n: int = 10) -> DataFrame:
    return report.orderBy(F.col("closure_factor").desc_nulls_last(), "store_nbr").limit(n)


def store_info_rows(scoring: DataFrame) -> DataFrame:
    return scoring.select("store_nbr", "pop_25_years_over", "census_block_counts").distinct()
