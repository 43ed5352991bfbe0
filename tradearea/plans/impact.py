"""Effect of a closure on the open stores around it, cleared of the market-wide shock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.functions.measures import relative_difference
from tradearea.operators.grouped import quantiles
from tradearea.sources.scratch import cut


def closure_pairs(overlaps: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Closed and open stores whose areas share enough of the closed store's population."""
    return overlaps.filter(F.col("share") >= min_share).select("closed_store", "open_store")


def pandemic_factor(forecasts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean relative difference per month over the open stores no closure touches."""
    touched = pairs.select(F.col("open_store").alias("store_nbr")).distinct()
    return forecasts.join(touched, "store_nbr", "left_anti").groupBy("month").agg(
        F.avg("relative_difference").alias("pandemic_factor"), F.count(F.lit(1)).alias("stores"))


def closure_impact(forecasts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair and month: difference to forecast, shock of the month, and what is left of it.

    The shock meets the months of the stores, not those of the pairs, which are by far the most rows.
    """
    pairs, forecasts = cut(pairs, "pairs"), cut(forecasts, "forecasts")
    factor = pandemic_factor(forecasts, pairs).drop("stores")
    rows = cut(forecasts.withColumnRenamed("store_nbr", "open_store").select(
        "open_store", "month", "actual", "predicted",
        relative_difference(F.col("actual"), F.col("predicted")).alias("pct_difference")).join(factor, "month").withColumn(
        "impact", F.col("pct_difference") - F.col("pandemic_factor")), "months")
    return pairs.join(rows.hint("merge"), "open_store").select(
        "month", "open_store", "closed_store", "actual", "predicted", "pct_difference", "pandemic_factor", "impact")


def recovery_rate(impact: DataFrame, lost: DataFrame) -> DataFrame:
    """Sales lifted at the paired stores as a part of the sales lost with the closed store.

    Months are added up per pair first, which needs no exchange: they come by open store.
    """
    of_pair = impact.groupBy("closed_store", "open_store").agg(F.sum(F.col("impact") * F.col("predicted")).alias("_lifted"))
    lifted = of_pair.groupBy("closed_store").agg(
        F.sum("_lifted").alias("lifted_sales"), F.count("open_store").alias("open_stores"))
    return lifted.join(lost, "closed_store").withColumn(
        "recovery_rate", F.try_divide("lifted_sales", "lost_sales"))


def lost_sales(closed_forecasts: DataFrame) -> DataFrame:
    """Forecast sales of the closed stores over the compared months."""
    return closed_forecasts.groupBy(F.col("store_nbr").alias("closed_store")).agg(
        F.sum("predicted").alias("lost_sales"))


def similar_stores(stores: DataFrame, region: str = "region", measure: str = "sales") -> DataFrame:
    """(store_nbr, region, tier, store_group): region by third of the sales in it."""
    cuts = quantiles(stores, measure, {"low": 1 / 3, "high": 2 / 3}, [region])
    tier = F.when(F.col(measure) <= F.col("low"), "small").when(F.col(measure) <= F.col("high"), "medium").otherwise("large")
    return stores.join(cuts, region).withColumn("tier", tier).select(
        "store_nbr", region, "tier", F.concat_ws("/", region, "tier").alias("store_group"))


def group_performance(forecasts: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean relative difference of the open stores of a group, per month."""
    return forecasts.join(groups, "store_nbr").groupBy("store_group", "month").agg(
        F.avg("relative_difference").alias("group_difference"), F.count(F.lit(1)).alias("open_stores"))


def borrowed_history(closed: DataFrame, groups: DataFrame, performance: DataFrame) -> DataFrame:
    """Each closed store with the monthly performance of the open stores like it.

    Groups are averaged before closed stores are attached, so no store-to-store pairs arise.
    """
    return closed.join(groups, "store_nbr").join(performance, "store_group").select(
        F.col("store_nbr").alias("closed_store"), "store_group", "month", "group_difference", "open_stores")
