"""Monthly forecasts of all series at once: straight trend times month-of-year index, or a bending trend times waves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tradearea.schemas import FORECAST_PERIODS, INTERVAL_Z


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def month_calendar(last: Column, periods: int = FORECAST_PERIODS) -> Column:
    """Array of the month starts that follow a month."""
    return F.sequence(F.add_months(last, 1), F.add_months(last, periods), F.expr("interval 1 month"))


def split_years(df: DataFrame, year: str, test_years: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(train, test): every other year, and the listed years."""
    listed = F.col(year).isin(*test_years)
    return df.filter(~listed), df.filter(listed)


def fit_monthly(df: DataFrame, by: Sequence[str], month: str, value: str, rounds: int = 2) -> DataFrame:
    """One row per series and month with trend, season index and fitted value.

    Rows are summed to one per series and month first, so a series is never longer than the
    calendar; all later steps are windows over that partitioning and need no further shuffle.
    Each round fits a line to the values divided by the season index, then the index to the line.
    """
    by = list(by)
    series, same_month = Window.partitionBy(*by), Window.partitionBy(*by, "moy")
    rows = df.groupBy(*by, F.col(month).alias("month")).agg(F.sum(value).alias("y")).withColumns({
        "moy": F.month("month"), "mn": month_number(F.col("month"))})
    rows = rows.withColumns({
        "first_mn": F.min("mn").over(series), "last_month": F.max("month").over(series),
    }).withColumns({"t": (F.col("mn") - F.col("first_mn")).cast("double"), "season": F.lit(1.0)})
    t, d = F.col("t"), F.col("d")
    for _ in range(rounds):
        rows = rows.withColumn("d", F.coalesce(F.try_divide("y", "season"), F.col("y")))
        rows = rows.withColumns({
            "_n": F.count(F.lit(1)).over(series).cast("double"), "_t": F.sum(t).over(series),
            "_d": F.sum(d).over(series), "_tt": F.sum(t * t).over(series), "_td": F.sum(t * d).over(series)})
        slope = F.coalesce(F.try_divide(
            F.col("_n") * F.col("_td") - F.col("_t") * F.col("_d"),
            F.col("_n") * F.col("_tt") - F.col("_t") * F.col("_t")), F.lit(0.0))
        rows = rows.withColumn("slope", slope).withColumn(
            "base", (F.col("_d") - F.col("slope") * F.col("_t")) / F.col("_n"))
        rows = rows.withColumn("trend", F.col("base") + F.col("slope") * t)
        rows = rows.withColumn("season", F.coalesce(F.try_divide(
            F.sum(F.col("y") * F.col("trend")).over(same_month),
            F.sum(F.col("trend") * F.col("trend")).over(same_month)), F.lit(1.0)))
    miss = F.col("y") - F.col("trend") * F.col("season")
    return rows.withColumn("fitted", F.col("trend") * F.col("season")).withColumn(
        "spread", F.sqrt(F.avg(miss * miss).over(series))
    ).select(*by, "month", "moy", "t", "y", "first_mn", "last_month", "base", "slope", "season", "fitted", "spread")


def forecast_monthly(df: DataFrame, by: Sequence[str], month: str, value: str,
                     periods: int = FORECAST_PERIODS, z: float = INTERVAL_Z, rounds: int = 2) -> DataFrame:
    """(by, month, yhat, lower, upper, position) for the months after each series' own end.

    The trend is one straight line, season is multiplicative; a month of the year never seen in
    training counts as average. The interval is the forecast -+ z times the residual spread.
    """
    by = list(by)
    fit = fit_monthly(df, by, month, value, rounds)
    heads = fit.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("first_mn", "last_month", "base", "slope", "spread")])
    seasons = fit.groupBy(*by, "moy").agg(F.max("season").alias("season"))
    ahead = heads.select(
        *by, "first_mn", "base", "slope", "spread",
        F.posexplode(month_calendar(F.col("last_month"), periods)).alias("position", "month"),
    ).withColumn("moy", F.month("month"))
    yhat = (F.col("base") + F.col("slope") * (month_number(F.col("month")) - F.col("first_mn"))) * F.coalesce(
        F.col("season"), F.lit(1.0))
    return ahead.join(seasons, [*by, "moy"], "left").withColumn("yhat", yhat).select(
        *by, "month", "yhat", (F.col("yhat") - z * F.col("spread")).alias("lower"),
        (F.col("yhat") + z * F.col("spread")).alias("upper"), (F.col("position") + 1).alias("position"))


BENDS, WAVES = 4, 3
#: pull towards zero of level, slope, bends and waves
RIDGE = (0.0, 0.0, 0.5, 0.05)


def terms(t: Column, month: Column, bends: int = BENDS, waves: int = WAVES) -> list[Column]:
    """Level, slope, bends of the trend at equal steps of the training span (t runs from 0 to 1), and yearly waves."""
    turn = F.lit(2 * pi / 12) * month
    out = [F.lit(1.0), t, *[F.greatest(t - F.lit((j + 1) / (bends + 1)), F.lit(0.0)) for j in range(bends)]]
    for k in range(1, waves + 1):
        out += [F.sin(turn * k), F.cos(turn * k)]
    return out


def fourier_gram(df: DataFrame, by: Sequence[str], month: str, value: str, bends: int = BENDS, waves: int = WAVES) -> DataFrame:
    """One row per series: n, first_mn, last_month, g_i_j (sums of products of two terms), r_i (of a term and log y), yy.

    Seasons are factors, so the model is linear in the logarithm; months without positive sales say nothing about it and are left out.
    One aggregate holds all a fit needs, however many months a series has.
    """
    by = list(by)
    rows = df.groupBy(*by, F.col(month).alias("month")).agg(F.sum(value).alias("y")).filter("y > 0").withColumn("mn", month_number(F.col("month")))
    ends = rows.groupBy(*by).agg(F.min("mn").alias("first_mn"), F.max("mn").alias("last_mn"), F.max("month").alias("last_month"))
    placed = rows.join(ends, by).withColumns({
        "t": F.coalesce(F.try_divide((F.col("mn") - F.col("first_mn")).cast("double"), (F.col("last_mn") - F.col("first_mn")).cast("double")), F.lit(0.0)),
        "ly": F.log("y")})
    x = terms(F.col("t"), F.month("month"), bends, waves)
    named = placed.select(*by, "first_mn", "last_mn", "last_month", "ly", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    p = range(len(x))
    return named.groupBy(*by, "first_mn", "last_mn", "last_month").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i in p for j in p if i <= j],
        *[F.sum(F.col(f"x{i}") * F.col("ly")).alias(f"r_{i}") for i in p], F.sum(F.col("ly") * F.col("ly")).alias("yy"))


def _solved(size: int, ridge: np.ndarray, keep: list[str]):
    """Coefficients and residual spread of each series of a batch, all solved together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names) if c not in keep}
            gram = np.zeros((batch.num_rows, size, size))
            for i in range(size):
                for j in range(i, size):
                    gram[:, i, j] = gram[:, j, i] = at[f"g_{i}_{j}"]
            right = np.stack([at[f"r_{i}"] for i in range(size)], axis=1)
            # a hair on the diagonal keeps series of one month solvable
            found = np.linalg.solve(gram + np.diag(ridge + 1e-9), right[:, :, None])[:, :, 0]
            miss = at["yy"] - 2 * (found * right).sum(1) + np.einsum("ni,nij,nj->n", found, gram, found)
            spread = np.sqrt(np.maximum(miss, 0) / at["n"])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in keep], pa.array(list(found), pa.list_(pa.float64())), pa.array(spread)],
                                             names=[*keep, "beta", "spread"])

    return run


def forecast_fourier(df: DataFrame, by: Sequence[str], month: str, value: str, periods: int = FORECAST_PERIODS, z: float = INTERVAL_Z,
                     bends: int = BENDS, waves: int = WAVES, ridge: Sequence[float] = RIDGE) -> DataFrame:
    """(by, month, yhat, lower, upper, position): a bending trend times yearly waves, fitted by regularised least squares.

    After the training span the last slope goes on. The interval is the forecast times and over exp(z * residual spread). Series
    without a month of positive sales have no forecast.
    """
    by = list(by)
    keep = [*by, "first_mn", "last_mn", "last_month"]
    gram = fourier_gram(df, by, month, value, bends, waves)
    pull = np.array([ridge[0], ridge[1], *[ridge[2]] * bends, *[ridge[3]] * (2 * waves)])
    schema = StructType([*[gram.schema[c] for c in keep], StructField("beta", ArrayType(DoubleType())), StructField("spread", DoubleType())])
    fit = gram.mapInArrow(_solved(2 + bends + 2 * waves, pull, keep), schema)
    ahead = fit.select(*keep, "beta", "spread", F.posexplode(month_calendar(F.col("last_month"), periods)).alias("position", "month"))
    t = F.coalesce(F.try_divide((month_number(F.col("month")) - F.col("first_mn")).cast("double"), (F.col("last_mn") - F.col("first_mn")).cast("double")), F.lit(1.0))
    total = sum((F.col("beta")[i] * x for i, x in enumerate(terms(t, F.month("month"), bends, waves))), F.lit(0.0))
    return ahead.withColumn("_log", total).select(
        *by, "month", F.exp("_log").alias("yhat"), F.exp(F.col("_log") - z * F.col("spread")).alias("lower"),
        F.exp(F.col("_log") + z * F.col("spread")).alias("upper"), (F.col("position") + 1).alias("position"))


def train_tail(df: DataFrame, by: Sequence[str], month: str, value: str,
               periods: int = FORECAST_PERIODS) -> DataFrame:
    """The last training values of a series, numbered 1..periods; nothing for a shorter series."""
    by = list(by)
    rows = df.groupBy(*by, F.col(month).alias("month")).agg(F.sum(value).alias("train_tail"))
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("month")))
    return rows.withColumn("_back", back).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*by))
    ).filter((F.col("_back") <= periods) & (F.col("_n") >= periods)).select(
        *by, (F.lit(periods + 1) - F.col("_back")).alias("position"), "train_tail")


def wape(actual: str, predicted: str) -> Column:
    """Mean absolute error over mean actual value, in percent (an aggregate)."""
    return F.try_divide(F.avg(F.abs(F.col(actual) - F.col(predicted))), F.avg(actual)) * 100


def forecast_backtest(df: DataFrame, by: Sequence[str], month: str, value: str, cutoffs: Sequence[str],
                      horizon: int) -> DataFrame:
    """Error per series and cutoff: train up to the cutoff month, compare the months after it."""
    by = list(by)
    days = F.explode(F.array(*[F.lit(c).cast("date") for c in cutoffs]))
    rows = df.select(*by, F.col(month).alias("month"), F.col(value).alias("y")).withColumn("cutoff", days)
    key = [*by, "cutoff"]
    ahead = forecast_monthly(rows.filter("month <= cutoff"), key, "month", "y", periods=horizon)
    actual = rows.filter("month > cutoff").groupBy(*key, "month").agg(F.sum("y").alias("actual"))
    return ahead.join(actual, [*key, "month"]).groupBy(*key).agg(
        wape("actual", "yhat").alias("wape"), F.count(F.lit(1)).alias("months"))
