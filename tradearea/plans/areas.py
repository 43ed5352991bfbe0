"""Trade areas: features per store and tract, clustering, the kept tracts and their parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradearea.functions.codes import cut_last, fips_normalize
from tradearea.functions.measures import closeness, finite_or, per_capita
from tradearea.operators.density import dbscan_by
from tradearea.operators.near import near_group, tiers
from tradearea.operators.scaling import scale_by
from tradearea.operators.search import Grid, best_params
from tradearea.operators.tiles import BLOCK
from tradearea.schemas import CODES, EPS_VALUES, MAX_DISTANCE, MIN_SAMPLES_VALUES
from tradearea.sources.scratch import cut

MEASURES = ("instore_density", "closeness", "bopis_density")
COORDS = tuple(f"z_{m}" for m in MEASURES)
STORE = ["store_nbr"]
AREA = ["store_nbr", *CODES, "geoid"]


def census_by_tract(census: DataFrame) -> DataFrame:
    """Population per tract from distinct block groups; rows without an id are left out."""
    return (
        census.select("geo_id", "pop_25_years_over").distinct()
        .filter(F.col("geo_id").isNotNull())
        .groupBy(cut_last(F.col("geo_id")).alias("geoid"))
        .agg(F.coalesce(F.sum("pop_25_years_over"), F.lit(0)).cast("long").alias("population"))
    )


def open_stores(stores: DataFrame) -> DataFrame:
    return stores.filter(F.col("close_date").isNull()).select("store_nbr").distinct()


def closed_stores(stores: DataFrame, concept: str, year: int, month: int) -> DataFrame:
    """Stores of a concept closed in a month, as a date range so that row groups can be skipped."""
    first = f"{year:04d}-{month:02d}-01"
    after = f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
    day = F.col("close_date")
    return stores.filter(
        (F.col("concept") == concept)
        & (day >= F.lit(first).cast("date")) & (day < F.lit(after).cast("date"))
    ).select("store_nbr").distinct()


def code_gaps(**tables: DataFrame) -> DataFrame:
    """Quality report: rows per input table that lack a census code and so cannot enter an area."""
    parts = []
    for name, df in tables.items():
        lacking = F.greatest(*[F.col(c).isNull().cast("int") for c in CODES])
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(lacking), F.lit(0)).alias("without_code"))
                     .select(F.lit(name).alias("table_name"), "row_count", "without_code"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_population(df: DataFrame, tracts: DataFrame) -> DataFrame:
    return df.join(tracts, "geoid", "left")


def density_of(df: DataFrame, tracts: DataFrame, count: str, name: str) -> DataFrame:
    """Count per head of tract population; 0 for an unknown or empty population."""
    coded = fips_normalize(df).filter(F.col("geoid").isNotNull())
    return with_population(coded, tracts).withColumn(
        name, finite_or(per_capita(F.col(count), F.col("population")), 0))


def area_features(tx: DataFrame, dist: DataFrame, bopis: DataFrame, census: DataFrame,
                  stores: DataFrame | None = None) -> DataFrame:
    """One row per store and tract met in any input, with the three clustering measures.

    Restricting to a store list is a semi join on the inputs, before anything is shuffled.
    """
    if stores is not None:
        tx, dist, bopis = (t.join(stores, STORE, "left_semi") for t in (tx, dist, bopis))
    tracts = census_by_tract(census)
    key = ["store_nbr", *CODES]
    visits = density_of(tx, tracts, "instore_transaction_count", "instore_density").select(*key, "instore_density")
    pickups = density_of(bopis, tracts, "bopis_customers", "bopis_density").select(*key, "bopis_density")
    miles = fips_normalize(dist).filter(F.col("geoid").isNotNull()).select(*key, "distance")
    met = visits.join(miles, key, "full").join(pickups, key, "full")
    filled = met.withColumns({
        "geoid": F.concat(*CODES),
        "instore_density": finite_or(F.col("instore_density"), 0),
        "bopis_density": finite_or(F.col("bopis_density"), 0),
        "distance": finite_or(F.col("distance"), MAX_DISTANCE),
    }).withColumn("closeness", closeness(F.col("distance")))
    # repeated rows of a tract (inputs that are not unique) get their own id after the first
    again = F.row_number().over(Window.partitionBy(*key).orderBy("distance", "instore_density", "bopis_density"))
    return filled.withColumn("_n", again).withColumn(
        "row_id", F.when(F.col("_n") == 1, F.col("geoid")).otherwise(F.concat_ws("#", "geoid", "_n"))
    ).select(*key, "geoid", "row_id", "distance", *MEASURES)


def scaled_features(features: DataFrame) -> DataFrame:
    return scale_by(features, MEASURES, STORE)


def trials_from(params: DataFrame) -> DataFrame:
    """The store's eps and min_samples, of stores that have both. A store with several rows is an error: it would be labelled twice."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("several parameter rows for store "), F.col("store_nbr").cast("string"))).cast("double"))
    return params.select(
        F.col("store_number").alias("store_nbr"), F.col("phase_1_eps_val").alias("eps"), F.col("phase_1_minsam").alias("min_samples")).groupBy("store_nbr").agg(
        F.coalesce(once, F.max("eps")).alias("eps"), F.max("min_samples").alias("min_samples")).filter("eps is not null and min_samples is not null")


def stores_without_params(stores: DataFrame, params: DataFrame) -> DataFrame:
    return stores.select("store_nbr").distinct().join(trials_from(params), STORE, "left_anti")


def kept(labelled: DataFrame, drop_label: int = 0, keep_noise: bool = True) -> DataFrame:
    """Rows of the area: every label but the dropped one; noise (-1) stays by default."""
    rows = labelled.filter(F.col("label") != drop_label)
    return rows if keep_noise else rows.filter("label <> -1")


def within(df: DataFrame, limit: float = MAX_DISTANCE) -> DataFrame:
    return df.filter(F.col("distance") < limit)


def labelled_features(features: DataFrame, params: DataFrame) -> DataFrame:
    """Cluster labels of every store that has tuned parameters."""
    return dbscan_by(cut(scaled_features(features), "features"), trials_from(params), STORE, COORDS, "row_id", BLOCK)


def trade_area_fixed(features: DataFrame, params: DataFrame, drop_label: int = 0,
                     keep_noise: bool = True) -> DataFrame:
    """Primary area per store: clustered with its tuned parameters, under 50 miles, near group."""
    area = within(kept(labelled_features(features, params), drop_label, keep_noise))
    return near_group(area, STORE, "distance").select(*AREA).distinct()


def area_summary(rows: DataFrame, suffix: str = "") -> DataFrame:
    """Distinct tracts and means of the measures per store."""
    return rows.groupBy(*STORE).agg(
        F.countDistinct("geoid").alias(f"tracts{suffix}"),
        F.avg("instore_density").alias(f"instore_transaction{suffix}"),
        F.avg("closeness").alias(f"closeness{suffix}"),
        F.avg("distance").alias(f"distance{suffix}"),
        F.avg("bopis_density").alias(f"bopis_order_counts{suffix}"))


def _best_labels(points: DataFrame, eps: Sequence[float], min_samples: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    grid = Grid(points, STORE, COORDS, "row_id", eps, min_samples)
    best = cut(best_params(grid.scores, STORE), "best")
    chosen = grid.chosen(best.drop("score"))
    return best, cut(points.join(chosen, [*STORE, *COORDS]), "phase")


def trade_area_tuned(features: DataFrame, eps: Sequence[float] = EPS_VALUES,
                     min_samples: Sequence[int] = MIN_SAMPLES_VALUES) -> tuple[DataFrame, DataFrame]:
    """(areas, parameters) by two searches: over all tracts, then over cluster 0 of the best result.

    Both searches use the same scaled values. A store without a valid trial in either search has a
    row in the parameters with its status and no area.
    """
    points = cut(scaled_features(features), "features")
    first, labelled = _best_labels(points, eps, min_samples)
    second, refined = _best_labels(labelled.filter("label = 0").drop("label"), eps, min_samples)
    done = second.select(*STORE)
    outer = kept(labelled).join(done, STORE, "left_semi")
    final = within(outer.unionByName(kept(refined)))
    areas = final.select(*AREA).distinct()

    def named(best: DataFrame, phase: int) -> DataFrame:
        return best.select(
            *STORE, F.col("eps").alias(f"phase_{phase}_eps_val"),
            F.col("min_samples").alias(f"phase_{phase}_minsam"), F.col("score").alias(f"phase_{phase}_best_score"))

    params = (
        points.select(*STORE).distinct()
        .join(named(first, 1), STORE, "left").join(named(second, 2), STORE, "left")
        .join(area_summary(outer, "_1"), STORE, "left").join(area_summary(final), STORE, "left")
        .withColumn("status", F.when(F.col("phase_2_eps_val").isNotNull(), "ok").otherwise("no_valid_params"))
    )
    return areas, params


def status_counts(params: DataFrame) -> DataFrame:
    return params.groupBy("status").agg(F.count(F.lit(1)).alias("stores"))


def min_volume(tx: DataFrame, n: int = 100) -> DataFrame:
    """Rows of the stores whose transactions add up to at least n."""
    enough = tx.groupBy(*STORE).agg(F.sum("instore_transaction_count").alias("_n")).filter(F.col("_n") >= n)
    return tx.join(enough, STORE, "left_semi")


def trade_area_tiers(visits: DataFrame, cuts: Sequence[float] = (0.7, 0.9)) -> DataFrame:
    """Primary, secondary and tertiary tracts by cumulative share of customers, nearest first."""
    return tiers(visits, STORE, "distance", "customers", cuts)
