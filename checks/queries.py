"""Every registered query: an operator applied to tables projected from the given ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from checks.projections import AS_OF, TEST_YEARS, YEAR, Tables, union_all
from tradearea.functions.codes import fill_gaps, fips_normalize, near_flags
from tradearea.functions.measures import closure_factor, haversine_miles
from tradearea.operators.density import neighbor_counts
from tradearea.operators.encoding import top_correlated
from tradearea.operators.models import (
    feature_importance, fit_boosted, fit_forest, fit_linear, random_search, score, similar_by_clusters,
)
from tradearea.operators.near import near_group
from tradearea.operators.sampling import nearest_within, oversample_tails, relevance_bounds, tail_of
from tradearea.operators.scaling import unscale
from tradearea.operators.search import best_params, dbscan_grid
from tradearea.operators.series import forecast_backtest, forecast_fourier, forecast_monthly, fourier_gram, split_years
from tradearea.operators.silhouette import silhouette_by
from tradearea.operators.similar import nearest_mixed
from tradearea.operators.tiles import BLOCK
from tradearea.plans import areas as A
from tradearea.plans import closure as C
from tradearea.plans import forecasts as P
from tradearea.plans import impact as I
from tradearea.plans import overlap as O
from tradearea.plans import sales as S
from tradearea.schemas import CODES, FEATURES, FIRST_BRAND, SECOND_BRAND, WEEKLY
from tradearea.sources import readers, writers
from tradearea.sources.scratch import cut, run_dir

#: four trials that a DuckDB statement can follow one by one
SMALL_GRID = ((0.2, 0.3), (3, 5))
TARGET = C.TARGET


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded (with one kind of zero), whole numbers as bigint."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            r = F.round(c, special.get(f.name, digits))
            c = F.when(r == 0, 0.0).otherwise(r)
        elif f.dataType.typeName() in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif f.dataType.typeName() == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


class Steps:
    """The shared intermediate results of one run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.t = Tables(spark, folder)

    # -- areas
    def features(self) -> DataFrame:
        return A.area_features(self.t.transactions(), self.t.distance(), self.t.bopis(), self.t.census())

    def scaled(self) -> DataFrame:
        return A.scaled_features(self.features())

    def labelled(self) -> DataFrame:
        return A.labelled_features(self.features(), self.t.best_params())

    def kept(self) -> DataFrame:
        return A.within(A.kept(self.labelled()))

    def tracts(self) -> DataFrame:
        return A.census_by_tract(self.t.census())

    def closed(self) -> DataFrame:
        return self.t.stores().filter("close_date is not null").select("store_nbr")

    def opened(self) -> DataFrame:
        return A.open_stores(self.t.stores())

    def cohort(self, stores: DataFrame) -> DataFrame:
        return A.area_features(self.t.transactions(), self.t.distance(), self.t.bopis(), self.t.census(), stores)

    def closed_areas(self, areas: DataFrame | None = None) -> DataFrame:
        return (self.t.near_areas() if areas is None else areas).join(self.closed(), "store_nbr", "left_semi")

    def open_areas(self, areas: DataFrame | None = None) -> DataFrame:
        return (self.t.near_areas() if areas is None else areas).join(self.opened(), "store_nbr", "left_semi")

    def grid(self) -> DataFrame:
        return dbscan_grid(cut(self.scaled(), "features"), A.STORE, A.COORDS, "row_id", *SMALL_GRID)[0]

    # -- forecasts and impact
    def sales_of(self, stores: DataFrame) -> DataFrame:
        return self.t.monthly_sales().join(
            stores.withColumnRenamed("store_nbr", "store_number"), "store_number", "left_semi")

    def compared(self, stores: DataFrame | None = None, relative: bool = True) -> DataFrame:
        sales = self.t.monthly_sales() if stores is None else self.sales_of(stores)
        return P.forecast_vs_actual(sales, TEST_YEARS, relative=relative)

    def train(self) -> DataFrame:
        return split_years(P.with_month(self.t.monthly_sales()), "yearss", TEST_YEARS)[0]

    def overlaps(self) -> DataFrame:
        return O.area_overlap_pairs(self.closed_areas(), self.open_areas(), self.tracts())

    def pairs(self) -> DataFrame:
        return I.closure_pairs(self.overlaps(), 0.9)

    def impact(self) -> DataFrame:
        return I.closure_impact(self.compared(self.opened()), self.pairs())

    def groups(self) -> DataFrame:
        sized = P.with_month(self.t.monthly_sales()).groupBy("store_nbr").agg(F.sum("sales").alias("sales"))
        return I.similar_stores(sized.join(self.t.similarity().select("store_nbr", "region"), "store_nbr"))

    # -- sales and closure
    def warehouse(self) -> dict[str, DataFrame]:
        names = ("sales_txn", "customer_txn_xref", "customer_curr", "location", "direct_marketing_area",
                 "location_geo", "mailing_address", "cust_near", "calendar")
        return {n: getattr(self.t, n)() for n in names}

    def customers(self) -> DataFrame:
        return S.store_customers(self.t.mailing_address(), self.t.near_areas(), self.t.customer_curr())

    def listings(self) -> S.Listings:
        """The same customers of the same areas, by tract: store_customers has a row for each of them in each store."""
        return S.Listings(S.customer_homes(self.t.mailing_address(), self.t.customer_curr()), S.area_tracts(self.t.near_areas()))

    def weekly(self, brand=FIRST_BRAND, areas: DataFrame | None = None) -> DataFrame:
        areas = cut(self.t.near_areas(), "areas") if areas is None else areas
        return S.weekly_store_features(self.warehouse(), areas, brand, YEAR, AS_OF)

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """Both tables of the closure study; the areas, which all their steps read, are written once."""
        areas = cut(self.t.near_areas(), "areas")
        weekly = cut(self.weekly(areas=areas), "weekly")
        training = C.training_base(
            weekly, self.t.closure_factors(), self.closed_areas(areas), self.open_areas(areas), self.t.competitors(), self.tracts())
        scoring = C.scoring_base(
            weekly.join(self.opened(), "store_nbr", "left_semi"), self.open_areas(areas), self.t.competitors(), self.tracts())
        return cut(training, "training"), cut(scoring, "scoring")

    def training(self) -> DataFrame:
        return C.closure_sets(*self.sets())[0]

    def fixed_report(self) -> DataFrame:
        """Report on a forecast column that needs no model."""
        _, scoring = self.sets()
        return C.closure_report(scoring.withColumn("forecast", F.col("instore_gross_sales") * 0.4))


def _labels(s: Steps, *cols: str) -> DataFrame:
    return s.labelled().select("store_nbr", F.col("row_id").alias("geoid"), *cols)


def _neighbor_counts(s: Steps) -> DataFrame:
    """Neighbours within eps per tract: a store of usual size from one matrix, a larger one through nested cells."""
    return neighbor_counts(
        cut(s.scaled(), "features"), A.trials_from(s.t.best_params()).select("store_nbr", "eps"), A.STORE, A.COORDS, "row_id", BLOCK
    ).select("store_nbr", F.col("row_id").alias("geoid"), "neighbors")


def _silhouette(s: Steps) -> DataFrame:
    labels = cut(s.labelled(), "labels")
    return silhouette_by(labels, A.STORE, A.COORDS, "label", "row_id", limit=BLOCK)


def _tiers(s: Steps) -> DataFrame:
    visits = fips_normalize(s.t.transactions()).select(
        "store_nbr", *CODES, "geoid", F.col("instore_transaction_count").alias("customers"))
    return A.trade_area_tiers(visits.join(s.t.distance(), ["store_nbr", *CODES])).select(
        "store_nbr", "geoid", "customers", "tier")


def _haversine(s: Steps) -> DataFrame:
    sold = S.enriched_sales(s.warehouse(), FIRST_BRAND)
    seen = sold.select(
        "store_nbr", "mailing_address_id", "cust_latitude", "cust_longitude", "store_latitude", "store_longitude").distinct()
    return rounded(seen.select("store_nbr", "mailing_address_id", haversine_miles(
        F.col("cust_latitude"), F.col("cust_longitude"), F.col("store_latitude"), F.col("store_longitude")).alias("miles")))


def _split(s: Steps) -> DataFrame:
    train, test = split_years(P.with_month(s.t.monthly_sales()), "yearss", TEST_YEARS)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("months"), F.countDistinct("store_nbr").alias("stores"))


def _forecast(s: Steps) -> DataFrame:
    return forecast_monthly(s.train(), ["store_nbr"], "month", "sales")


def _backtest(s: Steps) -> DataFrame:
    sales = P.with_month(s.t.monthly_sales()).select("store_nbr", "month", "sales")
    return forecast_backtest(sales, ["store_nbr"], "month", "sales", ("1998-06-01", "1999-01-01", "1999-06-01"), 6)


def _recovery(s: Steps) -> DataFrame:
    lost = I.lost_sales(s.compared(s.closed(), relative=False))
    return rounded(I.recovery_rate(s.impact(), lost), lifted_sales=2, lost_sales=2)


def _closure_factor(s: Steps) -> DataFrame:
    pre = s.train().groupBy("store_nbr").agg(F.avg("sales").alias("pre"))
    after = s.compared().groupBy("store_nbr").agg(F.avg("predicted").alias("baseline"), F.avg("actual").alias("post"))
    out = pre.join(after, "store_nbr").withColumn(
        "closure_factor", closure_factor(F.col("pre"), F.col("baseline"), F.col("post")))
    return rounded(out)


def _borrowed(s: Steps) -> DataFrame:
    groups = s.groups().select("store_nbr", "store_group")
    performance = I.group_performance(s.compared(s.opened()), groups)
    return rounded(I.borrowed_history(s.closed(), groups, performance))


def _enriched(s: Steps, brand) -> DataFrame:
    sold = S.enriched_sales(s.warehouse(), brand)
    day = F.date_format("trans_booked_dt", "yyyy-MM-dd").alias("booked_day")
    return rounded(sold.select(day, *[c for c in sold.columns if c != "trans_booked_dt"]), sales=3, gross_sales=2)


def _weekly_channel(s: Steps, brand) -> DataFrame:
    return rounded(S.channel_weekly(S.enriched_sales(s.warehouse(), brand), s.listings()), 2)


def _label_encoding(s: Steps) -> DataFrame:
    return rounded(union_all([
        v.select(F.lit(name).alias("column_name"), "value", "code") for name, v in C.vocabularies(*s.sets()).items()]))


MONEY = {"online_gross_sales": 2, "instore_gross_sales": 2, TARGET: 4}


def _training_out(s: Steps) -> DataFrame:
    return rounded(s.training().drop("mod_closure_factor"), **MONEY)


def _model_rows(s: Steps) -> tuple[DataFrame, DataFrame]:
    training, scoring = C.closure_sets(*s.sets())
    return cut(training, "model-training"), cut(scoring, "model-scoring")


def _model(s: Steps, fit) -> DataFrame:
    """Rare targets oversampled, then fitted, then scored."""
    training, scoring = C.closure_sets(*s.sets())
    keyed = cut(rounded(training.withColumn("id", F.col("store_nbr") * 100 + F.col("week")).select("id", *FEATURES, TARGET), **MONEY), "keyed")
    more = cut(oversample_tails(keyed, TARGET, "id"), "oversampled")
    return score(fit(more, FEATURES, TARGET), scoring).select("store_nbr", "week", "online_gross_sales", "forecast")


def _model_checks(s: Steps) -> DataFrame:
    """What must hold of each model's forecasts: a row per scored week, no gap, and trees stay inside the targets they saw."""
    training, scoring = _model_rows(s)
    bounds = training.agg(F.min(TARGET).alias("low"), F.max(TARGET).alias("high")).first()
    parts = []
    for name, fit in (("forest", fit_forest), ("linear", fit_linear)):
        scored = score(fit(training, FEATURES, TARGET), scoring)
        inside = F.col("forecast").between(bounds["low"] - 1e-6, bounds["high"] + 1e-6) if name != "linear" else F.col("forecast").isNotNull()
        parts.append(scored.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("store_nbr", "week").alias("n_keys"), F.coalesce(F.bool_and(inside), F.lit(True)).alias("holds")).withColumn("model", F.lit(name)))
    return union_all(parts)


def _importance_checks(s: Steps) -> DataFrame:
    """Importances of the default forest: one per feature, none negative, together 1."""
    found = feature_importance(cut(s.training(), "model-training"), FEATURES, TARGET)
    return rounded(found.agg(F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("total"), F.min(F.col("importance") >= 0).alias("holds")))


def _forecast_report(s: Steps) -> DataFrame:
    """The whole chain: oversample, fit, score, report."""
    return rounded(C.closure_report(_model(s, fit_forest)))


def _keyed_rows(s: Steps) -> DataFrame:
    """The feature table of the training weeks under a key of store and week."""
    training = s.training().withColumn("id", F.col("store_nbr") * 100 + F.col("week"))
    return cut(rounded(training.select("id", *FEATURES, TARGET), **MONEY), "keyed")


def _oversampled(s: Steps) -> DataFrame:
    return rounded(oversample_tails(_keyed_rows(s), TARGET, "id"), 4)


def _nearest_rows(s: Steps) -> DataFrame:
    tailed = tail_of(_keyed_rows(s), TARGET)
    return rounded(nearest_within(tailed, ["bump"], FEATURES, "id", 3))


def _bounds(s: Steps) -> DataFrame:
    return rounded(relevance_bounds(s.t.raw("lineitem").select(
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("v")), "v"), 3)


def _search(s: Steps) -> DataFrame:
    """The default search: 100 draws from the whole space, three folds by store."""
    training, _ = _model_rows(s)
    return random_search(training, FEATURES, TARGET, group="store_nbr")


def _store_clusters(s: Steps) -> DataFrame:
    sized = P.with_month(s.t.monthly_sales()).groupBy("store_nbr").agg(
        F.avg("sales").alias("sales"), F.stddev_pop("sales").alias("swing"))
    return similar_by_clusters(sized, ["sales", "swing"], 4).select("store_nbr", "store_group")


# -- written and read back
def _at(s: Steps, name: str) -> str:
    return f"{run_dir(s.t.spark)}/{name}-{uuid.uuid4().hex}"


def _cohort_loaded(s: Steps) -> DataFrame:
    """Codes that came as whole numbers, and sources' own column names."""
    at = _at(s, "cohort")
    whole = [F.col(c).cast("int").alias(c) for c in CODES]
    s.t.transactions().select("store_nbr", *whole, "instore_transaction_count").write.parquet(f"{at}/tx")
    s.t.distance().select(F.col("store_nbr").cast("int").alias("store_nbr"), *CODES, "distance").write.parquet(f"{at}/distance")
    s.t.bopis().withColumnsRenamed({"store_nbr": "PICKUP_STORE", "bopis_customers": "CUSTOMER_ID"}).write.parquet(f"{at}/bopis")
    cohort = readers.load_cohort(s.t.spark, {"transactions": f"{at}/tx", "distance": f"{at}/distance", "bopis": f"{at}/bopis"})
    parts = [cohort[n].groupBy(*CODES).agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(n)) for n in ("transactions", "distance", "bopis")]
    return union_all(parts)


def _params_round_trip(s: Steps) -> DataFrame:
    """Tuned parameters written, read by name, and used by the fixed job."""
    features = cut(s.features(), "features")
    at = _at(s, "params")
    writers.write_params(A.trade_area_tuned(features, *SMALL_GRID)[1], at)
    return _area(A.trade_area_fixed(features, readers.load_params(s.t.spark, at)))


def _areas_written(s: Steps) -> DataFrame:
    """Areas of two brands, one written twice: a rerun replaces its stores, and one brand is read alone."""
    at = _at(s, "areas")
    writers.write_areas(s.closed_areas(), at, "closed")
    for _ in range(2):
        writers.write_areas(s.open_areas(), at, "open")
    return union_all([readers.load_areas(s.t.spark, at, b).withColumn("brand", F.lit(b)) for b in ("open", "closed")])


def _forecasts_written(s: Steps) -> DataFrame:
    at = _at(s, "forecasts")
    for _ in range(2):
        writers.write_forecasts(s.compared(s.closed(), relative=False), at, "closed")
    return rounded(s.t.spark.read.parquet(at), 3)


def _sales_loaded(s: Steps) -> DataFrame:
    at = _at(s, "sales")
    writers.write_result(s.t.monthly_sales(), at, "csv")
    return rounded(P.with_month(readers.load_monthly_sales(s.t.spark, at)).select("store_nbr", "month", "sales"), 2)


def _competitors_loaded(s: Steps) -> DataFrame:
    """The names that the source gives its columns."""
    at = _at(s, "competitors")
    named = s.t.competitors()
    writers.write_result(named.toDF(*[c.replace("_0_5_", "_0.5_").replace("_2_5_", "_2.5_").replace("_mi", " mi").title() if c != "store_nbr" else c for c in named.columns]), at, "csv")
    return rounded(readers.load_competitors(s.t.spark, at))


def _factors_loaded(s: Steps) -> DataFrame:
    at = _at(s, "factors")
    s.t.closure_factors().withColumnsRenamed({"store_nbr": "STORE_NUMBER", "closure_factor": "HALO_FACTOR"}).write.parquet(at)
    return rounded(C.negative_factors(readers.load_factors(s.t.spark, at)))


def _weekly_loaded(s: Steps) -> DataFrame:
    """Weekly features as runs: the newest finished one is read, the oldest goes."""
    at = _at(s, "weekly")
    weekly = cut(s.weekly().select(*[f.name for f in WEEKLY.fields]), "weekly")
    writers.write_run(weekly.limit(1), at, "1")
    for name in ("2", "3"):
        writers.write_run(weekly.withColumnRenamed("week", "WEEKS"), at, name)
    writers.drop_runs(s.t.spark, at, 2)
    return rounded(readers.load_weekly(s.t.spark, f"{at}/run=3").unionByName(writers.read_run(s.t.spark, at).withColumnRenamed("WEEKS", "week")).distinct(), 2)


def _warehouse_loaded(s: Steps) -> DataFrame:
    """All nine tables from catalog views, by role."""
    tables = s.warehouse()
    names = {role: f"{role}_{uuid.uuid4().hex}" for role in tables}
    for role, name in names.items():
        tables[role].createOrReplaceTempView(name)
    loaded = readers.load_warehouse(s.t.spark, names)
    return rounded(S.channel_weekly(
        S.enriched_sales(loaded, FIRST_BRAND), S.customer_homes(loaded["mailing_address"], loaded["customer_curr"]), S.area_tracts(s.t.near_areas())), 2)


def _report_written(s: Steps) -> DataFrame:
    at = _at(s, "report")
    writers.write_result(s.fixed_report(), at, "csv")
    return rounded(s.t.spark.read.schema("store_nbr bigint, closure_factor double").csv(at, header=True))


def _factor_copied(s: Steps) -> DataFrame:
    return rounded(s.training().select("store_nbr", "week", "closure_factor", "mod_closure_factor"))


def _similar_nearest(s: Steps) -> DataFrame:
    """The three stores most like each store by region, volume, fashion, sales, people and people per tract."""
    place = s.t.location().join(s.t.direct_marketing_area(), "dma_cd").select("store_nbr", F.col("dma_name").alias("region"), "store_volume_cd", "fashion_attribute_cd")
    sold = s.t.monthly_sales().groupBy(F.col("store_number").alias("store_nbr")).agg(F.sum("f0_").alias("sales"))
    people = O.total_population(s.t.near_areas(), s.tracts())
    tracts = S.tract_counts(s.t.near_areas()).select("store_nbr", "census_block_counts")
    stores = place.join(sold, "store_nbr").join(people, "store_nbr").join(tracts, "store_nbr").withColumn("density", F.col("population") / F.col("census_block_counts"))
    return rounded(nearest_mixed(stores, "store_nbr", ("sales", "population", "density"), ("region", "store_volume_cd", "fashion_attribute_cd"), 3))


def _area(df: DataFrame) -> DataFrame:
    return df.select("store_nbr", "geoid")


QUERIES: dict[str, Callable[[Steps], DataFrame]] = {
    # sources
    "census_population": lambda s: s.t.census().distinct(),
    "open_stores": lambda s: s.opened(),
    "closed_stores": lambda s: A.closed_stores(s.t.stores(), "B", 2020, 12),
    "similarity_filled": lambda s: fill_gaps(s.t.similarity()),
    # features
    "census_by_tract": lambda s: s.tracts(),
    "census_tract_count": lambda s: s.tracts().agg(F.countDistinct("geoid").alias("tracts")),
    "fips_normalize": lambda s: fips_normalize(s.t.transactions()),
    "density": lambda s: rounded(A.density_of(
        s.t.transactions(), s.tracts(), "instore_transaction_count", "instore_density"
    ).select("store_nbr", "geoid", "instore_density"), 9),
    "area_features": lambda s: rounded(s.features().select("store_nbr", "geoid", *A.MEASURES, "distance"), 9),
    "scaled_features": lambda s: rounded(s.scaled().select("store_nbr", "geoid", *A.COORDS)),
    "inverse_scaled": lambda s: rounded(unscale(s.scaled(), A.MEASURES).select(
        "store_nbr", "geoid", *[f"raw_{m}" for m in A.MEASURES])),
    "code_gaps": lambda s: A.code_gaps(
        transactions=s.t.transactions(), distance=s.t.distance(), bopis=s.t.bopis()),
    # clustering
    "core_tracts": lambda s: _labels(s, F.col("core").cast("bigint").alias("core")),
    "neighbor_counts": _neighbor_counts,
    "dbscan_labels": lambda s: _labels(s, "eps", "min_samples", "label"),
    "kept_rows": lambda s: rounded(s.kept().select("store_nbr", F.col("row_id").alias("geoid"), "label", "distance")),
    "near_group": lambda s: rounded(near_group(cut(s.kept(), "kept"), A.STORE, "distance").select(
        "store_nbr", F.col("row_id").alias("geoid"), "distance")),
    "near_cluster_mean": lambda s: rounded(near_group(cut(s.kept(), "kept"), A.STORE, "distance").groupBy("store_nbr").agg(
        F.avg("distance").alias("mean_distance"), F.count(F.lit(1)).alias("tracts"))),
    "trade_area_fixed": lambda s: _area(A.trade_area_fixed(s.cohort(s.opened()), s.t.best_params())),
    "trade_area_closed": lambda s: _area(A.trade_area_fixed(s.cohort(s.closed()), s.t.best_params())),
    "stores_without_params": lambda s: A.stores_without_params(s.t.stores(), s.t.best_params()),
    "silhouette": lambda s: rounded(_silhouette(s)),
    "grid_scores": lambda s: rounded(s.grid()),
    "best_params": lambda s: rounded(best_params(s.grid(), A.STORE)),
    "trade_area_tuned": lambda s: _area(A.trade_area_tuned(s.features(), *SMALL_GRID)[0]),
    "area_summary": lambda s: rounded(A.trade_area_tuned(s.features(), *SMALL_GRID)[1].withColumns({
        c: F.col(c).cast("double") for c in ("phase_1_minsam", "phase_2_minsam", "tracts_1", "tracts")})),
    "status_counts": lambda s: A.status_counts(A.trade_area_tuned(s.features(), *SMALL_GRID)[1]),
    # the default grid of 72 trials: tests hold it against brute force, DuckDB would need minutes for it
    "grid_scores_full": lambda s: rounded(dbscan_grid(cut(s.scaled(), "features"), A.STORE, A.COORDS, "row_id")[0]),
    "area_summary_full": lambda s: rounded(A.trade_area_tuned(s.features())[1]),
    "trade_area_tuned_full": lambda s: _area(A.trade_area_tuned(s.features())[0]),
    # overlap
    "overlap_tracts": lambda s: O.overlap_tracts(s.t.near_areas()),
    "total_population": lambda s: O.total_population(s.closed_areas(), s.tracts()),
    "overlap_population": lambda s: O.overlap_population(
        s.closed_areas(), O.overlap_tracts(s.t.near_areas()), s.tracts()),
    "area_overlap_pairs": lambda s: rounded(s.overlaps()),
    "area_tiers": _tiers,
    "min_volume": lambda s: A.min_volume(fips_normalize(s.t.transactions()), 390).select(
        "store_nbr", "geoid", "instore_transaction_count"),
    "haversine": _haversine,
    # forecasts
    "month_date": lambda s: rounded(P.with_month(s.t.monthly_sales()).select("store_nbr", "month", "sales"), 2),
    "split_years": _split,
    "month_calendar": lambda s: rounded(_forecast(s).select("store_nbr", "month")),
    "forecast": lambda s: rounded(_forecast(s).drop("position"), 3),
    "fourier_gram": lambda s: rounded(fourier_gram(s.train(), ["store_nbr"], "month", "sales").drop("first_mn", "last_mn", "last_month"), 5),
    "forecast_fourier": lambda s: rounded(forecast_fourier(s.train(), ["store_nbr"], "month", "sales"), 3),
    "forecast_vs_actual_open": lambda s: rounded(s.compared(s.opened()), 3, relative_difference=6),
    "forecast_vs_actual_closed": lambda s: rounded(s.compared(s.closed(), relative=False), 3),
    "forecast_error": lambda s: rounded(P.forecast_error(s.compared(s.opened()))),
    "forecast_mean_error": lambda s: rounded(P.mean_error(P.forecast_error(s.compared(s.opened())))),
    "forecast_backtest": lambda s: rounded(_backtest(s)),
    "train_tail": lambda s: rounded(P.forecast_with_tail(s.t.monthly_sales(), TEST_YEARS), yhat=3, train_tail=2),
    # impact
    "similar_stores": lambda s: s.groups(),
    "similar_nearest": _similar_nearest,
    "similar_store_clusters": _store_clusters,
    "borrowed_history": _borrowed,
    "pandemic_factor": lambda s: rounded(I.pandemic_factor(s.compared(s.opened()), s.pairs())),
    "closure_pairs": lambda s: s.pairs(),
    "closure_impact": lambda s: rounded(s.impact(), actual=3, predicted=3),
    "recovery_rate": _recovery,
    "closure_factor": _closure_factor,
    # sales
    "store_customers": lambda s: s.customers(),
    "enriched_sales_first": lambda s: _enriched(s, FIRST_BRAND),
    "enriched_sales_second": lambda s: _enriched(s, SECOND_BRAND),
    "channel_weekly_first": lambda s: _weekly_channel(s, FIRST_BRAND),
    "channel_weekly_second": lambda s: _weekly_channel(s, SECOND_BRAND),
    "near_flags": lambda s: rounded(s.t.cust_near().select("trans_id", *[c.alias(n) for n, c in near_flags().items()])),
    "near_weekly_first": lambda s: rounded(S.near_weekly(s.t.cust_near(), s.listings(), FIRST_BRAND, YEAR)),
    "near_weekly_second": lambda s: rounded(S.near_weekly(s.t.cust_near(), s.listings(), SECOND_BRAND, YEAR)),
    "tract_counts": lambda s: S.tract_counts(s.t.near_areas()),
    "store_age": lambda s: S.store_info(s.t.near_areas(), s.t.location(), AS_OF),
    "season_by_week": lambda s: rounded(S.season_by_week(s.t.calendar())),
    "weekly_features_first": lambda s: rounded(s.weekly(FIRST_BRAND), 2),
    "weekly_features_second": lambda s: rounded(s.weekly(SECOND_BRAND), 2),
    # closure
    "negative_factors": lambda s: rounded(C.negative_factors(s.t.closure_factors())),
    "closure_training": _training_out,
    "closure_scoring": lambda s: rounded(C.closure_sets(*s.sets())[1], **MONEY),
    "label_encoding": _label_encoding,
    "corr_with_target": lambda s: rounded(C.correlations(s.training())),
    "top_features": lambda s: top_correlated(rounded(C.correlations(s.training())), 40).select(
        "column_name", "abs_correlation"),
    "model_features": lambda s: rounded(C.feature_table(s.training()), **MONEY),
    "feature_importance": lambda s: feature_importance(cut(s.training(), "model-training"), FEATURES, TARGET),
    "selected_features": lambda s: C.select_features(cut(s.training(), "model-training")),
    "closure_forecast": lambda s: _model(s, fit_forest),
    "model_checks": _model_checks,
    "importance_checks": _importance_checks,
    "forecast_report": _forecast_report,
    "linear_baseline": lambda s: _model(s, fit_linear),
    "boosted_trees": lambda s: _model(s, fit_boosted),
    "random_search": _search,
    "oversample_tails": _oversampled,
    "nearest_rows": _nearest_rows,
    "tail_bounds": _bounds,
    # report
    "closure_report": lambda s: rounded(s.fixed_report()),
    "closure_top10": lambda s: rounded(C.closure_top(s.fixed_report())),
    "closure_outliers": lambda s: rounded(C.closure_outliers(s.fixed_report())),
    "closure_mean_no_outliers": lambda s: rounded(C.closure_summary(s.fixed_report())),
    # sources and sinks
    "cohort_loaded": _cohort_loaded,
    "params_round_trip": _params_round_trip,
    "areas_written": _areas_written,
    "forecasts_written": _forecasts_written,
    "sales_loaded": _sales_loaded,
    "competitors_loaded": _competitors_loaded,
    "factors_loaded": _factors_loaded,
    "weekly_loaded": _weekly_loaded,
    "warehouse_loaded": _warehouse_loaded,
    "report_written": _report_written,
    "factor_copied": _factor_copied,
    "store_info_rows": lambda s: C.store_info_rows(s.sets()[1]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Steps], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Steps(spark, folder))
    return {name: bind(build) for name, build in QUERIES.items()}
