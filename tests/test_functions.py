import pytest
from pyspark.sql import functions as F

from tradearea import schemas as T
from tradearea.functions import codes, measures
from tradearea.plans import areas as A


def values(df):
    return [tuple(r) for r in df.collect()]


def test_codes_are_padded_and_never_cut(spark):
    df = spark.createDataFrame(
        [("6", "61", "40200"), ("36", "061", "1234567"), ("36.0", "7", None)], list(T.CODES))
    assert values(codes.fips_normalize(df)) == [
        ("06", "061", "040200", "06061040200"), ("36", "061", "1234567", "360611234567"),
        ("36", "007", None, None)]


def test_expressions(spark):
    row = spark.range(1).select(
        measures.per_capita(F.lit(100), F.lit(500)).alias("a"),
        measures.finite_or(measures.per_capita(F.lit(5), F.lit(0)), 0).alias("b"),
        measures.finite_or(measures.per_capita(F.lit(5), F.lit(None).cast("long")), 0).alias("c"),
        measures.finite_or(F.lit(float("inf")), 50).alias("d"),
        measures.relative_difference(F.lit(750000.0), F.lit(1000000.0)).alias("e"),
        F.round(measures.relative_difference(F.lit(1150000.0), F.lit(1050000.0)), 3).alias("f"),
        measures.percent_of(F.lit(1.0), F.lit(0.0)).alias("g"),
        measures.closure_factor(F.lit(200.0), F.lit(100.0), F.lit(150.0)).alias("h"),
        F.round(measures.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), 1).alias("i"),
        codes.cut_last(F.lit("060610402001")).alias("j"),
        codes.month_date(F.lit(2019), F.lit(3)).cast("string").alias("k"),
        codes.days_open(F.lit("2001-12-30").cast("date"), "2002-01-01").alias("m"),
        codes.channel(F.lit("BBS"), T.FIRST_BRAND.instore_sources).alias("n"),
        codes.channel(F.lit("BBS"), T.SECOND_BRAND.instore_sources).alias("o"),
        codes.channel(F.lit(None).cast("string"), T.FIRST_BRAND.instore_sources).alias("p"),
    ).first()
    assert tuple(row) == (
        0.2, 0.0, 0.0, 50.0, -0.25, 0.095, None, 0.25, pytest.approx(12436.8, abs=0.1), "06061040200", "2019-03-01",
        2, "instore", "online", "online")


def test_holidays_names_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, "x"), (2, None, None), (52, 3, "y")], "week int, `a b.c` int, t string")
    clean = codes.fill_gaps(codes.clean_names(df)).withColumn("h", codes.holiday_flag(F.col("week")))
    assert clean.columns == ["week", "a_b_c", "t", "h"]
    assert values(clean) == [(1, 1, "x", 1), (2, 0, "UNKNOWN", 0), (52, 3, "y", 1)]
    assert codes.keep_columns(clean, ["t", "week", "none"]).columns == ["week", "t"]


def test_census_and_store_lists(spark):
    census = spark.createDataFrame(
        [("060610402001", 5), ("060610402001", 5), ("060610402002", 7), (None, 9), ("123", None)], T.CENSUS)
    assert sorted(values(A.census_by_tract(census))) == [("06061040200", 12), ("12", 0)]
    stores = spark.createDataFrame(
        [(1, "B", None), (2, "B", "2020-12-31"), (3, "B", "2021-01-01"), (4, "A", "2020-12-01"), (2, "B", "2020-12-31")],
        "store_nbr long, concept string, close_date string").withColumn("close_date", F.col("close_date").cast("date"))
    assert values(A.closed_stores(stores, "B", 2020, 12)) == [(2,)]
    assert values(A.open_stores(stores)) == [(1,)]


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a")], "store_nbr long, concept string")
    with pytest.raises(ValueError, match="close_date"):
        T.require_columns(df, T.STORES, "stores")
    with pytest.raises(ValueError, match="not bigint"):
        T.require_columns(spark.createDataFrame([("g", 1.5)], "geo_id string, pop_25_years_over double"), T.CENSUS)
    # whole numbers of fewer bytes lose nothing
    assert T.require_columns(spark.createDataFrame([("g", 1)], "geo_id string, pop_25_years_over int"), T.CENSUS).dtypes[1] == ("pop_25_years_over", "bigint")
