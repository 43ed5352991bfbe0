"""Declared table schemas, fixed values of the analysis, and the load-time column check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)


def _schema(*fields: tuple[str, type]) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields])


_CODES = (
    ("fips_state_cd", StringType),
    ("fips_county_cd", StringType),
    ("census_block_cd", StringType),
)

TRANSACTIONS = _schema(("store_nbr", LongType), *_CODES, ("instore_transaction_count", LongType))
DISTANCE = _schema(("store_nbr", LongType), *_CODES, ("distance", DoubleType))
BOPIS = _schema(("store_nbr", LongType), *_CODES, ("bopis_customers", LongType))
HOME_STORE = _schema(("store_nbr", LongType), *_CODES)
CENSUS = _schema(("geo_id", StringType), ("pop_25_years_over", LongType))
BEST_PARAMS = _schema(
    ("store_number", LongType), ("phase_1_eps_val", DoubleType),
    ("phase_1_minsam", IntegerType), ("phase_1_best_score", DoubleType),
)
STORES = _schema(("store_nbr", LongType), ("concept", StringType), ("close_date", DateType))
MONTHLY_SALES = _schema(
    ("store_number", LongType), ("yearss", IntegerType), ("months", IntegerType), ("f0_", DoubleType),
)
TRADE_AREA = _schema(("store_nbr", LongType), *_CODES, ("geoid", StringType))
MAILING_ADDRESS = _schema(
    ("mailing_address_id", LongType), *_CODES, ("postal_cd", StringType),
    ("latitude_meas", DoubleType), ("longitude_meas", DoubleType),
)
CUSTOMER_CURR = _schema(
    ("customer_id", LongType), ("mailing_address_id", LongType), ("address_id", LongType),
    ("household_id", LongType), ("ghost_record_ind", StringType), ("customer_purge_ind", StringType),
)
CUSTOMER_TXN_XREF = _schema(("trans_id", LongType), ("customer_id", LongType))
SALES_TXN = _schema(
    ("trans_id", LongType), ("order_trans_id", LongType), ("trans_location_id", LongType),
    ("trans_booked_dt", TimestampNTZType), ("sales", DoubleType), ("gross_sales", DoubleType),
    ("ecom_order_source_cd", StringType), ("sales_trans_type_cd", StringType),
    ("bopus_ln_ind", StringType), ("concept_format_id", IntegerType),
)
LOCATION = _schema(
    ("location_id", LongType), ("store_nbr", LongType), ("dma_cd", IntegerType),
    ("store_volume_cd", StringType), ("fashion_attribute_cd", StringType), ("location_open_dt", DateType),
)
DIRECT_MARKETING_AREA = _schema(("dma_cd", IntegerType), ("dma_name", StringType))
LOCATION_GEO = _schema(
    ("location_id", LongType), ("latitude_meas", DoubleType), ("longitude_meas", DoubleType),
)
CUST_NEAR = _schema(
    ("customer_id", LongType), ("trans_id", LongType), ("trans_booked_dt", TimestampNTZType),
    ("all_near", StringType), ("instore_near", StringType), ("online_near", StringType),
    ("concept_format_id", IntegerType),
)
CALENDAR = _schema(("calendar_dt", DateType), ("calendar_season_cd", StringType))
CLOSURE_FACTOR = _schema(("store_nbr", LongType), ("closure_factor", DoubleType))
SIMILARITY = _schema(("store_nbr", LongType), ("region", StringType), ("store_group", StringType))

# Code widths, search grid, cuts and lists that decide the results.
CODE_WIDTHS = {"fips_state_cd": 2, "fips_county_cd": 3, "census_block_cd": 6}
CODES = tuple(CODE_WIDTHS)
EPS_VALUES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
MIN_SAMPLES_VALUES = (1, 2, 3, 4, 5, 6, 7, 8, 9)
MAX_DISTANCE = 50.0
FORECAST_PERIODS = 18
INTERVAL_Z = 1.2816  # normal quantile of the default 80 % interval
TEST_YEARS = (2020, 2021)
HOLIDAY_WEEKS = (1, 4, 8, 22, 27, 36, 42, 46, 48, 52)
LAST_WEEK = 40
OUTLIER_FACTOR = 100.0
TOP_CORRELATED = 40
TOP_IMPORTANT = 30
NEAR_CODES = ("N", "E", "A", "R")
NEAR_KINDS = ("all_near", "instore_near", "online_near")
COMPETITOR_COUNTS = (
    "wal_0_5_mi", "wal_10_mi", "hg_5_mi", "hg_20_mi", "kol_2_5_mi", "kol_10_mi", "kol_20_mi",
    "tar_10_mi", "jcp_10_mi", "mcy_10_mi",
)
COMPETITORS = _schema(("store_nbr", LongType), *((c, IntegerType) for c in COMPETITOR_COUNTS))
# The weekly feature table that the closure model is trained and scored on.
WEEKLY = _schema(
    ("store_nbr", LongType), ("week", IntegerType), ("calendar_season_cd", StringType), ("store_volume_cd", StringType),
    ("fashion_attribute_cd", StringType), ("online_customer_counts", LongType), ("online_transaction_counts", LongType),
    ("online_gross_sales", DoubleType), ("instore_customer_counts", LongType), ("instore_transaction_counts", LongType),
    ("instore_gross_sales", DoubleType), *((f"{kind}_{c.lower()}", LongType) for kind in NEAR_KINDS for c in NEAR_CODES),
    ("census_block_counts", LongType), ("opened_days", LongType),
)
# The thirty features of the regression, in the order the model is given them.
FEATURES = (
    "online_transaction_counts", "overlapped_customers", "online_gross_sales", "online_near_n",
    "pop_25_years_over", "wal_10_mi", "hg_20_mi", "kol_2_5_mi", "online_near_e", "instore_near_e",
    "all_near_e", "online_customer_counts", "tar_10_mi", "online_near_r", "jcp_10_mi", "kol_20_mi",
    "week", "kol_10_mi", "mcy_10_mi", "all_near_r", "all_near_a", "instore_gross_sales",
    "instore_near_a", "instore_near_n", "online_near_a", "hg_5_mi", "all_near_n", "wal_0_5_mi",
    "instore_near_r", "instore_customer_counts",
)


@dataclass(frozen=True)
class Brand:
    """What differs between the two brands in the sales and customer queries."""

    name: str
    concept_format_id: int
    instore_sources: tuple[str, ...]
    drop_pickup_lines: bool
    near_prefix: str = ""


# Fixed values of the two brands: concept ids and the order sources that count as in-store.
FIRST_BRAND = Brand("first", 1, ("U", "BBS"), True)
SECOND_BRAND = Brand("second", 3, ("U", "BAS"), False)


#: types whose every value another type holds
WIDENED = {
    "bigint": ("tinyint", "smallint", "int"), "int": ("tinyint", "smallint"), "double": ("float", "tinyint", "smallint", "int"),
    "timestamp_ntz": ("date",),
}


def fitted(df: DataFrame, field: StructField, kind: str) -> Column | None:
    """A column under its declared type, or None if a value could be lost on the way.

    Numbers go to wider numbers, and a census code that came as a whole number gets its leading zeros back.
    """
    wanted, own = field.dataType.simpleString(), F.col(f"`{field.name}`")
    if kind == wanted:
        return own
    if kind in WIDENED.get(wanted, ()):
        return own.cast(field.dataType).alias(field.name)
    if field.name in CODE_WIDTHS and kind in ("tinyint", "smallint", "int", "bigint"):
        width, said = CODE_WIDTHS[field.name], own.cast("string")
        return F.when(F.length(said) > width, F.raise_error(F.concat(F.lit(f"{field.name} has more than {width} digits: "), said)).cast("string")).otherwise(
            F.lpad(said, width, "0")).alias(field.name)
    return None


def require_columns(df: DataFrame, schema: StructType, table: str = "table") -> DataFrame:
    """The declared columns under their declared types; fails at load, not deep inside a job, when a table lacks
    columns or has a type that only a cast with loss would turn into the declared one."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}; it has {sorted(have)}")
    columns = {f.name: fitted(df, f, have[f.name].simpleString()) for f in schema.fields}
    wrong = [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema.fields if columns[f.name] is None]
    if wrong:
        raise ValueError(f"{table}: {'; '.join(wrong)}")
    return df.select(*columns.values())
