"""Input tables of the checks, projected by Spark from the given tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradearea.functions.codes import pad_code
from tradearea.schemas import COMPETITOR_COUNTS

TEST_YEARS = (2000, 2001)
YEAR = 1997
AS_OF = "2002-01-01"
#: stores whose distances one task makes
STORES_A_TASK = 256


class Tables:
    """The projected tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def places(self) -> DataFrame:
        """The place of each customer in numbers."""
        key = F.col("c_custkey")
        return self.raw("customer").select(
            "c_custkey", "c_nationkey", (key % 4).alias("county"), (F.floor(key / 4) % 5).alias("tract"))

    @staticmethod
    def coded(places: DataFrame) -> DataFrame:
        """Places with their padded codes. They follow from the numbers, so numbers are made distinct or added up first."""
        return places.withColumns({
            "fips_state_cd": pad_code(F.col("c_nationkey"), 2),
            "fips_county_cd": pad_code(F.col("county"), 3),
            "census_block_cd": pad_code(F.col("tract"), 6),
        }).withColumn("geoid", F.concat("fips_state_cd", "fips_county_cd", "census_block_cd"))

    def blocks(self) -> DataFrame:
        return self.coded(self.places())

    def _lines(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
            self.blocks(), F.col("o_custkey") == F.col("c_custkey"))

    def transactions(self) -> DataFrame:
        """Codes stay numbers here, as in raw input, so that padding has work to do."""
        return self._lines().filter("l_returnflag <> 'R'").groupBy(
            F.col("l_suppkey").alias("store_nbr"), F.col("c_nationkey").alias("fips_state_cd"),
            F.col("county").alias("fips_county_cd"), F.col("tract").alias("census_block_cd"),
        ).agg(F.count(F.lit(1)).alias("instore_transaction_count"))

    def bopis(self) -> DataFrame:
        return self._lines().filter("l_returnflag = 'R'").groupBy(
            F.col("l_suppkey").alias("store_nbr"), F.col("c_nationkey").alias("fips_state_cd"),
            F.col("county").alias("fips_county_cd"), F.col("tract").alias("census_block_cd"),
        ).agg(F.countDistinct("o_custkey").alias("bopis_customers"))

    def census(self) -> DataFrame:
        key = F.col("c_custkey")
        people = F.when(key % 50 == 0, 0).otherwise(100 + key % 400)
        counted = self.places().groupBy("c_nationkey", "county", "tract", (key % 3).alias("part")).agg(F.sum(people).alias("people"))
        return self.coded(counted).groupBy(F.concat("geoid", F.col("part").cast("string")).alias("geo_id")).agg(
            F.sum("people").cast("long").alias("pop_25_years_over"))

    def distance(self) -> DataFrame:
        """Every store with every tract but those whose distance is not known.

        Stores meet tracts through the nations, an equi-join on the nation key. The file of the stores is small and
        their tracts are many, so the stores are dealt out first, in as many tasks as their number asks for, and the
        tracts, whose codes bound their number, come to them.
        """
        few = self.raw("supplier").select(F.col("s_suppkey").alias("store_nbr"), "s_nationkey")
        stores = few.repartition(max(1, -(-few.count() // STORES_A_TASK)), "store_nbr")
        nations = self.raw("nation").agg(F.sort_array(F.collect_set("n_nationkey")).alias("nations"))
        near = stores.withColumn("_nations", nations.scalar()).withColumn("c_nationkey", F.explode("_nations")).drop("_nations").filter(
            (F.col("c_nationkey") + F.col("store_nbr")) % 7 != 0)
        tracts = self.coded(self.places().select("c_nationkey", "county", "tract").distinct()).drop("geoid")
        miles = F.abs(F.col("s_nationkey") - F.col("c_nationkey")) * 2.5 + F.col("county") + F.col("tract") * 0.3
        return near.join(F.broadcast(tracts), "c_nationkey").select(
            "store_nbr", "fips_state_cd", "fips_county_cd", "census_block_cd", miles.alias("distance"))

    def stores(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("store_nbr"), F.when(key % 3 == 0, "B").otherwise("A").alias("concept"),
            F.when((key % 10).isin(0, 5), F.lit("2020-12-15")).cast("date").alias("close_date"))

    def best_params(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").filter(key % 9 != 8).select(
            key.alias("store_number"), F.when(key % 2 == 1, 0.3).otherwise(0.2).alias("phase_1_eps_val"),
            (3 + 2 * (key % 2)).cast("int").alias("phase_1_minsam"),
            F.lit(None).cast("double").alias("phase_1_best_score"))

    def monthly_sales(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
        orders = self.raw("orders").select("o_orderkey", "o_orderdate")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(
            F.col("l_suppkey").alias("store_number"), F.year("o_orderdate").alias("yearss"),
            F.month("o_orderdate").alias("months"),
        ).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("f0_"))

    def mailing_address(self) -> DataFrame:
        return self.blocks().select(
            (F.col("c_custkey") + 500000).alias("mailing_address_id"),
            "fips_state_cd", "fips_county_cd", "census_block_cd",
            F.concat("fips_state_cd", "fips_county_cd").alias("postal_cd"),
            (30 + F.col("c_nationkey") * 0.5 + F.col("county") * 0.1).alias("latitude_meas"),
            (-100 + F.col("c_nationkey") * 0.7 + F.col("tract") * 0.1).alias("longitude_meas"))

    def customer_curr(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("customer_id"), (key + 500000).alias("mailing_address_id"),
            (key + 900000).alias("address_id"), F.floor(key / 2).alias("household_id"),
            F.when(key % 17 == 0, "Y").otherwise("N").alias("ghost_record_ind"),
            F.when(key % 19 == 0, "Y").otherwise("N").alias("customer_purge_ind"))

    def customer_txn_xref(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("trans_id"), F.col("o_custkey").alias("customer_id"))

    def sales_txn(self) -> DataFrame:
        places = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.min("l_suppkey").alias("store"))
        key = F.col("o_orderkey")
        source = F.element_at(
            F.create_map(F.lit("1"), F.lit("U"), F.lit("2"), F.lit("BBS"), F.lit("3"), F.lit("BAS")),
            F.left("o_orderpriority", F.lit(1)))
        kind = F.when(F.col("o_orderstatus") == "P", "S").when(F.col("o_orderstatus") == "F", "M").otherwise("R")
        money = F.col("o_totalprice").cast("decimal(18,2)")
        return self.raw("orders").join(places, "o_orderkey").select(
            key.alias("trans_id"), key.alias("order_trans_id"), (F.col("store") + 1000).alias("trans_location_id"),
            F.col("o_orderdate").alias("trans_booked_dt"),
            (money.cast("double") * 0.9).alias("sales"), F.col("o_totalprice").alias("gross_sales"),
            F.coalesce(source, F.lit("W")).alias("ecom_order_source_cd"), kind.alias("sales_trans_type_cd"),
            F.when(key % 10 == 0, "Y").otherwise("N").alias("bopus_ln_ind"),
            F.when(key % 3 == 0, 3).otherwise(1).alias("concept_format_id"))

    def location(self) -> DataFrame:
        key = F.col("s_suppkey")
        pick = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (key % n + 1).cast("int"))
        return self.raw("supplier").join(
            self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            (key + 1000).alias("location_id"), key.alias("store_nbr"), F.col("n_regionkey").alias("dma_cd"),
            pick(4, ("A", "A+", "B", "C")).alias("store_volume_cd"),
            pick(3, ("F1", "F2", "F3")).alias("fashion_attribute_cd"),
            F.date_add(F.lit("1990-01-01").cast("date"), (key * 30).cast("int")).alias("location_open_dt"))

    def location_geo(self) -> DataFrame:
        return self.raw("supplier").select(
            (F.col("s_suppkey") + 1000).alias("location_id"),
            (30 + F.col("s_nationkey") * 0.5).alias("latitude_meas"),
            (-100 + F.col("s_nationkey") * 0.7).alias("longitude_meas"))

    def direct_marketing_area(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("dma_cd"), F.col("r_name").alias("dma_name"))

    def cust_near(self) -> DataFrame:
        key = F.col("o_orderkey")
        letter = lambda n: F.substring(F.lit("NEAR"), (F.floor(key / n) % 4 + 1).cast("int"), F.lit(1))
        return self.raw("orders").select(
            F.col("o_custkey").alias("customer_id"), key.alias("trans_id"), F.col("o_orderdate").alias("trans_booked_dt"),
            letter(1).alias("all_near"), letter(4).alias("instore_near"), letter(16).alias("online_near"),
            F.when(key % 3 == 0, 3).otherwise(1).alias("concept_format_id"))

    def calendar(self) -> DataFrame:
        quarter = F.element_at(F.array(*[F.lit(s) for s in ("WI", "SP", "SU", "FA")]), F.quarter("calendar_dt"))
        return self.raw("orders").select(F.col("o_orderdate").cast("date").alias("calendar_dt")).distinct().withColumn(
            "calendar_season_cd", quarter)

    def near_areas(self) -> DataFrame:
        """Trade areas that need no clustering: the tracts under ten miles."""
        return self.distance().filter("distance < 10").select(
            "store_nbr", "fips_state_cd", "fips_county_cd", "census_block_cd",
            F.concat("fips_state_cd", "fips_county_cd", "census_block_cd").alias("geoid"))

    def closure_factors(self) -> DataFrame:
        return self.stores().filter("close_date is not null").select(
            "store_nbr", (((F.col("store_nbr") * 37) % 100 - 60) / 100.0).alias("closure_factor"))

    def competitors(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").filter(key % 11 != 10).select(
            key.alias("store_nbr"),
            *[((key * (i + 3)) % 7).cast("int").alias(c) for i, c in enumerate(COMPETITOR_COUNTS)])

    def similarity(self) -> DataFrame:
        """Region and volume group per store; the group is missing for some, as in the sheet."""
        tier = F.when(F.col("store_volume_cd") != "C", F.col("store_volume_cd"))
        return self.location().join(self.direct_marketing_area(), "dma_cd").select(
            "store_nbr", F.col("dma_name").alias("region"), tier.alias("store_group"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
