"""Customers of a trade area, enriched sales, and weekly features per store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradearea.functions.codes import channel, days_open, fips_normalize, iso_week, near_flags
from tradearea.schemas import CODES, Brand
from tradearea.sources.scratch import cut

#: money is added up in whole millionths: exact, eight bytes, and beyond 9 * 10^12 an error instead of a wrong sum
UNITS = 1_000_000
#: as functions.codes.channel names them
CHANNELS = ("online", "instore")


def area_tracts(areas: DataFrame) -> DataFrame:
    """Distinct store and padded codes."""
    return fips_normalize(areas.select("store_nbr", *CODES)).select("store_nbr", *CODES).distinct()


def customer_homes(addresses: DataFrame, customers: DataFrame) -> DataFrame:
    """Where customers live: one row per customer address and its codes."""
    return (
        addresses.select("mailing_address_id", *CODES)
        .join(customers.select("customer_id", "mailing_address_id", "address_id"), "mailing_address_id")
        .select(*CODES, "customer_id", "mailing_address_id", "address_id").distinct()
    )


def store_customers(addresses: DataFrame, areas: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers living in a store's area; one row per customer address.

    Both sides are made distinct before they meet and all their columns stay, so the pairs, by far the most rows, need
    no further step.
    """
    return area_tracts(areas).join(customer_homes(addresses, customers), list(CODES)).select(
        "store_nbr", *CODES, "customer_id", "mailing_address_id", "address_id")


#: rows of totals that every task may hold, by their counted size; and rows of listings dealt to one task
HELD, DEALT = 1 << 18, 50_000


class Listings:
    """Which customers count for which stores, without a row per store and customer.

    Customers with homes in the same places, equally often, form a unit: whatever is added up per store can be added up per
    unit first. `customers` has store_nbr and customer_id, one row per address. With `tracts` (store_nbr and codes,
    distinct) it has customer_id and the codes of the homes instead, as customer_homes gives them: then only units, as
    many as there are tracts or little more, meet the stores.

    `units`: customer_id, unit. `listed`: unit, store_nbr, listed (homes of each customer of the unit in the store's area), by store.
    """

    def __init__(self, customers: DataFrame, tracts: DataFrame | None = None):
        place = ["store_nbr"] if tracts is None else list(CODES)
        homes = customers.select("customer_id", F.struct(*place).alias("place"))
        if tracts is None:
            self.places = customers.select("store_nbr", F.struct(*place).alias("place")).distinct()
        else:
            known = F.concat(*CODES).isNotNull()
            homes, self.places = homes.filter(known), tracts.filter(known).select("store_nbr", F.struct(*place).alias("place"))
        self.homes = homes.groupBy("customer_id", "place").agg(F.count(F.lit(1)).alias("n"))
        sets = cut(self.homes.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("homes")), "homes")
        names = cut(sets.select("homes").distinct().withColumn("unit", F.monotonically_increasing_id()), "units")
        self.units = sets.join(names, "homes").select("customer_id", "unit")
        self.listed = self.dealt(names.select("unit", F.explode("homes").alias("_h")).select("unit", "_h.*").join(
            self.places, "place").groupBy("unit", "store_nbr").agg(F.sum("n").alias("listed")))

    def dealt(self, met: DataFrame) -> DataFrame:
        """Rows by store, in as many tasks as their number asks for: each store is added up in one place."""
        written = cut(met, "listings")
        return written.repartition(max(1, -(-written.count() // DEALT)), "store_nbr")

    @staticmethod
    def meet(listed: DataFrame, totals: DataFrame, key: str | list[str] = "unit", how: str = "inner") -> DataFrame:
        """Each store with the totals of what counts for it; a small table of totals is read where the store's rows are."""
        written = cut(totals, "totals")
        return listed.join(F.broadcast(written) if written.count() <= HELD else written, key, how)

    def common(self, shared: DataFrame, key: list[str]) -> DataFrame:
        """(store_nbr, key..., common_orders): distinct orders with an owner in the area, of orders with several owners.

        Orders whose owners live in the same places are counted together before they meet the stores.
        """
        owned = shared.join(self.homes.drop("n"), "customer_id").groupBy("order_trans_id", *key).agg(
            F.sort_array(F.collect_set("place")).alias("places"))
        counted = cut(owned.groupBy("places", *key).agg(F.count(F.lit(1)).alias("common_orders")), "common")
        names = cut(counted.select("places").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
        listed = self.dealt(names.select("group", F.explode("places").alias("place")).join(self.places, "place").select("group", "store_nbr").distinct())
        totals = counted.join(names, "places").drop("places")
        return self.meet(listed, totals, "group").groupBy("store_nbr", *key).agg(F.sum("common_orders").alias("common_orders"))


def valid_sales(txn: DataFrame, brand: Brand) -> DataFrame:
    keep = (F.col("concept_format_id") == brand.concept_format_id) & F.col("sales_trans_type_cd").isin("S", "M")
    if brand.drop_pickup_lines:
        keep = keep & (F.col("bopus_ln_ind") != "Y")
    return txn.filter(keep)


def valid_customers(customers: DataFrame) -> DataFrame:
    return customers.filter(
        (F.col("customer_id") > 0) & (F.col("ghost_record_ind") == "N") & (F.col("customer_purge_ind") == "N"))


def enriched_sales(tables: Mapping[str, DataFrame], brand: Brand) -> DataFrame:
    """Transactions with customer, home address, store and market.

    `tables`: sales_txn, customer_txn_xref, customer_curr, location, direct_marketing_area,
    location_geo, mailing_address. Every join is an inner equi-join without a hint: the filters
    reach the scans, and Spark broadcasts a dimension only when its measured size allows it.
    Repeated rows are removed from each input, since every input column is in the result: the sales
    are made distinct right after the join that partitions them by transaction, not as wide rows.
    """
    booked = F.col("trans_booked_dt")
    txn = valid_sales(tables["sales_txn"], brand).select(
        "trans_id", "order_trans_id", F.col("trans_location_id").alias("location_id"), "trans_booked_dt",
        "sales", "gross_sales", "ecom_order_source_cd",
        channel(F.col("ecom_order_source_cd"), brand.instore_sources).alias("channel"),
        F.year(booked).alias("year"), iso_week(booked).alias("week"), F.month(booked).alias("month"))
    people = valid_customers(tables["customer_curr"]).select(
        "customer_id", "address_id", "mailing_address_id", "household_id").distinct()
    places = tables["location"].select("location_id", "store_nbr", "dma_cd").distinct()
    markets = tables["direct_marketing_area"].select("dma_cd", F.col("dma_name").alias("store_dma_name")).distinct()
    points = tables["location_geo"].select(
        "location_id", F.col("latitude_meas").alias("store_latitude"), F.col("longitude_meas").alias("store_longitude")).distinct()
    homes = tables["mailing_address"].select(
        "mailing_address_id", *CODES, "postal_cd",
        F.col("latitude_meas").alias("cust_latitude"), F.col("longitude_meas").alias("cust_longitude")).distinct()
    # dimensions meet each other first: the sales are dealt out by transaction, customer and location only
    shops = places.join(markets, "dma_cd").join(points, "location_id")
    buyers = people.join(homes, "mailing_address_id")
    return (
        txn.join(tables["customer_txn_xref"].select("trans_id", "customer_id"), "trans_id").distinct()
        .join(buyers, "customer_id").join(shops, "location_id")
        .withColumnRenamed("dma_cd", "store_dma")
    )


def channel_totals(sales: DataFrame, of: Listings, when: list[str]) -> tuple[DataFrame, DataFrame]:
    """Totals per unit and `when` (customers, orders, spent in millionths), and the orders with several owners.

    Sales are first made distinct by customer, order, time, amount and channel, then added up per customer, then per unit.
    """
    lines = sales.select("customer_id", "order_trans_id", "trans_booked_dt", "gross_sales", "channel").distinct().withColumns({
        # after the distinct: two amounts of an order may differ by less than a cent
        "gross_sales": F.round(F.col("gross_sales") * UNITS).cast("bigint"), "week": iso_week(F.col("trans_booked_dt"))})
    lines = cut(lines.select("customer_id", "order_trans_id", "week", "channel", "gross_sales"), "lines")
    per_customer = ["customer_id", *when]
    orders = lines.filter("order_trans_id is not null").select(*per_customer, "order_trans_id").distinct()
    owners = orders.groupBy("order_trans_id", *when).agg(
        F.count(F.lit(1)).alias("owners"), F.min("customer_id").alias("customer_id"))
    # an order of one customer is counted with that customer; orders of several must stay distinct
    single = owners.filter("owners = 1").groupBy(*per_customer).agg(F.count(F.lit(1)).alias("orders"))
    shared = orders.join(owners.filter("owners > 1").drop("customer_id"), ["order_trans_id", *when], "left_semi")
    spent = lines.groupBy(*per_customer).agg(F.sum("gross_sales").alias("spent")).join(single, per_customer, "left")
    totals = spent.join(of.units, "customer_id").groupBy("unit", *when).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"), F.sum("spent").alias("spent"))
    return totals, shared


def channel_weekly(sales: DataFrame, customers: DataFrame | Listings, tracts: DataFrame | None = None) -> DataFrame:
    """(store_nbr, week, channel, customers, transactions, gross_sales).

    Sales are added up per unit of customers (see Listings, also for `customers` and `tracts`) and week; only units
    meet the stores. A customer listed with several addresses in an area counts once in the counts and once per address in the sum.
    """
    of = customers if isinstance(customers, Listings) else Listings(customers, tracts)
    when = ["week", "channel"]
    key = ["store_nbr", *when]
    totals, shared = channel_totals(sales, of, when)
    people = of.meet(of.listed, totals).groupBy(*key).agg(*store_sums())
    return of.meet(people, of.common(shared, when), key, "left").select(
        *key, "customers", all_orders().alias("transactions"), "gross_sales")


def store_sums(prefix: str = "") -> list[Column]:
    """What the units of a store add up to; totals and sums carry the prefix."""
    c = lambda name: F.col(f"{prefix}{name}")
    return [
        F.sum(c("customers")).alias(f"{prefix}customers"),
        F.coalesce(F.sum(c("orders")), F.lit(0)).alias(f"{prefix}own_orders"),
        (F.sum(c("spent") * F.col("listed")) / F.lit(float(UNITS))).alias(f"{prefix}gross_sales")]


def all_orders(prefix: str = "") -> Column:
    return F.col(f"{prefix}own_orders") + F.coalesce(f"{prefix}common_orders", F.lit(0))


def near_totals(near: DataFrame, of: Listings, brand: Brand, year: int) -> DataFrame:
    """The twelve lifecycle flags per unit and week; a customer counts once per distinct set of flags in a week."""
    flags = near_flags(brand.near_prefix)
    booked = F.col("trans_booked_dt")
    days = booked.between(
        F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz"), F.lit(f"{year}-12-31 00:00:00").cast("timestamp_ntz"))
    seen = near.filter(days & (F.col("concept_format_id") == brand.concept_format_id)).select(
        "customer_id", iso_week(booked).alias("week"), *[c.alias(n) for n, c in flags.items()]).distinct()
    return seen.join(of.units, "customer_id").groupBy("unit", "week").agg(*[F.sum(n).alias(n) for n in flags])


def near_weekly(near: DataFrame, customers: DataFrame | Listings, brand: Brand, year: int, tracts: DataFrame | None = None) -> DataFrame:
    """Weekly sums of the twelve lifecycle flags per store.

    A customer counts once per distinct set of flags in a week. The last day counts only at
    midnight, as in the range the flags are defined with. Flags are added up per unit of customers before they
    meet the stores (see Listings, also for `customers` and `tracts`).
    """
    of = customers if isinstance(customers, Listings) else Listings(customers, tracts)
    totals = near_totals(near, of, brand, year)
    return of.meet(of.listed, totals).groupBy("store_nbr", "week").agg(*[F.sum(n).alias(n) for n in near_flags(brand.near_prefix)])


def tract_counts(areas: DataFrame) -> DataFrame:
    return counted_tracts(area_tracts(areas))


def counted_tracts(tracts: DataFrame) -> DataFrame:
    """Tracts per store, from distinct store and padded codes."""
    return tracts.filter(F.concat(*CODES).isNotNull()).groupBy("store_nbr").agg(F.count(F.lit(1)).alias("census_block_counts"))


def store_info(areas: DataFrame, location: DataFrame, as_of: str) -> DataFrame:
    return located(tract_counts(areas), location, as_of)


def located(counts: DataFrame, location: DataFrame, as_of: str) -> DataFrame:
    """Stores' tract counts with volume, fashion and days since opening."""
    return counts.join(location.select(
        "store_nbr", "store_volume_cd", "fashion_attribute_cd",
        days_open(F.col("location_open_dt"), as_of).cast("long").alias("opened_days")), "store_nbr")


def season_by_week(calendar: DataFrame) -> DataFrame:
    """One season per week of the year: the smallest code that occurs in it."""
    return calendar.groupBy(iso_week(F.col("calendar_dt")).alias("week")).agg(
        F.min("calendar_season_cd").alias("calendar_season_cd"))


def weekly_store_features(tables: Mapping[str, DataFrame], areas: DataFrame, brand: Brand, year: int,
                          as_of: str, sales: DataFrame | None = None) -> DataFrame:
    """One row per store and week that has flags, online and in-store sales, a season and store data.

    `tables` also needs cust_near and calendar; `sales` may be a stored result of enriched_sales.
    """
    tracts = cut(area_tracts(areas), "tracts")
    people = Listings(customer_homes(tables["mailing_address"], tables["customer_curr"]), tracts)
    if sales is None:
        sales = enriched_sales({**tables, "sales_txn": in_year(tables["sales_txn"], year)}, brand)
    key = ["store_nbr", "week"]
    flags = list(near_flags(brand.near_prefix))
    by_channel, shared = channel_totals(sales, people, ["week", "channel"])

    def wide(rows: DataFrame, by: str, *names: str) -> DataFrame:
        return rows.groupBy(by, "week").agg(*[
            F.max(F.when(F.col("channel") == c, F.col(n))).alias(f"{c}_{n}") for c in CHANNELS for n in names])

    # sales of both channels and flags come to the stores together: each store's listings are read and added up once
    totals = wide(by_channel, "unit", "customers", "orders", "spent").join(
        near_totals(tables["cust_near"], people, brand, year), ["unit", "week"], "full")
    met = people.meet(people.listed, totals).groupBy(*key).agg(
        *[s for c in CHANNELS for s in store_sums(f"{c}_")], *[F.sum(n).alias(n) for n in flags])
    full = met.filter(F.col("online_customers").isNotNull() & F.col("instore_customers").isNotNull() & F.col(flags[0]).isNotNull())
    common = wide(people.common(shared, ["week", "channel"]), "store_nbr", "common_orders")
    sold = people.meet(full, common, key, "left").select(*key, *[x for c in CHANNELS for x in (
        F.col(f"{c}_customers").alias(f"{c}_customer_counts"), all_orders(f"{c}_").alias(f"{c}_transaction_counts"),
        F.col(f"{c}_gross_sales"))], *flags)
    info = located(counted_tracts(tracts), tables["location"], as_of)
    return people.meet(sold, info, "store_nbr").join(season_by_week(tables["calendar"]), "week")


def in_year(txn: DataFrame, year: int) -> DataFrame:
    """Transactions of one year, as a range so that row groups can be skipped."""
    booked = F.col("trans_booked_dt")
    return txn.filter(
        (booked >= F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz"))
        & (booked < F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz")))
