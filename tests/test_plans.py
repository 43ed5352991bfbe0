import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import dbscan, silhouette
from tradearea import schemas as T
from tradearea.operators.models import fit_boosted, fit_linear, random_search, score
from tradearea.plans import areas as A
from tradearea.plans import closure as C
from tradearea.plans import impact as I
from tradearea.plans import overlap as O
from tradearea.plans import sales as S


def raw_inputs(spark, stores=2, tracts=45):
    """Small transactions, distance, pick-ups and census with gaps, an empty tract and a bad code."""
    rng = np.random.default_rng(11)
    tx, dist, bopis, census = [], [], [], []
    for k in range(tracts):
        codes = (str(k % 3 + 1), str(k % 5), str(k))
        geoid = f"{k % 3 + 1:02d}{k % 5:03d}{k:06d}"
        census += [(f"{geoid}1", 0 if k == 7 else 100 + 3 * k), (f"{geoid}2", 0 if k == 7 else 50)]
        for s in range(1, stores + 1):
            tx.append((s, *codes, int(rng.integers(1, 60) if k % 4 else 300)))
            if k % 6:
                dist.append((s, *codes, float(np.round(rng.gamma(2, 9), 2))))
            if k % 2:
                bopis.append((s, *codes, int(rng.integers(1, 9))))
    tx.append((1, "1", None, "9", 5))
    return (spark.createDataFrame(tx, T.TRANSACTIONS), spark.createDataFrame(dist, T.DISTANCE),
            spark.createDataFrame(bopis, T.BOPIS), spark.createDataFrame(census, T.CENSUS))


@pytest.fixture(scope="module")
def features(spark):
    inputs = raw_inputs(spark)
    return A.area_features(*inputs), inputs


def test_features(features):
    df, (tx, dist, bopis, _) = features
    rows = {(r.store_nbr, r.geoid): r for r in df.collect()}
    assert len(rows) == 90
    empty = rows[1, "02002000007"]
    assert empty.instore_density == 0 and empty.bopis_density == 0
    unknown = rows[2, "01001000006"]
    assert unknown.distance == 50 and unknown.closeness == 0
    gaps = {r.table_name: r.without_code for r in A.code_gaps(transactions=tx, distance=dist, bopis=bopis).collect()}
    assert gaps == {"transactions": 1, "distance": 0, "bopis": 0}


def brute_search(x, ids):
    best = None
    for eps in T.EPS_VALUES:
        for ms in T.MIN_SAMPLES_VALUES:
            _, labels = dbscan(x, ids, eps, ms)
            found = silhouette(x, labels)
            if found is not None:
                rank = (-round(found, 9), eps, ms)
                if best is None or rank < best[0]:
                    best = (rank, labels)
    return best


def test_full_search_equals_brute_force(spark, features):
    df, _ = features
    areas, params = A.trade_area_tuned(df)
    got = {r.store_nbr: r for r in params.collect()}
    mine = {s: set() for s in got}
    for r in areas.collect():
        mine[r.store_nbr].add(r.geoid)
    points = A.scaled_features(df).toPandas()
    for store, part in points.groupby("store_nbr"):
        part = part.sort_values("row_id").reset_index(drop=True)
        (rank, labels) = brute_search(part[list(A.COORDS)].to_numpy(), list(part.row_id))
        assert (got[store].phase_1_best_score, got[store].phase_1_eps_val, got[store].phase_1_minsam) == (
            pytest.approx(-rank[0]), *rank[1:])
        inner = part[labels == 0]
        second = brute_search(inner[list(A.COORDS)].to_numpy(), list(inner.row_id))
        if second is None:
            assert got[store].status == "no_valid_params" and not mine[store]
            continue
        assert (got[store].phase_2_eps_val, got[store].phase_2_minsam) == second[0][1:]
        final = pd.concat([part[labels != 0], inner[second[1] != 0]])
        assert mine[store] == set(final[final.distance < 50].geoid)
    assert sum(r.stores for r in A.status_counts(params).collect()) == len(got)


def test_fixed_area_skips_stores_without_params(spark, features):
    df, _ = features
    params = spark.createDataFrame([(1, 0.6, 4, 0.5)], T.BEST_PARAMS)
    stores = spark.createDataFrame([(1,), (2,)], "store_nbr long")
    assert [r.store_nbr for r in A.stores_without_params(stores, params).collect()] == [2]
    area = A.trade_area_fixed(df, params).toPandas()
    assert set(area.store_nbr) == {1} and not area.duplicated().any()


def areas_of(spark, rows):
    return spark.createDataFrame([(s, g[:2], g[2:5], g[5:], g) for s, g in rows], T.TRADE_AREA)


def test_overlap(spark):
    a, b, c = "01001000001", "01001000002", "01001000003"
    closed, opened = areas_of(spark, [(1, a), (1, b), (1, c)]), areas_of(spark, [(2, a), (2, b), (3, c), (4, a)])
    tracts = spark.createDataFrame([(a, 60), (b, 30)], "geoid string, population long")
    pairs = {(r.closed_store, r.open_store): (r.shared_tracts, r.shared_population, r.share)
             for r in O.area_overlap_pairs(closed, opened, tracts).collect()}
    assert pairs == {(1, 2): (2, 90, 1.0), (1, 3): (1, 0, 0.0), (1, 4): (1, 60, pytest.approx(2 / 3))}
    shared = O.overlap_tracts(opened)
    assert [(r.geoid, r.stores) for r in shared.collect()] == [(a, 2)]
    assert [tuple(r) for r in O.overlap_population(closed, shared, tracts).collect()] == [(1, 60)]


def test_overlap_pairs_meet_in_blocks_of_any_size(spark, monkeypatch):
    """Many small blocks and matrices, null keys, repeated rows, a tract without people and an empty side, against brute force."""
    import random

    rng = random.Random(3)
    codes = [f"0100100{i:04d}" for i in range(12)]
    rows = [(s, g) for s in range(40) for g in rng.sample(codes, rng.randint(1, 5))]
    closed, opened = ([r for r in rows if r[0] % 3 == k] for k in (0, 1))
    people = {g: 1000 + i for i, g in enumerate(codes[:-1])}
    table = lambda r: spark.createDataFrame(r, "store_nbr long, geoid string")
    tracts = spark.createDataFrame([*people.items()], "geoid string, population long")
    monkeypatch.setattr(O, "STORES", 3)
    monkeypatch.setattr(O, "ENTRIES", 9)
    monkeypatch.setattr(O, "NUMBERS", 4)
    of = lambda r, s: {g for x, g in r if x == s}
    want = {}
    for a in {s for s, _ in closed}:
        whole = sum(people.get(g, 0) for g in of(closed, a))
        for b in {s for s, _ in opened}:
            if both := of(closed, a) & of(opened, b):
                n = sum(people.get(g, 0) for g in both)
                want[a, b] = (len(both), n, pytest.approx(n / whole) if whole else None)
    odd = [(None, codes[0]), (0, None)]
    got = O.area_overlap_pairs(table(closed + closed[:5] + odd), table(opened + opened[:5] + odd[1:]), tracts).collect()
    assert len(got) == len(want) and {(r[0], r[1]): tuple(r[2:]) for r in got} == want
    assert O.area_overlap_pairs(table([]), table(opened), tracts).count() == O.area_overlap_pairs(table(closed), table([]), tracts).count() == 0


def test_impact_and_recovery(spark):
    rows = [(10, 1350000.0, 1000000.0), (11, 1150000.0, 1050000.0), (12, 850000.0, 1000000.0)]
    forecasts = spark.createDataFrame(rows, "store_nbr long, actual double, predicted double").withColumn(
        "month", F.lit("2021-01-01").cast("date")).withColumn("relative_difference", F.expr("actual / predicted - 1"))
    pairs = spark.createDataFrame([(1, 10), (1, 11)], "closed_store long, open_store long")
    got = {r.open_store: r for r in I.closure_impact(forecasts, pairs).collect()}
    assert got[10].pandemic_factor == pytest.approx(-0.15) and got[10].impact == pytest.approx(0.5)
    assert round(got[11].pct_difference, 3) == 0.095
    lost = spark.createDataFrame([(1, 2000000.0)], "closed_store long, lost_sales double")
    rate = I.recovery_rate(I.closure_impact(forecasts, pairs), lost).first()
    assert rate.recovery_rate == pytest.approx((500000 + (1150000 / 1050000 - 1 + 0.15) * 1050000) / 2000000)


def test_months_of_pairs_meet_nothing_but_their_stores(spark):
    """The shock joins the months of the stores; the pairs' months, by far the most rows, meet in one join and are added up without an exchange."""
    forecasts = spark.createDataFrame([(s, 110.0, 100.0, 0.1) for s in (10, 11, 12)], "store_nbr long, actual double, predicted double, relative_difference double").withColumn(
        "month", F.lit("2021-01-01").cast("date"))
    pairs = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "closed_store long, open_store long")
    impact = I.closure_impact(forecasts, pairs)
    plan = impact._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and impact.columns == [
        "month", "open_store", "closed_store", "actual", "predicted", "pct_difference", "pandemic_factor", "impact"]
    lost = spark.createDataFrame([(1, 100.0), (2, 100.0)], "closed_store long, lost_sales double")
    assert sorted((r.closed_store, r.open_stores) for r in I.recovery_rate(impact, lost).collect()) == [(1, 1), (2, 2)]


def test_weekly_counts_with_shared_orders_and_two_addresses(spark):
    rows = [(1, 100, "2019-01-08", 10.0, "online"), (2, 100, "2019-01-08", 10.0, "online"),
            (1, 100, "2019-01-08", 10.0, "online"), (1, 101, "2019-01-09", 5.0, "online"),
            (2, 102, "2019-01-09", 7.0, "instore"), (3, 103, "2019-01-09", 9.0, "online")]
    sales = spark.createDataFrame(rows, "customer_id long, order_trans_id long, d string, gross_sales double, channel string").withColumn(
        "trans_booked_dt", F.col("d").cast("timestamp_ntz"))
    people = spark.createDataFrame([(7, 1, 51), (7, 1, 52), (7, 2, 53), (8, 2, 53)], "store_nbr long, customer_id long, address_id long")
    got = {(r.store_nbr, r.channel): (r.week, r.customers, r.transactions, r.gross_sales)
           for r in S.channel_weekly(sales, people).collect()}
    assert got == {(7, "online"): (2, 2, 2, 40.0), (8, "online"): (2, 1, 1, 10.0),
                   (7, "instore"): (2, 1, 1, 7.0), (8, "instore"): (2, 1, 1, 7.0)}


def test_customers_meet_stores_by_tract(spark):
    """Customers of the same tracts are added up before they meet the stores, with the results of the pairs."""
    codes = "fips_state_cd string, fips_county_cd string, census_block_cd string"
    tract = lambda k: ("01", "001", f"{k:06d}")
    homes = [(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 4, 1), (4, 5, 2), (5, 6, 1), (5, 7, 1), (6, 8, 3), (7, 9, None), (None, 1, 1)]
    addresses = spark.createDataFrame([(m, *(tract(k) if k else ("01", None, "000001"))) for _, m, k in homes[:-1]], f"mailing_address_id long, {codes}")
    customers = spark.createDataFrame([(c, m, m + 100) for c, m, _ in homes] + [(1, 1, 101)], "customer_id long, mailing_address_id long, address_id long")
    areas = spark.createDataFrame([(s, *tract(k)) for s, k in ((7, 1), (7, 2), (8, 1), (9, 2), (9, 2), (10, 4))], f"store_nbr long, {codes}")
    rows = [(c, o, "2019-01-08", float(c + o), "online") for c, o in ((1, 1), (2, 1), (2, 2), (3, 3), (4, 3), (4, 4), (5, 5), (1, 5), (6, 6), (7, 7))]
    rows += [(5, 8, "2019-01-16", 2.5, "instore"), (None, 9, "2019-01-08", 1.0, "online"), (3, None, "2019-01-08", 4.0, "online")]
    sales = spark.createDataFrame(rows, "customer_id long, order_trans_id long, d string, gross_sales double, channel string").withColumn(
        "trans_booked_dt", F.col("d").cast("timestamp_ntz"))
    pairs = S.store_customers(addresses, areas, customers)
    by_tract = S.Listings(S.customer_homes(addresses, customers), S.area_tracts(areas))
    assert sorted((r.store_nbr, r.customer_id) for r in pairs.collect() if r.customer_id) == [
        (7, 1), (7, 2), (7, 3), (7, 4), (7, 4), (7, 5), (7, 5), (8, 1), (8, 2), (8, 4), (8, 5), (8, 5), (9, 3), (9, 4)]
    got = {tuple(r) for r in S.channel_weekly(sales, by_tract).collect()}
    assert got == {tuple(r) for r in S.channel_weekly(sales, pairs).collect()} == {
        (7, 2, "online", 5, 5, 75.0), (8, 2, "online", 4, 5, 50.0), (9, 2, "online", 2, 2, 25.0), (7, 3, "instore", 1, 1, 5.0), (8, 3, "instore", 1, 1, 5.0)}
    assert by_tract.units.select("unit").distinct().count() == 5
    near = sales.select("customer_id", "trans_booked_dt", F.lit(1).alias("concept_format_id"), *[
        F.lit(x).alias(f"{k}_near") for k, x in (("all", "N"), ("instore", "E"), ("online", "A"))])
    flags = {(r.store_nbr, r.week, r.all_near_n) for r in S.near_weekly(near, by_tract, T.FIRST_BRAND, 2019).collect()}
    assert flags == {(7, 2, 5), (8, 2, 4), (9, 2, 2), (7, 3, 1), (8, 3, 1)}


def test_enriched_sales_filters_and_repeated_rows(spark):
    from tradearea.plans.sales import enriched_sales
    txn = [(1, 1, 50, "2019-01-02", 9.0, 10.0, "U", "S", "N", 1), (1, 1, 50, "2019-01-02", 9.0, 10.0, "U", "S", "N", 1),
           (2, 2, 50, "2019-01-02", 9.0, 10.0, "W", "M", "Y", 1), (3, 3, 50, "2019-01-02", 9.0, 10.0, "BAS", "M", "Y", 3),
           (4, 4, 50, "2019-01-02", 9.0, 10.0, "U", "R", "N", 1), (5, 5, 50, "2019-01-02", 9.0, 10.0, "U", "S", "N", 1)]
    cols = [f.name for f in T.SALES_TXN.fields]
    tables = {
        "sales_txn": spark.createDataFrame(txn, cols).withColumn("trans_booked_dt", F.col("trans_booked_dt").cast("timestamp_ntz")),
        "customer_txn_xref": spark.createDataFrame([(k, 7) for k in (1, 2, 3, 4)] + [(1, 8), (1, 7), (5, 0)], T.CUSTOMER_TXN_XREF),
        "customer_curr": spark.createDataFrame(
            [(7, 70, 71, 1, "N", "N"), (7, 70, 71, 1, "N", "N"), (8, 70, 72, 1, "Y", "N"), (0, 70, 73, 1, "N", "N")], T.CUSTOMER_CURR),
        "location": spark.createDataFrame([(50, 5, 2, "A", "F", None), (50, 5, 2, "B", "F", None)], T.LOCATION),
        "direct_marketing_area": spark.createDataFrame([(2, "NORTH")], T.DIRECT_MARKETING_AREA),
        "location_geo": spark.createDataFrame([(50, 1.0, 2.0)], T.LOCATION_GEO),
        "mailing_address": spark.createDataFrame([(70, "01", "001", "000001", "p", 1.0, 2.0)] * 2, T.MAILING_ADDRESS),
    }
    first = enriched_sales(tables, T.FIRST_BRAND).collect()
    second = enriched_sales(tables, T.SECOND_BRAND).collect()
    assert [(r.trans_id, r.customer_id, r.channel, r.week, r.store_nbr) for r in first] == [(1, 7, "instore", 1, 5)]
    assert [(r.trans_id, r.channel, r.store_dma_name) for r in second] == [(3, "instore", "NORTH")]


def test_lifecycle_flags_count_once_per_week_and_end_at_midnight(spark):
    rows = [(1, 1, "2019-01-08 10:00:00", "N", "E", "A"), (1, 2, "2019-01-09 10:00:00", "N", "E", "A"),
            (1, 3, "2019-01-09 11:00:00", "R", "E", "A"), (1, 4, "2019-12-31 00:00:01", "N", "N", "N")]
    near = spark.createDataFrame(rows, "customer_id long, trans_id long, d string, all_near string, instore_near string, online_near string").withColumns({
        "trans_booked_dt": F.col("d").cast("timestamp_ntz"), "concept_format_id": F.lit(1)})
    people = spark.createDataFrame([(7, 1), (7, 1)], "store_nbr long, customer_id long")
    got = S.near_weekly(near, people, T.FIRST_BRAND, 2019).collect()
    assert [(r.week, r.all_near_n, r.all_near_r, r.instore_near_e, r.online_near_a, r.online_near_n) for r in got] == [(2, 1, 1, 2, 2, 0)]


def test_report(spark):
    rows = [(1, 2, 100.0, 20.0), (1, 3, 100.0, 40.0), (1, 4, 1.0, 99.0), (1, 41, 1.0, 99.0), (2, 2, 10.0, 12.0),
            (3, 2, 0.0, 5.0)]
    scored = spark.createDataFrame(rows, "store_nbr long, week int, online_gross_sales double, forecast double")
    report = C.closure_report(scored)
    assert sorted(map(tuple, report.collect())) == [(1, 30.0), (2, 120.0), (3, None)]
    assert tuple(C.closure_summary(report).first()) == (75.0, 30.0, 3)
    assert [r.store_nbr for r in C.closure_top(report, 2).collect()] == [2, 1]
    assert [r.store_nbr for r in C.closure_outliers(report).collect()] == [2]
    factors = spark.createDataFrame([(1, -0.2), (2, 0.0), (3, 0.3)], T.CLOSURE_FACTOR)
    assert [tuple(r) for r in C.negative_factors(factors).collect()] == [(1, -0.2)]


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    rows = [(k, *map(float, x[k]), float(3 * x[k, 0] - x[k, 1])) for k in range(120)]
    df = spark.createDataFrame(rows, "store_nbr long, a double, b double, c double, y double")
    error = F.avg(F.abs(F.col("forecast") - F.col("y"))).alias("e")
    assert score(fit_linear(df, ["a", "b", "c"], "y"), df).agg(error).first().e < 1e-3
    assert score(fit_boosted(df, ["a", "b", "c"], "y", maxIter=5), df).agg(error).first().e < 1.0
    tried = random_search(df, ["a", "b", "c"], "y", draws=2, folds=2, space={"numTrees": (3, 5), "maxDepth": (2, 4)})
    assert tried.count() == 2 and tried.columns == ["trial", "numTrees", "maxDepth", "rmse"]
    from tradearea.operators.models import feature_importance
    top = feature_importance(df, ["a", "b", "c"], "y", numTrees=5, maxDepth=4).collect()
    assert [r.column_name for r in top][:1] == ["a"] and sum(r.importance for r in top) == pytest.approx(1)


def test_sales_that_differ_by_less_than_a_cent(spark):
    sales = spark.sql("""select 1L customer_id, 5L order_trans_id, timestamp'1997-03-04 10:00:00' trans_booked_dt, g gross_sales, 'online' channel
        from values (10.001D), (10.004D), (10.004D) as t(g)""")
    customers = spark.createDataFrame([(3, 1)], "store_nbr long, customer_id long")
    assert S.channel_weekly(sales, customers).first()["gross_sales"] == pytest.approx(20.005)


def planned(df):
    """The plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_categories_move_no_rows(spark):
    """A small vocabulary is a map that rows read; a large one is joined with salt, so a common value is spread."""
    from tradearea.operators import encoding
    facts = spark.range(1000).select("id", F.when(F.col("id") % 10 < 9, "common").otherwise(F.col("id").cast("string")).alias("kind"))
    words = encoding.vocabulary("kind", facts)
    small = encoding.encode(facts, {"kind": words})
    assert "Join" not in planned(small) and "Exchange" not in planned(small).split("Subquery")[0]
    want = {v: i for i, v in enumerate(sorted({"common", *(str(i) for i in range(9, 1000, 10))}))}
    assert {r.kind: r.kind_cat for r in small.collect()} == want
    kept = encoding.MAPPED
    encoding.MAPPED = 5
    try:
        large = encoding.encode(facts, {"kind": words})
        assert "_salt" in planned(large) and {r.kind: r.kind_cat for r in large.collect()} == want
    finally:
        encoding.MAPPED = kept


def test_sales_are_dealt_out_by_three_keys(spark):
    """By transaction, customer and location; the market's few values never deal out sales."""
    from tradearea.plans.sales import enriched_sales
    names = {"sales_txn": T.SALES_TXN, "customer_txn_xref": T.CUSTOMER_TXN_XREF, "customer_curr": T.CUSTOMER_CURR, "location": T.LOCATION,
             "direct_marketing_area": T.DIRECT_MARKETING_AREA, "location_geo": T.LOCATION_GEO, "mailing_address": T.MAILING_ADDRESS}
    one = {n: spark.range(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name == "location_open_dt" else (
        F.col("id").cast("string") if f.dataType.simpleString() in ("string", "timestamp_ntz", "date") else F.col("id")).cast(
        "timestamp" if f.dataType.simpleString() in ("timestamp_ntz", "date") else f.dataType).cast(f.dataType).alias(f.name) for f in t.fields]) for n, t in names.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        lines = planned(enriched_sales(one, T.FIRST_BRAND)).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.ansi.enabled")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    moved = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(" in line:
            below = []
            for k in range(i + 1, len(lines)):
                if depth[k] <= depth[i]:
                    break
                below.append(lines[k])
            if any("trans_booked_dt" in x for x in below):
                moved.append(line.split("hashpartitioning(")[1].split("#")[0])
    assert moved and set(moved) <= {"trans_id", "customer_id", "location_id"}, moved
    assert any("hashpartitioning(dma_cd" in line for line in lines)


def weekly_inputs(spark):
    """Three customers in two tracts, two stores, an order of two owners, a week that has no online sale."""
    codes = "fips_state_cd string, fips_county_cd string, census_block_cd string"
    tract = lambda k: ("01", "001", f"{k:06d}")
    day = lambda df: df.withColumn("trans_booked_dt", F.col("d").cast("timestamp_ntz")).drop("d")
    b = T.FIRST_BRAND
    sold = [(o, o, 50, d, 1.0, g, src, "S", "N", b.concept_format_id) for o, d, g, src in (
        (1, "2019-01-08", 10.0, "W"), (2, "2019-01-08", 4.0, b.instore_sources[0]), (3, "2019-01-09", 2.5, "W"),
        (4, "2019-01-16", 7.0, b.instore_sources[0]), (5, "2019-01-23", 3.0, "W"), (6, "2019-01-23", 6.0, b.instore_sources[0]))]
    owners = [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 1), (5, 3), (6, 2)]
    near = [(c, o, d, "N", "E", "A", b.concept_format_id) for c, o, d in ((1, 1, "2019-01-08"), (2, 2, "2019-01-08"), (3, 3, "2019-01-09"), (1, 4, "2019-01-16"))]
    tables = {
        "sales_txn": day(spark.createDataFrame(sold, "trans_id long, order_trans_id long, trans_location_id long, d string, sales double, gross_sales double, ecom_order_source_cd string, sales_trans_type_cd string, bopus_ln_ind string, concept_format_id int")),
        "customer_txn_xref": spark.createDataFrame(owners, "trans_id long, customer_id long"),
        "customer_curr": spark.createDataFrame([(c, m, m + 100, c, "N", "N") for c, m in ((1, 1), (2, 2), (3, 3), (3, 4))], "customer_id long, mailing_address_id long, address_id long, household_id long, ghost_record_ind string, customer_purge_ind string"),
        "mailing_address": spark.createDataFrame([(m, *tract(k), "z", 1.0, 2.0) for m, k in ((1, 1), (2, 1), (3, 2), (4, 2))], f"mailing_address_id long, {codes}, postal_cd string, latitude_meas double, longitude_meas double"),
        "location": spark.createDataFrame([(50, 7, 1, "A", "F1"), (51, 8, 1, "B", "F2")], "location_id long, store_nbr long, dma_cd int, store_volume_cd string, fashion_attribute_cd string").withColumn("location_open_dt", F.lit("2018-12-31").cast("date")),
        "direct_marketing_area": spark.createDataFrame([(1, "X")], "dma_cd int, dma_name string"),
        "location_geo": spark.createDataFrame([(50, 1.0, 2.0), (51, 1.0, 2.0)], "location_id long, latitude_meas double, longitude_meas double"),
        "cust_near": day(spark.createDataFrame(near, "customer_id long, trans_id long, d string, all_near string, instore_near string, online_near string, concept_format_id int")),
        "calendar": spark.createDataFrame([("2019-01-08", "WI"), ("2019-01-16", "WI")], "d string, calendar_season_cd string").select(F.col("d").cast("date").alias("calendar_dt"), "calendar_season_cd")}
    areas = spark.createDataFrame([(7, *tract(1)), (7, *tract(2)), (8, *tract(1)), (8, *tract(1))], f"store_nbr long, {codes}")
    return tables, areas


def test_weekly_features_read_the_areas_once(spark):
    """The areas are worked through in one go, and the rows are those of the two weekly tables, joined."""
    tables, areas = weekly_inputs(spark)
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    watched = areas.repartition(1).withColumn("census_block_cd", F.udf(look, "string")("census_block_cd"))
    got = {(r.store_nbr, r.week): r.asDict() for r in S.weekly_store_features(tables, watched, T.FIRST_BRAND, 2019, "2019-01-01").collect()}
    assert seen.value == areas.count()
    people = S.Listings(S.customer_homes(tables["mailing_address"], tables["customer_curr"]), S.area_tracts(areas))
    by = {(r.store_nbr, r.week, r.channel): r for r in S.channel_weekly(S.enriched_sales(tables, T.FIRST_BRAND), people).collect()}
    flags = {(r.store_nbr, r.week): r.asDict() for r in S.near_weekly(tables["cust_near"], people, T.FIRST_BRAND, 2019).collect()}
    assert set(got) == {(7, 2), (8, 2)}
    for (store, week), row in got.items():
        for c in ("online", "instore"):
            want = by[store, week, c]
            assert (row[f"{c}_customer_counts"], row[f"{c}_transaction_counts"], row[f"{c}_gross_sales"]) == (want.customers, want.transactions, want.gross_sales)
        assert {k: row[k] for k in flags[store, week]} == flags[store, week]
        assert (row["calendar_season_cd"], row["opened_days"], row["census_block_counts"]) == ("WI", 1, 3 - (store - 6))
    assert got[7, 2]["online_transaction_counts"] == 2 and got[7, 2]["online_gross_sales"] == 10 + 2.5 + 2 * 2.5
    assert got[8, 2]["instore_customer_counts"] == 2 and got[8, 2]["instore_transaction_counts"] == 1


def _odd_rows(spark, n=400):
    rng = np.random.default_rng(7)
    a, b, c = rng.integers(0, 30, n), rng.integers(0, 5, n), rng.normal(size=n)
    rows = [(int(i % 11), float(a[i]), int(b[i]), float(c[i]), float(a[i] * 3 + (b[i] > 2) * 20 + c[i])) for i in range(n)]
    return spark.createDataFrame(rows, "store long, a double, b int, c double, y double")


def test_trees_grown_in_tasks_are_spark_s(spark, monkeypatch):
    """One tree without chance: the same importances and errors as Spark's own, however deep; no Spark forest is fitted for it."""
    from tradearea.operators import models, trees

    df = models.cut(_odd_rows(spark), "rows")
    cases = [dict(numTrees=1, featureSubsetStrategy="all", bootstrap=False, maxDepth=d, minInstancesPerNode=m) for d, m in ((3, 1), (30, 4))]
    space = {"numTrees": (1,), "featureSubsetStrategy": ("all",), "bootstrap": (False,), "maxDepth": (2, 8), "minInstancesPerNode": (5, 8)}  # in smaller nodes rounding breaks Spark's ties
    fitted, fit = [], models._fit
    monkeypatch.setattr(models, "_fit", lambda *a: fitted.append(1) or fit(*a))

    def found():
        tops = [{r.column_name: r.importance for r in models.feature_importance(df, ["a", "b", "c"], "y", **case).collect()} for case in cases]
        tried = models.random_search(df, ["a", "b", "c"], "y", draws=3, space=space, group="store").orderBy("trial").collect()
        return tops, [r.rmse for r in tried]

    mine = found()
    assert not fitted
    monkeypatch.setattr(trees, "HELD", 0)
    spark_s = found()
    assert len(fitted) == 2
    for own, other in zip(mine[0], spark_s[0], strict=True):
        assert own == pytest.approx(other, abs=1e-6)
    assert mine[1] == pytest.approx(spark_s[1], rel=1e-6)


def test_forests_in_tasks_refuse_gaps_and_empty_folds(spark):
    from tradearea.operators.models import cut, feature_importance

    df = _odd_rows(spark, 60)
    gaps = cut(df.withColumn("a", F.when(F.col("b") > 0, F.col("a"))), "gaps")
    with pytest.raises(Exception, match="without a value"):
        feature_importance(gaps, ["a", "b"], "y", numTrees=2)
    with pytest.raises(Exception, match="no rows"):
        random_search(df.filter("store = 1"), ["a", "b"], "y", draws=1, space={"numTrees": (2,)}, group="store")
    same = [feature_importance(cut(df.repartition(n), "again"), ["a", "b", "c"], "y", numTrees=6).collect() for n in (1, 5)]
    assert same[0] == same[1] and sum(r.importance for r in same[0]) == pytest.approx(1)


def test_the_registered_search_is_the_whole_one(monkeypatch):
    from checks import queries as Q
    from tradearea.operators import models

    seen = {}
    monkeypatch.setattr(Q, "_model_rows", lambda s: (None, None))
    monkeypatch.setattr(Q, "random_search", lambda df, features, target, **options: seen.update(options))
    Q.QUERIES["random_search"](None)
    assert not {"draws", "folds", "space"} & set(seen)
    assert models.random_search.__defaults__[:2] == (100, 3) and [len(v) for v in models.SEARCH_SPACE.values()] == [10, 2, 3, 3, 2]
