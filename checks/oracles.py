"""Independent DuckDB statements for the registered queries, built from named pieces."""

from __future__ import annotations

import re
from math import pi

from tradearea.schemas import COMPETITOR_COUNTS, FEATURES, HOLIDAY_WEEKS, NEAR_CODES, NEAR_KINDS


def rd(expr: str, digits: int = 6) -> str:
    """Rounded, with one kind of zero."""
    return f"(case when round({expr}, {digits}) = 0 then 0.0 else round({expr}, {digits}) end)"


def ymd(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


CODES = "fips_state_cd, fips_county_cd, census_block_cd"
D3 = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"

PIECES: dict[str, str] = {
    # ---- fixture projections
    "blocks": """select c_custkey, c_nationkey, c_custkey % 4 as county, (c_custkey // 4) % 5 as tract,
        lpad(cast(c_nationkey as varchar), 2, '0') as fips_state_cd,
        lpad(cast(c_custkey % 4 as varchar), 3, '0') as fips_county_cd,
        lpad(cast((c_custkey // 4) % 5 as varchar), 6, '0') as census_block_cd,
        lpad(cast(c_nationkey as varchar), 2, '0') || lpad(cast(c_custkey % 4 as varchar), 3, '0')
          || lpad(cast((c_custkey // 4) % 5 as varchar), 6, '0') as geoid from customer""",
    "lines": """select l_suppkey as store_nbr, l_returnflag, o_custkey, geoid, fips_state_cd, fips_county_cd, census_block_cd
        from lineitem join orders on l_orderkey = o_orderkey join blocks on o_custkey = c_custkey""",
    "tx": f"""select store_nbr, {CODES}, geoid, count(*) as instore_transaction_count
        from lines where l_returnflag <> 'R' group by all""",
    "bp": f"""select store_nbr, {CODES}, geoid, count(distinct o_custkey) as bopis_customers
        from lines where l_returnflag = 'R' group by all""",
    "census": """select geoid || cast(c_custkey % 3 as varchar) as geo_id,
        sum(case when c_custkey % 50 = 0 then 0 else 100 + c_custkey % 400 end) as pop from blocks group by 1""",
    "tracts": """select left(geo_id, length(geo_id) - 1) as geoid, cast(sum(pop) as bigint) as population
        from (select distinct geo_id, pop from census) group by 1""",
    "dist": f"""select s_suppkey as store_nbr, {CODES}, geoid,
        abs(s_nationkey - c_nationkey) * 2.5::double + county + tract * 0.3::double as distance
        from supplier cross join (select distinct c_nationkey, county, tract, {CODES}, geoid from blocks)
        where (c_nationkey + s_suppkey) % 7 <> 0""",
    "stores": """select s_suppkey as store_nbr, case when s_suppkey % 3 = 0 then 'B' else 'A' end as concept,
        case when s_suppkey % 10 in (0, 5) then date '2020-12-15' end as close_date from supplier""",
    "params": """select s_suppkey as store_nbr, case when s_suppkey % 2 = 1 then 0.3::double else 0.2::double end as eps,
        3 + 2 * (s_suppkey % 2) as min_samples from supplier where s_suppkey % 9 <> 8""",
    "sales_m": """select l_suppkey as store_nbr, year(o_orderdate) as yearss, month(o_orderdate) as months,
        make_date(year(o_orderdate), month(o_orderdate), 1) as month,
        cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as y
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4""",
    "areas": f"select store_nbr, {CODES}, geoid from dist where distance < 10",
    "closed_areas": "select * from areas where store_nbr in (select store_nbr from stores where close_date is not null)",
    "open_areas": "select * from areas where store_nbr in (select store_nbr from stores where close_date is null)",
    # ---- features
    "txd": "select store_nbr, geoid, coalesce(instore_transaction_count / nullif(population, 0)::double, 0) as d from tx left join tracts using (geoid)",
    "bpd": "select store_nbr, geoid, coalesce(bopis_customers / nullif(population, 0)::double, 0) as d from bp left join tracts using (geoid)",
    "features": """select coalesce(t.store_nbr, m.store_nbr, b.store_nbr) as store_nbr,
        coalesce(t.geoid, m.geoid, b.geoid) as geoid, coalesce(t.d, 0) as instore_density,
        coalesce(b.d, 0) as bopis_density, coalesce(m.distance, 50) as distance, 50 - coalesce(m.distance, 50) as closeness
        from txd t full join dist m on t.store_nbr = m.store_nbr and t.geoid = m.geoid
        full join bpd b on b.store_nbr = coalesce(t.store_nbr, m.store_nbr) and b.geoid = coalesce(t.geoid, m.geoid)""",
    "scaled": "select *, " + ", ".join(
        f"coalesce(round(({c} - avg({c}) over w) / nullif(case when min({c}) over w = max({c}) over w then 0 else stddev_pop({c}) over w end, 0), 9), 0) as {a}"
        for c, a in (("instore_density", "x"), ("closeness", "y"), ("bopis_density", "z"))
    ) + ", " + ", ".join(
        f"avg({c}) over w as m{a}, case when min({c}) over w = max({c}) over w then 0 else stddev_pop({c}) over w end as s{a}"
        for c, a in (("instore_density", "x"), ("closeness", "y"), ("bopis_density", "z"))
    ) + " from features window w as (partition by store_nbr)",
    "pts": "select store_nbr, geoid as row_id, distance, instore_density, closeness, bopis_density, x, y, z from scaled",
}


def dbscan_pieces(px: str, pts: str, trials: str) -> dict[str, str]:
    """Clustering of `pts` for every row of `trials`: {px}lab(store_nbr, eps, min_samples, row_id, core, label)."""
    k = "store_nbr, eps, min_samples"
    return {
        f"{px}d": f"""select a.store_nbr, a.row_id as i, b.row_id as j, {D3} as d
            from {pts} a join {pts} b on a.store_nbr = b.store_nbr
            join (select store_nbr, max(eps) as top from {trials} group by 1) t on t.store_nbr = a.store_nbr
            where {D3} <= t.top""",
        f"{px}core": f"""select {k}, i from {px}d join {trials} using (store_nbr) where d <= eps
            group by {k}, i having count(*) >= min_samples""",
        f"{px}edge": f"""select c.store_nbr, c.eps, c.min_samples, d.i, d.j from {px}core c
            join {px}d d on c.store_nbr = d.store_nbr and c.i = d.i and d.d <= c.eps
            join {px}core o on o.store_nbr = c.store_nbr and o.eps = c.eps and o.min_samples = c.min_samples and o.i = d.j
            where d.i <> d.j""",
        f"{px}cc({k}, node, root) using key ({k}, node)": f"""select {k}, i, i from {px}core
            union select e.store_nbr, e.eps, e.min_samples, e.j, min(u.root) from {px}cc u
            join {px}edge e on e.store_nbr = u.store_nbr and e.eps = u.eps and e.min_samples = u.min_samples and e.i = u.node
            join recurring.{px}cc r on r.store_nbr = e.store_nbr and r.eps = e.eps and r.min_samples = e.min_samples and r.node = e.j
            where u.root < r.root group by 1, 2, 3, 4""",
        f"{px}num": f"select {k}, node, cast(dense_rank() over (partition by {k} order by root) - 1 as bigint) as label from {px}cc",
        f"{px}border": f"""select n.store_nbr, n.eps, n.min_samples, d.j, min(n.label) as label from {px}num n
            join {px}d d on d.store_nbr = n.store_nbr and d.i = n.node and d.d <= n.eps group by 1, 2, 3, 4""",
        f"{px}lab": f"""select p.store_nbr, t.eps, t.min_samples, p.row_id, n.node is not null as core,
            coalesce(n.label, b.label, -1) as label, p.x, p.y, p.z
            from {pts} p join {trials} t using (store_nbr)
            left join {px}num n on n.store_nbr = p.store_nbr and n.eps = t.eps and n.min_samples = t.min_samples and n.node = p.row_id
            left join {px}border b on b.store_nbr = p.store_nbr and b.eps = t.eps and b.min_samples = t.min_samples and b.j = p.row_id""",
    }


def silhouette_pieces(px: str, lab: str) -> dict[str, str]:
    """{px}score(store_nbr, eps, min_samples, score, clusters, points) of the labels in `lab`."""
    k = "store_nbr, eps, min_samples"
    return {
        f"{px}size": f"select {k}, count(distinct label) as clusters, count(*) as points from {lab} group by all",
        f"{px}sum": f"""select a.store_nbr, a.eps, a.min_samples, a.row_id, a.label as li, b.label as lj, sum({D3}) as s, count(*) as n
            from {lab} a join {lab} b on a.store_nbr = b.store_nbr and a.eps = b.eps and a.min_samples = b.min_samples
            group by 1, 2, 3, 4, 5, 6""",
        f"{px}ab": f"""select {k}, row_id, max(case when li = lj then n end) as own,
            max(case when li = lj and n > 1 then s / (n - 1) end) as a, min(case when li <> lj then s / n end) as b
            from {px}sum group by {k}, row_id""",
        f"{px}score": f"""select z.*, q.score from {px}size z left join (
              select {k}, round(avg(case when own = 1 then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end), 9) as score
              from {px}ab group by all) q using (store_nbr, eps, min_samples)""",
        f"{px}ranked": f"""select {k}, clusters, points,
            case when clusters > 1 and clusters < points then score end as score from {px}score""",
        f"{px}best": f"""select {k}, score from {px}ranked where score is not null
            qualify row_number() over (partition by store_nbr order by score desc, eps, min_samples) = 1""",
    }


def near_pieces(px: str, src: str) -> dict[str, str]:
    """{px}near: rows of `src` (store_nbr, distance, ...) in the near group."""
    return {
        f"{px}v": f"select store_nbr, distance, count(*) as n, distance * count(*) as s, distance * distance * count(*) as q from {src} group by 1, 2",
        f"{px}run": f"""select store_nbr, distance, sum(n) over w as n, sum(s) over w as s, sum(q) over w as q,
            sum(n) over g as tn, sum(s) over g as ts, sum(q) over g as tq from {px}v
            window w as (partition by store_nbr order by distance), g as (partition by store_nbr)""",
        f"{px}cut": f"""select store_nbr, distance as threshold from {px}run where tn > 2 and n < tn
            qualify row_number() over (partition by store_nbr
              order by round(q - s * s / n + (tq - q) - (ts - s) * (ts - s) / (tn - n), 6), distance) = 1""",
        f"{px}near": f"""select r.* from {src} r left join {px}cut c using (store_nbr)
            where threshold is null or distance <= threshold""",
    }


PIECES |= dbscan_pieces("f", "pts", "params")
PIECES |= {
    "fkept": "select p.*, l.label from flab l join pts p using (store_nbr, row_id) where l.label <> 0 and p.distance < 50",
}
PIECES |= near_pieces("f", "fkept")
PIECES |= silhouette_pieces("f", "flab")

# ---- the two searches on a grid of two by two
PIECES |= {
    "g1t": """select distinct store_nbr, e as eps, m as min_samples from pts,
        (values (0.2::double), (0.3::double)) e(e), (values (3), (5)) m(m)""",
}
PIECES |= dbscan_pieces("g1", "pts", "g1t")
PIECES |= silhouette_pieces("g1", "g1lab")
PIECES |= {
    "p1": "select p.*, l.label from pts p join g1lab l using (store_nbr, row_id) join g1best b using (store_nbr, eps, min_samples)",
    "pts2": "select * exclude (label) from p1 where label = 0",
    "g2t": """select distinct store_nbr, e as eps, m as min_samples from pts2,
        (values (0.2::double), (0.3::double)) e(e), (values (3), (5)) m(m)""",
}
PIECES |= dbscan_pieces("g2", "pts2", "g2t")
PIECES |= silhouette_pieces("g2", "g2lab")
PIECES |= {
    # labels of the best trial, marked by a union and a window: joining g2lab with g2best does not end in DuckDB 2.0
    "p2lab": """select store_nbr, row_id, label from (
        select store_nbr, row_id, label, max(best) over (partition by store_nbr, eps, min_samples) as chosen from (
          select store_nbr, eps, min_samples, row_id, label, 0 as best from g2lab
          union all select store_nbr, eps, min_samples, null, null, 1 from g2best)) where chosen = 1 and row_id is not null""",
    "p2": "select p.*, l.label from pts2 p join p2lab l using (store_nbr, row_id)",
    "outer1": "select * from p1 where label <> 0 and store_nbr in (select store_nbr from g2best)",
    "final1": "select * from (select * from outer1 union all select * from p2 where label <> 0) where distance < 50",
}

# ---- forecasts
def fit_pieces(px: str, src: str, key: str) -> dict[str, str]:
    """{px}fit and {px}fc (18 or `horizon` months) for `src` (key..., month, y)."""
    def line(n: int, prev: str, season: str) -> dict[str, str]:
        return {
            f"{px}l{n}": f"""select {key}, count(*)::double as n, sum(t) as st, sum(d) as sd, sum(t * t) as stt, sum(t * d) as std
                from (select *, {season} as d from {prev}) group by {key}""",
            f"{px}r{n}": f"""select r.* exclude ({'season, slope, base' if n > 1 else 'mn'}), {'' if n > 1 else 'r.mn, '}
                coalesce((l.n * std - st * sd) / nullif(l.n * stt - st * st, 0), 0) as slope,
                (sd - coalesce((l.n * std - st * sd) / nullif(l.n * stt - st * st, 0), 0) * st) / l.n as base
                from {prev} r join {px}l{n} l using ({key})""",
            f"{px}s{n}": f"""select *, coalesce(sum(y * (base + slope * t)) over w
                / nullif(sum((base + slope * t) * (base + slope * t)) over w, 0), 1) as season
                from {px}r{n} window w as (partition by {key}, moy)""",
        }
    return {
        f"{px}r0": f"""select {key}, month, sum(y) as y, month(month) as moy, year(month) * 12 + month(month) as mn,
            min(year(month) * 12 + month(month)) over (partition by {key}) as first_mn,
            max(month) over (partition by {key}) as last_month,
            (year(month) * 12 + month(month) - min(year(month) * 12 + month(month)) over (partition by {key}))::double as t
            from {src} group by {key}, month""",
        **line(1, f"{px}r0", "y"),
        **line(2, f"{px}s1", "coalesce(y / nullif(season, 0), y)"),
        f"{px}fit": f"""select {key}, max(first_mn) as first_mn, max(last_month) as last_month, max(base) as base, max(slope) as slope,
            sqrt(avg((y - (base + slope * t) * season) * (y - (base + slope * t) * season))) as spread from {px}s2 group by {key}""",
        f"{px}seas": f"select distinct {key}, moy, season from {px}s2",
    }


def forecast_piece(px: str, key: str, horizon: int) -> dict[str, str]:
    return {
        f"{px}fc": f"""select f.*, coalesce(s.season, 1) * (base + slope * (year(f.month) * 12 + month(f.month) - first_mn)) as yhat
            from (select *, cast(last_month + to_months(cast(position as integer)) as date) as month
                  from {px}fit, (select unnest(range(1, {horizon + 1})) as position)) f
            left join {px}seas s on {' and '.join(f's.{c.strip()} = f.{c.strip()}' for c in key.split(','))} and s.moy = month(f.month)""",
    }


PIECES |= {"train": "select store_nbr, month, y from sales_m where yearss not in (2000, 2001)",
           "test": "select store_nbr, month, y from sales_m where yearss in (2000, 2001)"}
PIECES |= fit_pieces("t", "train", "store_nbr") | forecast_piece("t", "store_nbr", 18)
PIECES |= {
    "fva": """select store_nbr, f.month, f.yhat as predicted, f.yhat - 1.2816::double * f.spread as lower,
        f.yhat + 1.2816::double * f.spread as upper, a.y as actual, a.y / nullif(f.yhat, 0) - 1 as diff
        from tfc f join test a using (store_nbr, month)""",
    "fva_open": "select * from fva where store_nbr in (select store_nbr from stores where close_date is null)",
    "fva_closed": "select * from fva where store_nbr in (select store_nbr from stores where close_date is not null)",
    "bt": """select s.store_nbr, cast(c as date) as cutoff, s.month, s.y from sales_m s,
        (values ('1998-06-01'), ('1999-01-01'), ('1999-06-01')) c(c)""",
    "bttrain": "select store_nbr, cutoff, month, y from bt where month <= cutoff",
}
PIECES |= fit_pieces("b", "bttrain", "store_nbr, cutoff") | forecast_piece("b", "store_nbr, cutoff", 6)

# ---- overlap and impact
PIECES |= {
    "closed_pop": "select store_nbr, coalesce(sum(population), 0) as population from closed_areas left join tracts using (geoid) group by 1",
    "pairs_all": """select c.store_nbr as closed_store, o.store_nbr as open_store, count(*) as shared_tracts,
        coalesce(sum(t.population), 0) as shared_population, max(p.population) as population
        from closed_areas c join open_areas o on c.geoid = o.geoid left join tracts t on t.geoid = c.geoid
        join closed_pop p on p.store_nbr = c.store_nbr group by 1, 2""",
    "pairs": "select closed_store, open_store from pairs_all where shared_population::double / nullif(population, 0) >= 0.9",
    "pfactor": """select month, avg(diff) as pandemic_factor, count(*) as stores from fva_open
        where store_nbr not in (select open_store from pairs) group by 1""",
    "impact": """select closed_store, open_store, f.month, actual, predicted, diff as pct_difference, pandemic_factor,
        diff - pandemic_factor as impact from pairs join fva_open f on f.store_nbr = open_store join pfactor using (month)""",
    "lost": "select store_nbr as closed_store, sum(predicted) as lost_sales from fva_closed group by 1",
    "sized": """select store_nbr, r_name as region, sum(y) as sales from sales_m join supplier on s_suppkey = store_nbr
        join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by 1, 2""",
    "grouped": """select store_nbr, region, case when sales <= low then 'small' when sales <= high then 'medium' else 'large' end as tier
        from sized join (select region, quantile_cont(sales, 1/3::double) as low, quantile_cont(sales, 2/3::double) as high
          from sized group by 1) using (region)""",
}

# ---- sales and customers
def sales_pieces(px: str, concept: int, sources: str, extra: str) -> dict[str, str]:
    flags = [f"{k}_{c.lower()}" for k in NEAR_KINDS for c in NEAR_CODES]
    return {
        f"{px}sales": f"""select distinct x.trans_id, x.order_trans_id, c.customer_id, c.address_id, c.mailing_address_id, c.household_id,
            x.trans_location_id as location_id, x.trans_booked_dt, x.sales, x.gross_sales, x.ecom_order_source_cd,
            case when x.ecom_order_source_cd in ({sources}) then 'instore' else 'online' end as channel,
            year(x.trans_booked_dt) as year, weekofyear(x.trans_booked_dt) as week, month(x.trans_booked_dt) as month,
            l.dma_cd as store_dma, g.dma_name as store_dma_name, l.store_nbr, a.{', a.'.join(CODES.split(', '))}, a.postal_cd,
            a.latitude as cust_latitude, a.longitude as cust_longitude, p.latitude as store_latitude, p.longitude as store_longitude
            from txn x join (select o_orderkey as trans_id, o_custkey as customer_id from orders) r using (trans_id)
            join cust c on c.customer_id = r.customer_id
            join (select distinct location_id, store_nbr, dma_cd from loc) l on l.location_id = x.trans_location_id
            join (select r_regionkey as dma_cd, r_name as dma_name from region) g on g.dma_cd = l.dma_cd
            join locgeo p on p.location_id = l.location_id join addr a on a.mailing_address_id = c.mailing_address_id
            where x.concept = {concept} and x.kind in ('S', 'M') and c.customer_id > 0 and c.ghost = 'N' and c.purge = 'N' {extra}""",
        f"{px}lines": f"""select * exclude (gross_sales), cast(gross_sales as decimal(24,6)) as gross from (select distinct customer_id, order_trans_id,
            trans_booked_dt, gross_sales, channel, weekofyear(trans_booked_dt) as week from {px}sales)""",
        f"{px}weekly": f"""select store_nbr, week, channel, count(distinct customer_id) as customers,
            count(distinct order_trans_id) as transactions, cast(sum(gross) as double) as gross_sales
            from {px}lines join sc using (customer_id) group by 1, 2, 3""",
        f"{px}near": f"""select store_nbr, week, {', '.join(f'cast(sum({f}) as bigint) as {f}' for f in flags)} from (
            select distinct customer_id, store_nbr, weekofyear(trans_booked_dt) as week,
            {', '.join(f"case when {k} = '{c}' then 1 else 0 end as {k}_{c.lower()}" for k in NEAR_KINDS for c in NEAR_CODES)}
            from nearcodes join sc using (customer_id)
            where trans_booked_dt between timestamp '1997-01-01 00:00:00' and timestamp '1997-12-31 00:00:00' and concept = {concept})
            group by 1, 2""",
        f"{px}sales_y": f"select * from {px}sales where year = 1997",
        f"{px}features": f"""select o.store_nbr, o.week, o.customers as online_customer_counts, o.transactions as online_transaction_counts,
            o.gross_sales as online_gross_sales, i.customers as instore_customer_counts, i.transactions as instore_transaction_counts,
            i.gross_sales as instore_gross_sales, s.calendar_season_cd, {', '.join(flags)}, census_block_counts, store_volume_cd,
            fashion_attribute_cd, opened_days
            from (select * from {px}wy where channel = 'online') o join (select * from {px}wy where channel = 'instore') i using (store_nbr, week)
            join {px}near using (store_nbr, week) join sinfo using (store_nbr) join season s using (week)""",
        f"{px}wy": f"""select store_nbr, week, channel, count(distinct customer_id) as customers,
            count(distinct order_trans_id) as transactions, cast(sum(gross) as double) as gross_sales
            from (select * exclude (gross_sales), cast(gross_sales as decimal(24,6)) as gross from (select distinct customer_id, order_trans_id,
              trans_booked_dt, gross_sales, channel, weekofyear(trans_booked_dt) as week from {px}sales_y)) join sc using (customer_id) group by 1, 2, 3""",
    }


PIECES |= {
    "addr": f"""select 500000 + c_custkey as mailing_address_id, {CODES}, fips_state_cd || fips_county_cd as postal_cd,
        30 + c_nationkey * 0.5::double + county * 0.1::double as latitude,
        -100 + c_nationkey * 0.7::double + tract * 0.1::double as longitude from blocks""",
    "cust": """select c_custkey as customer_id, 500000 + c_custkey as mailing_address_id, 900000 + c_custkey as address_id,
        c_custkey // 2 as household_id, case when c_custkey % 17 = 0 then 'Y' else 'N' end as ghost,
        case when c_custkey % 19 = 0 then 'Y' else 'N' end as purge from customer""",
    "txn": """select o_orderkey as trans_id, o_orderkey as order_trans_id, 1000 + m as trans_location_id, o_orderdate as trans_booked_dt,
        cast(cast(o_totalprice as decimal(18,2)) as double) * 0.9::double as sales, o_totalprice as gross_sales,
        case left(o_orderpriority, 1) when '1' then 'U' when '2' then 'BBS' when '3' then 'BAS' else 'W' end as ecom_order_source_cd,
        case o_orderstatus when 'P' then 'S' when 'F' then 'M' else 'R' end as kind,
        case when o_orderkey % 10 = 0 then 'Y' else 'N' end as bopus, case when o_orderkey % 3 = 0 then 3 else 1 end as concept
        from orders join (select l_orderkey, min(l_suppkey) as m from lineitem group by 1) on l_orderkey = o_orderkey""",
    "loc": """select 1000 + s_suppkey as location_id, s_suppkey as store_nbr, n_regionkey as dma_cd,
        case s_suppkey % 4 when 0 then 'A' when 1 then 'A+' when 2 then 'B' else 'C' end as store_volume_cd,
        case s_suppkey % 3 when 0 then 'F1' when 1 then 'F2' else 'F3' end as fashion_attribute_cd,
        date '1990-01-01' + cast(30 * s_suppkey as integer) as location_open_dt
        from supplier join nation on n_nationkey = s_nationkey""",
    "locgeo": """select 1000 + s_suppkey as location_id, 30 + s_nationkey * 0.5::double as latitude,
        -100 + s_nationkey * 0.7::double as longitude from supplier""",
    "nearcodes": """select o_custkey as customer_id, o_orderkey as trans_id, o_orderdate as trans_booked_dt,
        substr('NEAR', cast(o_orderkey % 4 as integer) + 1, 1) as all_near,
        substr('NEAR', cast((o_orderkey // 4) % 4 as integer) + 1, 1) as instore_near,
        substr('NEAR', cast((o_orderkey // 16) % 4 as integer) + 1, 1) as online_near,
        case when o_orderkey % 3 = 0 then 3 else 1 end as concept from orders""",
    "calendar": """select distinct cast(o_orderdate as date) as d,
        case quarter(o_orderdate) when 1 then 'WI' when 2 then 'SP' when 3 then 'SU' else 'FA' end as calendar_season_cd from orders""",
    "season": "select weekofyear(d) as week, min(calendar_season_cd) as calendar_season_cd from calendar group by 1",
    "sc": f"""select distinct store_nbr, {CODES}, customer_id, mailing_address_id, address_id
        from addr join (select distinct store_nbr, {CODES} from areas) using ({CODES}) join cust using (mailing_address_id)""",
    "sinfo": """select store_nbr, census_block_counts, store_volume_cd, fashion_attribute_cd,
        cast(date '2002-01-01' - location_open_dt as bigint) as opened_days
        from (select store_nbr, count(*) as census_block_counts from areas group by 1) join loc using (store_nbr)""",
}
PIECES |= sales_pieces("s1", 1, "'U', 'BBS'", "and x.bopus <> 'Y'")
PIECES |= sales_pieces("s2", 3, "'U', 'BAS'", "")

# ---- closure
COMP = ", ".join(f"(s_suppkey * {i + 3}) % 7 as {c}" for i, c in enumerate(COMPETITOR_COUNTS))
_NUM = ["online_customer_counts", "online_transaction_counts", "online_gross_sales", "instore_customer_counts",
        "instore_transaction_counts", "instore_gross_sales", *[f"{k}_{c.lower()}" for k in NEAR_KINDS for c in NEAR_CODES],
        "census_block_counts", "opened_days", "overlapped_customers", "pop_25_years_over", *COMPETITOR_COUNTS]
_HOL = f"case when week in ({', '.join(map(str, HOLIDAY_WEEKS))}) then 1 else 0 end as holiday_ind"
PIECES |= {
    "factors": """select store_nbr, ((store_nbr * 37) % 100 - 60) / 100.0::double as closure_factor from stores where close_date is not null""",
    "comp": f"select s_suppkey as store_nbr, {COMP} from supplier where s_suppkey % 11 <> 10",
    "shared_all": "select geoid from areas group by 1 having count(distinct store_nbr) > 1",
    "shared_open": "select geoid from open_areas group by 1 having count(distinct store_nbr) > 1",
    "closed_over": """select store_nbr, coalesce(sum(population), 0) as overlapped_customers from closed_areas left join tracts using (geoid)
        where geoid in (select geoid from shared_all) group by 1""",
    "open_over": """select store_nbr, coalesce(sum(population), 0) as overlapped_customers from open_areas left join tracts using (geoid)
        where geoid in (select geoid from shared_open) group by 1""",
    "open_pop": "select store_nbr, coalesce(sum(population), 0) as population from open_areas left join tracts using (geoid) group by 1",
    "trainset0": f"""select store_nbr, week, calendar_season_cd, store_volume_cd, fashion_attribute_cd, closure_factor,
        abs(online_gross_sales * closure_factor) as store_online_gross_sales, {_HOL},
        {', '.join(f'coalesce({c}, 0) as {c}' for c in _NUM)}
        from s1features join factors using (store_nbr) left join closed_over using (store_nbr)
        left join (select store_nbr, population as pop_25_years_over from closed_pop) using (store_nbr)
        join comp using (store_nbr) where closure_factor < 0""",
    "scoreset0": f"""select store_nbr, week, calendar_season_cd, store_volume_cd, fashion_attribute_cd, {_HOL},
        {', '.join(f'coalesce({c}, 0) as {c}' for c in _NUM)}
        from s1features join (select store_nbr from stores where close_date is null) using (store_nbr)
        left join open_over using (store_nbr)
        left join (select store_nbr, population as pop_25_years_over from open_pop) using (store_nbr)
        left join comp using (store_nbr)""",
    "v_season": "select v, dense_rank() over (order by v) - 1 as code from (select distinct calendar_season_cd as v from trainset0)",
    "v_volume": """select v, dense_rank() over (order by v) - 1 as code from (
        select store_volume_cd as v from trainset0 union select store_volume_cd from scoreset0)""",
    "v_fashion": """select v, dense_rank() over (order by v) - 1 as code from (
        select fashion_attribute_cd as v from trainset0 union select fashion_attribute_cd from scoreset0)""",
}
for _name in ("train", "score"):
    PIECES[f"{_name}set"] = f"""select t.*, a.code as calendar_season_cd_cat, b.code as store_volume_cd_cat, c.code as fashion_attribute_cd_cat
        from {_name}set0 t join v_season a on a.v = t.calendar_season_cd join v_volume b on b.v = t.store_volume_cd
        join v_fashion c on c.v = t.fashion_attribute_cd"""
PIECES |= {
    # a forecast that needs no model, so that the report can be checked exactly
    "fixedscore": "select store_nbr, week, online_gross_sales, instore_gross_sales * 0.4::double as forecast from scoreset0",
    "report": f"""select store_nbr, avg(forecast / nullif(online_gross_sales, 0) * 100) as closure_factor from fixedscore
        where week not in ({', '.join(map(str, HOLIDAY_WEEKS))}) and week <= 40 group by 1""",
}

def _draw(*parts: str) -> str:
    """The library's key-only draw: 48 bits of an MD5 sum."""
    said = " || ':' || ".join(["'42'", *[f"cast({p} as varchar)" for p in parts]])
    return f"(cast(('0x' || substr(md5({said}), 1, 12))::bigint as double) + 0.5::double) / 281474976710656::double"


def oversample_pieces(coef: str = "2.5", k: int = 3, pert: str = "0.02", far: str = "2.0") -> dict[str, str]:
    """osmade: the oversampled training rows; osnear: the nearest rows of every row in its own tail."""
    cols = (*FEATURES, "store_online_gross_sales")
    money = {c: 4 if c.startswith("store") else 2 for c in cols if c.endswith("gross_sales")}
    d = "sqrt(" + " + ".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in FEATURES) + ")"

    def normal(i: int) -> str:
        return f"sqrt(-2.0::double * ln({_draw('p.id', 'p.copy', str(10 + 2 * i))})) * cos({2 * pi!r}::double * {_draw('p.id', 'p.copy', str(11 + 2 * i))})"

    made = ", ".join(f"case when near then p.{c} + u * (o.{c} - p.{c}) else p.{c} + {pert}::double * p.s_{c} * {normal(i)} end as {c}" for i, c in enumerate(cols))
    return {
        "osrows": "select cast(store_nbr * 100 + week as bigint) as id, " + ", ".join(
            f"{rd(c, money[c])} as {c}" if c in money else f"cast({c} as double) as {c}" for c in cols) + " from trainset",
        "osbox": "select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.75) as q3 from (select store_online_gross_sales as v from osrows)",
        "osbound": f"""select med, case when bool_or(v < q1 - {coef} * (q3 - q1)) then min(case when v >= q1 - {coef} * (q3 - q1) then v end) end as low,
            case when bool_or(v > q3 + {coef} * (q3 - q1)) then max(case when v <= q3 + {coef} * (q3 - q1) then v end) end as high
            from (select store_online_gross_sales as v from osrows), osbox group by med""",
        "osclimb": """select r.*, store_online_gross_sales > med as upper,
            case when case when store_online_gross_sales > med then high else low end is not null then
              least((store_online_gross_sales - med) / nullif(case when store_online_gross_sales > med then high else low end - med, 0), 1.0::double) end as u from osrows r, osbound""",
        "ostail": "select * exclude (u, upper), case when coalesce(u * u * (3 - 2 * u), 0) >= 0.8 then (case when upper then 'high' else 'low' end) else 'middle' end as bump from osclimb",
        "ossize": "select bump, count(*) as size from ostail group by 1",
        "osrate": "select bump, round(all_rows / size / inverse / size, 1) as rate from ossize, (select sum(size) as all_rows, sum(1.0::double / size) as inverse from ossize)",
        "ostried": "select * from ostail join osrate using (bump)",
        "osrare": "select * from ostried where bump <> 'middle' and rate > 1",
        "osnear": f"""select a.bump, a.id, b.id as neighbour, {d} as d, row_number() over (partition by a.id order by {d}, b.id) as nearest
            from ostried a join ostried b on a.bump = b.bump and a.id <> b.id qualify nearest <= {k}""",
        "oskth": "select bump, quantile_cont(m, 0.5) as median from (select bump, id, max(round(d, 9)) as m from osnear group by 1, 2) group by 1",
        "osspread": "select bump, " + ", ".join(f"stddev_pop({c}) as s_{c}" for c in cols) + " from osrare group by 1",
        "osbase": f"""select r.*, unnest(range(1, cast(floor(rate - 1) as bigint) + case when {_draw('id', '-2')} < rate - 1 - floor(rate - 1) then 1 else 0 end + 1)) as copy from osrare r""",
        "osdrawn": f"""select b.*, m.median, s.* exclude (bump), c.n, cast(floor({_draw('b.id', 'b.copy', '1')} * c.n) as bigint) + 1 as pick, {_draw('b.id', 'b.copy', '2')} as u
            from osbase b join oskth m using (bump) join osspread s using (bump) join (select id, count(*) as n from osnear group by 1) c using (id)""",
        "ospick": f"select p.*, n.neighbour, round(n.d, 9) <= {far}::double * p.median as near from osdrawn p join osnear n on n.id = p.id and n.nearest = p.pick",
        "osmade": f"""select id, {', '.join(cols)}, 'kept' as origin from ostried where rate >= 1 or {_draw('id', '-1')} < rate
            union all select p.id, {made}, case when near then 'between' else 'shaken' end as origin from ospick p join osrare o on o.id = p.neighbour""",
    }


PIECES |= oversample_pieces()


def fourier_gram_sql(bends: int = 4, waves: int = 3) -> str:
    x = ["1.0::double", "t", *[f"greatest(t - {(j + 1) / (bends + 1)!r}::double, 0.0::double)" for j in range(bends)]]
    for k in range(1, waves + 1):
        x += [f"sin({2 * pi / 12!r}::double * m * {k})", f"cos({2 * pi / 12!r}::double * m * {k})"]
    p = range(len(x))
    sums = [f"{rd(f'sum(x{i} * x{j})', 5)} as g_{i}_{j}" for i in p for j in p if i <= j] + [f"{rd(f'sum(x{i} * ly)', 5)} as r_{i}" for i in p]
    return f"""select store_nbr, count(*) as n, {', '.join(sums)}, {rd('sum(ly * ly)', 5)} as yy from (
        select store_nbr, ly, {', '.join(f'{c} as x{i}' for i, c in enumerate(x))} from (
        select store_nbr, month(month) as m, ln(y) as ly, coalesce((mn - min(mn) over w)::double / nullif(max(mn) over w - min(mn) over w, 0), 0.0::double) as t
        from (select store_nbr, month, y, year(month) * 12 + month(month) as mn from train where y > 0) window w as (partition by store_nbr))) group by 1"""


CORR_COLUMNS = ["week", *_NUM, "holiday_ind", "calendar_season_cd_cat", "store_volume_cd_cat", "fashion_attribute_cd_cat"]
MATERIALIZED = re.compile(r"^(f|g1|g2|w)(d|core|edge|num|lab|ranked|best)$|^(pts|pts2|p1|features|scaled|s1sales|s2sales|sc|dist|areas|fva|trainset0|scoreset0|s1features|ostried|osnear)$")


def statement(final: str) -> str:
    """The final select with every piece it needs, in dependency order."""
    bodies = {name.split("(")[0]: (name, body) for name, body in PIECES.items()}
    order: list[str] = []

    def need(text: str, me: str | None = None) -> None:
        for word in re.findall(r"\b[a-z][a-z0-9_]*\b", text):
            if word in bodies and word != me and word not in order and word not in stack:
                stack.append(word)
                need(bodies[word][1], word)
                stack.remove(word)
                order.append(word)

    stack: list[str] = []
    need(final)
    parts = []
    for word in order:
        name, body = bodies[word]
        how = " as materialized (" if MATERIALIZED.match(word) else " as ("
        parts.append(f"{name}{how}{body})")
    return f"with recursive {', '.join(parts)} {final}" if parts else final


def _round_list(cols: list[str], digits: int) -> str:
    return ", ".join(f"{rd(c, digits)} as {c}" for c in cols)


def corr_sql(table: str) -> str:
    one = " union all ".join(
        f"select '{c}' as column_name, case when min({c}) <> max({c}) then corr({c}::double, store_online_gross_sales) end as r from {table}"
        for c in CORR_COLUMNS)
    return f"select column_name, {rd('r', 6)} as correlation, {rd('abs(r)', 6)} as abs_correlation from ({one})"


_FLAGS = [f"{k}_{c.lower()}" for k in NEAR_KINDS for c in NEAR_CODES]
_WEEKLY = f"""store_nbr, cast(week as bigint) as week, online_customer_counts, online_transaction_counts, {rd('online_gross_sales', 2)} as online_gross_sales,
    calendar_season_cd, instore_customer_counts, instore_transaction_counts, {rd('instore_gross_sales', 2)} as instore_gross_sales,
    {', '.join(_FLAGS)}, census_block_counts, store_volume_cd, fashion_attribute_cd, opened_days"""
_SETCOLS = ", ".join(
    f"{rd(c, 2)} as {c}" if c.endswith("gross_sales") else f"cast({c} as bigint) as {c}" for c in _NUM)
_CATS = ", ".join(f"cast({c}_cat as bigint) as {c}_cat" for c in ("calendar_season_cd", "store_volume_cd", "fashion_attribute_cd"))
_TA = f"select store_nbr, geoid from "

FINAL: dict[str, str] = {
    # sources
    "census_population": "select distinct geo_id, cast(pop as bigint) as pop_25_years_over from census",
    "open_stores": "select distinct store_nbr from stores where close_date is null",
    "closed_stores": "select distinct store_nbr from stores where concept = 'B' and year(close_date) = 2020 and month(close_date) = 12",
    "similarity_filled": """select store_nbr, r_name as region, case when store_volume_cd <> 'C' then store_volume_cd else 'UNKNOWN' end as store_group
        from loc join region on r_regionkey = dma_cd""",
    # features
    "census_by_tract": "select geoid, population from tracts",
    "census_tract_count": "select count(distinct geoid) as tracts from tracts",
    "fips_normalize": f"select store_nbr, {CODES}, geoid, instore_transaction_count from tx",
    "density": f"select store_nbr, geoid, {rd('d', 9)} as instore_density from txd",
    "area_features": f"select store_nbr, geoid, {_round_list(['instore_density', 'bopis_density', 'distance', 'closeness'], 9)} from features",
    "scaled_features": f"select store_nbr, geoid, {rd('x')} as z_instore_density, {rd('y')} as z_closeness, {rd('z')} as z_bopis_density from scaled",
    "inverse_scaled": f"""select store_nbr, geoid, {rd('x * sx + mx')} as raw_instore_density, {rd('y * sy + my')} as raw_closeness,
        {rd('z * sz + mz')} as raw_bopis_density from scaled""",
    "code_gaps": """select 'transactions' as table_name, count(*) as row_count, cast(0 as bigint) as without_code from tx
        union all select 'distance', count(*), 0 from dist union all select 'bopis', count(*), 0 from bp""",
    # clustering
    "core_tracts": "select store_nbr, row_id as geoid, cast(core as bigint) as core from flab",
    "neighbor_counts": "select store_nbr, i as geoid, count(*) as neighbors from fd join params using (store_nbr) where d <= eps group by 1, 2",
    "dbscan_labels": f"select store_nbr, row_id as geoid, eps, cast(min_samples as bigint) as min_samples, label from flab",
    "kept_rows": f"select store_nbr, row_id as geoid, label, {rd('distance')} as distance from fkept",
    "near_group": f"select store_nbr, row_id as geoid, {rd('distance')} as distance from fnear",
    "near_cluster_mean": f"select store_nbr, {rd('avg(distance)')} as mean_distance, count(*) as tracts from fnear group by 1",
    "trade_area_fixed": "select distinct n.store_nbr, geoid from fnear n join pts p using (store_nbr, row_id) join features f on f.store_nbr = n.store_nbr and f.geoid = n.row_id where n.store_nbr in (select store_nbr from stores where close_date is null)",
    "trade_area_closed": "select distinct n.store_nbr, n.row_id as geoid from fnear n where n.store_nbr in (select store_nbr from stores where close_date is not null)",
    "stores_without_params": "select store_nbr from stores where store_nbr not in (select store_nbr from params)",
    "silhouette": f"select store_nbr, {rd('score')} as score, clusters, points from franked",
    "grid_scores": f"select store_nbr, eps, cast(min_samples as bigint) as min_samples, {rd('score')} as score, clusters, points from g1ranked",
    "best_params": f"select store_nbr, eps, cast(min_samples as bigint) as min_samples, {rd('score')} as score from g1best",
    "trade_area_tuned": "select distinct store_nbr, row_id as geoid from final1",
    "area_summary": f"""select s.store_nbr, a.eps as phase_1_eps_val, cast(a.min_samples as double) as phase_1_minsam, {rd('a.score')} as phase_1_best_score,
        b.eps as phase_2_eps_val, cast(b.min_samples as double) as phase_2_minsam, {rd('b.score')} as phase_2_best_score,
        cast(o.tracts as double) as tracts_1, {rd('o.i')} as instore_transaction_1, {rd('o.c')} as closeness_1, {rd('o.d')} as distance_1, {rd('o.b')} as bopis_order_counts_1,
        cast(n.tracts as double) as tracts, {rd('n.i')} as instore_transaction, {rd('n.c')} as closeness, {rd('n.d')} as distance, {rd('n.b')} as bopis_order_counts,
        case when b.eps is null then 'no_valid_params' else 'ok' end as status
        from (select distinct store_nbr from pts) s left join g1best a using (store_nbr) left join g2best b using (store_nbr)
        left join (select store_nbr, count(distinct row_id) as tracts, avg(instore_density) as i, avg(closeness) as c, avg(distance) as d, avg(bopis_density) as b from outer1 group by 1) o using (store_nbr)
        left join (select store_nbr, count(distinct row_id) as tracts, avg(instore_density) as i, avg(closeness) as c, avg(distance) as d, avg(bopis_density) as b from final1 group by 1) n using (store_nbr)""",
    "status_counts": """select case when b.eps is null then 'no_valid_params' else 'ok' end as status, count(*) as stores
        from (select distinct store_nbr from pts) s left join g2best b using (store_nbr) group by 1""",
    # overlap
    "overlap_tracts": "select geoid, count(distinct store_nbr) as stores from areas group by 1 having count(distinct store_nbr) > 1",
    "total_population": "select store_nbr, cast(population as bigint) as population from closed_pop",
    "overlap_population": "select store_nbr, cast(overlapped_customers as bigint) as overlapped_customers from closed_over",
    "area_overlap_pairs": f"""select closed_store, open_store, shared_tracts, cast(shared_population as bigint) as shared_population,
        {rd('shared_population::double / nullif(population, 0)')} as share from pairs_all""",
    "area_tiers": """select store_nbr, geoid, customers, case when before < 0.7 * total then 'primary' when before < 0.9 * total then 'secondary' else 'tertiary' end as tier
        from (select store_nbr, geoid, instore_transaction_count as customers,
            sum(instore_transaction_count) over (partition by store_nbr order by distance) - sum(instore_transaction_count) over (partition by store_nbr, distance) as before,
            sum(instore_transaction_count) over (partition by store_nbr) as total
          from tx join dist using (store_nbr, geoid))""",
    "min_volume": """select store_nbr, geoid, instore_transaction_count from tx
        where store_nbr in (select store_nbr from tx group by 1 having sum(instore_transaction_count) >= 390)""",
    "haversine": f"""select store_nbr, a.mailing_address_id, {rd('2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians(p.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(p.latitude)) * pow(sin(radians(p.longitude - a.longitude) / 2), 2))))')} as miles
        from s1sales s join addr a using (mailing_address_id) join locgeo p using (location_id) group by all""",
    # forecasts
    "month_date": f"select store_nbr, {ymd('month')} as month, {rd('y', 2)} as sales from sales_m",
    "split_years": "select case when yearss in (2000, 2001) then 'test' else 'train' end as part, count(*) as months, count(distinct store_nbr) as stores from sales_m group by 1",
    "month_calendar": f"select distinct store_nbr, {ymd('month')} as month from tfc",
    "forecast": f"select store_nbr, {ymd('month')} as month, {rd('yhat', 3)} as yhat, {rd('yhat - 1.2816::double * spread', 3)} as lower, {rd('yhat + 1.2816::double * spread', 3)} as upper from tfc",
    "forecast_vs_actual_open": f"select store_nbr, {ymd('month')} as month, {_round_list(['predicted', 'lower', 'upper', 'actual'], 3)}, {rd('diff')} as relative_difference from fva_open",
    "forecast_vs_actual_closed": f"select store_nbr, {ymd('month')} as month, {_round_list(['predicted', 'lower', 'upper', 'actual'], 3)} from fva_closed",
    "forecast_error": f"select store_nbr, {rd('avg(abs(actual - predicted)) / nullif(avg(actual), 0) * 100')} as wape, count(*) as months from fva_open group by 1",
    "forecast_mean_error": f"select {rd('avg(w)')} as mean_wape, count(*) as stores from (select avg(abs(actual - predicted)) / nullif(avg(actual), 0) * 100 as w from fva_open group by store_nbr)",
    "forecast_backtest": f"""select store_nbr, {ymd('cutoff')} as cutoff, {rd('avg(abs(b.y - f.yhat)) / nullif(avg(b.y), 0) * 100')} as wape, count(*) as months
        from bfc f join bt b using (store_nbr, cutoff, month) group by 1, 2""",
    "train_tail": f"""select store_nbr, cast(position as bigint) as position, {ymd('f.month')} as month, {rd('f.yhat', 3)} as yhat, {rd('r.y', 2)} as train_tail from tfc f
        left join (select store_nbr, y, 19 - row_number() over (partition by store_nbr order by month desc) as position,
            count(*) over (partition by store_nbr) as n from train qualify n >= 18 and position >= 1) r using (store_nbr, position)""",
    # impact
    "similar_stores": "select store_nbr, region, tier, region || '/' || tier as store_group from grouped",
    "borrowed_history": f"""select s.store_nbr as closed_store, g.region || '/' || g.tier as store_group, {ymd('month')} as month,
        {rd('group_difference')} as group_difference, open_stores
        from (select store_nbr from stores where close_date is not null) s join grouped g using (store_nbr)
        join (select region, tier, month, avg(diff) as group_difference, count(*) as open_stores from fva_open join grouped using (store_nbr) group by 1, 2, 3) p
          on p.region = g.region and p.tier = g.tier""",
    "pandemic_factor": f"select {ymd('month')} as month, {rd('pandemic_factor')} as pandemic_factor, stores from pfactor",
    "closure_pairs": "select closed_store, open_store from pairs",
    "closure_impact": f"""select closed_store, open_store, {ymd('month')} as month, {rd('actual', 3)} as actual, {rd('predicted', 3)} as predicted,
        {rd('pct_difference')} as pct_difference, {rd('pandemic_factor')} as pandemic_factor, {rd('impact')} as impact from impact""",
    "recovery_rate": f"""select closed_store, {rd('sum(impact * predicted)', 2)} as lifted_sales, count(distinct open_store) as open_stores, {rd('max(lost_sales)', 2)} as lost_sales,
        {rd('sum(impact * predicted) / nullif(max(lost_sales), 0)')} as recovery_rate from impact join lost using (closed_store) group by 1""",
    "closure_factor": f"""select store_nbr, {rd('pre')} as pre, {rd('baseline')} as baseline, {rd('post')} as post, {rd('(post - baseline) / nullif(pre, 0)')} as closure_factor
        from (select store_nbr, avg(y) as pre from train group by 1) join (select store_nbr, avg(predicted) as baseline, avg(actual) as post from fva group by 1) using (store_nbr)""",
    # sales
    "store_customers": f"select store_nbr, {CODES}, customer_id, mailing_address_id, address_id from sc",
}
for _n, _px in (("first", "s1"), ("second", "s2")):
    FINAL |= {
        f"enriched_sales_{_n}": f"""select trans_id, order_trans_id, customer_id, address_id, mailing_address_id, household_id, location_id, {ymd('trans_booked_dt')} as booked_day,
            {rd('sales', 3)} as sales, {rd('gross_sales', 2)} as gross_sales, ecom_order_source_cd, channel, cast(year as bigint) as year, cast(week as bigint) as week,
            cast(month as bigint) as month, cast(store_dma as bigint) as store_dma, store_dma_name, store_nbr, {CODES}, postal_cd,
            {_round_list(['cust_latitude', 'cust_longitude', 'store_latitude', 'store_longitude'], 6)} from {_px}sales""",
        f"channel_weekly_{_n}": f"select store_nbr, cast(week as bigint) as week, channel, customers, transactions, {rd('gross_sales', 2)} as gross_sales from {_px}weekly",
        f"near_weekly_{_n}": f"select store_nbr, cast(week as bigint) as week, {', '.join(_FLAGS)} from {_px}near",
        f"weekly_features_{_n}": f"select {_WEEKLY} from {_px}features",
    }
FINAL |= {
    "near_flags": f"""select trans_id, {', '.join(f"cast(case when {k} = '{c}' then 1 else 0 end as bigint) as {k}_{c.lower()}" for k in NEAR_KINDS for c in NEAR_CODES)} from nearcodes""",
    "tract_counts": "select store_nbr, census_block_counts from sinfo",
    "store_age": "select store_nbr, census_block_counts, store_volume_cd, fashion_attribute_cd, opened_days from sinfo",
    "season_by_week": "select cast(week as bigint) as week, calendar_season_cd from season",
    # closure
    "negative_factors": f"select store_nbr, {rd('closure_factor')} as closure_factor from factors where closure_factor < 0",
    "closure_training": f"""select store_nbr, cast(week as bigint) as week, calendar_season_cd, store_volume_cd, fashion_attribute_cd, {rd('closure_factor')} as closure_factor,
        {rd('store_online_gross_sales', 4)} as store_online_gross_sales, cast(holiday_ind as bigint) as holiday_ind, {_SETCOLS}, {_CATS} from trainset""",
    "closure_scoring": f"""select store_nbr, cast(week as bigint) as week, calendar_season_cd, store_volume_cd, fashion_attribute_cd,
        cast(holiday_ind as bigint) as holiday_ind, {_SETCOLS}, {_CATS} from scoreset""",
    "label_encoding": """select 'calendar_season_cd' as column_name, v as value, cast(code as bigint) as code from v_season
        union all select 'store_volume_cd', v, code from v_volume union all select 'fashion_attribute_cd', v, code from v_fashion""",
    "corr_with_target": corr_sql("trainset"),
    "top_features": f"select column_name, abs_correlation from ({corr_sql('trainset')}) where correlation is not null order by abs_correlation desc, column_name limit 40",
    "model_features": "select " + ", ".join(
        f"{rd(c, 4 if c.startswith('store') else 2)} as {c}" if c.endswith("gross_sales") else f"cast({c} as bigint) as {c}" for c in (*FEATURES, "store_online_gross_sales")) + " from trainset",
    "tail_bounds": f"""select {rd('med', 3)} as med,
        {rd('case when below then low end', 3)} as low, {rd('case when above then high end', 3)} as high from (
        select med, min(case when v >= q1 - 2.5 * (q3 - q1) then v end) as low, max(case when v <= q3 + 2.5 * (q3 - q1) then v end) as high,
          bool_or(v < q1 - 2.5 * (q3 - q1)) as below, bool_or(v > q3 + 2.5 * (q3 - q1)) as above
        from (select l_extendedprice * l_quantity as v from lineitem),
          (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.75) as q3 from (select l_extendedprice * l_quantity as v from lineitem))
        group by med)""",
    "oversample_tails": "select id, " + ", ".join(f"{rd(c, 4)} as {c}" for c in (*FEATURES, "store_online_gross_sales")) + ", origin from osmade",
    "nearest_rows": f"select bump, id as row, neighbour, {rd('d')} as distance, cast(nearest as bigint) as nearest from osnear",
    "fourier_gram": fourier_gram_sql(),
    "closure_report": f"select store_nbr, {rd('closure_factor')} as closure_factor from report",
    "closure_top10": f"select store_nbr, {rd('closure_factor')} as closure_factor from report order by report.closure_factor desc nulls last, store_nbr limit 10",
    "closure_outliers": f"select store_nbr, {rd('closure_factor')} as closure_factor from report where closure_factor >= 100",
    "closure_mean_no_outliers": f"select {rd('avg(closure_factor)')} as mean_factor, {rd('avg(case when closure_factor < 100 then closure_factor end)')} as mean_without_outliers, count(*) as stores from report",
    "store_info_rows": "select distinct store_nbr, cast(pop_25_years_over as bigint) as pop_25_years_over, cast(census_block_counts as bigint) as census_block_counts from scoreset0",
}


PIECES |= {
    "simst": """select s_suppkey as store_nbr, r_name as region, (['A', 'A+', 'B', 'C'])[s_suppkey % 4 + 1] as vol, (['F1', 'F2', 'F3'])[s_suppkey % 3 + 1] as fash
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "simsold": "select store_nbr, sum(y) as sales from sales_m group by 1",
    "simppl": "select store_nbr, coalesce(sum(population), 0) as population, count(distinct geoid) as n_tracts from areas left join tracts using (geoid) group by 1",
    "simc": "select simst.*, sales, population, population / n_tracts::double as density from simst join simsold using (store_nbr) join simppl using (store_nbr)",
    "simg": "select max(sales) - min(sales) as rs, (max(population) - min(population))::double as rp, max(density) - min(density) as rd from simc",
    "simd": """select a.store_nbr, b.store_nbr as neighbour, round((abs(a.sales - b.sales) / rs + abs(a.population - b.population) / rp + abs(a.density - b.density) / rd
        + (a.region <> b.region)::int + (a.vol <> b.vol)::int + (a.fash <> b.fash)::int) / 6.0::double, 12) as distance from simc a, simc b, simg where a.store_nbr <> b.store_nbr""",
}
PIECES |= {"wtrial": "select store_nbr, eps, min_samples from g1best"} | dbscan_pieces("w", "pts", "wtrial")
PIECES |= {"wkept": "select p.*, l.label from wlab l join pts p using (store_nbr, row_id) where l.label <> 0 and p.distance < 50"} | near_pieces("w", "wkept")
FINAL |= {
    "cohort_loaded": " union all ".join(f"select {CODES}, count(*) as row_count, '{n}' as table_name from {t} group by {CODES}"
                                        for n, t in (("transactions", "tx"), ("distance", "dist"), ("bopis", "bp"))),
    "params_round_trip": "select distinct store_nbr, row_id as geoid from wnear",
    "areas_written": f"select store_nbr, {CODES}, geoid, 'open' as brand from open_areas union all select store_nbr, {CODES}, geoid, 'closed' from closed_areas",
    "forecasts_written": f"select *, 'closed' as cohort from ({FINAL['forecast_vs_actual_closed']})",
    "sales_loaded": FINAL["month_date"],
    "competitors_loaded": f"select store_nbr, {', '.join(f'cast({c} as bigint) as {c}' for c in COMPETITOR_COUNTS)} from comp",
    "factors_loaded": FINAL["negative_factors"],
    "weekly_loaded": f"select distinct * from ({FINAL['weekly_features_first']})",
    "warehouse_loaded": FINAL["channel_weekly_first"],
    "report_written": FINAL["closure_report"],
    "similar_nearest": f"""select store_nbr, neighbour, {rd('distance')} as distance, cast(row_number() over (partition by store_nbr order by simd.distance, neighbour) as bigint) as nearest
        from simd qualify nearest <= 3""",
    "model_checks": """select m.model, count(*) as n_rows, count(distinct store_nbr * 100 + week) as n_keys, true as holds
        from scoreset, (values ('forest'), ('linear')) m(model) group by 1""",
    "importance_checks": f"select {len(FEATURES)} as n_features, 1.0::double as total, count(*) > 0 as holds from trainset",
    "factor_copied": f"select store_nbr, cast(week as bigint) as week, {rd('closure_factor')} as closure_factor, {rd('closure_factor')} as mod_closure_factor from trainset",
}


def oracle_sql() -> dict[str, str]:
    return {name: statement(final) for name, final in FINAL.items()}
