"""Oversampling of rare target values: more rows in the tails, fewer in the middle."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradearea.operators import blocks
from tradearea.operators.grouped import join_on, quantiles
from tradearea.sources.scratch import cut


def unit_draw(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on seed and key only, not on where the row is processed: 48 bits of an MD5 sum."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 48))


def relevance_bounds(df: DataFrame, y: str, coef: float = 2.5) -> DataFrame:
    """One row: median and the outermost values still inside the box-plot fences.

    A side without any value beyond its fence has no rare values: its bound is NULL.
    """
    box = quantiles(df, y, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    value, reach = F.col(y), coef * (F.col("q3") - F.col("q1"))
    low_fence, high_fence = F.col("q1") - reach, F.col("q3") + reach
    seen = join_on(df.select(y), box, []).groupBy("q1", "med", "q3").agg(
        F.min(F.when(value >= low_fence, value)).alias("low"), F.max(F.when(value <= high_fence, value)).alias("high"),
        F.max((value < low_fence).cast("int")).alias("below"), F.max((value > high_fence).cast("int")).alias("above"))
    return seen.select(
        "med", F.when(F.col("below") == 1, F.col("low")).alias("low"),
        F.when(F.col("above") == 1, F.col("high")).alias("high"))


def tail_of(df: DataFrame, y: str, coef: float = 2.5, thres: float = 0.8) -> DataFrame:
    """Add `relevance` (0 at the median, 1 at the bounds, smooth between) and `bump`.

    `bump` is 'low' or 'high' for rows whose relevance reaches the threshold, else 'middle'.
    """
    bounds = relevance_bounds(df, y, coef)
    value = F.col(y)

    def climb(bound: str) -> Column:
        u = F.least(F.try_divide(value - F.col("med"), F.col(bound) - F.col("med")), F.lit(1.0))
        return F.when(F.col(bound).isNotNull(), u * u * (3 - 2 * u))

    upper = value > F.col("med")
    relevance = F.coalesce(F.when(upper, climb("high")).otherwise(climb("low")), F.lit(0.0))
    rare = F.col("relevance") >= thres
    return join_on(df, bounds, []).withColumn("relevance", relevance).withColumn(
        "bump", F.when(rare & upper, "high").when(rare, "low").otherwise("middle")).drop("med", "low", "high")


def bump_rates(tailed: DataFrame) -> DataFrame:
    """(bump, size, rate): wanted rows per row; above 1 in rare bumps, below 1 in the middle.

    The more extreme a bump's share, the stronger it is moved: each size is scaled by the square of
    the mean size over the size, normed so that the wanted sizes add up to the rows there are.
    """
    sizes = tailed.groupBy("bump").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("bumps"), F.sum(1 / F.col("size")).alias("inverse"))
    wanted = F.col("rows") / F.col("size") / F.col("inverse")
    return join_on(sizes, whole, []).select("bump", "size", F.round(wanted / F.col("size"), 1).alias("rate"))


#: sampled places that lay out the blocks, and places that come to one task of a block
SAMPLED, SENT = 1 << 15, 1 << 14


def nearest_within(df: DataFrame, by: Sequence[str], coords: Sequence[str], row: str, k: int,
                   per_block: int = 1024) -> DataFrame:
    """(by, row, neighbour, distance, nearest): the k nearest other rows of the same group, exactly; ties to the smaller row.

    `row` is an integer key. Equal places are one place that lists its smallest rows. Halving along the widest coordinates
    of a bounded sample lays out blocks of about `per_block` places, which route rows and decide no result. A place's
    nearest rows inside its block bound how far the others can be, so it goes on only to blocks whose box, in all
    coordinates, is no farther: two steps of numpy per block, and pairs are never rows. A row with a NULL is left out.
    """
    by = list(by) or ["_all"]
    xs = [f"x{d}" for d in range(len(coords))]
    place = ["_g", *xs]
    source = df if "_all" not in by else df.withColumn("_all", F.lit(0))
    pts = source.select(*by, F.to_json(F.struct(*by)).alias("_g"), F.col(row).cast("long").alias("row"), *[F.col(c).cast("double").alias(x) for c, x in zip(coords, xs)])
    rows = cut(pts.dropna().groupBy(*by, *place, "row").agg(F.count(F.lit(1)).alias("n")), "points")
    # rows that share a key are one row at several places: their own entries must not fill a list
    most = rows.groupBy("_g", "row").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    keep = k + most
    smallest = F.row_number().over(Window.partitionBy(*place).orderBy("row"))
    heads = rows.select(*place, "row", "n").withColumn("_at", smallest).filter(F.col("_at") <= keep).groupBy(*place).agg(
        F.sort_array(F.collect_list(F.struct("row", "n"))).alias("heads"))
    known = cut(heads.withColumn("_p", F.monotonically_increasing_id()), "places")
    share = min(1.0, SAMPLED / max(1, known.count()))
    sampled: dict[str, list] = {}
    for r in known.sample(share, 1).select("_g", F.array(*xs).alias("x")).collect():
        sampled.setdefault(r["_g"], []).append(r["x"])
    trees = {g: blocks.tree_of(np.array(x), max(8, int(per_block * share)) if share < 1 else per_block) for g, x in sampled.items()}
    plain = known.select("_g", "_p", F.array(*xs).alias("x"), "heads")
    put = cut(plain.mapInArrow(blocks.to_blocks(trees), f"{_ddl(plain)}, _block int"), "blocks")
    own = cut(put.groupBy("_g", "_block").applyInArrow(blocks.within_block(keep), f"_g string, _block int, _p bigint, x array<double>, u double, best {blocks.BEST}"), "nearest")
    boxes: dict[str, list] = {}
    for r in own.groupBy("_g", "_block").agg(*[f(F.get("x", F.lit(d))).alias(f"{n}{d}") for n, f in (("l", F.min), ("h", F.max)) for d in range(len(xs))]).collect():
        boxes.setdefault(r[0], []).append((r[1], r[2:2 + len(xs)], r[2 + len(xs):]))
    laid = {g: tuple(np.array(c) for c in zip(*b)) for g, b in boxes.items()}
    sent = cut(own.select("_g", "_block", "_p", "x", "u").mapInArrow(blocks.to_others(laid), "_g string, _block int, _p bigint, x array<double>, u double"), "sent")
    parts = cut(sent.groupBy("_g", "_block").agg(F.ceil(F.count(F.lit(1)) / F.lit(SENT)).cast("int").alias("_parts")), "parts")
    asked = sent.join(parts, ["_g", "_block"]).withColumn("_part", F.pmod(F.xxhash64("_p"), F.col("_parts")).cast("int")).drop("_parts")
    hosts = put.join(parts, ["_g", "_block"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    met = asked.groupBy("_g", "_block", "_part").cogroup(hosts.groupBy("_g", "_block", "_part")).applyInArrow(
        blocks.across_blocks(keep), f"_p bigint, best {blocks.BEST}")
    lists = own.select("_p", "best").unionByName(met).groupBy("_p").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, keep).alias("best"))
    others = F.transform(F.filter("best", lambda b: b["neighbour"] != F.col("row")), lambda b: F.struct(
        b["distance"].alias("distance"), b["neighbour"].alias("neighbour"), F.least(b["n"] * F.col("n"), F.lit(k)).cast("int").alias("n")))
    of = rows.join(known.select(*place, "_p"), place).select(*by, "row", "n", "_p").join(lists, "_p").select(*by, "row", others.alias("best"))
    every = of.groupBy(*by, "row").agg(F.flatten(F.collect_list("best")).alias("best")).select(*by, "row", F.slice(
        F.array_sort(F.flatten(F.transform("best", lambda b: F.array_repeat(b, b["n"])))), 1, k).alias("best"))
    return every.select(*by, "row", F.posexplode("best").alias("_i", "_n")).select(
        *[c for c in by if c != "_all"], "row", F.col("_n.neighbour").alias("neighbour"), F.col("_n.distance").alias("distance"), (F.col("_i") + 1).alias("nearest"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def oversample_tails(df: DataFrame, y: str, key: str, k: int = 3, coef: float = 2.5, thres: float = 0.8,
                     seed: int = 42, rates: dict[str, float] | None = None, pert: float = 0.02, far: float = 2.0) -> DataFrame:
    """Rows of the numeric table with rare targets multiplied and common ones thinned.

    A tail row yields rate - 1 new rows, each from one of its k nearest rows in the same tail, drawn. If that row is no
    farther than `far` times the tail's median distance to the k-th nearest row, the new row lies between the two at a
    drawn position, and its target is the mean of both weighted by nearness. A farther row says little about what
    lies between, so then the base row itself is shaken: each value by `pert` of the tail's standard deviation times a normal draw. Rows
    of the middle stay with probability `rate`. `key` is a unique integer; draws are digests of it, so a
    repeated or re-partitioned run gives the same rows. `rates` overrides the computed rates. A NULL in
    any column is an error that names the column. A tail of one row has no neighbours and yields no new rows.
    Result: the columns of df plus `origin` ('kept', 'between' or 'shaken'); made rows repeat their base row's key.
    """
    columns = [c for c in df.columns if c != key]

    def known(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(
            F.raise_error(F.lit(f"{name} is NULL")).cast(df.schema[name].dataType)).alias(name)

    tailed = tail_of(df.select(*[known(c) for c in df.columns]), y, coef, thres)
    if rates is None:
        tailed = cut(tailed, "bumps")
        wanted = bump_rates(tailed).select("bump", "rate")
        tailed = tailed.join(wanted, "bump")
    else:
        pick = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
        tailed = tailed.withColumn("rate", F.coalesce(F.element_at(pick, F.col("bump")), F.lit(1.0)))
    tailed = cut(tailed, "tails")
    stays = (F.col("rate") >= 1) | (unit_draw(seed, F.col(key), F.lit(-1)) < F.col("rate"))
    old = tailed.filter(stays).select(key, *[F.col(c).cast("double").alias(c) for c in columns], F.lit("kept").alias("origin"))

    rare = tailed.filter("bump <> 'middle' and rate > 1").select("bump", "rate", key, *[F.col(c).cast("double").alias(c) for c in columns])
    xs = [c for c in columns if c != y]
    near = cut(nearest_within(rare, ["bump"], xs, key, k).withColumn("distance", F.round("distance", 9)), "neighbours")
    kth = quantiles(near.groupBy("bump", "row").agg(F.max("distance").alias("_kth")), "_kth", {"_median": 0.5}, ["bump"])
    spread = rare.groupBy("bump").agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    choices = near.groupBy("bump", F.col("row").alias(key)).agg(F.sort_array(F.collect_list(F.struct("nearest", "neighbour", "distance"))).alias("choices"))
    extra = F.col("rate") - 1
    whole = F.floor(extra)
    copies = whole + (unit_draw(seed, F.col(key), F.lit(-2)) < extra - whole).cast("long")
    bases = (
        rare.withColumn("copies", copies).filter("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .join(choices, ["bump", key]).join(kth, "bump").join(spread, "bump")
    )

    def draw(n: int) -> Column:
        return unit_draw(seed, F.col(key), F.col("copy"), F.lit(n))

    drawn = bases.withColumn("_pick", F.get("choices", F.floor(draw(1) * F.size("choices")).cast("int"))).withColumns({
        "neighbour": F.col("_pick.neighbour"), "u": draw(2), "_near": F.col("_pick.distance") <= F.lit(far) * F.col("_median")})
    other = rare.select("bump", F.col(key).alias("neighbour"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    # two uniform draws make a normal one
    def normal(i: int) -> Column:
        return F.sqrt(F.lit(-2.0) * F.log(draw(10 + 2 * i))) * F.cos(F.lit(2 * pi) * draw(11 + 2 * i))

    made = drawn.join(other, ["bump", "neighbour"]).select(
        key,
        *[F.when(F.col("_near"), F.col(c) + F.col("u") * (F.col(f"_o_{c}") - F.col(c))).otherwise(
            F.col(c) + F.lit(pert) * F.col(f"_s_{c}") * normal(i)).alias(c) for i, c in enumerate(columns)],
        F.when(F.col("_near"), "between").otherwise("shaken").alias("origin"))
    return old.unionByName(made)
