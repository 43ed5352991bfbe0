"""Running totals, ranks and quantiles that stay spread out when one group holds most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradearea.sources.scratch import cut

SLOTS = 1024
#: values of a group that one slot may hold
ONE_SLOT = 4 * SLOTS
#: borders looked at in one go when a value is routed to its slot
STRIDE = 32


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on the group columns; an empty list means one global group.

    Then `right` has at most one row, which is read as a scalar: no join is planned, every row of `left` stays, and a
    second row of `right` is an error.
    """
    if keys:
        return left.join(right, list(keys), how)
    row = right.select(F.struct(*right.columns).alias("_row")).scalar()
    return left.withColumn("_row", row).select(*left.columns, "_row.*")


def value_slots(df: DataFrame, by: Sequence[str], order: str, slots: int = SLOTS) -> DataFrame:
    """Add `_slot`: how many of the group's approximate quantiles lie below a number.

    The quantiles only route rows, so their error moves borders and no result; a heavy tail does not
    fill one slot as equal steps would. Every STRIDE-th border is tried first, then those after it.
    Approximate quantiles come out differently when they are merged in another order, so the borders are written once:
    whoever reads the slots twice sees the same ones. A group of few values is one slot.
    """
    borders = cut(df.groupBy(*by).agg(F.when(F.count(order) > ONE_SLOT, F.array_distinct(F.percentile_approx(
        order, [i / slots for i in range(1, slots)], 4 * slots))).alias("_borders")), "borders")
    heads = F.filter("_borders", lambda b, i: i % STRIDE == 0)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < F.col(order)))

    routed = join_on(df, borders.withColumn("_heads", heads), by).withColumn("_head", F.greatest(below(F.col("_heads")) - 1, F.lit(0)))
    near = F.slice("_borders", F.col("_head") * STRIDE + 1, F.lit(STRIDE))
    return routed.withColumn(
        "_slot", F.coalesce(F.col("_head") * STRIDE + below(near), F.lit(0)).cast("long")).drop("_borders", "_heads", "_head")


def running_total(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str],
                  slot: Column | None = None) -> DataFrame:
    """Sums over all rows of the group up to and including `order`, which must be unique in it.

    `sums` maps output names to summed columns. Rows are ordered in two levels: totals per slot
    (few rows per group) give each slot its start, and inside a slot a window adds the rest, so a
    group of any size is spread over its slots. `slot` must not decrease with `order`; the default
    routes numbers by approximate quantiles of the group.
    """
    by = list(by)
    slotted = value_slots(df, by, order) if slot is None else df.withColumn("_slot", slot)
    totals = slotted.groupBy(*by, "_slot").agg(
        *[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by, "_slot",
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    inside = Window.partitionBy(*by, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        slotted.join(starts, [*by, "_slot"])
        .withColumns({
            name: F.col(f"_s{i}") + F.sum(c).over(inside) for i, (name, c) in enumerate(sums.items())
        })
        .drop("_slot", *[f"_s{i}" for i in range(len(sums))])
    )


def quantiles(df: DataFrame, value: str, points: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per named point."""
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    sizes = known.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(sizes, by, "_v", {"_upto": "_n"})
    total = sizes.groupBy(*by).agg(F.sum("_n").alias("_all_rows"))
    placed = join_on(ranked, total, by)
    picks = []
    for name, q in points.items():
        at = F.lit(float(q)) * (F.col("_all_rows") - 1)
        for side, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
    found = placed.groupBy(*by).agg(*picks, F.max("_all_rows").alias("_all_rows"))
    out = [*by]
    for name, q in points.items():
        at = F.lit(float(q)) * (F.col("_all_rows") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*out)


def occurrences(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in a column `name`; which row gets which number is open.

    For telling equal rows apart. The rows must be a written table: a running number of its rows puts them in order,
    in two levels, so a group may hold any share of them.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    slot = F.shiftright("_row", 12)
    counted = rows.groupBy(*by, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slot").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_slot").orderBy("_row")
    return rows.withColumn("_slot", slot).join(starts, same & (F.col("_slot") == F.col("_of"))).withColumn(
        name, F.col("_start") + F.row_number().over(inside) - 1).select(*df.columns, name)
