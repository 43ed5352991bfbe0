"""How areas share tracts and population."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.operators.tiles import Batches
from tradearea.plans.areas import with_population
from tradearea.sources.scratch import cut, grown

STORE = ["store_nbr"]
#: stores and tracts of stores in one block, and numbers in one matrix of a step
STORES, ENTRIES, NUMBERS = 4096, 1 << 19, 1 << 21


def overlap_tracts(areas: DataFrame) -> DataFrame:
    """Tracts that lie in the area of more than one store."""
    return areas.groupBy("geoid").agg(F.countDistinct("store_nbr").alias("stores")).filter("stores > 1")


def total_population(areas: DataFrame, tracts: DataFrame) -> DataFrame:
    return with_population(areas, tracts).groupBy(*STORE).agg(
        F.coalesce(F.sum("population"), F.lit(0)).alias("population"))


def overlap_population(areas: DataFrame, shared: DataFrame, tracts: DataFrame) -> DataFrame:
    """Population per store in the shared tracts only; stores without any are absent."""
    inside = with_population(areas, tracts).join(shared, "geoid", "left_semi")
    return inside.groupBy(*STORE).agg(F.coalesce(F.sum("population"), F.lit(0)).alias("overlapped_customers"))


def _into_blocks(areas: DataFrame, name: str) -> DataFrame:
    """(name, stores, sizes, tracts) of areas (store, population, list of tract numbers): near stores, by their first tract, in one row."""
    written = cut(areas.withColumn("_n", F.size("tracts")), "areas")
    seen = written.agg(F.count(F.lit(1)).alias("stores"), F.coalesce(F.sum("_n"), F.lit(0)).alias("entries")).first()
    blocks = max(1, -(-seen["stores"] // STORES), -(-seen["entries"] // ENTRIES))
    dealt = written.withColumn("_first", F.array_min("tracts")).repartitionByRange(blocks, "_first", "store")
    return grown(dealt.withColumn(name, F.spark_partition_id()).groupBy(name).agg(
        F.collect_list(F.struct("store", "population", "tracts")).alias("_rows")).select(
        name, F.col("_rows.store").alias(f"{name}_stores"), F.col("_rows.population").alias(f"{name}_population"),
        F.transform("_rows", lambda r: F.size(r["tracts"])).alias(f"{name}_sizes"), F.flatten("_rows.tracts").alias(f"{name}_tracts")), name)


def _shared_of_blocks(names: list[str]):
    """Pairs of stores of two blocks that share a tract: matrix products of who has which tract, some rows at a time."""

    def items(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name))[row].values

    def product(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if np.abs(weight.astype(float)).sum() < 2**53:  # whole numbers stay exact in doubles
            return ((left * weight.astype(float)) @ right).astype(np.int64)
        return (left.astype(np.int64) * weight) @ right.astype(np.int64)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                mine, theirs = (items(batch, f"{side}_tracts", row).to_numpy() for side in ("closed", "open"))
                of_mine, of_theirs = (np.repeat(np.arange(len(n)), n) for n in (
                    items(batch, f"{side}_sizes", row).to_numpy() for side in ("closed", "open")))
                tracts = np.intersect1d(mine, theirs)
                rows, people = (items(batch, c, row).to_numpy() for c in ("closed_rows", "closed_people"))
                first = np.unique(mine, return_index=True)[1]
                rows, people = rows[first[np.searchsorted(mine[first], tracts)]], people[first[np.searchsorted(mine[first], tracts)]]
                own, other = np.isin(mine, tracts), np.isin(theirs, tracts)
                mine, of_mine, theirs, of_theirs = np.searchsorted(tracts, mine[own]), of_mine[own], np.searchsorted(tracts, theirs[other]), of_theirs[other]
                closed, opened, population = (items(batch, c, row) for c in ("closed_stores", "open_stores", "closed_population"))
                height = max(1, NUMBERS // max(1, len(opened)))
                width = max(1, NUMBERS // max(height, len(opened)))
                for top in range(0, len(closed), height):
                    high = min(height, len(closed) - top)
                    count, both = np.zeros((high, len(opened)), np.int64), np.zeros((high, len(opened)), np.int64)
                    in_rows = (of_mine >= top) & (of_mine < top + high)
                    for at in range(0, len(tracts), width):
                        wide = min(width, len(tracts) - at)
                        a, b = in_rows & (mine >= at) & (mine < at + wide), (theirs >= at) & (theirs < at + wide)
                        left, right = np.zeros((high, wide)), np.zeros((wide, len(opened)))
                        left[of_mine[a] - top, mine[a] - at] = 1
                        right[theirs[b] - at, of_theirs[b]] = 1
                        count += product(left, right, rows[at:at + wide])
                        both += product(left, right, people[at:at + wide])
                    i, j = np.nonzero(count)
                    yield pa.RecordBatch.from_arrays([
                        closed.take(pa.array(i + top)), opened.take(pa.array(j)), pa.array(count[i, j]), pa.array(both[i, j]),
                        population.take(pa.array(i + top))], names=names)

    return run


def area_overlap_pairs(closed: DataFrame, opened: DataFrame, tracts: DataFrame) -> DataFrame:
    """(closed_store, open_store, shared_tracts, shared_population, share of the closed area).

    Stores are packed into blocks of bounded size. Blocks that share a tract meet, and each meeting is one numpy step whose
    output is the pairs themselves: a row per pair and tract arises nowhere, and pairs are not shuffled.
    """
    mine = closed.select(*STORE, "geoid").distinct().filter(F.col("store_nbr").isNotNull() & F.col("geoid").isNotNull())
    theirs = opened.select(*STORE, "geoid").distinct().filter(F.col("geoid").isNotNull())
    known = cut(with_population(mine.select("geoid").distinct(), tracts).groupBy("geoid").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("population"), F.lit(0)).cast("long").alias("people")
    ).withColumn("tract", F.monotonically_increasing_id()), "tracts")

    def areas(rows: DataFrame) -> DataFrame:
        return rows.join(known, "geoid").groupBy(F.col("store_nbr").alias("store")).agg(
            F.sum("people").alias("population"), F.sort_array(F.collect_list("tract")).alias("tracts"))

    left, right = _into_blocks(areas(mine), "closed"), _into_blocks(areas(theirs), "open")
    # what a closed block's tracts count for travels with it, in the order of its tracts
    counted = left.select("closed", F.posexplode("closed_tracts").alias("_i", "tract")).join(known.drop("geoid"), "tract").groupBy("closed").agg(
        F.array_sort(F.collect_list(F.struct("_i", "rows", "people"))).alias("_rows")).select(
        "closed", F.col("_rows.rows").alias("closed_rows"), F.col("_rows.people").alias("closed_people"))
    meet = cut(left.select("closed", F.explode("closed_tracts").alias("tract")).distinct().join(
        right.select("open", F.explode("open_tracts").alias("tract")).distinct(), "tract").select("closed", "open").distinct(), "meetings")
    ready = meet.join(left, "closed").join(counted.hint("merge"), "closed").join(right, "open")
    kinds = {c: areas_of.schema["store_nbr"].dataType.simpleString() for c, areas_of in (("closed_store", mine), ("open_store", theirs))}
    names = [*kinds, "shared_tracts", "shared_population", "population"]
    pairs = ready.repartition(max(1, meet.count()), "closed", "open").mapInArrow(
        _shared_of_blocks(names), ", ".join([*[f"{c} {k}" for c, k in kinds.items()], *[f"{c} bigint" for c in names[2:]]]))
    return pairs.select(
        "closed_store", "open_store", "shared_tracts", "shared_population",
        F.try_divide(F.col("shared_population").cast("double"), F.col("population").cast("double")).alias("share"))
