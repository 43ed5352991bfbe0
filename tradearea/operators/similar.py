"""Nearest rows by criteria of mixed kinds."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradearea.sources.scratch import cut


def nearest_mixed(df: DataFrame, key: str, numbers: Sequence[str], categories: Sequence[str], k: int) -> DataFrame:
    """(key, neighbour, distance, nearest): the k rows most like each row, exactly; ties go to the smaller neighbour.

    The distance is the mean over all criteria of |a - b| / range for a number (0 where all are equal) and of 0 or 1 for a
    category, so it lies between 0 and 1. A NULL category is a value of its own; a NULL number is an error that names it.
    Rows first meet those of the same categories. Whoever differs in r + 1 categories is at least (r + 1) / criteria away, so a row whose k-th
    neighbour after round r is nearer is done; only the others go on to rows that differ in one category more.
    """
    criteria = len(numbers) + len(categories)
    ranges = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in numbers]).first() if numbers else {}
    known = [F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(F.raise_error(F.lit(f"{c} is NULL")).cast("double")).alias(f"n{i}") for i, c in enumerate(numbers)]
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"c{i}") for i, c in enumerate(categories)]
    rows = cut(df.select(F.col(key).alias("row"), *known, *named), "criteria")
    cs, ns = [f"c{i}" for i in range(len(categories))], [f"n{i}" for i in range(len(numbers))]
    other = rows.toDF(*[f"_{c}" for c in rows.columns])
    todo, found = rows, []
    for r in range(len(cs) + 1):
        met = None
        for same in combinations(cs, len(cs) - r):
            # of the pairs that differ in fewer categories each choice of equal ones finds some again
            on = F.lit(True)
            for c in same:
                on = on & (F.col(c) == F.col(f"_{c}"))
            pairs = todo.join(other, on & (F.col("row") != F.col("_row")))
            met = pairs if met is None else met.unionByName(pairs)
        apart = [F.abs(F.col(n) - F.col(f"_{n}")) / F.lit(ranges[c]) for n, c in zip(ns, numbers) if ranges[c]]
        apart += [(F.col(c) != F.col(f"_{c}")).cast("double") for c in cs]
        far = F.round(sum(apart, F.lit(0.0)) / F.lit(float(criteria)), 12)
        listed = met.select("row", F.col("_row").alias("neighbour"), far.alias("distance")).distinct()
        place = F.row_number().over(Window.partitionBy("row").orderBy("distance", "neighbour"))
        best = cut(listed.withColumn("nearest", place).filter(F.col("nearest") <= k), "similar")
        sure = best.filter((F.col("nearest") == k) & (F.col("distance") < (r + 1) / criteria)).select("row")
        done = best if r == len(cs) else best.join(sure, "row", "left_semi")
        found.append(done)
        todo = cut(todo.join(sure, "row", "left_anti"), "todo")
        if todo.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("row", key)
