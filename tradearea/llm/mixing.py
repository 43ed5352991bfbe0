"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the key -ln(u) / weight, u being uniform and fixed by its id and text. Smallest keys first is a
weighted random order (Efraimidis and Spirakis); reading it until the budget is full samples without
replacement with the documents' quality as weights. A source whose target exceeds its size gives
complete epochs first, and only what is left is sampled.

The prefix sums of a source have two levels: words per cell of the key's logarithm, then rows inside the one
cell in which the budget ends. So no task sorts a source, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradearea.operators.grouped import occurrences
from tradearea.sources.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
MARKS = "#*$%&|<>!"
#: cells per factor e of the key
CELLS = 2000
TIMES = 3


def size_of(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_of(text: Column, size: Column) -> Column:
    """1 for text without marks, falling towards 1/2 with the marks per word; exact counts, so any engine agrees."""
    marks = F.coalesce(F.length(text) - F.length(F.translate(text, MARKS, "")), F.lit(0))
    return F.lit(0.5) + F.lit(0.5) / (F.lit(1.0) + marks.cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def uniform(seed: int, *values: Column) -> Column:
    """A number in (0, 1) fixed by seed and values: 48 bits of an MD5 sum."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("")) for v in values]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), times: int = TIMES) -> DataFrame:
    """Per source (source, source_size, target): a share of all words by weight, at most `times` the source's size.

    Sources by code point, null last, weigh `weights` in turn. The shares are those of repeated re-sharing:
    with sources in order of size / weight, the small ones are full, and the rest share what these leave.
    One row per source is read; the documents are not.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    placed = weighed.withColumns({
        "_total": F.sum("source_size").over(whole), "_weights": F.sum("_w").over(whole),
        "_full": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "_used": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    # words per unit of weight if all before this source are full
    share = (F.col("_total") - times * F.col("_full")).cast("double") / (F.col("_weights") - F.col("_used"))
    shared = placed.withColumn("_share", share).withColumn(
        "_is_full", share * F.col("_w") > (times * F.col("source_size")).cast("double"))
    level = F.min(F.when(~F.col("_is_full"), F.struct(F.col("source_size") / F.col("_w"), F.col("_share")))).over(whole).getField("_share")
    return shared.withColumn("_level", level).select("source", "source_size", F.when(
        F.col("_is_full"), (times * F.col("source_size")).cast("double")).otherwise(F.col("_level") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3),
        times: int = TIMES, seed: int = 7, cells: int = CELLS, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, weight, taken (words the mix takes), and the columns `carry`.

    taken is size times the complete epochs, plus size once more for sampled documents. The document in which
    the budget ends is taken if that brings the source nearer to its target. The sampling key is fixed by id and
    text, and by a running number among rows equal in both; so rows that share an id, or have none, are sampled
    like others. Ties of the key go to the smaller id (null first), then size. A null source is a source; a null
    text has size 0. Carried columns named like a result, or beginning with an underscore, are passed over, as are all others; an empty table gives no rows.
    """
    size = size_of(F.col(text))
    results = {key, "source", "size", "source_size", "target", "weight", "taken"}
    carried = [c for c in carry if c not in results and not c.startswith("_")]
    sized = docs.select(F.col(key).alias("_id"), F.col(source).alias("source"), size.alias("size"), quality_of(F.col(text), size).alias("weight"),
                        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_text"), *carried)
    sized = cut(sized, "sized")
    if sized.groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        sized = sized.withColumn("_nth", F.lit(0).cast("bigint"))
    else:
        sized = cut(occurrences(sized, ["_id", "_text"], "_nth"), "numbered")
    sized = sized.withColumn("_key", -F.log(uniform(seed, F.col("_id"), F.col("_text"), F.col("_nth"))) / F.col("weight")).drop("_text", "_nth")
    sized = sized.withColumn("_cell", F.floor(F.log("_key") * cells))
    by_cell = cut(sized.groupBy("source", "_cell").agg(F.sum("size").alias("words")), "cells")
    goal = cut(targets(by_cell.groupBy("source").agg(F.sum("words").alias("source_size")), weights, times).withColumns({
        "_epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")}
    ).withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size")), "goal")
    until = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        by_cell.withColumn("_before", F.coalesce(F.sum("words").over(until), F.lit(0)))
        .join(goal.select(F.col("source").alias("_s"), "_budget"), F.col("source").eqNullSafe(F.col("_s")))
        .filter("_before < _budget").groupBy("source").agg(F.max(F.struct("_cell", "_before")).alias("_e"))
        .select(F.col("source").alias("_s"), F.col("_e._cell").alias("_end"), F.col("_e._before").alias("_before")))
    # sources whose budget is empty have no cell in which it ends
    plan = cut(goal.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_source"), "plan")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    columns = [F.col("_id").alias(key), *carried, "source", "size", "source_size", "target", "weight"]
    # all cells but the last one are taken or left whole
    whole = joined.filter("_end is null or _cell <> _end").select(
        *columns, (F.col("size") * (F.col("_epochs") + F.coalesce(F.col("_cell") < F.col("_end"), F.lit(False)).cast("bigint"))).alias("taken"))
    inside = Window.partitionBy("source").orderBy("_key", F.col("_id").asc_nulls_first(), "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_before") + F.sum("size").over(inside) - F.col("size") / F.lit(2.0)
    last = joined.filter("_cell = _end").withColumn("_take", (middle <= F.col("_budget")) & (F.col("_epochs") < times)).select(
        *columns, (F.col("size") * (F.col("_epochs") + F.col("_take").cast("bigint"))).alias("taken"))
    return whole.unionByName(last)
