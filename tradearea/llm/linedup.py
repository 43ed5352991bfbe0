"""Deletes later copies of repeated line runs, found with a suffix array over line numbers.

The corpus is a sequence of lines, each named by a hash. Prefix doubling ranks the suffixes by their first
1, 2, 4, ... lines; a rank is the left border of the interval of suffixes that share these lines, in suffix
order, and suffixes that are alone leave the table, so each round is smaller. Two ranks of overlapping powers of two name the
interval of any depth n (longest common prefix at least n), and the smallest position of an
interval is the copy that stays.

A run counts when it has at least `min_words` words. It is enough to look, from every line forwards and
backwards, at the shortest run of that many words: a line lies in a repeated run of `min_words` words or more
exactly if one of these shortest runs around it is repeated. So the depth, and with it the number of rounds,
follows from `min_words` and not from the length of the copies, and the union of the intervals found
is the union of all maximal repeated runs.

Only DataFrame operations are used. No window or group holds more than the lines of one document, but for the
ranking inside one range partition of distinct intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tradearea.sources.scratch import cut

MIN_WORDS = 50
#: key is known, key, text hash
DOC = ["_z", "_d", "_h"]


def _named(key: Column, kind: DataType) -> tuple[Column, Column]:
    """Whether there is a key, and the key or a stand-in: neither is null, so joins keep documents without key. They sort first."""
    return key.isNotNull(), F.coalesce(key, F.lit("0").cast(kind))


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: document (_z, _d, _h), line number, hash and words. Rows that repeat key and text are one document."""
    known, name = _named(F.col(key), docs.schema[key].dataType)
    lines = docs.filter(F.col(text).isNotNull()).select(
        known.alias("_z"), name.alias("_d"), F.xxhash64(text).alias("_h"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("_p", "_line"))
    return lines.select(*DOC, "_p", F.xxhash64("_line").alias("_id"), F.regexp_count("_line", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("_w"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """The lines whose name and word count come more than once, each place once."""
    several = lines.groupBy("_id", "_w").count().filter("count > 1").select("_id", "_w")
    return lines.join(several, ["_id", "_w"]).dropDuplicates([*DOC, "_p"])


def islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Unbroken stretches of repeated lines with enough words: _run names the stretch, _c the words before a line in it."""
    order = Window.partitionBy(*DOC).orderBy("_p")
    stretch = Window.partitionBy(*DOC, "_run")
    before = stretch.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return (
        lines.withColumn("_run", F.col("_p") - F.row_number().over(order))
        .withColumns({"_c": F.coalesce(F.sum("_w").over(before), F.lit(0)), "_all": F.sum("_w").over(stretch), "_stop": F.max("_p").over(stretch) + 1})
        .filter(F.col("_all") >= min_words))


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(document, first line, lines) of the shortest runs of min_words words from each line on, and up to each line."""
    by_words = Window.partitionBy(*DOC, "_run").orderBy("_c")
    found = lines.withColumns({
        "_next": F.coalesce(
            F.min("_p").over(by_words.rangeBetween(min_words, Window.unboundedFollowing)),
            F.when(F.col("_all") >= F.col("_c") + min_words, F.col("_stop"))),
        "_back": F.max("_p").over(by_words.rangeBetween(Window.unboundedPreceding, -min_words)),
        "_tail": F.max(F.when(F.col("_c") <= F.col("_all") - min_words, F.col("_p"))).over(Window.partitionBy(*DOC, "_run"))})
    span = F.explode(F.array(
        F.struct(F.col("_p").alias("s"), (F.col("_next") - F.col("_p")).alias("n")),
        F.struct(F.col("_back").alias("s"), (F.col("_p") - F.col("_back")).alias("n")),
        F.when(F.col("_p") == F.col("_stop") - 1, F.struct(F.col("_tail").alias("s"), (F.col("_stop") - F.col("_tail")).alias("n")))))
    return found.select(*DOC, span.alias("_x")).select(
        *DOC, F.col("_x.s").alias("_p"), F.col("_x.n").cast("bigint").alias("_n")).filter("_n is not null").distinct()


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose values of `by` occur in several places, with _rank: the left border of their interval in suffix order.

    Distinct values are dealt out by ranges; a row number inside each range and the totals of the ranges before
    give the border. The hottest value is one row here.
    """
    place = F.struct(*DOC, "_p")
    classes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"), F.min(place).alias("_low"), F.max(place).alias("_high")).filter("_low <> _high")
    dealt = cut(classes.select(*by, "_k").repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "classes")
    local = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.sum("_k").alias("_sum")).withColumn(
        "_offset", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    borders = dealt.withColumn("_local", F.coalesce(F.sum("_k").over(local), F.lit(0))).join(parts.select("_part", "_offset"), "_part").select(
        *by, (F.col("_local") + F.col("_offset")).alias("_rank"))
    return rows.join(borders, by)


def doomed_lines(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(_z, _d, _h, _cut): sorted numbers of the lines to delete from each document that loses any."""
    lines = cut(repeated_lines(numbered_lines(docs, key, text)), "lines")
    lines = cut(islands(lines, min_words), "islands")
    runs = cut(shortest_runs(lines, min_words), "runs")
    depth = runs.agg(F.max("_n")).first()[0] or 0
    level = cut(ranked(lines, ["_id", "_w"]).select(*DOC, "_p", "_rank"), "level")
    named, step = [], 1
    while step <= depth:
        # runs of step to 2 * step - 1 lines: two overlapping stretches of `step` lines
        own = runs.filter((F.col("_n") >= step) & (F.col("_n") < 2 * step))
        begin = level.withColumnRenamed("_rank", "_r1")
        end = level.select(*DOC, F.col("_p").alias("_q"), F.col("_rank").alias("_r2"))
        named.append(own.withColumn("_q", F.col("_p") + F.col("_n") - step).join(begin, [*DOC, "_p"]).join(end, [*DOC, "_q"]).select(
            *DOC, "_p", "_n", "_r1", "_r2"))
        if 2 * step <= depth:
            ahead = Window.partitionBy(*DOC).orderBy("_p").rangeBetween(step, step)
            pairs = level.withColumn("_second", F.max("_rank").over(ahead)).filter("_second is not null")
            level = cut(ranked(pairs.withColumnRenamed("_rank", "_first"), ["_first", "_second"]).select(*DOC, "_p", "_rank"), "level")
        step *= 2
    if not named:
        named = [runs.select(*DOC, "_p", "_n", F.lit(0).cast("bigint").alias("_r1"), F.lit(0).cast("bigint").alias("_r2")).limit(0)]
    intervals = named[0]
    for more in named[1:]:
        intervals = intervals.unionByName(more)
    intervals = cut(intervals, "intervals")
    place, depth_key = F.struct(*DOC, "_p"), ["_n", "_r1", "_r2"]
    kept = intervals.groupBy(*depth_key).agg(F.min(place).alias("_keep"), F.max(place).alias("_other")).filter("_keep <> _other")
    later = intervals.join(kept.select(*depth_key, "_keep"), depth_key).filter(place > F.col("_keep"))
    numbers = later.select(*DOC, F.explode(F.sequence(F.col("_p"), F.col("_p") + F.col("_n").cast("int") - 1)).alias("_cut")).distinct()
    return numbers.groupBy(*DOC).agg(F.sort_array(F.collect_list("_cut")).alias("_cut"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs deleted from the text; all rows and other columns stay.

    Earlier means a smaller key (null first), then text hash, then line. Lines are separated by line feeds and
    compared by 64-bit names and word counts. A text loses whole lines with their line feeds; one that loses all becomes empty. Null texts stay
    null. Rows that repeat key and text are one document: all keep the same lines.
    """
    found = _joined(docs, key, text, min_words)
    return found.select(*[_rest().alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def _rest() -> Column:
    """The text without the lines in _cut."""
    numbers = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_cut"))
    left = F.transform(numbers, lambda i: F.get(F.col("_lines"), i))
    return F.when(F.col("_cut").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(left, "\n"))


def _joined(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """_row (all columns but the text), _lines, and _cut: the lines to delete, null if none."""
    found = doomed_lines(docs, key, text, min_words)
    others = [c for c in docs.columns if c != text]
    own = docs.select(F.struct(*others).alias("_row"), F.split(F.col(text), "\n", -1).alias("_lines"), F.xxhash64(text).alias("_own"))
    known, name = _named(F.col("_row").getField(key), docs.schema[key].dataType)
    return own.join(found, (known == F.col("_z")) & (name == F.col("_d")) & (F.col("_own") == F.col("_h")), "left")


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: key, n_lines, n_removed, text (what is left). Other columns are passed over."""
    out = _joined(docs.select(F.col(key), F.col(text)), key, text, min_words)
    return out.select(
        F.col("_row").getField(key).alias(key), F.coalesce(F.when(F.col("_lines").isNotNull(), F.size("_lines")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.when(F.col("_cut").isNotNull(), F.size("_cut")), F.lit(0)).cast("bigint").alias("n_removed"), _rest().alias("text"))
