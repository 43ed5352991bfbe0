"""Merkle manifest of a dataset: leaves, subroots per group, one root, and each leaf's proof.

Where a leaf stands follows from bitmaps, not from sorting: the ids of a group are a bitmap of 64-bit words, kept
only where an id is set. Words merge by bit-or, so partial bitmaps of any number of tasks add up to one. A directory
of running counts over the words gives the ids before each word; an id's rank is that plus the bits below its own
in its word. Words in which an id repeats are ranked by counts per id, and rows that share an id by their leaf.

With coordinates known each level is one aggregate: up to sixteen children go into the slots of their parent, keyed by
the low digit of their coordinate. From the root down each node hands its children what stands left and right
of them, so a leaf ends up with its whole proof. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradearea.operators.grouped import running_total
from tradearea.sources.scratch import cut, grown

FANOUT = 16
#: copies of the directory, so that many rows of one word are looked up by several tasks
SALTS = 8
WORD = 64
#: stands before all words of whole numbers, for rows without an id
NULL_BLOCK = -(1 << 62)
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes' count, a colon, and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def group_name(source: Column) -> Column:
    """A name that is never null and sorts like its source by bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (g, id, leaf, ...) with pos, the place of each row in its group from 0, and n, the group's rows."""
    block = F.coalesce(F.shiftright("id", 6), F.lit(NULL_BLOCK))
    placed = leaves.withColumns({"_block": block, "_bit": F.coalesce(F.col("id").bitwiseAND(F.lit(WORD - 1)), F.lit(0)).cast("int")})
    bit = F.expr("shiftleft(1L, _bit)")
    words = cut(placed.groupBy("g", "_block").agg(F.bit_or(bit).alias("_word"), F.count(F.lit(1)).alias("_rows")).withColumn(
        "_again", F.col("_rows") > F.bit_count("_word")), "words")
    # the popcount directory: rows before each word
    directory = grown(running_total(words, ["g"], "_block", {"_upto": "_rows"}).select(
        "g", "_block", "_word", "_again", (F.col("_upto") - F.col("_rows")).alias("_before")), "directory")
    salted = directory.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = placed.withColumn("_salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["g", "_block", "_salt"]).drop("_salt")
    below = F.bit_count(F.col("_word").bitwiseAND(F.expr("~shiftleft(-1L, _bit)")))
    totals = words.groupBy("g").agg(F.sum("_rows").alias("n"))
    once = found.filter("not _again").withColumn("pos", F.col("_before") + below)
    if words.filter("_again").isEmpty():
        out = once
    else:
        many = cut(found.filter("_again"), "repeated")
        per_leaf = many.groupBy("g", "_block", "id", "leaf").agg(F.count(F.lit(1)).alias("_c"), F.any_value("_before").alias("_before"))
        per_id = running_total(per_leaf.groupBy("g", "_block", "id").agg(F.sum("_c").alias("_c")).withColumn("_i", F.coalesce("id", F.lit(0))),
                               ["g", "_block"], "_i", {"_upto": "_c"}, slot=F.lit(0)).select(
            "g", "_block", "_i", (F.col("_upto") - F.col("_c")).alias("_lower"))
        # rows of one id go by leaf, in two levels: a repeated id may hold many of all rows
        in_id = running_total(per_leaf.withColumn("_i", F.coalesce("id", F.lit(0))), ["g", "_block", "_i"], "leaf", {"_upto": "_c"}, slot=F.left("leaf", F.lit(4)))
        starts = in_id.join(per_id, ["g", "_block", "_i"]).select(
            "g", "_block", "_i", "leaf", (F.col("_before") + F.col("_lower") + F.col("_upto") - F.col("_c")).alias("_start"))
        own = many.withColumn("_i", F.coalesce("id", F.lit(0))).join(starts, ["g", "_block", "_i", "leaf"])
        # equal rows are interchangeable; a written running number tells them apart
        own = cut(own.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        turn = running_total(own.withColumn("_one", F.lit(1)), ["g", "_block", "_i", "leaf"], "_row", {"_nth": "_one"}, slot=F.shiftright("_row", 12))
        out = once.unionByName(turn.withColumn("pos", F.col("_start") + F.col("_nth") - 1).select(*once.columns))
    return out.drop("_block", "_bit", "_word", "_again", "_before").join(totals, "g")


def in_slots(nodes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Parents (g, pos, n of their level, single, children) of nodes (g, pos, h, n): children in the slots of their coordinates.

    A node alone in its group has no parent; it is passed on under its own hash (`single`).
    """
    slot = F.pmod("pos", F.lit(FANOUT)).cast("int")
    rows = nodes.groupBy("g", F.expr(f"pos div {FANOUT}").alias("pos")).agg(
        F.map_from_entries(F.collect_list(F.struct(slot, F.struct("h", *extra)))).alias("_m"), F.any_value("n").alias("n"))
    children = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda i: F.try_element_at("_m", i)), lambda c: c.isNotNull())
    made = rows.withColumn("children", children).drop("_m").withColumn("single", F.col("n") == 1)
    joined = F.array_join(F.transform("children", lambda c: c["h"]), "")
    return made.withColumn("h", F.when(F.col("single"), F.col("children")[0]["h"]).otherwise(digest(joined))).withColumn(
        "n", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}"))


def levels(nodes: DataFrame, extra: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """All levels above the nodes, lowest first, and the roots (g, h)."""
    made = [cut(in_slots(nodes, extra), "level")]
    while not made[-1].filter("n > 1").isEmpty():
        made.append(cut(in_slots(made[-1].filter("n > 1").select("g", "pos", "h", "n")), "level"))
    roots = made[0].filter("n = 1")
    for level in made[1:]:
        roots = roots.select("g", "h").unionByName(level.filter("n = 1").select("g", "h"))
    return made, cut(roots.select("g", "h"), "roots")


STEP = "array<struct<before:string,after:string>>"


def with_paths(level: DataFrame, above: DataFrame) -> DataFrame:
    """Each child of a level with its path: what stands left and right of it, from its own run up to the root.

    `above` has (g, pos, path) of the parents. A lone node has no run of its own and its parent's path.
    """
    around = F.transform("children", lambda c, i: F.struct(
        c.alias("child"), i.cast("bigint").alias("i"),
        F.when(F.col("single"), F.col("path")).otherwise(F.concat(F.array(F.struct(
            F.array_join(F.transform(F.slice("children", 1, i), lambda x: x["h"]), "").alias("before"),
            F.array_join(F.transform(F.slice("children", i + 2, F.lit(FANOUT)), lambda x: x["h"]), "").alias("after"))), F.col("path"))).alias("path")))
    return level.join(above.hint("merge"), ["g", "pos"]).select("g", "pos", F.explode(around).alias("_x")).select(
        "g", (F.col("pos") * FANOUT + F.col("_x.i")).alias("pos"), "_x.child.*", "_x.path")


def paths(made: list[DataFrame], above: DataFrame) -> DataFrame:
    """Children of the lowest level with their paths; `above` has the path (g, path) of each group's root."""
    known = None
    for i in reversed(range(len(made))):
        tops = made[i].filter("n = 1").select("g", "pos").join(above, "g")
        known = tops if known is None else known.select("g", "pos", "path").unionByName(tops)
        known = with_paths(made[i], known)
        if i:
            known = cut(known, "paths")
    return known


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["before"], h, step["after"])))


def proof(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "source", altered: Column | None = None) -> DataFrame:
    """One row per row of docs: key, group, leaf, checked (the leaf of the row with its last column replaced by
    `altered`), subroot, root, path (siblings left and right of it, level by level).

    A leaf is the digest of `columns`, null or not. In each group leaves ascend by key (a whole number, null first);
    rows that repeat a key go by leaf, and equal rows are leaves of their own. Groups go by their names' bytes, null first.
    Sixteen nodes in a row make one until one is left; a lone leaf is its own subroot, and a lone subroot the
    root. Texts of any length are read once, for their digest. Columns besides these are passed over, also
    those that begin with an underscore; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a whole number, not {kind}")
    own = [F.col(c) for c in columns]
    other = own if altered is None else [*own[:-1], altered]
    leaves = cut(docs.select(
        group_name(F.col(group)).alias("g"), F.col(key).cast("bigint").alias("id"), leaf_of(own).alias("leaf"), leaf_of(other).alias("checked")), "leaves")
    nodes = ranked(leaves).withColumnRenamed("leaf", "h")
    made, subroots = levels(nodes, ["id", "checked"])
    # few rows: one per group; two levels of sums keep even those apart
    named = running_total(subroots.withColumn("_one", F.lit(1)), [], "g", {"_upto": "_one"}, slot=F.left("g", F.lit(3)))
    every = subroots.agg(F.count(F.lit(1)).alias("n"))
    tops = cut(named.withColumn("n", every.select("n").scalar()).select(
        F.lit("").alias("g"), (F.col("_upto") - 1).alias("pos"), "h", F.col("g").alias("name"), "n"), "subroots")
    over, root = levels(tops, ["name"])
    start = root.select("g", F.array().cast(STEP).alias("path"))
    of_group = cut(paths(over, start).select(F.col("name").alias("g"), F.col("h").alias("subroot"), "path"), "groups")
    out = paths(made, of_group.select("g", "path")).join(of_group.select("g", "subroot"), "g").withColumn("root", root.select("h").scalar())
    return out.select(F.col("id").cast(kind).alias(key), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group),
                      F.col("h").alias("leaf"), "checked", "subroot", "root", "path")


def verified(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of a manifest: key, leaf, subroot, root, proof_sha256, folded_root (from `checked` and the path), verified."""
    return made.select(key, "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), fold(F.col("checked"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
