"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle space gives two signature values, the smallest and the largest hash, so
`bands * rows / 2` evaluations make `bands * rows` values. Two sets of similarity J agree on each value
with probability J; a band of `rows` values agrees with J^rows. With 24 bands of 3 rows a pair at
J = 0.75 is missed with probability (1 - 0.75^3)^24 = 2e-6.

Documents with equal shingle sets are one class from the start, so a large group of copies costs one
aggregate. Classes that share a band are candidates. A class whose shingles are mostly its own can have no
partner and leaves (an exact bound on what a pair can have in common). Then each band tries all its members
against one hub, the class with the fewest shingles of its own, on the full sets; bands that still hold several
components try a second and third hub; what is then left between different components is joined with its bucket under the
bounds that the counts with the hub give, so only pairs that may still be similar become rows. A band with thousands of
near copies costs about one comparison per member, and no candidate link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradearea.llm.words import SPACED, Piece, in_row, mix, row_of, shingles, slices
from tradearea.operators.components import connected
from tradearea.sources.scratch import cut

SIZE, BANDS, BAND_ROWS, PERCENT = 5, 24, 3, 75
#: what tells the set of a document
SAME = ["n_shingles", "sum_1", "sum_2"]


def shingle_sets(piece: Piece, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within the row, and the first of each row (and one more).

    A row with fewer words than `size`, but not none, has its whole sequence as its only shingle.
    """
    starts, ends, first = piece.spans(SPACED)
    words = piece.hashes(starts, ends)
    grams, at = shingles(words, first, size)
    rows = row_of(first)[at]
    counts = np.diff(first)
    for n in range(1, size):  # few words: their sequence, told apart from longer ones by its length
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(n):
                whole = whole * np.uint64(0xD6E8FEB86659FD93) + words[first[short] + k]
            grams = np.concatenate([grams, mix(whole + np.uint64(n))])
            rows = np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[new], rows[new]
    return grams, np.searchsorted(rows, np.arange(piece.rows + 1))


def signatures(grams: np.ndarray, first: np.ndarray, values: int) -> np.ndarray:
    """One row of `values` numbers per set: minima and maxima of values / 2 permutations. Empty sets get zeros."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, values), np.uint64)
    if not len(full):
        return out
    seeds = mix(np.arange(1, values + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    for k in range(values // 2):
        # an odd multiplier permutes 64-bit numbers; the shift lets the low half of a shingle reach the top
        x = (grams ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= seeds[2 * k] | np.uint64(1)
        out[full, k] = np.minimum.reduceat(x, first[full])
        out[full, values // 2 + k] = np.maximum.reduceat(x, first[full])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hash of each band of each signature."""
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + signature[:, r::rows][:, :bands])
    return out


def _list(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values.view(np.int64)))


def fingerprints(docs: DataFrame, key: str, text: str, bands: int, rows: int, whole: bool = False) -> DataFrame:
    """key, n_shingles, two checksums of the set, and its band hashes or (`whole`) all its shingle hashes.

    Whole texts are read, with A-Z in lower case.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("_text"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            grams, first = shingle_sets(Piece(batch.column("_text"), lower=True))
            one = np.concatenate((np.zeros(1, np.uint64), np.cumsum(grams, dtype=np.uint64)))
            two = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)))
            n = np.diff(first)
            if whole:
                listed = _list(grams, first)
            else:
                keys = band_keys(signatures(grams, first, bands * rows), bands, rows)
                listed = _list(keys[n > 0].reshape(-1), np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("text_hash"), pa.array(n.astype(np.int64)), pa.array((one[first[1:]] - one[first[:-1]]).view(np.int64)),
                 pa.array((two[first[1:]] - two[first[:-1]]).view(np.int64)), listed],
                names=["key", "text_hash", *SAME, "listed"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, text_hash bigint, n_shingles bigint, sum_1 bigint, sum_2 bigint, listed array<bigint>")


def _possible(common: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b with `common` shingles in common are similar enough."""
    return (100 + percent) * common >= percent * (a + b)


def counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) with the number of shingles that their full sets have in common."""
    left = sets.select(F.col("node").alias("a"), F.col("listed").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("listed").alias("grams_b"))
    return pairs.join(right, "b").join(left, "a").select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("bigint").alias("common"))


def _several(rows: DataFrame, of: str = "node") -> DataFrame:
    """The rows of buckets that hold several different values of a column."""
    kept = rows.groupBy("band", "hash").agg(F.min(of).alias("_low"), F.max(of).alias("_high")).filter("_low <> _high").select("band", "hash")
    return rows.join(kept, ["band", "hash"])


def hopeful(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Bucket members (band, hash, node, n, s) that may still have a partner in their bucket.

    s counts the shingles of a class that any other candidate has too, so no pair has more in common. A member
    leaves a bucket if even its smallest partner there of a fitting size would need more. The sizes in a
    bucket are distinct numbers, few even in a bucket with very many classes.
    """
    nodes = buckets.select("node").distinct()
    own = sets.join(nodes, "node", "left_semi").select("node", F.explode("listed").alias("g"))
    alone = own.groupBy("g").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("_c")).filter("_c = 1").groupBy("node").agg(
        F.count(F.lit(1)).alias("_alone"))
    sizes = buckets.groupBy("band", "hash", "n").agg(F.count(F.lit(1)).alias("_c")).withColumn("_log", F.log("n"))
    by_size = Window.partitionBy("band", "hash").orderBy("_log")
    smaller = F.expr("min(n) over (partition by band, hash order by _log range between "
                     f"{-math.log(percent / 100) + 1e-9!r}D preceding and 1e-12D preceding)")
    partner = F.coalesce(smaller, F.when(F.col("_c") > 1, F.col("n")), F.lead("n").over(by_size))
    fits = sizes.select("band", "hash", "n", partner.alias("_m")).filter(F.least("n", "_m") * 100 >= percent * F.greatest("n", "_m"))
    shared = buckets.drop("s").join(alone, "node", "left").withColumn("s", F.col("n") - F.coalesce("_alone", F.lit(0))).drop("_alone")
    left = shared.join(fits, ["band", "hash", "n"]).filter(_possible(F.col("s"), F.col("n"), F.col("_m"), percent))
    return _several(left.select("band", "hash", "node", "n", "s"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Bucket members with `keys`: names of all buckets in which their node stands, by band."""
    name = F.xxhash64("band", "hash")
    keys = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", name.alias("k")))).alias("_k")).select(
        "node", F.transform("_k", lambda x: x["k"]).alias("keys"))
    return rows.join(keys, "node")


def _pairs(rows: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of rows and others of a bucket in different components that may be similar, each once.

    With `keys` a pair is made only in the first bucket that both share. c counts what a member has in common with the first hub of its bucket. Two members have at most the
    smaller c in common inside the hub, and outside of it at most what either shares with anyone there.
    """
    keyed = ["keys"] if "keys" in rows.columns else []
    named = others.select("band", "hash", *[F.col(c).alias(f"_{c}") for c in ["node", "root", "n", "s", "c", *keyed]])
    most = F.least("c", "_c") + F.least(F.col("s") - F.col("c"), F.col("_s") - F.col("_c"))
    most = F.least("s", "_s", F.coalesce(most, F.col("s")))
    met = rows.join(named, ["band", "hash"]).filter(F.col("root") != F.col("_root")).filter(
        _possible(F.least(F.col("n"), F.col("_n"), most), F.col("n"), F.col("_n"), percent))
    if keyed:
        met = met.filter(F.get(F.array_intersect("keys", "_keys"), F.lit(0)) == F.xxhash64("band", "hash"))
    first = F.col("node") < F.col("_node")
    return met.select(
        F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"), F.when(first, F.col("n")).otherwise(F.col("_n")).alias("n_a"),
        F.when(first, F.col("_n")).otherwise(F.col("n")).alias("n_b")).distinct()


def class_links(banded: DataFrame, sets_of, percent: int, rounds: int) -> DataFrame:
    """Component of each class that has a link: (node, root), root being the smallest node.

    `banded` has node, n, band, hash; `sets_of` gives the full sets (node, listed) of some nodes.
    """
    buckets = cut(_several(banded), "buckets")
    sets = cut(sets_of(buckets.select("node").distinct()), "sets")
    for _ in range(2):
        buckets = cut(hopeful(buckets, sets, percent), "hopeful")
    # the class with the fewest shingles of its own is the likeliest centre of its bucket
    hubs = buckets.groupBy("band", "hash").agg(F.min_by("node", F.struct(F.col("n") - F.col("s"), "node")).alias("hub"))
    buckets = cut(buckets.join(hubs, ["band", "hash"]), "starred")
    sizes = buckets.select(F.col("node").alias("a"), F.col("n").alias("n_a")).distinct()
    stars = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_b"), "s").distinct()
    stars = stars.join(sizes, "a").filter(_possible(F.least("n_a", "s"), F.col("n_a"), F.col("n_b"), percent)).drop("s")
    tried = cut(counted(stars, sets), "tried")
    inside = tried.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("common").alias("c"))
    buckets = cut(buckets.join(inside, ["hub", "node"], "left").withColumn(
        "c", F.when(F.col("hub") == F.col("node"), F.col("n")).otherwise(F.col("c"))), "members")
    swap = F.col("a") > F.col("b")
    tried = tried.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), "common")
    linked = _possible(F.col("common"), F.col("n_a"), F.col("n_b"), percent)
    known, links = tried.select("a", "b"), tried.filter(linked).select("a", "b")
    for turn in range(rounds + 1):
        roots = cut(connected(links, [], "a", "b"), "roots")
        named = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = named.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("main")), "hub", "left").withColumn("main", F.coalesce("main", "hub"))
        named = cut(_several(named, "root"), "named")
        outside = named.filter("root <> main")
        if outside.isEmpty():
            break
        if turn < rounds:
            # a second centre among those that the first one did not reach
            centre = F.min_by(F.struct("node", "root", "n", "s", "c"), F.struct(F.col("n") - F.col("s"), "node")).alias("_x")
            others = outside.groupBy("band", "hash").agg(centre).select("band", "hash", "_x.*")
            pairs = _pairs(named, others, percent)
        else:
            keyed = cut(_keyed(named), "keyed")
            pairs = _pairs(keyed.filter("root <> main"), keyed, percent)
        new = cut(counted(pairs.join(known, ["a", "b"], "left_anti"), sets), "tried")
        known, links = known.unionByName(new.select("a", "b")), links.unionByName(new.filter(linked).select("a", "b"))
    return connected(links, [], "a", "b")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
               bands: int = BANDS, rows: int = BAND_ROWS, rounds: int = 2) -> DataFrame:
    """One row per row of docs: key, text_hash, n_shingles, component_id, _root, _least.

    _root numbers the group (null for rows without words); groups that share their smallest key share component_id only. A group
    without any key has no component_id. _least is the smallest text hash of the group's rows without a key.
    """
    prints = cut(fingerprints(docs, key, text, bands, rows), "prints")
    known = prints.filter("n_shingles > 0")
    lone = F.when(F.col("key").isNull(), F.col("text_hash"))
    # written at once, so the running number is a lasting name of the class
    classes = cut(known.groupBy(*SAME).agg(F.min("key").alias("head"), F.min("text_hash").alias("head_hash"), F.min(lone).alias("lone"),
                                           F.any_value("listed").alias("listed")).withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", F.col("n_shingles").alias("n"), F.posexplode("listed").alias("band", "hash"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        heads = classes.drop("listed").join(nodes, "node", "left_semi")
        texts = docs.join(heads.select(F.col("head").alias(key)).distinct(), key, "left_semi").select(key, text)
        unkeyed = heads.filter("head is null").select("head_hash")
        if not unkeyed.isEmpty():
            # classes without any key are found by their text, of which one copy does
            other = docs.filter(F.col(key).isNull()).select(key, text, F.xxhash64(F.col(text).cast("string")).alias("head_hash")).join(unkeyed, "head_hash", "left_semi")
            texts = texts.unionByName(other.groupBy("head_hash").agg(F.first(text).alias(text)).select(F.lit(None).cast(docs.schema[key].dataType).alias(key), text))
        full = fingerprints(texts, key, text, bands, rows, whole=True)
        return full.join(heads, SAME).groupBy("node").agg(F.any_value("listed").alias("listed"))

    roots = class_links(banded, sets_of, percent, rounds)
    rooted = cut(classes.drop("listed").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("head").alias("component_id"), F.min("lone").alias("_least"))
    found = rooted.join(lowest, "root").select(*SAME, "component_id", F.col("root").alias("_root"), "_least")
    return prints.drop("listed").join(found, SAME, "left").select(
        F.col("key").alias(key), "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"), "_root", "_least")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the smallest key reachable), kept.

    Null or wordless texts have empty sets, are linked with nothing and kept. Rows that repeat a key are documents of their
    own, each with the component of its text. Rows without a key are linked like others; they go if their group has a
    row with a key, else the group's component is null and those with its smallest text hash are kept (equal rows
    all). Texts of any length are whole; other columns of docs are passed over; empty tables give no rows.
    """
    lone = F.col("_root").isNull() | (F.col("component_id").isNull() & (F.col("text_hash") == F.col("_least")))
    kept = F.when(F.col(key).isNull(), lone).otherwise(F.col(key) == F.col("component_id"))
    return components(docs, key, text, **options).withColumn("kept", F.coalesce(kept, F.lit(False))).drop("text_hash", "_root", "_least")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """docs with one row of each group left, all columns as they were: of the smallest key the smallest text hash; a
    row without a key only if the group has no other.

    Rows without words are in no group and stay. Groups that have their smallest key in common each keep a row of
    their own. Of rows that repeat key and text one stays; of wordless rows without a key all do.
    """
    found = cut(components(docs, key, text, **options).filter("_root is not null").select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"), "_root"), "found")
    rank = F.struct(F.col("_key").isNull().alias("_last"), "_key", "_hash")
    stay = cut(found.groupBy("_root").agg(F.min(rank).alias("_s")).select("_s._key", "_s._hash").distinct(), "stay")
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.withColumn("_own", F.xxhash64(F.col(text).cast("string")))
    left = named.filter(worded).join(stay, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_hash")), "left_semi")
    if not found.groupBy("_key", "_hash").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([key, "_own"])
    wordless = named.filter(~worded)
    once = wordless.filter(F.col(key).isNotNull()).dropDuplicates([key, "_own"])
    return left.unionByName(once).unionByName(wordless.filter(F.col(key).isNull())).drop("_own")
