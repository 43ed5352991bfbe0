"""Mean silhouette of labelled points per group, for plain Euclidean distance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tradearea.operators.cuts import silhouettes
from tradearea.operators.tiles import (
    BLOCK, Batches, block_pairs, field_arrays, into_blocks, list_values, pair_distances, with_lists,
)
from tradearea.sources.scratch import cut


def _tile_sums(keep: list[str], dims: int):
    """Per point of block i: distance sum to its own label, the smallest mean over labels that lie
    whole in block j, and the share of the mean when block j is a piece of one large label."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            li, lj = list_values(batch, "i_label"), list_values(batch, "j_label")
            xi = [list_values(batch, f"i_x{k}") for k in range(dims)]
            xj = [list_values(batch, f"j_x{k}") for k in range(dims)]
            wj, cj = list_values(batch, "j_w"), list_values(batch, "j_size")
            own, best, piece = [], [], []
            for r in range(batch.num_rows):
                order = np.argsort(lj[r], kind="stable")
                labels, starts = np.unique(lj[r][order], return_index=True)
                far = pair_distances(
                    np.stack([x[r][order] for x in xj], axis=1), np.stack([x[r] for x in xi], axis=1))
                sums = np.add.reduceat(far * wj[r][order][:, None], starts, axis=0)
                whole = np.add.reduceat(wj[r][order], starts)
                size = cj[r][order][starts]
                same = labels[:, None] == li[r][None, :]
                own.append(np.where(same, sums, 0.0).sum(axis=0))
                means = np.where(same, np.inf, sums / size[:, None])
                complete = whole == size
                best.append(means[complete].min(axis=0, initial=np.inf))
                parts = means[~complete]
                piece.append(parts.sum(axis=0) if len(parts) else np.full(len(li[r]), np.inf))
            yield with_lists(batch, keep, {"own": own, "best": best, "piece": piece})

    return run


#: groups of few rows that one task scores
GROUPS = 64


def _in_one_step(pts: DataFrame, by: list[str], dims: int, groups: int) -> DataFrame:
    """The scores of groups of few rows, each from one distance matrix."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        xyz = np.stack([table.column(f"x{k}").to_numpy() for k in range(dims)], axis=1)
        label, w = table.column("label").to_numpy(), table.column("w").to_numpy()
        scores, clusters = silhouettes(pair_distances(xyz, xyz), w, np.unique(label, return_inverse=True)[1][None, :])
        score = None if np.isnan(scores[0]) else float(scores[0])
        return pa.table([*[table.column(c).slice(0, 1) for c in by], pa.array([score], pa.float64()), pa.array([int(clusters[0])], pa.int64()),
                         pa.array([int(w.sum())], pa.int64())], names=[*by, "score", "clusters", "points"])

    kinds = ", ".join(f"`{c}` {pts.schema[c].dataType.simpleString()}" for c in by)
    rows = pts.select(*by, "label", "w", *[f"x{k}" for k in range(dims)]).repartition(max(1, -(-groups // GROUPS)), *by)
    return rows.groupBy(*by).applyInArrow(run, f"{kinds}, score double, clusters bigint, points bigint")


def silhouette_by(points: DataFrame, by: Sequence[str], coords: Sequence[str], label: str, id_col: str,
                  weight: str | None = None, block: int = BLOCK, limit: int = 0) -> DataFrame:
    """(by, score, clusters, points). Label -1 counts as a cluster like any other.

    Groups of up to `limit` rows, by their counted size, are one numpy step each; `points` must then be a written table.
    Larger ones go through blocks.

    The score is NULL when there is one label only or every point has its own. Large labels are cut
    into pieces of about `block` places, small ones are packed together whole; each pair of blocks is
    one numpy step whose output is three numbers per point, never the pairs themselves.
    """
    by, coords = list(by), list(coords)
    pts = points.select(
        *by, F.col(id_col).cast("string").alias("pid"), F.col(label).cast("long").alias("label"),
        (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"),
        *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(coords)])
    if limit:
        counted = cut(pts.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")), "counted")
        small, large = counted.filter(F.col("_rows") <= limit), counted.filter(F.col("_rows") > limit)
        parts = [_in_one_step(pts.join(small.select(*by), by, "left_semi"), by, len(coords), small.count())]
        if not large.isEmpty():
            parts.append(silhouette_by(points.join(large.select(*by), by, "left_semi"), by, coords, label, id_col, weight, block))
        return reduce(DataFrame.unionByName, parts)
    sizes = pts.groupBy(*by, "label").agg(F.sum("w").alias("size"), F.count(F.lit(1)).alias("places"))
    totals = sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("points"), F.sum("places").alias("all_places"))
    valid = totals.filter("clusters > 1 and clusters < points")
    sized = pts.join(sizes, [*by, "label"]).join(valid, by)
    pieces = F.ceil(F.col("places") / block)
    bins = F.ceil(F.col("all_places") / block)
    part = F.when(
        F.col("places") > block,
        F.concat_ws("/", F.lit("label"), F.col("label"), F.pmod(F.xxhash64("pid"), pieces)),
    ).otherwise(F.concat_ws("/", F.lit("bin"), F.pmod(F.xxhash64("label"), bins)))
    xs = [f"x{k}" for k in range(len(coords))]
    blocks = into_blocks(sized, by, part, ["pid", "label", "w", "size", *xs])
    tiles = block_pairs(blocks, by)
    # which large label block j is a piece of; NULL for a bin of whole labels
    piece_of = F.when(F.col("other_part").startswith("label/"), F.split("other_part", "/")[1])
    keep = [*by, "piece_of", "i_pid", "i_label", "i_w", "i_size"]
    ready = tiles.withColumn("piece_of", piece_of).select(
        *by, "piece_of",
        *field_arrays(tiles, ["pid", "label", "w", "size", *xs], ["label", "w", "size", *xs]))
    out = StructType([ready.schema[c] for c in keep] + [
        StructField(c, ArrayType(DoubleType())) for c in ("own", "best", "piece")])
    sums = ready.mapInArrow(_tile_sums(keep, len(coords)), out)
    rows = sums.select(
        *by, "piece_of",
        F.explode(F.arrays_zip(
            *[F.col(f"i_{c}").alias(c) for c in ("pid", "label", "w", "size")], "own", "best", "piece")).alias("p"),
    ).select(*by, "piece_of", "p.*")
    point = [*by, "pid", "label", "w", "size"]
    other = F.least(F.col("best"), F.col("piece"))
    per_point = (
        rows.groupBy(*point, "piece_of")
        .agg(F.sum("own").alias("own"), F.min("best").alias("best"), F.sum("piece").alias("piece"))
        .groupBy(*point).agg(F.sum("own").alias("own"), F.min(other).alias("b"))
        .withColumn("a", F.try_divide(F.col("own"), F.col("size") - 1))
    )
    lone = F.col("size") == 1
    value = F.when(lone, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    scored = per_point.groupBy(*by).agg((F.sum(value * F.col("w")) / F.sum("w")).alias("score"))
    return totals.join(scored, by, "left").select(*by, "score", "clusters", F.col("points").cast("long").alias("points"))
