"""Parameter grids and the choice of the best-scoring clustering per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradearea.operators.cuts import grid_of_group
from tradearea.operators.density import collapse, dbscan_sites
from tradearea.operators.silhouette import silhouette_by
from tradearea.operators.tiles import BLOCK
from tradearea.schemas import EPS_VALUES, MIN_SAMPLES_VALUES
from tradearea.sources.scratch import cut

SCORE_DIGITS = 9
#: groups whose trials one task makes
GROUPS = 64


def grid_trials(groups: DataFrame, by: Sequence[str], eps: Sequence[float] = EPS_VALUES,
                min_samples: Sequence[int] = MIN_SAMPLES_VALUES) -> DataFrame:
    """Each group with every (eps, min_samples) pair of a short literal grid."""
    pairs = F.array(*[
        F.struct(F.lit(round(float(e), 1)).alias("eps"), F.lit(int(m)).alias("min_samples"))
        for e in eps for m in min_samples])
    return groups.select(*by).distinct().withColumn("_t", F.explode(pairs)).select(*by, "_t.*")


def _one_task(sites: DataFrame, by: list[str], coords: list[str], eps: list[float], min_samples: list[int], every: bool = False) -> DataFrame:
    """All trials of each group from one distance matrix: a row per group with the scores, and one per site with its labels.

    Labels are those of the trials that can be the best one (`tops`, by their places in the grid); with `every`, of all trials.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        xyz = np.stack([table.column(c).to_numpy() for c in coords], axis=1).astype(float)
        labels, scores, clusters = grid_of_group(xyz, table.column("w").to_numpy().astype(float), eps, min_samples)
        n = table.num_rows
        known = scores[~np.isnan(scores)]
        # rounding may make near scores equal, so all within its reach stay
        kept = np.arange(len(scores)) if every else np.flatnonzero(scores >= known.max() - 10.0**(1 - SCORE_DIGITS)) if len(known) else np.empty(0, np.int64)
        ends = lambda width: pa.array(np.arange(n + 1, dtype=np.int32) * width)
        listed = pa.ListArray.from_arrays(ends(len(kept)), pa.array(labels[kept].T.reshape(-1).astype(np.int32)))
        tops = pa.ListArray.from_arrays(ends(len(kept)), pa.array(np.tile(kept.astype(np.int32), n)))
        sites_own = [table.column(c) for c in ("w", "pid")] if every else [pa.nulls(n, table.schema.field(c).type) for c in ("w", "pid")]
        own = pa.table([*[table.column(c) for c in [*by, *coords]], *sites_own, tops, listed,
                        pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.list_(pa.int32()))], names=names)
        one = pa.table([*[table.column(c).slice(0, 1) for c in by], *[pa.nulls(1, table.schema.field(c).type) for c in coords], pa.nulls(1, table.schema.field("w").type),
                        pa.nulls(1, table.schema.field("pid").type), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())),
                        pa.array([[None if np.isnan(s) else s for s in scores.tolist()]], pa.list_(pa.float64())), pa.array([clusters.tolist()], pa.list_(pa.int32()))], names=names)
        return pa.concat_tables([own, one])

    names = [*by, *coords, "w", "pid", "tops", "labels", "scores", "clusters"]
    kinds = ", ".join(f"`{c}` {sites.schema[c].dataType.simpleString()}" for c in names[:-4])
    return sites.select(*names[:-4]).groupBy(*by).applyInArrow(run, f"{kinds}, tops array<int>, labels array<int>, scores array<double>, clusters array<int>")


def _distributed(points: DataFrame, by: list[str], coords: list[str], id_col: str, eps: list[float], min_samples: list[int]) -> tuple[DataFrame, DataFrame]:
    """The same for groups of any size, spread over cells and tiles. Each distinct labelling is scored once, in its
    first trial; two hash sums over its labels (128 bits together) tell labellings apart."""
    trial = [*by, "eps", "min_samples"]
    labels = cut(dbscan_sites(points, grid_trials(points, by, eps, min_samples), by, coords, id_col), "grid")
    named = cut(labels.groupBy(*trial).agg(
        F.sum(F.xxhash64("pid", "label").cast("decimal(38,0)")).alias("_sum"),
        F.bit_xor(F.xxhash64(F.lit("x"), "label", "pid")).alias("_xor")), "labellings")
    same = [*by, "_sum", "_xor"]
    first = named.groupBy(*same).agg(F.min(F.struct("eps", "min_samples")).alias("_first"))
    once = labels.join(first.select(*by, "_first.*"), trial, "left_semi")
    scored = silhouette_by(once, trial, coords, "label", "pid", weight="w").withColumn("score", F.round("score", SCORE_DIGITS))
    of_first = scored.withColumn("_first", F.struct("eps", "min_samples")).drop("eps", "min_samples")
    scores = named.join(first, same).join(of_first, [*by, "_first"])
    return scores.select(*trial, "score", "clusters", "points"), labels


class Grid:
    """The clusterings of all trials in all groups of `points`, computed once.

    Groups of up to `limit` distinct places are one numpy step each (its matrix holds limit x limit numbers); larger
    ones, by their counted size, are clustered and scored through joins of cells and tiles. `scores` has by, eps,
    min_samples, score (null if the trial has none), clusters, points. Written are the scores and the labels of the best trials.
    """

    def __init__(self, points: DataFrame, by: Sequence[str], coords: Sequence[str], id_col: str, eps: Sequence[float] = EPS_VALUES,
                 min_samples: Sequence[int] = MIN_SAMPLES_VALUES, limit: int = BLOCK):
        self.by, self.coords = list(by), list(coords)
        eps, min_samples = [round(float(e), 1) for e in eps], [int(m) for m in min_samples]
        self.trial = [*self.by, "eps", "min_samples"]
        sites = cut(collapse(points, self.by, self.coords, id_col), "sites")
        sizes = cut(sites.groupBy(*self.by).agg(F.count(F.lit(1)).alias("_places"), F.sum("w").cast("bigint").alias("points")), "sizes")
        small, large = sizes.filter(F.col("_places") <= limit), sizes.filter(F.col("_places") > limit)
        # few bytes make much work here, so tasks follow from the groups' number, not from their size
        dealt = sites.join(small.select(*self.by), self.by, "left_semi").repartition(max(1, -(-small.count() // GROUPS)), *self.by)
        step = lambda every: _one_task(dealt, self.by, self.coords, eps, min_samples, every)
        self.done, self.every = cut(step(False), "grid"), step(True)
        self.tried = F.array(*[F.struct(F.lit(e).alias("eps"), F.lit(m).cast("bigint").alias("min_samples")) for e in eps for m in min_samples])
        self.scores = self.done.filter("scores is not null").join(sizes.drop("_places"), self.by).select(
            *self.by, "points", F.explode(F.arrays_zip(self.tried.alias("t"), "scores", "clusters")).alias("_x")).select(
            *self.by, "_x.t.*", F.round("_x.scores", SCORE_DIGITS).alias("score"), F.col("_x.clusters").cast("bigint").alias("clusters"), "points")
        self.more: DataFrame | None = None
        if not large.isEmpty():
            few = points.join(large.select(*self.by), self.by, "left_semi")
            more_scores, self.more = _distributed(few, self.by, self.coords, id_col, eps, min_samples)
            self.scores = self.scores.unionByName(more_scores)

    def labels(self) -> DataFrame:
        """by, coords, w, pid, eps, min_samples, label per distinct place and trial. A number per place and trial is not written: who reads it makes it."""
        keep = [*self.by, *self.coords, "w", "pid"]
        out = self.every.filter("labels is not null").select(*keep, F.explode(F.arrays_zip(self.tried.alias("t"), "labels")).alias("_x")).select(
            *keep, "_x.t.*", F.col("_x.labels").cast("bigint").alias("label"))
        return out if self.more is None else out.unionByName(self.more.select(*out.columns))

    def chosen(self, best: DataFrame) -> DataFrame:
        """by, coords, label of the best trial of each group (by, eps, min_samples): read by its place in the lists, not joined trial by trial."""
        trial = F.array_position(self.tried, F.struct("eps", F.col("min_samples").cast("bigint").alias("min_samples"))) - 1
        place = F.array_position("tops", trial.cast("int")).cast("int")
        out = self.done.filter("labels is not null").join(best, self.by).select(*self.by, *self.coords, F.element_at("labels", place).cast("bigint").alias("label"))
        return out if self.more is None else out.unionByName(self.more.join(best, self.trial).select(*out.columns))


def dbscan_grid(points: DataFrame, by: Sequence[str], coords: Sequence[str], id_col: str, eps: Sequence[float] = EPS_VALUES,
                min_samples: Sequence[int] = MIN_SAMPLES_VALUES, limit: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(scores, site labels) of every trial in every group; a trial without a valid score has NULL."""
    grid = Grid(points, by, coords, id_col, eps, min_samples, limit)
    return grid.scores, grid.labels()


def best_params(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Highest score per group; ties go to the smallest eps, then the smallest min_samples."""
    rank = F.struct("score", -F.col("eps"), -F.col("min_samples"))
    pick = F.max_by(F.struct("eps", "min_samples", "score"), rank)
    return scores.filter("score is not null").groupBy(*by).agg(pick.alias("_b")).select(*by, "_b.*")
