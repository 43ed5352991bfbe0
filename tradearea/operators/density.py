"""Density clustering (DBSCAN) of all groups and all parameter pairs in one set of joins.

Space is cut into cells whose diagonal is just under eps, so points of one cell are always
neighbours of each other. A cell holding at least the largest tried min_samples is *full*: its
points are core points and need no counting. Only points of the other cells, at most a handful per
cell, are joined with their surroundings, which keeps the work linear in the number of points
however dense a region is. Between two full cells it is enough to know whether any pair is near.

Neighbour counts serve every min_samples of the same eps: a point carries its *depth*, the largest
tried min_samples for which it is a core point.

Groups of up to `limit` rows, by their counted size, need no joins: each is one numpy step with one distance matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from tradearea.operators.components import connected
from tradearea.operators.cuts import core_levels, grid_labels, pair_levels
from tradearea.operators.grouped import running_total
from tradearea.operators.tiles import Batches, field_arrays, list_values, pair_distances, with_lists
from tradearea.sources.scratch import cut, grown

SHRINK = 1 - 1e-9


def distance(a: str, b: str, coords: Sequence[str]) -> Column:
    """Euclidean distance between the coordinates of two joined sides."""
    return F.sqrt(sum(
        (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in coords))


def _offsets(reach: int, dims: int) -> Column:
    steps = product(range(-reach, reach + 1), repeat=dims)
    return F.array(*[F.array(*[F.lit(s).cast("long") for s in step]) for step in steps])


def _half(reach: int, dims: int) -> Column:
    """One of each two opposite offsets, and not the middle."""
    steps = [step for step in product(range(-reach, reach + 1), repeat=dims) if step > (0,) * dims]
    return F.array(*[F.array(*[F.lit(s).cast("long") for s in step]) for step in steps])


def collapse(points: DataFrame, by: Sequence[str], coords: Sequence[str], id_col: str) -> DataFrame:
    """One row per distinct place in a group: weight and smallest id."""
    return points.groupBy(*by, *coords).agg(F.count(F.lit(1)).alias("w"), F.min(id_col).alias("pid"))


def _cells(sites: DataFrame, trials: DataFrame, by: list[str], coords: list[str]) -> DataFrame:
    """Sites once per eps, with cell name, cell weight and the wide cell used to look around."""
    unit = [*by, "eps"]
    tops = trials.groupBy(*unit).agg(
        F.max("min_samples").alias("top"), F.array_sort(F.collect_set("min_samples")).alias("tries"))
    side = F.col("eps") / sqrt(len(coords)) * SHRINK
    placed = sites.join(tops, by).withColumns({
        **{f"f{i}": F.floor(F.col(c) / side) for i, c in enumerate(coords)},
        **{f"g{i}": F.floor(F.col(c) / (F.col("eps") / SHRINK)) for i, c in enumerate(coords)},
    })
    fine = [*unit, *[f"f{i}" for i in range(len(coords))]]
    weights = placed.groupBy(*fine).agg(F.sum("w").alias("cell_w"), F.min("pid").alias("cell"))
    return placed.join(weights, fine).withColumn("full", F.col("cell_w") >= F.col("top"))


def _surroundings(pts: DataFrame, unit: list[str], coords: list[str]) -> DataFrame:
    """Weight near each point of a non-full cell: per neighbour, or per cell where that is full."""
    wide = [f"g{i}" for i in range(len(coords))]
    loose = pts.filter(~F.col("full")).withColumn("_step", F.explode(_offsets(1, len(coords))))
    loose = loose.select(
        *unit, "top", "tries", "pid", "cell", *coords,
        *[(F.col(g) + F.col("_step")[i]).alias(g) for i, g in enumerate(wide)])
    p, q = loose.alias("p"), pts.alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in [*unit, *wide]]
    near = (F.col("p.cell") != F.col("q.cell")) & (distance("p", "q", coords) <= F.col("p.eps"))
    for test in same:
        near = near & test
    return (
        p.join(q, near)
        .groupBy(*[F.col(f"p.{c}").alias(c) for c in unit], F.col("p.pid").alias("pid"),
                 F.col("p.cell").alias("cell"), F.col("q.cell").alias("other_cell"),
                 F.when(~F.col("q.full"), F.col("q.pid")).alias("other"))
        .agg(F.sum("q.w").alias("near_w"), F.any_value("p.top").alias("top"), F.any_value("p.tries").alias("tries"))
    )


def _full_pairs(pts: DataFrame, unit: list[str], coords: list[str]) -> DataFrame:
    """Pairs of full cells with at least one pair of points within eps: (unit, a, b, level, tries)."""
    dims = range(len(coords))
    fine = [f"f{i}" for i in dims]
    place = F.struct(*coords)
    # The outermost points of a cell in every axis and diagonal direction stand for the cell first.
    ways = [way for way in product((-1, 0, 1), repeat=len(coords)) if any(way)]
    ways = [w for w in ways if sum(map(abs, w)) in (1, len(coords))]
    ends = F.array(*[
        F.max_by(place, sum((F.col(c) * s for c, s in zip(coords, way) if s), F.lit(0.0))) for way in ways])
    boxes = grown(pts.filter("full").groupBy(*unit, *fine, "cell").agg(
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(coords)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(coords)],
        ends.alias("ends"), F.any_value("top").alias("top"), F.any_value("tries").alias("tries")), "boxes")
    # only names step to the cells on one side; bounds and end points follow the pairs that met
    names = boxes.select(*unit, *fine, F.col("cell").alias("_other"))
    stepped = boxes.select(*unit, *fine, F.col("cell").alias("_own"), F.explode(_half(2, len(coords))).alias("_step")).select(
        *unit, *[(F.col(f) + F.col("_step")[i]).alias(f) for i, f in enumerate(fine)], "_own")
    pairs = stepped.join(names, [*unit, *fine]).select(
        *unit, F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"))
    first = boxes.select(
        *unit, F.col("cell").alias("a"), F.col("ends").alias("ends_a"),
        *[F.col(f"lo{i}").alias(f"alo{i}") for i in dims], *[F.col(f"hi{i}").alias(f"ahi{i}") for i in dims])
    met = pairs.join(first, [*unit, "a"]).join(boxes.drop(*fine).withColumnRenamed("cell", "b"), [*unit, "b"])
    gap = sum(
        F.pow(F.greatest(F.col(f"lo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"hi{i}"), F.lit(0.0)), 2)
        for i in dims)
    def apart(x: Column, y: Column) -> Column:
        return F.sqrt(sum((x[c] - y[c]) * (x[c] - y[c]) for c in coords))
    sure = F.exists("ends_a", lambda x: F.exists("ends", lambda y: apart(x, y) <= F.col("eps")))
    met = met.filter(F.sqrt(gap) <= F.col("eps") / SHRINK).withColumn("sure", sure)
    met = grown(met.drop("ends", "ends_a"), "cellpairs")
    # The rest is decided by the points that face the other cell; the search stops at the first hit.
    rest = met.filter(~F.col("sure"))

    def facing(cell: str, lo: str, hi: str) -> DataFrame:
        beyond = sum(
            F.pow(F.greatest(F.col(f"{lo}{i}") - F.col(c), F.col(c) - F.col(f"{hi}{i}"), F.lit(0.0)), 2)
            for i, c in enumerate(coords))
        inside = pts.filter("full").select(*unit, F.col("cell").alias(cell), *coords)
        return rest.join(inside, [*unit, cell]).filter(F.sqrt(beyond) <= F.col("eps") / SHRINK).select(
            *unit, "a", "b", "top", "tries", *coords)

    x, y = facing("a", "lo", "hi").alias("x"), facing("b", "alo", "ahi").alias("y")
    test = distance("x", "y", coords) <= F.col("x.eps")
    for c in [*unit, "a", "b"]:
        test = test & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    found = x.join(y, test, "left_semi").select(*unit, "a", "b", "top", "tries").distinct()
    both = met.filter("sure").select(*unit, "a", "b", "top", "tries").unionByName(found)
    return both.withColumnRenamed("top", "level")


def _tried(least: Column, deepest: Column) -> Column:
    """The tried min_samples above `least` and up to `deepest`, one row each."""
    return F.explode(F.filter("tries", lambda m: (m > least) & (m <= deepest)))


def dbscan_sites(points: DataFrame, trials: DataFrame, by: Sequence[str], coords: Sequence[str],
                 id_col: str) -> DataFrame:
    """Labels per distinct place and trial.

    `trials` lists eps and min_samples per group. Result: by, eps, min_samples, coords, w (rows at
    the place), pid (smallest id there), core, label. Label -1 is noise; cluster 0 owns the smallest
    core id of its group, the others follow in that order. A border point joins the
    lowest-numbered cluster with a core point within eps.
    """
    by, coords = list(by), list(coords)
    unit, trial = [*by, "eps"], [*by, "eps", "min_samples"]
    trials = trials.select(*by, F.col("eps").cast("double").alias("eps"),
                           F.col("min_samples").cast("long").alias("min_samples")).distinct()
    pts = grown(_cells(collapse(points, by, coords, id_col), trials, by, coords), "cells")
    near = grown(_surroundings(pts, unit, coords), "near")

    counts = near.groupBy(*unit, "pid").agg(F.sum("near_w").alias("near_w"))
    depth = F.when(F.col("full"), F.col("top")).otherwise(
        F.least("top", F.col("cell_w") + F.coalesce("near_w", F.lit(0))))
    pts = grown(
        pts.join(counts, [*unit, "pid"], "left").withColumn("depth", depth)
        .select(*unit, "top", "tries", "full", "cell", "pid", "w", *coords, "depth",
                *[f"f{i}" for i in range(len(coords))]), "depth")

    # reach: deepest point of a neighbouring cell within eps of the point
    depths = pts.select(*unit, "pid", "depth")
    side = [*unit, "pid", "cell", "other_cell", "tries"]
    to_full = near.filter("other is null").select(*side, F.col("top").alias("reach"))
    to_point = near.filter("other is not null").join(
        depths.withColumnsRenamed({"pid": "other", "depth": "reach"}), [*unit, "other"]).select(*side, "reach")
    links = grown(
        to_full.unionByName(to_point)
        .groupBy(*unit, "pid", "cell", "other_cell").agg(F.max("reach").alias("reach"), F.any_value("tries").alias("tries"))
        .join(depths, [*unit, "pid"]), "links")
    none = F.lit(0)
    joined = links.groupBy(*unit, F.col("cell").alias("a"), F.col("other_cell").alias("b")).agg(
        F.max(F.least("depth", "reach")).alias("level"), F.any_value("tries").alias("tries"))
    edges = joined.unionByName(_full_pairs(pts, unit, coords)).select(
        *unit, "a", "b", _tried(none, F.col("level")).alias("min_samples"))
    roots = connected(edges, trial, "a", "b", grown)

    # clusters are numbered by their smallest core id
    firsts = (
        pts.groupBy(*unit, "cell", "depth").agg(F.min("pid").alias("first"), F.any_value("tries").alias("tries"))
        .select(*unit, "cell", "first", _tried(none, F.col("depth")).alias("min_samples"))
        .groupBy(*trial, "cell").agg(F.min("first").alias("first"))
        .join(roots.withColumnRenamed("node", "cell"), [*trial, "cell"], "left")
        .withColumn("root", F.coalesce("root", "cell"))
    )
    firsts = grown(firsts, "cores")
    heads = firsts.groupBy(*trial, "root").agg(F.min("first").alias("first")).withColumn("one", F.lit(1))
    numbered = running_total(heads, trial, "first", {"upto": "one"}, slot=F.left("first", F.lit(5)))
    cell_labels = grown(
        firsts.join(numbered.select(*trial, "root", (F.col("upto") - 1).cast("long").alias("label")),
                    [*trial, "root"])
        .select(*trial, "cell", "label"), "celllabels")

    own = pts.select(*unit, "pid", "cell", "depth", "tries")
    core = own.select(*unit, "pid", "cell", _tried(none, F.col("depth")).alias("min_samples")).join(
        cell_labels, [*trial, "cell"]).select(*trial, "pid", "label")
    deepest = pts.groupBy(*unit, "cell").agg(F.max("depth").alias("reach"))
    beside = links.select(*unit, "pid", "other_cell", "depth", "reach", "tries").unionByName(
        own.join(deepest, [*unit, "cell"]).filter("depth < reach").select(
            *unit, "pid", F.col("cell").alias("other_cell"), "depth", "reach", "tries"))
    border = (
        beside.select(*unit, "pid", "other_cell", _tried(F.col("depth"), F.col("reach")).alias("min_samples"))
        .join(cell_labels.withColumnRenamed("cell", "other_cell"), [*trial, "other_cell"])
        .groupBy(*trial, "pid").agg(F.min("label").alias("label"))
    )
    labels = core.unionByName(border)
    return (
        pts.withColumn("min_samples", F.explode("tries"))
        .withColumn("core", F.col("depth") >= F.col("min_samples"))
        .select(*trial, *coords, "w", "pid", "core")
        .join(labels, [*trial, "pid"], "left")
        .withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))
    )


def _by_size(points: DataFrame, by: list[str], limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The points of groups of up to `limit` rows and those of larger ones; None where there are none."""
    if not limit:
        return None, points
    large = cut(points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*by), "large")
    if large.isEmpty():
        return points, None
    return points.join(large, by, "left_anti"), points.join(large, by, "left_semi")


def _places(table: pa.Table, coords: list[str], id_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each row of a group, and each place's coordinates and rows; places in the order of their smallest ids."""
    xyz = np.stack([table.column(c).to_numpy() for c in coords], axis=1).astype(float) + 0.0
    order, n = np.lexsort(xyz.T), len(xyz)
    found = np.empty(n, np.int64)
    found[order] = np.cumsum(np.r_[True, (xyz[order[1:]] != xyz[order[:-1]]).any(1)]) - 1
    by_id = pc.sort_indices(table, [(id_col, "ascending")]).to_numpy().astype(np.int64)
    first = np.full(found.max() + 1, n, np.int64)
    np.minimum.at(first, found[by_id], np.arange(n))
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    place = number[found]
    return place, xyz[by_id[np.sort(first)]], np.bincount(place).astype(float)


def _with_settings(points: DataFrame, settings: DataFrame, by: list[str], coords: list[str], out: list[StructField],
                   run: Callable[[pa.Table, pa.Table], list[pa.Table]]) -> DataFrame:
    """Each group of points and its settings (rows of the same key) in one numpy step; rows without a place or a key have no result."""
    known = points.dropna(subset=[*by, *coords])
    schema = StructType(out)

    def met(table: pa.Table, tried: pa.Table) -> pa.Table:
        parts = run(table, tried) if table.num_rows and tried.num_rows else []
        return pa.concat_tables(parts) if parts else pa.table(
            [table.column(f.name).slice(0, 0) if f.name in table.column_names else pa.array([], empty[f.name]) for f in schema], names=schema.names)

    empty = {"eps": pa.float64(), "min_samples": pa.int64(), "core": pa.bool_(), "label": pa.int64(), "neighbors": pa.int64()}
    return known.groupBy(*by).cogroup(settings.dropna().groupBy(*by)).applyInArrow(met, schema)


def _labels_of_groups(points: DataFrame, trials: DataFrame, by: list[str], coords: list[str], id_col: str) -> DataFrame:
    """The points of small groups with eps, min_samples, core and label."""
    names = [*by, *coords, *[c for c in points.columns if c not in {*by, *coords}]]

    def run(table: pa.Table, tried: pa.Table) -> list[pa.Table]:
        place, xyz, weight = _places(table, coords, id_col)
        far, tries, parts = pair_distances(xyz, xyz), {}, []
        for eps, least in zip(tried.column("eps").to_pylist(), tried.column("min_samples").to_pylist()):
            tries.setdefault(eps, []).append(least)
        for eps, least in tries.items():
            level = pair_levels(far, [eps])
            core = core_levels(level, weight, 1, least)
            for m, is_core, label in zip(least, core == 0, grid_labels(level, core, 1)[0]):
                n = table.num_rows
                parts.append(pa.table([*[table.column(c) for c in names], pa.array(np.full(n, eps)), pa.array(np.full(n, m, np.int64)),
                                       pa.array(is_core[place]), pa.array(label[place].astype(np.int64))], names=[*names, "eps", "min_samples", "core", "label"]))
        return parts

    out = [*[points.schema[c] for c in names], StructField("eps", DoubleType()), StructField("min_samples", LongType()),
           StructField("core", BooleanType()), StructField("label", LongType())]
    return _with_settings(points, trials, by, coords, out, run)


def dbscan_by(points: DataFrame, trials: DataFrame, by: Sequence[str], coords: Sequence[str],
              id_col: str, limit: int = 0) -> DataFrame:
    """Every point of a group that has trials, with eps, min_samples, core and label.

    Groups of up to `limit` rows are one numpy step each (its matrix holds limit x limit numbers); larger ones, by their
    counted size, go through the joins of cells. `points` are read twice then.
    """
    by, coords = list(by), list(coords)
    trials = trials.select(*by, F.col("eps").cast("double").alias("eps"),
                           F.col("min_samples").cast("long").alias("min_samples")).distinct()
    small, large = _by_size(points, by, limit)
    done = [] if small is None else [_labels_of_groups(small, trials, by, coords, id_col)]
    if large is not None:
        sites = dbscan_sites(large, trials, by, coords, id_col)
        done.append(large.hint("merge").join(sites.drop("w", "pid"), [*by, *coords]))
    return reduce(DataFrame.unionByName, done)


#: places a cell may hold before it is opened, and how often a cell's side may be halved
LEAF, HALVINGS = 48, 20


def _nested(sites: DataFrame, by: list[str], coords: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): cells of side eps, halved while they hold more than LEAF places.

    nodes: by, node, parent, bounds (lo, hi), w (rows), leaf. leaves: the sites with the leaf that holds them. Cells are
    named by depth and position, a node without children is a leaf.
    """
    dims = range(len(coords))
    bounds = [*[F.min(c).alias(f"lo{i}") for i, c in enumerate(coords)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(coords)]]
    left = sites.withColumns({f"_f{i}": F.floor(F.col(c) / F.col("eps") * SHRINK * float(1 << HALVINGS)) for i, c in enumerate(coords)})

    def name(depth: int) -> Column:
        return F.concat_ws("/", F.lit(str(depth)), *[F.shiftright(f"_f{i}", HALVINGS - depth).cast("string") for i in dims])

    nodes, leaves = [], []
    for depth in range(HALVINGS + 1):
        parent = name(depth - 1) if depth else F.lit(None).cast("string")
        cells = cut(left.groupBy(*by, "eps", parent.alias("parent"), name(depth).alias("node")).agg(
            *bounds, F.sum("w").alias("w"), F.count(F.lit(1)).alias("_n")).withColumn(
            "leaf", (F.col("_n") <= LEAF) if depth < HALVINGS else F.lit(True)), "nodes")
        nodes.append(cells.drop("_n"))
        placed = left.withColumn("node", name(depth))
        leaves.append(placed.join(cells.filter("leaf").select(*by, "node"), [*by, "node"], "left_semi").select(*by, "eps", "node", "pid", "w", *coords))
        if cells.filter("not leaf").isEmpty():
            break
        left = cut(placed.join(cells.filter("not leaf").select(*by, "node"), [*by, "node"], "left_semi").drop("node"), "dense")
    every, held = nodes[0], leaves[0]
    for more_nodes, more_leaves in zip(nodes[1:], leaves[1:]):
        every, held = every.unionByName(more_nodes), held.unionByName(more_leaves)
    return every, held


def _leaf_pairs(keep: list[str], dims: int):
    """Per row of a pair of leaves: the places of the first leaf and the weight of the second within eps of each."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            xi = [list_values(batch, f"i_x{k}") for k in range(dims)]
            xj = [list_values(batch, f"j_x{k}") for k in range(dims)]
            wj, eps = list_values(batch, "j_w"), batch.column(batch.schema.get_field_index("eps")).to_numpy()
            near = []
            for r in range(batch.num_rows):
                far = pair_distances(np.stack([x[r] for x in xi], axis=1), np.stack([x[r] for x in xj], axis=1))
                near.append(((far <= eps[r]) * wj[r]).sum(axis=1).astype(np.int64))
            yield with_lists(batch, keep, {"near": near})

    return run


def _counts_of_groups(points: DataFrame, radius: DataFrame, by: list[str], coords: list[str], id_col: str) -> DataFrame:
    """(by, id, neighbors) of small groups."""

    def run(table: pa.Table, tried: pa.Table) -> list[pa.Table]:
        place, xyz, weight = _places(table, coords, id_col)
        far = pair_distances(xyz, xyz)
        return [pa.table([*[table.column(c) for c in [*by, id_col]], pa.array(((far <= eps) @ weight).astype(np.int64)[place])],
                         names=[*by, id_col, "neighbors"]) for eps in tried.column("eps").to_pylist()]

    out = [*[points.schema[c] for c in [*by, id_col]], StructField("neighbors", LongType())]
    return _with_settings(points.select(*by, *coords, id_col), radius, by, coords, out, run)


def neighbor_counts(points: DataFrame, radius: DataFrame, by: Sequence[str], coords: Sequence[str],
                    id_col: str, limit: int = 0) -> DataFrame:
    """(by, id, neighbors): rows of the same group within eps of each row, itself included.

    `radius` holds eps per group. Groups of up to `limit` rows are one numpy step each, larger ones are counted through nested cells.
    """
    by, coords = list(by), list(coords)
    radius = radius.select(*by, F.col("eps").cast("double").alias("eps")).distinct()
    small, large = _by_size(points, by, limit)
    done = [] if small is None else [_counts_of_groups(small, radius, by, coords, id_col)]
    if large is not None:
        done.append(_nested_counts(large, radius, by, coords, id_col))
    return reduce(DataFrame.unionByName, done)


def _nested_counts(points: DataFrame, radius: DataFrame, by: list[str], coords: list[str], id_col: str) -> DataFrame:
    """The same for groups of any size.

    Cells are nested, and pairs of cells are followed from the widest on: a pair that lies wholly
    within eps adds the one's rows to all rows of the other at once, one that lies wholly apart is dropped, and
    only pairs on the border are opened, down to leaves of a few places, which are compared place by place. So a dense region
    costs its border, not the square of its rows.
    """
    dims, wide = range(len(coords)), [f"g{i}" for i in range(len(coords))]
    sites = cut(collapse(points, by, coords, id_col).join(radius, by), "sites")
    nodes, held = _nested(sites, by, coords)
    nodes, held = cut(nodes, "cells"), cut(held, "leaves")
    box = [*[f"lo{i}" for i in dims], *[f"hi{i}" for i in dims]]

    # the first pairs: cells of side eps that touch
    places = [F.split("node", "/")[i + 1].cast("long") for i in dims]
    tops = nodes.filter("parent is null").withColumns(dict(zip(wide, places)))
    around = tops.withColumn("_step", F.explode(_offsets(1, len(coords)))).select(*by, F.col("node").alias("a"), *[(F.col(g) + F.col("_step")[i]).alias(g) for i, g in enumerate(wide)])
    pairs = around.join(tops.select(*by, *wide, F.col("node").alias("b")), [*by, *wide]).select(*by, "a", "b")
    first = nodes.select(*by, "eps", F.col("node").alias("a"), F.col("leaf").alias("leaf_a"), *[F.col(c).alias(f"a{c}") for c in box])
    second = nodes.select(*by, F.col("node").alias("b"), F.col("leaf").alias("leaf_b"), F.col("w").alias("w_b"), *[F.col(c).alias(f"b{c}") for c in box])
    steps = nodes.filter("parent is not null").select(*by, F.col("parent").alias("up"), F.col("node").alias("down"))
    ends = nodes.filter("leaf").select(*by, F.col("node").alias("up"), F.col("node").alias("down"))
    opened = steps.unionByName(ends)
    gap = sum((F.pow(F.greatest(F.col(f"alo{i}") - F.col(f"bhi{i}"), F.col(f"blo{i}") - F.col(f"ahi{i}"), F.lit(0.0)), 2) for i in dims), F.lit(0.0))
    reach = sum((F.pow(F.greatest(F.col(f"ahi{i}") - F.col(f"blo{i}"), F.col(f"bhi{i}") - F.col(f"alo{i}")), 2) for i in dims), F.lit(0.0))
    whole, border = [], []
    while True:
        met = pairs.join(first, [*by, "a"]).join(second, [*by, "b"]).filter(F.sqrt(gap) <= F.col("eps") / SHRINK).withColumn(
            "inside", F.sqrt(reach) <= F.col("eps") * SHRINK).select(*by, "eps", "a", "b", "inside", "w_b", (F.col("leaf_a") & F.col("leaf_b")).alias("last"))
        met = cut(met, "cellpairs")
        whole.append(met.filter("inside").groupBy(*by, F.col("a").alias("node")).agg(F.sum("w_b").alias("near")))
        border.append(met.filter("not inside and last").select(*by, "eps", "a", "b"))
        rest = met.filter("not inside and not last").select(*by, "a", "b")
        if rest.isEmpty():
            break
        pairs = rest.join(opened.withColumnsRenamed({"up": "a", "down": "_a"}), [*by, "a"]).join(
            opened.withColumnsRenamed({"up": "b", "down": "_b"}), [*by, "b"]).select(*by, F.col("_a").alias("a"), F.col("_b").alias("b"))
    tallies, edges = whole[0], border[0]
    for more_whole, more_border in zip(whole[1:], border[1:]):
        tallies, edges = tallies.unionByName(more_whole), edges.unionByName(more_border)

    # a leaf has what its own cell and all cells above it were given at once
    parts = F.split("node", "/")
    depth = parts[0].cast("int")
    above = F.transform(F.sequence(F.lit(0), depth), lambda d: F.concat_ws("/", d.cast("string"), *[
        F.floor(parts[i + 1].cast("double") / F.pow(F.lit(2.0), depth - d)).cast("string") for i in dims]))
    given = tallies.groupBy(*by, "node").agg(F.sum("near").alias("near"))
    whole_of = nodes.filter("leaf").select(*by, F.col("node").alias("leaf"), F.explode(above).alias("node")).join(given, [*by, "node"]).groupBy(
        *by, F.col("leaf").alias("node")).agg(F.sum("near").alias("whole"))

    xs = [f"x{i}" for i in dims]
    packed = held.select(*by, "node", F.struct("pid", "w", *[F.col(c).alias(x) for c, x in zip(coords, xs)]).alias("_s")).groupBy(*by, "node").agg(F.collect_list("_s").alias("rows"))
    tiles = edges.join(packed.withColumnRenamed("node", "a"), [*by, "a"]).join(packed.select(*by, F.col("node").alias("b"), F.col("rows").alias("other_rows")), [*by, "b"])
    ready = tiles.select(*by, "eps", *field_arrays(tiles, ["pid", *xs], ["w", *xs]))
    keep = [*by, "i_pid"]
    compared = ready.mapInArrow(_leaf_pairs(keep, len(coords)), StructType([*[ready.schema[c] for c in keep], StructField("near", ArrayType(LongType()))]))
    single = compared.select(*by, F.explode(F.arrays_zip(F.col("i_pid").alias("pid"), "near")).alias("_p")).select(*by, "_p.*").groupBy(*by, "pid").agg(F.sum("near").alias("single"))
    counts = held.join(whole_of, [*by, "node"], "left").join(single, [*by, "pid"], "left").select(
        *by, *coords, (F.coalesce("whole", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("neighbors"))
    return points.select(*by, *coords, id_col).join(counts, [*by, *coords]).select(*by, id_col, "neighbors")
