import numpy as np
import pandas as pd
import pytest

from brute import dbscan, distances, silhouette
from tradearea.operators import density
from tradearea.operators.density import dbscan_by, neighbor_counts
from tradearea.operators.silhouette import silhouette_by

XYZ = ["x", "y", "z"]


def make_points(seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for store in (1, 2, 3):
        blob = rng.normal(0, 0.15, (60 * store, 3))
        far = rng.normal(2, 0.3, (30, 3))
        line = np.stack([np.linspace(-3, 3, 40), np.full(40, 3.0), np.zeros(40)], axis=1)
        copies = np.repeat([[0.5, 0.5, 0.5]], 25, axis=0)
        noise = rng.uniform(-4, 4, (40, 3))
        xyz = np.round(np.concatenate([blob, far, line, copies, noise]), 6)
        ids = [f"{k:011d}" for k in rng.permutation(len(xyz))]
        frames.append(pd.DataFrame(xyz, columns=XYZ).assign(store=store, id=ids))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def labelled(spark):
    pdf = make_points()
    trials = [(s, e, m) for s in (1, 2, 3) for e, m in
              [(0.1, 1), (0.1, 4), (0.2, 2), (0.2, 5), (0.5, 3), (0.5, 9), (1.2, 20)]]
    got = dbscan_by(
        spark.createDataFrame(pdf).repartition(5),
        spark.createDataFrame(trials, "store long, eps double, min_samples int"), ["store"], XYZ, "id")
    return pdf, got, got.toPandas()


def test_labels_equal_brute_force(labelled):
    pdf, _, got = labelled
    assert len(got) == len(pdf) * 7
    for (store, eps, ms), part in got.groupby(["store", "eps", "min_samples"]):
        mine = pdf[pdf.store == store].sort_values("id")
        core, want = dbscan(mine[XYZ].to_numpy(), list(mine.id), eps, ms)
        part = part.sort_values("id")
        assert list(part.core) == list(core), (store, eps, ms)
        assert list(part.label) == list(want), (store, eps, ms)


@pytest.mark.parametrize("block", [2048, 25])
def test_silhouette_equals_brute_force(labelled, block):
    _, frame, got = labelled
    score = silhouette_by(frame, ["store", "eps", "min_samples"], XYZ, "label", "id", block=block).toPandas()
    assert len(score) == 21
    for _, row in score.iterrows():
        part = got[(got.store == row.store) & (got.eps == row.eps) & (got.min_samples == row.min_samples)]
        want = silhouette(part[XYZ].to_numpy(), part.label.to_numpy())
        if want is None:
            assert pd.isna(row.score)
        else:
            assert row.score == pytest.approx(want, abs=1e-9)


def test_partitioning_does_not_matter(spark, labelled):
    pdf, _, got = labelled
    trials = spark.createDataFrame([(1, 0.2, 5), (2, 0.5, 3)], "store long, eps double, min_samples int")
    again = dbscan_by(spark.createDataFrame(pdf.sample(frac=1, random_state=3)).repartition(13), trials,
                      ["store"], XYZ, "id").toPandas()
    want = got.merge(again[["store", "eps", "min_samples", "id", "label"]],
                     on=["store", "eps", "min_samples", "id"], suffixes=("", "_again"))
    assert len(want) == len(again) > 0
    assert (want.label == want.label_again).all()


@pytest.mark.parametrize("leaf", [48, 3])
def test_neighbor_counts_equal_brute_force(spark, monkeypatch, leaf):
    """Loose, dense and coinciding places, two groups with radii of their own, and cells opened several times."""
    monkeypatch.setattr(density, "LEAF", leaf)
    rng = np.random.default_rng(7)
    frames = []
    for store, n in ((1, 500), (2, 90)):
        xyz = np.concatenate([rng.normal(0, 0.05, (n, 3)), rng.uniform(-2, 2, (60, 3)), np.repeat([[0.01, 0.02, 0.03]], 30, axis=0), [[0.3, 0.0, 0.0], [-0.3, 0.0, 0.0]]])
        frames.append(pd.DataFrame(np.round(xyz, 5), columns=XYZ).assign(store=store, id=[f"{store}-{k:04d}" for k in range(len(xyz))]))
    pdf = pd.concat(frames, ignore_index=True)
    radius = spark.createDataFrame([(1, 0.3), (2, 0.6), (3, 1.0)], "store long, eps double")
    got = neighbor_counts(spark.createDataFrame(pdf).repartition(5), radius, ["store"], XYZ, "id").toPandas()
    assert len(got) == len(pdf)
    for (store, eps) in ((1, 0.3), (2, 0.6)):
        own = pdf[pdf.store == store]
        far = distances(own[XYZ].to_numpy())
        want = dict(zip(own.id, (far <= eps).sum(axis=1)))
        assert dict(zip(got[got.store == store].id, got[got.store == store].neighbors)) == want


def test_no_clustering_step_is_sent_to_all_executors(labelled):
    """Written steps look small as files and fill the driver as broadcast tables; tests' small tables would be sent too."""
    plan = labelled[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _mixed_groups(size: int = 150):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(np.round(rng.standard_normal((size, 3)), 1), columns=XYZ)
    pdf["store"], pdf["id"] = np.repeat([1, 2, 3], [size // 2, size // 4, size - size // 2 - size // 4]), [f"p{i:04d}" for i in rng.permutation(size)]
    pdf.loc[pdf.index % 7 == 0, XYZ] = pdf.loc[0, XYZ].values  # places that coincide
    return pdf


def _plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_groups_are_clustered_without_joins_as_large_ones_are(spark):
    """One numpy step per group and the joins of cells give the same labels; the former writes none of their steps."""
    points = spark.createDataFrame(_mixed_groups()).repartition(5)
    trials = spark.createDataFrame([(1, 0.3, 3), (1, 0.5, 2), (1, 0.5, 4), (2, 0.4, 5)], "store long, eps double, min_samples long")
    ways = {limit: dbscan_by(points, trials, ["store"], XYZ, "id", limit=limit) for limit in (50, 2048)}
    assert len({tuple(df.columns) for df in ways.values()}) == 1
    rows = {limit: sorted(map(tuple, df.select("store", "eps", "min_samples", "id", "core", "label").collect())) for limit, df in ways.items()}
    assert rows[2048] == rows[50] and {r[0] for r in rows[50]} == {1, 2}
    assert "Join" not in _plan_of(ways[2048])


def test_small_groups_are_counted_without_joins_as_large_ones_are(spark):
    points = spark.createDataFrame(_mixed_groups()).repartition(5)
    radius = spark.createDataFrame([(1, 0.5), (2, 0.8)], "store long, eps double")
    ways = {limit: neighbor_counts(points, radius, ["store"], XYZ, "id", limit=limit) for limit in (50, 2048)}
    rows = {limit: sorted(map(tuple, df.select("store", "id", "neighbors").collect())) for limit, df in ways.items()}
    assert rows[2048] == rows[50] and {r[0] for r in rows[50]} == {1, 2}
    assert "Join" not in _plan_of(ways[2048])


def test_rows_without_key_or_coordinates_have_no_label(spark):
    points = spark.createDataFrame([(None, "a", 0.0, 0.0, 0.0), (1, "b", None, 0.0, 0.0), (1, "c", 0.0, 0.0, 0.0), (2, "d", 0.0, 0.0, 0.0)],
                                   "store long, id string, x double, y double, z double").toDF("store", "id", *XYZ)
    trials = spark.createDataFrame([(None, 0.5, 1), (1, 0.5, 1)], "store long, eps double, min_samples long")
    for limit in (0, 2048):
        assert [(r.id, r.core, r.label) for r in dbscan_by(points, trials, ["store"], XYZ, "id", limit=limit).collect()] == [("c", True, 0)]
    assert [(r.id, r.neighbors) for r in neighbor_counts(points, trials, ["store"], XYZ, "id", limit=2048).collect()] == [("c", 1)]
