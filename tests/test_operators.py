import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradearea.operators import sampling
from tradearea.operators.components import connected
from tradearea.operators.cuts import silhouettes
from tradearea.operators.encoding import corr_with, encode, vocabulary
from tradearea.operators.grouped import quantiles, running_total, value_slots
from tradearea.operators.near import near_group, tiers
from tradearea.operators.sampling import nearest_within, oversample_tails, tail_of
from tradearea.operators.scaling import scale_by, unscale
from tradearea.sources.scratch import cut
from brute import dbscan as brute_dbscan, silhouette as brute_silhouette
from tradearea.operators.search import Grid, best_params, dbscan_grid
from tradearea.operators.silhouette import silhouette_by
from tradearea.operators.similar import nearest_mixed
from tradearea.operators.series import forecast_backtest, forecast_fourier, forecast_monthly, train_tail


def test_running_total_and_quantiles_of_one_hot_group(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.9 else 2, round(rng.expovariate(1), 5) + k * 1e-9) for k in range(800)]
    df = spark.createDataFrame(rows, "g int, v double").withColumn("one", F.lit(1))
    got = {(r.g, r.v): r.n for r in running_total(df, ["g"], "v", {"n": "one"}).collect()}
    for g in (1, 2):
        for rank, v in enumerate(sorted(v for k, v in rows if k == g), 1):
            assert got[g, v] == rank
    q = {r.g: (r.a, r.b) for r in quantiles(df, "v", {"a": 0.25, "b": 0.9}, ["g"]).collect()}
    for g in (1, 2):
        want = np.quantile([v for k, v in rows if k == g], [0.25, 0.9])
        assert q[g] == pytest.approx(tuple(want))


def test_slots_of_a_heavy_tail(spark):
    x = np.random.default_rng(8).lognormal(0, 3, 50000)
    df = spark.createDataFrame([(1, float(v)) for v in x] + [(2, 5.0)] * 3 + [(3, None), (2, None)], "g int, v double")
    slotted = value_slots(df, ["g"], "v")
    sizes = [r["count"] for r in slotted.filter("g = 1").groupBy("_slot").count().collect()]
    assert sum(sizes) == 50000 and max(sizes) < 500
    spans = sorted((r.lo, r.hi) for r in slotted.filter("g = 1").groupBy("_slot").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # slots follow the values
    assert slotted.filter("g > 1").groupBy("g").agg(F.count("*").alias("n")).collect() and slotted.count() == 50005


def test_slots_are_the_same_for_all_who_read_them(spark):
    """Borders come from approximate quantiles, which differ from run to run when many tasks merge: they are written, not planned twice."""
    rows = spark.range(0, 60000, 1, 40).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 60000).alias("v"), F.lit(1).alias("one"))
    few = spark.range(10).select(F.lit(2).alias("g"), F.col("id").alias("v"), F.lit(1).alias("one"))
    total = running_total(rows.unionByName(few), ["g"], "v", {"n": "one"})
    assert "percentile" not in total._jdf.queryExecution().optimizedPlan().toString()
    assert total.filter("n <> v + 1").count() == 0 and total.count() == 60010
    slots = value_slots(rows.unionByName(few), ["g"], "v").groupBy("g").agg(F.countDistinct("_slot").alias("n")).collect()
    assert {r.g: r.n > 500 for r in slots} == {1: True, 2: False}


def test_one_global_group_plans_no_cross_join(spark, capsys):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 1.5).alias("v"))
    for limit in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            tail_of(df, "v").explain()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        plan = capsys.readouterr().out
        assert "Scan" in plan or "Range" in plan
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_grid_scores_equal_each_trials_own_score(spark):
    rng = np.random.default_rng(9)
    rows = [(g, f"{i:03d}", *map(float, np.round(rng.normal(3 * (i % 2), 0.3, 3), 4))) for g in (1, 2) for i in range(40)]
    points = spark.createDataFrame(rows, "g int, id string, x double, y double, z double")
    scores, labels = dbscan_grid(points, ["g"], ["x", "y", "z"], "id", (0.3, 0.6, 0.7, 5.0), (1, 3, 5))
    want = silhouette_by(labels, ["g", "eps", "min_samples"], ["x", "y", "z"], "label", "pid", weight="w")
    key = ["g", "eps", "min_samples"]
    got, want = ({tuple(r[c] for c in key): r for r in df.collect()} for df in (scores, want))
    assert got.keys() == want.keys() and len(got) == 24
    for k in got:
        assert (got[k].clusters, got[k].points) == (want[k].clusters, want[k].points)
        assert (got[k].score is None) == (want[k].score is None) and (got[k].score is None or got[k].score == pytest.approx(want[k].score, abs=1e-8))


@pytest.mark.parametrize("limit", [2048, 30])
def test_whole_grid_equals_brute_force(spark, limit):
    """All 72 trials of the default grid, by one matrix and (above the limit) by joins."""
    rng = np.random.default_rng(4)
    frames = {}
    for g, n in ((1, 25), (2, 70)):
        xyz = np.concatenate([rng.normal(0, 0.2, (n // 2, 3)), rng.normal(1, 0.4, (n - n // 2, 3)), np.repeat([[0.1, 0.2, 0.3]], 4, axis=0)])
        frames[g] = ([f"{i:03d}" for i in rng.permutation(len(xyz))], np.round(xyz, 4))
    points = spark.createDataFrame([(g, i, *map(float, x)) for g, (ids, xyz) in frames.items() for i, x in zip(ids, xyz)], "g int, id string, x double, y double, z double")
    grid = Grid(points, ["g"], ["x", "y", "z"], "id", limit=limit)
    scores = {(r.g, r.eps, r.min_samples): r for r in grid.scores.collect()}
    labels = {}
    for r in grid.labels().collect():
        labels.setdefault((r.g, r.eps, r.min_samples), {})[r.x, r.y, r.z] = r.label
    assert len(scores) == len(labels) == 144
    for (g, eps, m), r in scores.items():
        ids, xyz = frames[g]
        _, want = brute_dbscan(xyz, ids, eps, m)
        assert [labels[g, eps, m][tuple(x)] for x in xyz] == list(want), (g, eps, m)
        score = brute_silhouette(xyz, want)
        assert r.clusters == len(np.unique(want)) and r.points == len(xyz)
        assert (r.score is None) == (score is None) and (score is None or r.score == pytest.approx(score, abs=1e-9))
    best = best_params(grid.scores, ["g"])
    picked = {r.g: (r.eps, r.min_samples) for r in best.collect()}
    for r in grid.chosen(best.drop("score")).collect():
        assert labels[(r.g, *picked[r.g])][r.x, r.y, r.z] == r.label


def test_components_of_chain_star_and_separate_keys(spark):
    chain = [("x", f"{i:03d}", f"{i + 1:03d}") for i in range(40)]
    star = [("y", "500", f"{i:03d}") for i in range(0, 60, 2)] + [("y", "901", "900")]
    got = connected(spark.createDataFrame(chain + star, "k string, a string, b string"), ["k"], "a", "b").collect()
    roots = {(r.k, r.node): r.root for r in got}
    assert {roots["x", f"{i:03d}"] for i in range(41)} == {"000"}
    assert {v for (k, n), v in roots.items() if k == "y" and n < "900"} == {"000"}
    assert roots["y", "901"] == roots["y", "900"] == "900"


def test_scaling_and_back(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, 5.0), (2, 7.0, 2.0)], "s int, a double, b double")
    out = unscale(scale_by(df, ["a", "b"], ["s"]), ["a", "b"]).orderBy("s", "a").collect()
    assert [(r.z_a, r.z_b) for r in out] == [(-1.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    assert [(r.raw_a, r.raw_b) for r in out] == [(1.0, 5.0), (3.0, 5.0), (7.0, 2.0)]


def test_near_group(spark):
    rows = [(1, float(d)) for d in (1, 2, 3, 30, 31)] + [(2, 4.0), (2, 40.0)] + [(3, 9.0)] * 4
    got = near_group(spark.createDataFrame(rows, "s int, d double"), ["s"], "d").collect()
    assert sorted(map(tuple, got)) == [(1, 1.0), (1, 2.0), (1, 3.0), (2, 4.0), (2, 40.0)] + [(3, 9.0)] * 4


def test_near_threshold_beats_every_other_cut(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.gamma(2, 8, 300), 3)
    got = near_group(spark.createDataFrame([(1, float(v)) for v in x], "s int, d double"), ["s"], "d").count()
    x = np.sort(x)
    costs = [((x[:k] - x[:k].mean()) ** 2).sum() + ((x[k:] - x[k:].mean()) ** 2).sum() for k in range(1, len(x))]
    assert got == int(np.argmin(costs)) + 1


def test_tiers(spark):
    rows = [(1, 1.0, 60), (1, 2.0, 20), (1, 3.0, 15), (1, 4.0, 5)]
    got = tiers(spark.createDataFrame(rows, "s int, d double, n int"), ["s"], "d", "n").orderBy("d").collect()
    assert [r.tier for r in got] == ["primary", "primary", "secondary", "tertiary"]


def test_best_params_ties(spark):
    rows = [(1, 0.2, 5, 0.5), (1, 0.1, 7, 0.5), (1, 0.1, 3, 0.5), (1, 0.3, 1, None), (2, 0.1, 1, None)]
    got = best_params(spark.createDataFrame(rows, "s int, eps double, min_samples int, score double"), ["s"]).collect()
    assert [(r.s, r.eps, r.min_samples) for r in got] == [(1, 0.1, 3)]


SEASON = [0.8, 0.9, 1.0, 1.1, 1.2, 1.0, 0.9, 0.8, 1.0, 1.1, 1.3, 0.9]


def monthly(spark, months=60):
    rows = [(1, 2015 + k // 12, k % 12 + 1, (1000.0 + 5 * k) * SEASON[k % 12]) for k in range(months)]
    rows += [(2, 2015, 1, 7.0)]
    return spark.createDataFrame(rows, "s int, y int, m int, v double").withColumn(
        "month", F.make_date("y", "m", F.lit(1)))


def test_forecast_of_trend_times_season(spark):
    got = forecast_monthly(monthly(spark), ["s"], "month", "v", rounds=4).orderBy("s", "month").collect()
    assert len(got) == 36
    for k, row in enumerate(got[:18], 60):
        assert row.month.isoformat() == f"{2015 + k // 12}-{k % 12 + 1:02d}-01"
        assert row.yhat == pytest.approx((1000 + 5 * k) * SEASON[k % 12], rel=2e-3)
        assert row.lower <= row.yhat <= row.upper
    assert [r.yhat for r in got[18:]] == [7.0] * 18


def test_tail_and_backtest(spark):
    tail = train_tail(monthly(spark), ["s"], "month", "v").collect()
    assert {r.s for r in tail} == {1} and sorted(r.position for r in tail) == list(range(1, 19))
    errors = forecast_backtest(monthly(spark), ["s"], "month", "v", ["2018-01-01", "2018-06-01"], 3).collect()
    assert {(r.s, r.months) for r in errors} == {(1, 3)} and all(r.wape < 3 for r in errors)


def test_encoding_and_correlation(spark):
    a = spark.createDataFrame([("b", 1.0, 2.0, 7), ("a", 2.0, 4.1, 7), ("c", 3.0, 5.9, 7)], "k string, x double, y double, z int")
    vocab = vocabulary("k", a, a.withColumn("k", F.lit("d")))
    assert sorted(map(tuple, vocab.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert {r.k: r.k_cat for r in encode(a, {"k": vocab}).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(Exception, match="unseen k: q"):
        encode(a.withColumn("k", F.lit("q")), {"k": vocab}).collect()
    got = {r.column_name: r.correlation for r in corr_with(a, "y").collect()}
    assert got["x"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1]) and got["z"] is None


@pytest.mark.parametrize("block", [2048, 16])
def test_nearest_within(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(k % 2, k, *map(float, x[k])) for k in range(90)], "g int, row long, a double, b double, c double, d double")
    got = nearest_within(df, ["g"], ["a", "b", "c", "d"], "row", 3, block).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.row, {})[r.nearest] = r.neighbour
    for k in range(90):
        far = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        near = [j for j in np.argsort(far) if j != k and j % 2 == k % 2][:3]
        assert [mine[k][i] for i in (1, 2, 3)] == near


def test_oversampling(spark):
    rows = [(k, float(k % 10), 100.0 + k % 7) for k in range(200)] + [(200 + k, float(k), 400.0 + 10 * k) for k in range(8)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    bumps = {r.bump: r.n for r in tail_of(df, "y").groupBy("bump").agg(F.count("*").alias("n")).collect()}
    assert bumps == {"middle": 172, "high": 36}  # the outermost inner value counts as rare
    out = oversample_tails(df, "y", "id", rates={"high": 3.0, "middle": 0.5}).collect()
    made = [r for r in out if r.origin == "between"]
    shaken = [r for r in out if r.origin == "shaken"]
    kept = [r for r in out if r.origin == "kept"]
    assert len(made) + len(shaken) == 72 and all(106 <= r.y <= 470 and 0 <= r.x <= 9 for r in made)
    assert sum(r.y >= 106 for r in kept) == 36 and 50 < len(kept) - 36 < 120
    again = oversample_tails(df.repartition(7), "y", "id", rates={"high": 3.0, "middle": 0.5}).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_oversampling_shakes_rows_with_far_neighbours(spark):
    """A tail row far from all others is not mixed with them: its copies stay beside it."""
    rows = [(k, float(k % 10), 100.0 + k % 7) for k in range(200)] + [(200 + k, 0.1 * k, 400.0 + k) for k in range(9)] + [(300, 5000.0, 405.0)]
    out = oversample_tails(spark.createDataFrame(rows, "id long, x double, y double"), "y", "id", rates={"high": 6.0, "middle": 1.0}).collect()
    lone = [r for r in out if r.id == 300]
    assert [r.origin for r in lone].count("shaken") == 5 and [r.origin for r in lone].count("kept") == 1
    # a fiftieth of the tail's deviation, times a normal draw
    assert all(abs(r.x - 5000) < 0.02 * 1500 * 5 for r in lone) and len({r.x for r in lone}) == 6
    assert sum(r.origin == "kept" for r in out) == 210 and any(r.origin == "between" for r in out)


def test_nearest_within_when_groups_are_small_equal_or_lone(spark):
    rows = [("a", 1, 0.0, 0.0)] + [("b", 10 + i, 5.0, 5.0) for i in range(5)] + [("c", 20, 0.0, 0.0), ("c", 21, 1e6, -1e6)]
    rows += [("d", 100 + i, float(i % 40), float(i // 40) ** 3) for i in range(1600)]
    got = {}
    for r in nearest_within(spark.createDataFrame(rows, "g string, id long, x double, y double"), ["g"], ["x", "y"], "id", 3, 4).collect():
        got.setdefault(r.row, []).append((r.nearest, r.neighbour, r.distance))
    assert 1 not in got and sorted(got[20]) == [(1, 21, pytest.approx(2 ** 0.5 * 1e6))]
    assert [n for _, n, _ in sorted(got[10])] == [11, 12, 13] and [n for _, n, _ in sorted(got[14])] == [10, 11, 12]
    at = {k: np.array([x, y]) for g, k, x, y in rows if g == "d"}
    keys, places = np.array(list(at)), np.array(list(at.values()))
    for k in list(at)[::37]:
        far = np.sqrt(((places - at[k]) ** 2).sum(1))
        far[keys == k] = np.inf
        assert [n for _, n, _ in sorted(got[k])] == keys[np.lexsort((keys, far))[:3]].tolist()


def test_oversampling_names_a_null(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 7 else float(i * i)) for i in range(40)], "id long, x double, y double")
    with pytest.raises(Exception, match="y is NULL"):
        oversample_tails(df, "y", "id", coef=0.1).count()


def test_fourier_forecast_equals_numpy(spark):
    """Regularised least squares of the logarithm on bends and waves, series by series; a year's pattern is found again."""
    import datetime
    rng = np.random.default_rng(5)
    rows, months = [], [datetime.date(2015 + m // 12, m % 12 + 1, 1) for m in range(60)]
    for store in (1, 2, 3):
        for m, day in enumerate(months[:60 if store < 3 else 1]):
            level = 1000 * (1 + 0.01 * m) * (1 + 0.3 * np.sin(2 * np.pi * (m % 12 + 1) / 12)) * store
            rows.append((store, day, float(level * np.exp(rng.normal(0, 0.01)))))
    rows.append((2, datetime.date(2014, 1, 1), -5.0))
    got = {}
    for r in forecast_fourier(spark.createDataFrame(rows, "store int, month date, y double"), ["store"], "month", "y", periods=12).collect():
        got.setdefault(r.store, []).append((r.position, r.month, r.yhat, r.lower, r.upper))

    def design(t, month):
        cols = [np.ones_like(t), t, *[np.maximum(t - (j + 1) / 5, 0) for j in range(4)]]
        for k in (1, 2, 3):
            cols += [np.sin(2 * np.pi / 12 * month * k), np.cos(2 * np.pi / 12 * month * k)]
        return np.stack(cols, 1)

    pull = np.diag([0, 0, .5, .5, .5, .5, *[.05] * 6]) + 1e-9 * np.eye(12)
    for store in (1, 2):
        own = [(d, y) for s, d, y in rows if s == store and y > 0]
        t, month = np.arange(60) / 59, np.array([d.month for d, _ in own])
        x, ly = design(t, month), np.log([y for _, y in own])
        beta = np.linalg.solve(x.T @ x + pull, x.T @ ly)
        spread = np.sqrt(((ly - x @ beta) ** 2).mean())
        ahead = design(np.arange(60, 72) / 59, np.arange(12) % 12 + 1) @ beta
        mine = sorted(got[store])
        assert [p for p, *_ in mine] == list(range(1, 13)) and mine[0][1] == datetime.date(2020, 1, 1)
        assert np.allclose([y for _, _, y, _, _ in mine], np.exp(ahead), rtol=1e-6)
        assert np.allclose([lo for *_, lo, _ in mine], np.exp(ahead - 1.2816 * spread), rtol=1e-6)
        truth = [1000 * (1 + 0.01 * m) * (1 + 0.3 * np.sin(2 * np.pi * (m % 12 + 1) / 12)) * store for m in range(60, 72)]
        assert np.abs(np.exp(ahead) / truth - 1).max() < 0.12
    assert len(got[3]) == 12 and all(np.isfinite(y) for _, _, y, _, _ in got[3])


def test_nearest_mixed_equals_brute_force(spark):
    """Lone categories, ties, a constant number, NULL categories and fewer rows than neighbours."""
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 50)), 7.0, ["a", "b", None][int(rng.integers(0, 3))], "xy"[int(rng.integers(0, 2))]) for i in range(60)]
    rows += [(100, 3.0, 7.0, "lone", "z"), (101, 3.0, 7.0, "a", "x"), (102, 3.0, 7.0, "a", "x")]
    df = spark.createDataFrame(rows, "id long, n double, same double, c string, d string")
    got = {}
    for r in nearest_mixed(df, "id", ["n", "same"], ["c", "d"], 4).collect():
        got.setdefault(r.id, []).append((r.nearest, r.neighbour, r.distance))
    span = max(r[1] for r in rows) - min(r[1] for r in rows)
    for a in rows:
        want = sorted((round((abs(a[1] - b[1]) / span + (a[3] != b[3]) + (a[4] != b[4])) / 4, 12), b[0]) for b in rows if b[0] != a[0])[:4]
        assert [(n, d) for _, n, d in sorted(got[a[0]])] == [(n, pytest.approx(d)) for d, n in want], a
    few = nearest_mixed(df.limit(2), "id", ["n"], ["c"], 4).collect()
    assert len(few) == 2
    with pytest.raises(Exception, match="n is NULL"):
        nearest_mixed(df.withColumn("n", F.lit(None).cast("double")), "id", ["n"], ["c"], 2).collect()


def test_equal_labellings_of_a_group_are_scored_once():
    """Many trials of a grid give the same clusters; their score needs one product."""
    widths = []

    class Counted(np.ndarray):
        def __matmul__(self, member):
            widths.append(member.shape[1])
            return np.asarray(self) @ member

    rng = np.random.default_rng(5)
    xyz = rng.standard_normal((40, 3))
    far = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    one, two = rng.integers(0, 2, 40), rng.integers(-1, 3, 40)
    scores, clusters = silhouettes(far.view(Counted), np.ones(40), np.stack([one, two, one, np.zeros(40, int), one, two]))
    assert sum(widths) == 2 + 4 and list(clusters) == [2, 4, 2, 1, 2, 4]
    want = [brute_silhouette(xyz, one), brute_silhouette(xyz, two)]
    assert scores[[0, 1, 2, 4, 5]] == pytest.approx([want[0], want[1], want[0], want[0], want[1]], abs=1e-9) and np.isnan(scores[3])


def test_nearest_within_makes_no_rows_of_pairs(spark, monkeypatch):
    """All rows but one lie close together: cells over the whole range put them into one, where each met each."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    x[0] = 1e9
    x[1:400] = x[1]
    df = spark.createDataFrame([("g", i, *map(float, r)) for i, r in enumerate(x)], "g string, row long, a double, b double, c double, d double")
    steps = {}

    def noted(step, name):
        steps[name] = cut(step, name)
        return steps[name]

    monkeypatch.setattr(sampling, "cut", noted)
    got = nearest_within(df, ["g"], ["a", "b", "c", "d"], "row", 3, 64).collect()
    assert "sent" in steps and steps["sent"].count() < 15 * len(x)
    assert steps["blocks"].groupBy("_block").count().agg(F.max("count")).first()[0] <= 64
    want = set()
    for i in range(len(x)):
        far = np.zeros(len(x))
        for d in range(4):
            far += (x[i, d] - x[:, d]) ** 2
        order = [j for j in np.lexsort((np.arange(len(x)), np.sqrt(far))) if j != i][:3]
        want |= {(i, int(j), n + 1) for n, j in enumerate(order)}
    assert {(r.row, r.neighbour, r.nearest) for r in got} == want and len(got) == len(want)


def test_nearest_within_with_repeated_rows(spark):
    rows = [("g", 1, 0.0), ("g", 1, 0.0), ("g", 2, 1.0), ("g", 2, 5.0), ("g", 3, 2.0)]
    got = nearest_within(spark.createDataFrame(rows, "g string, row long, a double"), ["g"], ["a"], "row", 3).collect()
    assert sorted((r.row, r.nearest, r.neighbour, r.distance) for r in got) == [
        (1, 1, 2, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 2.0), (2, 1, 1, 1.0), (2, 2, 1, 1.0), (2, 3, 3, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 2.0), (3, 3, 1, 2.0)]


def test_search_writes_scores_and_the_labels_of_best_trials_only(spark, monkeypatch):
    """A label per place and trial is 72 numbers a place; only the trials that may be best go on, also if several are equal."""
    from tradearea.operators import search

    rng = np.random.default_rng(12)
    points = spark.createDataFrame([(g, f"{i:03d}", *map(float, rng.normal(i % 3, 0.1, 3))) for g in (1, 2) for i in range(60)] + [(3, "a", 0.0, 0.0, 0.0)],
                                   "g int, id string, x double, y double, z double")
    steps = {}
    monkeypatch.setattr(search, "cut", lambda df, name="step": steps.setdefault(name, cut(df, name)))
    grid = Grid(points, ["g"], ["x", "y", "z"], "id")
    written = steps["grid"]
    assert written.filter("labels is not null and size(labels) < 72").count() == 121 and written.filter("labels is null").count() == 3
    best = best_params(grid.scores, ["g"])
    want = grid.labels().join(best, ["g", "eps", "min_samples"]).select("g", "x", "y", "z", "label")
    got = grid.chosen(best.drop("score"))
    assert got.count() == 120 and sorted(got.collect()) == sorted(want.collect())
    monkeypatch.setattr(search, "GROUPS", 1)
    assert search.Grid(points, ["g"], ["x", "y", "z"], "id").done.rdd.getNumPartitions() >= 1


def test_scores_of_small_groups_from_one_matrix(spark):
    """Groups on both sides of the limit against the blocks: repeated rows, one label, a label a row, lone rows, weights."""
    rng = np.random.default_rng(21)
    rows = [(g, f"{i}", *map(float, rng.normal(size=2)), int(rng.integers(-1, 3)), float(rng.integers(1, 4))) for g, n in ((1, 40), (2, 90)) for i in range(n)]
    rows += [(3, "a", 0.0, 0.0, 1, 1.0), (3, "b", 1.0, 0.0, 1, 1.0), (4, "a", 0.0, 0.0, 0, 1.0), (4, "b", 1.0, 0.0, 1, 1.0)]
    rows += [(5, f"{i}", 1.0, 1.0, i % 2, 1.0) for i in range(4)] + [(6, "a", 0.0, 0.0, 7, 1.0), (6, "b", 1.0, 0.0, 2, 1.0), (6, "c", 1.0, 3.0, 2, 1.0)]
    df = cut(spark.createDataFrame(rows, "g int, id string, x double, y double, label int, w double"), "rows")
    for weight in (None, "w"):
        want = {r.g: r for r in silhouette_by(df, ["g"], ["x", "y"], "label", "id", weight).collect()}
        made = silhouette_by(df, ["g"], ["x", "y"], "label", "id", weight, limit=60)
        got = {r.g: r for r in made.collect()}
        assert made.columns == ["g", "score", "clusters", "points"] and set(got) == set(want) == {1, 2, 3, 4, 5, 6}
        for g, r in want.items():
            assert (got[g].clusters, got[g].points) == (r.clusters, r.points), g
            assert got[g].score == (None if r.score is None else pytest.approx(r.score, abs=1e-12)), g
