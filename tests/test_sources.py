import pytest
from pyspark.sql import functions as F

from tradearea import schemas as T
from tradearea.plans import areas as areas_plan
from tradearea.sources import readers, writers
from tradearea.sources.scratch import cut, shared_dir


def test_cohort_round_trip(spark, tmp_path):
    codes = ["6", "61", "40200"]
    base = spark.createDataFrame([(1, *codes)], "store_nbr long, fips_state_cd string, fips_county_cd string, census_block_cd string")
    base.withColumn("instore_transaction_count", F.lit(4).cast("long")).write.parquet(f"{tmp_path}/tx")
    base.withColumn("distance", F.lit(3.5)).write.parquet(f"{tmp_path}/dist")
    base.withColumnRenamed("store_nbr", "PICKUP_STORE").withColumn("CUSTOMER_ID", F.lit(2).cast("long")).write.parquet(f"{tmp_path}/bopis")
    paths = {n: f"{tmp_path}/{d}" for n, d in (("transactions", "tx"), ("distance", "dist"), ("bopis", "bopis"))}
    cohort = readers.load_cohort(spark, paths)
    assert cohort["bopis"].columns == ["store_nbr", *T.CODES, "bopis_customers"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.load_cohort(spark, {**paths, "distance": f"{tmp_path}/none"})
    with pytest.raises(ValueError, match="lacks"):
        readers.load_cohort(spark, {"distance": paths["distance"]})


def test_csv_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("store_number,yearss,months,f0_\n1,2019,3,10.5\n")
    assert tuple(readers.load_monthly_sales(spark, f"{tmp_path}/s.csv").first()) == (1, 2019, 3, 10.5)
    (tmp_path / "p.csv").write_text("Store_Number,Phase_1_eps_val,Phase_1_minsam,Phase_1_best_score\n7,0.3,5,0.67\n")
    assert tuple(readers.load_params(spark, f"{tmp_path}/p.csv").first()) == (7, 0.3, 5, 0.67)
    (tmp_path / "c.csv").write_text("STORE_NBR,Kol_2.5_mi,Wal 10 mi\n7,1,2\n")
    assert readers.load_competitors(spark, f"{tmp_path}/c.csv").columns == ["store_nbr", "kol_2_5_mi", "wal_10_mi"]
    (tmp_path / "g.csv").write_text("store_nbr,region,store_group\n7,EAST,\n")
    assert tuple(readers.load_similarity(spark, f"{tmp_path}/g.csv").first()) == (7, "EAST", "UNKNOWN")


def test_sinks(spark, tmp_path):
    areas = spark.createDataFrame([(1, "06061040200"), (2, "06061040300")], "store_nbr long, geoid string")
    writers.write_areas(areas, f"{tmp_path}/areas", "first")
    for _ in range(2):  # a rerun replaces, it does not double
        writers.write_areas(areas.filter("store_nbr = 1"), f"{tmp_path}/areas", "closed")
    back = spark.read.parquet(f"{tmp_path}/areas")
    assert sorted((r.brand, r.store_nbr) for r in back.collect()) == [("closed", 1), ("first", 1), ("first", 2)]
    writers.write_forecasts(areas, f"{tmp_path}/fc", "open")
    writers.write_params(areas, f"{tmp_path}/params")
    writers.write_result(areas, f"{tmp_path}/report", "csv")
    assert spark.read.csv(f"{tmp_path}/report", header=True).count() == 2


def test_written_steps_use_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = cut(spark.range(5).withColumn("x", F.lit("a")))
    assert df.count() == 5 and df.inputFiles()[0].split("://")[-1].replace("file:", "").startswith(shared_dir(spark))


def test_params_by_name_and_checked(spark, tmp_path):
    (tmp_path / "p.csv").write_text("phase_1_best_score,phase_1_minsam,phase_1_eps_val,store_number\n0.67,5,0.3,7\n0.5,4,,8\n")
    rows = readers.load_params(spark, f"{tmp_path}/p.csv")
    assert sorted(map(tuple, rows.collect())) == [(7, 0.3, 5, 0.67), (8, None, 4, 0.5)]
    stores = spark.createDataFrame([(7,), (8,), (9,)], "store_nbr long")
    assert sorted(r.store_nbr for r in areas_plan.stores_without_params(stores, rows).collect()) == [8, 9]
    head = "store_number,phase_1_eps_val,phase_1_minsam,phase_1_best_score\n"
    for name, text in (("bad", head + "7,x,5,0.6\n"), ("twice", head + "7,0.3,5,0.6\n7,0.4,5,0.6\n"), ("lacking", "store_number\n7\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(ValueError):
            readers.load_params(spark, f"{tmp_path}/{name}.csv")


def test_package_archive(tmp_path):
    import zipfile

    from tradearea.sources.shipping import package_zip
    names = zipfile.ZipFile(package_zip(f"{tmp_path}/p.zip")).namelist()
    assert "tradearea/schemas.py" in names and "tradearea/operators/tiles.py" in names and "tradearea/__init__.py" in names


def test_written_steps_go_at_the_end(spark, tmp_path, monkeypatch):
    from tradearea.sources import scratch
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    assert scratch.cut(spark.range(5)).count() == 5 and list(tmp_path.glob("*/step-*"))
    scratch.clear(spark)
    assert not list(tmp_path.iterdir())


def test_a_cluster_needs_the_shared_folder():
    from tradearea.sources import scratch

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: "local-cluster[3,2,3000]" if name == "spark.master" else default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_types_are_widened_but_never_cut(spark, tmp_path):
    base = spark.createDataFrame([(1, 6, 61, 40200)], "store_nbr int, fips_state_cd int, fips_county_cd long, census_block_cd int")
    got = T.require_columns(base.withColumn("distance", F.lit(1.5).cast("float")), T.DISTANCE)
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in T.DISTANCE.fields] and tuple(got.first()) == (1, "06", "061", "040200", 1.5)
    with pytest.raises(Exception, match="more than 2 digits"):
        T.require_columns(base.withColumn("fips_state_cd", F.lit(123)).withColumn("distance", F.lit(1.0)), T.DISTANCE).collect()
    for kind, schema in (("bigint", T.CLOSURE_FACTOR), ("string", T.CLOSURE_FACTOR), ("decimal(20,2)", T.CLOSURE_FACTOR)):
        with pytest.raises(ValueError, match="closure_factor"):
            T.require_columns(spark.createDataFrame([(1,)], "store_nbr long").withColumn("closure_factor", F.lit("1").cast(kind)), schema)
    spark.createDataFrame([(5, -0.25)], "Store_Number int, Halo_Factor double").write.parquet(f"{tmp_path}/f")
    assert tuple(readers.load_factors(spark, f"{tmp_path}/f").first()) == (5, -0.25)


def test_competitors_are_declared(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("STORE_NBR,Kol_2.5_mi,Wal 10 mi\n7,1,\n")
    got = readers.load_competitors(spark, f"{tmp_path}/ok.csv")
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "int", "int"] and tuple(got.first()) == (7, 1, None)
    (tmp_path / "bad.csv").write_text("store_nbr,wal_10_mi\n7,many\n")
    with pytest.raises(Exception, match="no whole number"):
        readers.load_competitors(spark, f"{tmp_path}/bad.csv").collect()
    (tmp_path / "odd.csv").write_text("store_nbr,shop\n7,1\n")
    with pytest.raises(ValueError, match="unknown"):
        readers.load_competitors(spark, f"{tmp_path}/odd.csv")


def test_runs_have_a_life(spark, tmp_path):
    at = f"{tmp_path}/result"
    with pytest.raises(FileNotFoundError):
        writers.read_run(spark, at)
    for n in ("1", "2", "3"):
        writers.write_run(spark.range(int(n)), at, n)
    (tmp_path / "result" / "run=4").mkdir()  # a run that broke off has no mark
    (tmp_path / "result" / "run=0").mkdir()
    assert writers.read_run(spark, at).count() == 3 and writers.read_run(spark, at, "1").count() == 1
    with pytest.raises(FileNotFoundError):
        writers.read_run(spark, at, "4")
    with pytest.raises(Exception, match="exists"):
        writers.write_run(spark.range(1), at, "3")
    assert writers.drop_runs(spark, at, 2) == ["run=0", "run=1"]
    assert writers.read_run(spark, at, "2").count() == 2
    assert writers.write_run(spark.range(9), at) > "2" and writers.read_run(spark, at).count() in (3, 9)


def test_params_written_by_the_search_are_read_by_the_fixed_job(spark, tmp_path):
    params = spark.createDataFrame([(7, 0.3, 5, 0.67, "ok"), (8, None, None, None, "no_valid_params")],
                                   "store_nbr long, phase_1_eps_val double, phase_1_minsam int, phase_1_best_score double, status string")
    writers.write_params(params, f"{tmp_path}/params")
    assert [tuple(r) for r in areas_plan.trials_from(readers.load_params(spark, f"{tmp_path}/params")).collect()] == [(7, 0.3, 5)]
    twice = spark.createDataFrame([(7, 0.3, 5), (7, 0.4, 5)], "store_number long, phase_1_eps_val double, phase_1_minsam int")
    with pytest.raises(Exception, match="several parameter rows for store 7"):
        areas_plan.trials_from(twice).collect()


def test_a_job_clears_its_steps(spark, tmp_path, monkeypatch):
    from tradearea.sources import scratch
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    with pytest.raises(ValueError), scratch.job(spark):
        scratch.cut(spark.range(5))
        assert list(tmp_path.iterdir())
        raise ValueError
    assert not list(tmp_path.iterdir())


def test_areas_go_to_a_bounded_number_of_folders(spark, tmp_path):
    at = f"{tmp_path}/areas"
    areas = spark.range(300).select(F.col("id").alias("store_nbr"), F.lit("a").alias("geoid")).unionByName(
        spark.createDataFrame([(None, "a")], "store_nbr long, geoid string"))
    writers.write_areas(areas, at, "open")
    writers.write_areas(areas.filter("store_nbr < 5"), at, "closed")
    # stores 7 and 8 and the one without number again, with other tracts; all others stay
    again = spark.createDataFrame([(7, "b"), (7, "c"), (8, "b"), (None, "b"), (900, "b")], "store_nbr int, geoid string")
    writers.write_areas(again, at, "open")
    back = spark.read.parquet(at)
    got = sorted((r.store_nbr if r.store_nbr is not None else -1, r.geoid) for r in back.filter("brand = 'open'").collect())
    assert got == sorted([(i, "a") for i in range(300) if i not in (7, 8)] + [(7, "b"), (7, "c"), (8, "b"), (-1, "b"), (900, "b")])
    assert back.filter("brand = 'closed'").count() == 5
    assert len(list((tmp_path / "areas" / "brand=open").iterdir())) <= writers.AREA_PARTS
