from pyspark.sql import functions as F

from checks.projections import STORES_A_TASK, Tables
from tradearea.operators.models import similar_by_clusters


def test_distances_are_made_in_as_many_tasks_as_stores_ask_for(spark, tmp_path):
    """The stores' file is one small piece; their tracts are not made in one task, and the stores go to no broadcast."""
    n = STORES_A_TASK * 3 + 1
    spark.range(n).coalesce(1).selectExpr("id as s_suppkey", "cast(id % 3 as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(3).selectExpr("cast(id as int) as n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(60).selectExpr("id as c_custkey", "cast(id % 3 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    made = Tables(spark, str(tmp_path)).distance()
    assert made.count() == sum((c + s) % 7 != 0 for c in range(3) for s in range(n)) * 20
    parts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 4 and max(parts) < 0.5 * sum(parts)


def test_measures_of_store_groups_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(k, float(k % 4), float(k % 5)) for k in range(40)], "store_nbr long, a double, b double")
    found = similar_by_clusters(rows.withColumn("a", F.udf(look, "double")("a")), ["a", "b"], 2)
    assert found.count() == 40 and {r.store_group for r in found.collect()} == {0, 1}
    assert seen.value == 40
