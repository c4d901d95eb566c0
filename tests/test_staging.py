import os

from pyspark.sql import functions as F

from codicil.functions.relational import join_hot, small_side, stage, work_dir


def test_staged_tables_lie_in_the_named_folder(spark):
    root = work_dir(spark)
    assert root == spark.conf.get("spark.checkpoint.dir")
    df = stage(spark.range(10).withColumn("k", F.col("id") % 2), "numbers", by="k")
    assert {r.k for r in df.collect()} == {0, 1} and df.count() == 10
    assert any(n.startswith("numbers-") for n in os.listdir(root))
    assert "numbers-" in df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_within_the_bound(spark):
    df = spark.range(10)
    assert small_side(df, 9) is df
    assert small_side(df, 10) is not df


def test_hot_key_join_is_exact_both_ways(spark, monkeypatch):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    small = spark.createDataFrame([(i, i * 10) for i in range(5)], "k bigint, v int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=repr)
        assert sorted(map(tuple, join_hot(big, small, ["k"], "id", how).collect()), key=repr) == want
        with monkeypatch.context() as m:
            m.setattr(small_side, "__defaults__", (1,))
            salted = join_hot(big, small, ["k"], "id", how)
            assert sorted(map(tuple, salted.collect()), key=repr) == want
