"""Operators against hand-made frames."""

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import alloc, joins, models, rates, stats, vectors, windows


def test_rates_of_six_records(spark):
    df = spark.createDataFrame([(True, "apple"), (True, "apple"), (True, "apple"), (False, "peach"), (False, "peach"), (False, "peach")], "ok boolean, what string")
    rows = rates.rate_block(df, ["what"], "ok").orderBy("rate").collect()
    assert [(r["what"], r["rate"]) for r in rows] == [("peach", 0.0), ("apple", 1.0)]
    buckets = rates.summary(df, ["what"], "ok")
    assert buckets.where("dimension = 'overall'").first()["k"] == 3 and rates.weakest(buckets, 1, 1).first()["rate"] == 0


def test_shrinkage_and_nested_mean(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("b", 0), ("b", 1)], "k string, y int")
    got = {r["k"]: r["encoded"] for r in rates.shrunken_rate(df, "k", "y", 8.0).collect()}
    assert got["a"] == pytest.approx((8 * 0.5 + 1) / 9, abs=1e-6)
    assert rates.nested_mean(df, [], ["k"], "y").first()["mean"] == pytest.approx((1 + 1 / 3) / 2, abs=1e-6)


def test_exactly_once(spark):
    want, have = spark.createDataFrame([(1,), (2,), (3,)], "id int"), spark.createDataFrame([(1,), (2,), (2,), (9,)], "id int")
    assert {(r["id"], r["problem"]) for r in rates.exactly_once(want, have, ["id"]).collect()} == {(2, "doubled"), (3, "missing"), (9, "unexpected")}


@pytest.mark.parametrize(("x", "kept"), [(0.05, False), (0.2, True), (0.1, True)])
def test_epsilon_gate(spark, x, kept):
    used = spark.createDataFrame([("a", 0.0, 0.0)], "c string, x double, y double")
    pool = spark.createDataFrame([("a", x, 0.0), ("b", x, 0.0)], "c string, x double, y double")
    assert joins.epsilon_gate(pool, used, "c", "x", "y", 0.1).where("c = 'a'").count() == int(kept)
    assert joins.epsilon_gate(pool, used, "c", "x", "y", 0.1).where("c = 'b'").count() == 1


def pulls(spark, **arms):
    return spark.createDataFrame([(a, j, d) for a, ds in arms.items() for j, d in enumerate(ds, 1)], "arm string, round_j int, delta double")


def test_elimination(spark):
    far = alloc.elimination(pulls(spark, hi=(0.5, 0.51, 0.49), mid=(0.2, 0.21, 0.19), lo=(0.0, 0.01, -0.01)), "arm", "round_j", "delta", 1.64, 0.0333)
    assert [r["arm"] for r in far.where("survives").collect()] == ["hi"]
    same = alloc.elimination(pulls(spark, a=(0.1,) * 3, b=(0.1,) * 3, c=(0.1,) * 3), "arm", "round_j", "delta", 1.64, 0.0333)
    assert same.where("survives").count() == 3
    guard = alloc.elimination(pulls(spark, a=(0.05, 0.15, 0.25), b=(0.15,) * 3), "arm", "round_j", "delta", 1.64, 0.0333)
    assert guard.where("survives and arm = 'a'").count() == 1


def test_allocation(spark):
    df = spark.createDataFrame([("a", 5.0, 10.0), ("b", 3.0, 100.0), ("c", 2.0, 100.0)], "n string, s double, cap double")
    got = {r["n"]: r["alloc"] for r in alloc.water_fill(df, "s", "cap", 60.0).collect()}
    assert got == pytest.approx({"a": 10, "b": 30, "c": 20})
    assert sorted(r["alloc"] for r in alloc.largest_remainder(df, "s", 7, "n").collect()) == [1, 2, 4]
    assert alloc.proportional(df, "s", 10.0).agg(F.sum("alloc")).first()[0] == pytest.approx(10)


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)], "s double, y int")
    assert stats.auc(df, "s", "y").first()["auc"] == pytest.approx(0.875)
    assert [r["r"] for r in df.select(windows.midrank("s").alias("r")).orderBy("r").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_tiles_and_picks(spark):
    df = spark.range(300)
    t = windows.tiles(df, 3, ["id"]).groupBy("tile").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("tile").collect()
    assert [(r["n"], r["a"], r["b"]) for r in t] == [(100, 0, 99), (100, 100, 199), (100, 200, 299)]
    picks = [r["id"] for r in windows.even_picks(df.withColumn("g", F.lit(1)), 50, ["g"], ["id"]).orderBy("id").collect()]
    assert len(picks) == 50 and picks[0] == 0 and picks[-1] == 299


def test_islands(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([1, 1, 0, 1, 1, 1])], "k int, i int, c int")
    assert {(r["start"], r["length"]) for r in windows.islands(df, "k", ["i"], F.col("c") == 1).collect()} == {(0, 2), (3, 3)}


def test_shuffles_repeat_and_folds_keep_groups(spark):
    df = spark.range(60).select("id", (F.col("id") % 5).alias("g"), (F.col("id") % 2).cast("int").alias("f"), (F.col("id") * 1.0).alias("y"))
    a, b = (stats.permutation_test(d, "id", "g", "f", "y", 20).first() for d in (df, df.repartition(7)))
    assert a == b
    assert models.group_folds(df, "g", 3).groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "id long, v array<double>")
    assert vectors.mean_pairwise_dot(df, "v").first()["coherence"] == pytest.approx(0, abs=1e-6)
    assert vectors.farthest_points(df, "id", "v", 3).count() == 3
    white = vectors.whiten(df.union(spark.createDataFrame([(9, [9.0, 0.0, 0.0, 0.0])], "id long, v array<double>")), "id", "v", 1)
    assert white.where("id = 9").first()["white"] == pytest.approx([0, 0, 0, 0], abs=1e-9)
