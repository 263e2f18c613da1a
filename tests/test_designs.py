"""Designs against brute force and in their defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import designs as D
from gaugeline.operators import windows
from gaugeline.functions import exprs as E


def test_t_quantiles():
    assert D.t_quantile(0.95, 2) == pytest.approx(2.919985580, abs=1e-6)
    assert D.t_quantile(0.80, 2) == pytest.approx(1.060660172, abs=1e-6)
    assert D.t_quantile(0.95, 10) == pytest.approx(1.812461, abs=1e-5)


def test_tiles_and_midranks_of_ranges(spark):
    vals = [None, None] + [1.0] * 50 + [float(i % 37) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(vals)), "id int, x double").repartition(5)
    order = sorted(range(len(vals)), key=lambda i: (vals[i] is not None, vals[i] or 0.0, i))
    want = {i: t for t, part in enumerate(np.array_split(order, 7)) for i in part}
    assert {r["id"]: r["tile"] for r in windows.tiles(df, 7, ["x", "id"]).collect()} == want
    known = [v for v in vals if v is not None]
    got = windows.midranked(df.where("x is not null"), "x", "r").collect()
    assert len(got) == len(known)
    for r in got:
        assert r["r"] == sum(v < r["x"] for v in known) + (known.count(r["x"]) + 1) / 2
    assert windows.tiles(df.limit(0), 3, ["x", "id"]).count() == 0
    assert sorted(r["tile"] for r in windows.tiles(df.limit(2), 5, ["x", "id"]).collect()) == [0, 1]


def test_gated_draw_walk(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((60, 2)))]
    df = spark.createDataFrame(pts, "id int, a double, b double")
    got = [r["id"] for r in D.gated_draw(df, "id", ["a", "b"], ["a", "b"], 20, 0.05, 3).orderBy("pick").collect()]
    first = [r["id"] for r in df.orderBy(E.shuffle_key(3, "id"), "id").collect()]
    x = np.array([pts[i][1:] for i in first])
    z = (x - x.mean(0)) / x.std(0)
    seen, kept = [0], [0]
    while len(kept) < 20:
        i = max((j for j in range(60) if j not in seen), key=lambda j: min(((z[j] - z[s]) ** 2).sum() for s in seen))
        seen.append(i)
        if all(math.dist(x[i], x[k]) > 0.05 for k in kept):
            kept.append(i)
    assert got == [first[i] for i in kept]
    with pytest.raises(Exception, match="novelty gate"):
        D.gated_draw(df, "id", ["a", "b"], ["a", "b"], 20, 5.0, 3).collect()


def test_canonical_check_raises(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    assert D.assert_canonical(df.where("s is not null"), "s", ["a"]).first()["n"] == 1
    with pytest.raises(Exception, match="not canonical"):
        D.assert_canonical(df, "s", ["a"]).collect()


def test_distributed_against_loop(spark):
    rows = [(g, k, n) for g, ns in enumerate([[3, 0, 7, 7, 1], [5, 5, 5], [0, 0]]) for k, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "g int, k int, n int")
    for want in (0, 1, 4, 11, 100):
        got = {(r["g"], r["k"]): r["given"] for r in D.distributed(df, "k", "n", F.lit(want), ["g"]).collect()}
        for g in range(3):
            part = [(k, n) for a, k, n in rows if a == g]
            total = sum(n for _, n in part)
            target = min(want, total)
            given = {k: target * n // total if total else 0 for k, n in part}
            while sum(given.values()) < target:
                best = max((k for k, n in part if given[k] < n), key=lambda k: (target * dict(part)[k] - given[k] * total, -k))
                given[best] += 1
            assert {k: got[g, k] for k, _ in part} == given


def test_signal_has_its_correlation(spark):
    df = spark.createDataFrame([(i, float(i * i % 17)) for i in range(30)], "k int, v double")
    r = D.correlated_vector(df, "k", "v", -0.4, 9).agg(F.corr("v", "signal").alias("c"), F.avg("signal").alias("m"), F.stddev_pop("signal").alias("s")).first()
    assert (r["c"], r["m"], r["s"]) == (pytest.approx(-0.4), pytest.approx(0, abs=1e-9), pytest.approx(1))


def test_reference_blocks(spark):
    x = np.random.default_rng(2).random((50, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got = {r["id"]: r["distance"] for r in D.reference_distance(df, df.where("id % 3 = 0"), "id", "v", block=4).collect()}
    for i in range(50):
        assert got[i] == pytest.approx(min(math.dist(x[i], x[j]) for j in range(0, 50, 3)))
    assert D.reference_distance(df, df.limit(0), "id", "v").where("distance is null").count() == 50


def test_costs_add_up(spark):
    assert spark.range(1).select(E.cost_in_steps(F.lit(10), F.lit(6)).alias("c")).first()["c"] == 12


def test_blocks_and_rounds_equal_one_task(spark):
    from gaugeline.operators import vectors

    x = np.random.default_rng(4).normal(size=(80, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)
    pick = lambda most: [r["id"] for r in vectors.farthest_points(df, "id", "v", 12, most).orderBy("pick").collect()]
    assert pick(100) == pick(10)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, v array<double>")
    assert [r["id"] for r in vectors.farthest_points(same, "id", "v", 3, 5).collect()] == [0]
    score = lambda block: {r["id"]: r["score"] for r in vectors.top_k_score(df, df.where("id % 2 = 0"), "id", "v", 5, block).collect()}
    assert score(7) == pytest.approx(score(1000), abs=2e-6)
