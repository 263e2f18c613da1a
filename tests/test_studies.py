"""Studies against brute force, and their defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import studies as S


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"g{i % 9}", float(a), float(b), float(3 * a - b + 0.5 * e)) for i, (a, b, e) in enumerate(rng.normal(size=(300, 3)))]
    return spark.createDataFrame([*rows, (900, "g1", None, 1.0, 1.0), (901, None, 1.0, 1.0, 1.0)], "id long, g string, a double, b double, y double"), rows


def test_leave_group_out(made):
    df, rows = made
    got = {r["g"]: r for r in S.leave_group_out(df, "a", "y", "g").collect()}
    assert len(got) == 9
    for g, r in got.items():
        out, own = np.array([(x[2], x[4]) for x in rows if x[1] != g]), np.array([(x[2], x[4]) for x in rows if x[1] == g])
        b, a = np.polyfit(out[:, 0], out[:, 1], 1)
        assert r["slope"] == pytest.approx(b)
        assert r["rmse"] == pytest.approx(np.sqrt(((own[:, 1] - a - b * own[:, 0]) ** 2).mean()))
    assert S.leave_group_out(df.limit(0), "a", "y", "g").count() == 0
    assert [r["slope"] for r in S.leave_group_out(df.where("g = 'g2'"), "a", "y", "g").collect()] == [None]  # no others


def test_ridge_nested(made):
    from binascii import crc32

    df, rows = made
    fold = np.array([crc32(r[1].encode()) % 3 for r in rows])
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows])

    def error(train, test, penalty):
        m, s, n = x[train].mean(0), x[train].std(0), train.sum()
        z = (x[train] - m) / s
        w = np.linalg.solve(z.T @ z + penalty * n * np.eye(2), z.T @ (y[train] - y[train].mean()))
        return ((y[test] - y[train].mean() - (x[test] - m) / s @ w) ** 2).sum()

    penalties = [0.0, 0.05, 1.0]
    got = {r["fold"]: r for r in S.ridge_nested(df, ["a", "b"], "y", "g", penalties, 3).collect()}
    assert set(got) == set(fold.tolist())
    for f, r in got.items():
        rest = [k for k in set(fold.tolist()) if k != f]
        inner = [sum(error((fold != f) & (fold != k), fold == k, p) for k in rest) for p in penalties]
        best = penalties[int(np.argmin(inner))]
        assert (r["n"], r["penalty"]) == ((fold == f).sum(), best)
        assert r["mse"] == pytest.approx(error(fold != f, fold == f, best) / r["n"])
    assert S.ridge_nested(df.limit(0), ["a"], "y", "g", penalties).count() == 0


def test_stage_model(spark, made):
    df, _ = made
    d = df.withColumn("s", F.when(F.col("y") < -1, 0).when(F.col("y") < 1, 1).otherwise(2))
    gates = S.stage_gates(d, "s", ["a", "b"], 3)
    got = S.stage_probabilities(d, gates, ["a", "b"]).select("s", "a", "stages").collect()
    known = [r for r in got if r["stages"] is not None]
    assert len(got) - len(known) == 1  # a null input
    assert all(sum(r["stages"]) == pytest.approx(1) for r in known)
    assert np.mean([int(np.argmax(r["stages"])) == r["s"] for r in known]) > 0.85
    assert S.stage_gates(d.where("s = 2"), "s", ["a"], 3)[0][0] > 3  # all pass


def test_sign_test_and_orders(spark):
    from math import comb

    d = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, -1, -2, 0]] + [(None,)], "d double")
    r = S.sign_test(d, "d").first()
    assert (r["n"], r["up"]) == (9, 7)
    assert r["p"] == pytest.approx(2 * sum(comb(9, k) for k in range(3)) / 2**9, abs=1e-6)
    assert S.sign_test(d.limit(0), "d").first()["p"] is None
    rows = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(4)], "k int, a double, y double")
    assert tuple(S.exact_order_test(rows, "k", ["a"], "y").first()) == (4, 1.0, round(2 / 24, 6))
    with pytest.raises(ValueError):
        S.exact_order_test(rows, "k", ["a"], "y", most=3)
    assert S.exact_order_test(rows.limit(0), "k", ["a"], "y").first()["p"] is None


def test_quota_scan(spark):
    d = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(8)], "i int, c string")
    got = {r["i"]: r["phase"] for r in S.quota_scan(d, ["c"], "i", 2, 5).collect()}
    assert got == {0: "quota", 1: "quota", 6: "quota", 7: "quota", 2: "overflow"}
    assert S.quota_scan(d.limit(0), ["c"], "i", 2, 5).count() == 0


def test_clusterings(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[9, 0, 0], [0, 9, 0], [0, 0, 9]])
    rows = [(i, [float(v) for v in centres[i % 3] + rng.normal(size=3) * 0.3]) for i in range(90)]
    df = spark.createDataFrame([*rows, (99, [0.0, 0.0, 0.0])], "k int, v array<double>")
    got = {r["k"]: r["cluster"] for r in S.spherical_kmeans(df, "k", "v", 3).collect()}
    assert len(got) == 90 and len({(i % 3, c) for i, c in got.items()}) == 3
    assert S.seed_stability(df, "k", "v", 3, [1, 2]).first()["ari"] == pytest.approx(1)
    mixed = {r["k"]: r["cluster"] for r in S.mixture(df.where("k < 90"), "k", "v", 2, 2, seed=3).collect()}
    assert len(mixed) == 90
