"""Regressions, learners and searches against brute force; defined cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import inference as I
from gaugeline.operators import learners as L


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"g{i % 7}", float(a), float(b), float(2 * a - b + (i % 7) + 0.3 * e), int(a - 0.5 * b + 0.8 * e > 0.2)) for i, (a, b, e) in enumerate(rng.normal(size=(400, 3)))]
    return spark.createDataFrame([*rows, (999, "g1", None, 1.0, 1.0, 1)], "id long, g string, a double, b double, y double, z int"), rows


def test_ols(made):
    df, rows = made
    groups = sorted({r[1] for r in rows})
    x = np.array([[r[2], r[3], *(float(r[1] == g) for g in groups)] for r in rows])
    y = np.array([r[4] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    se = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))
    got = {r["term"]: r for r in I.ols(df, ["a", "b"], "y", "g").collect()}
    assert [got["a"]["coef"], got["b"]["coef"], got["a"]["se"], got["b"]["se"]] == pytest.approx([*beta[:2], *se[:2]])
    assert all(r["coef"] is None for r in I.ols(df.withColumn("c", F.col("a")), ["a", "c"], "y").collect())
    assert all(r["coef"] is None for r in I.ols(df.limit(0), ["a"], "y").collect())


def test_newton_logistic(made):
    df, rows = made
    got = [r["coef"] for r in I.newton_logistic(df, ["a", "b"], "z").collect()]
    x, z = np.array([[1, r[2], r[3]] for r in rows]), np.array([r[5] for r in rows])
    p = 1 / (1 + np.exp(-x @ got))
    assert np.abs(x.T @ (z - p)).max() < 1e-3  # the gradient is zero there
    assert got[1] > 0 > got[2]


def test_agreement(spark):
    a, b = [0, 0, 1, 1, 2, 2, 2], [1, 1, 1, 0, 2, 2, 0]
    df = spark.createDataFrame([*zip(a, b), (None, 1)], "a int, b int")
    both = [(a[i] == a[j], b[i] == b[j]) for i, j in itertools.combinations(range(7), 2)]
    s, sa, sb, n = sum(p and q for p, q in both), sum(p for p, _ in both), sum(q for _, q in both), len(both)
    r = I.agreement(df, "a", "b").first()
    assert r["n"] == 7 and r["ari"] == pytest.approx((s - sa * sb / n) / ((sa + sb) / 2 - sa * sb / n), abs=1e-6)
    same = I.agreement(df, "a", "a").first()
    assert (same["ari"], same["nmi"]) == (1.0, 1.0)
    assert I.agreement(df.limit(0), "a", "b").first()["ari"] is None


def test_halving(spark):
    rows = [(arm, stage, base + (stage == 1) * bonus) for arm, base, bonus in (("a", 1.0, 0), ("b", 2.0, 0), ("c", 3.0, -9), ("d", 4.0, 0)) for stage in (1, 2)]
    got = dict(I.halving(spark.createDataFrame(rows, "arm string, stage int, y double"), "arm", "stage", "y", 2).collect())
    assert got == {"a": 0, "b": 1, "c": 0, "d": 2}  # c is out in the first round and doesn't come back


@pytest.mark.parametrize("rule", ["ucb1", "exp3"])
def test_race(spark, rule):
    arms = spark.createDataFrame([("x", 0.1), ("y", 0.9), ("z", 0.3), (None, 0.5)], "arm string, rate double")
    got = L.race(arms, "arm", "rate", 3, 400, rule).toPandas()
    assert (got.groupby("seed")["pulls"].sum() == 400).all()
    assert (got.loc[got.groupby("seed")["pulls"].idxmax(), "arm"] == "y").all()
    assert L.race(arms.limit(0), "arm", "rate", 3, 10, rule).count() == 0


def test_determinantal(spark):
    v = np.random.default_rng(2).normal(size=(30, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    chosen: list[int] = []
    for _ in range(4):
        chosen.append(max((i for i in range(30) if i not in chosen), key=lambda i: np.linalg.det(v[[*chosen, i]] @ v[[*chosen, i]].T)))
    got = L.determinantal(df, "id", "v", 4).orderBy("pick").collect()
    assert [r["id"] for r in got] == chosen
    assert sum(r["gain"] for r in got) == pytest.approx(np.log(np.linalg.det(v[chosen] @ v[chosen].T)), abs=1e-6)
    assert L.determinantal(df, "id", "v", 20).count() == 6  # the space has six directions


def test_mutual_information(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1500)
    y = 0.9 * x + np.sqrt(1 - 0.81) * rng.normal(size=1500)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, rng.normal(size=1500)))], "id long, x double, y double, z double")
    r = L.mutual_information(df, "id", "x", "y").first()
    assert r["n"] == 1500 and r["mi"] == pytest.approx(-0.5 * np.log(1 - 0.81), abs=0.12)
    assert abs(L.mutual_information(df, "id", "x", "z").first()["mi"]) < 0.1
    assert L.mutual_information(df.limit(0), "id", "x", "y").first()["mi"] is None


def test_sign_projection(spark):
    got = I.sign_projection(spark.createDataFrame([(1, [1.0, 2.0, 4.0])], "id long, v array<double>"), "id", "v", 3, 2).first()
    s = np.array(I.signs(3, 2, 0))
    assert [got["p1"], got["p2"]] == pytest.approx((s @ [1, 2, 4] / np.sqrt(2)).tolist(), abs=1e-4)
