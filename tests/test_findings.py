"""Cases of a review's findings, each against the query's SQL or brute force."""

import hashlib
import inspect

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gaugeline.llm import lm
from gaugeline.operators import designs as D
from gaugeline.operators import joins, stats, vectors
from gaugeline.plans import catalogue, columns, designs  # noqa: F401  (registers its queries)
from tests.llm.test_operators import small_scorer


def both(spark, name, **tables):
    """Rows of a query and of its SQL over Parquet files, exactly."""
    c = duckdb.connect()
    for t, path in tables.items():
        c.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    want = c.sql(catalogue.SQL[name]).df()
    got = catalogue.QUERIES[name](spark, str(path)).toPandas()[list(want.columns)]
    return [sorted(map(tuple, x.itertuples(index=False))) for x in (got, want)]


def test_progress_score_is_rounded_as_its_sql(spark):
    got, want = both(spark, "progress_score", orders="/root/testdata/sf0.01")
    assert got == want


def test_chunk_sizes_of_long_numbers(spark, tmp_path):
    duckdb.sql(f"copy (select unnest([0, 999, 1000, 100000, 999999, 1000000, 1009999, 8999999])::bigint as o_orderkey) to '{tmp_path}/orders.parquet'")
    got, want = both(spark, "chunk_sizes", orders=tmp_path)
    assert got == want and ("chunk-100", 3) in got


def greedy(x, t, n):
    u, t = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, t))
    best, out = np.zeros(len(t)), []
    for _ in range(n):
        gain = [-1 if i in out else np.maximum(u[i] @ t.T - best, 0).sum().round(9) for i in range(len(u))]
        out.append(int(np.argmax(gain)))
        best = np.maximum(best, u[out[-1]] @ t.T)
    return out


def test_facility_location_has_no_row_limit(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 5))
    x[40:50] = x[7]  # copies tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = [r["id"] for r in vectors.facility_location(df, df.where("id % 2 = 0"), "id", "v", 12).orderBy("pick").collect()]
    assert got == greedy(x, x[::2], 12)
    ids = spark.range(51_000).selectExpr("id", "array(float(cos(id)), float(sin(id)), float(1)) as v")  # beyond the limit of before
    got = [r["id"] for r in vectors.facility_location(ids, ids.where("id % 500 = 0"), "id", "v", 2).orderBy("pick").collect()]
    x = np.float32([[np.cos(i), np.sin(i), 1] for i in range(51_000)]).astype(float)
    u, t = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, x[::500]))
    gain = np.maximum(u @ t.T, 0).sum(1).round(9)
    assert len(got) == 2 and got[0] == int(np.argmax(gain))
    assert vectors.facility_location(df.limit(0), df, "id", "v", 3).count() == 0
    assert vectors.facility_location(df.limit(3), df, "id", "v", 9).count() == 3


@pytest.mark.parametrize("block", [7, 50_000])
def test_blocks_of_vectors(spark, block):
    """Nearest references and mean of the largest cosines by brute force; copies, nulls and vectors of zeros."""
    x = np.random.default_rng(7).normal(size=(90, 6))
    x[30:40], x[50] = x[3], 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None), (903, [None] * 6)], "id long, v array<double>")
    near = {r["id"]: r["distance"] for r in D.reference_distance(df, df.where("id % 3 = 0"), "id", "v", block).collect()}
    far = np.sqrt(((x[:, None] - x[None, ::3]) ** 2).sum(2)).min(1)
    assert [near[i] for i in range(90)] == pytest.approx(far.tolist(), abs=1e-12) and near[900] is None and near[903] is None and len(near) == 92
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    best = np.sort(u @ u[::3].T, 1)[:, -4:].mean(1)
    got = {r["id"]: r["score"] for r in vectors.top_k_score(df, df.where("id % 3 = 0"), "id", "v", 4, block).collect()}
    assert [got[i] for i in range(90)] == pytest.approx(best.tolist(), abs=1e-6) and got[900] is None and len(got) == 92
    few = {r["id"]: r["score"] for r in vectors.top_k_score(df, df.where("id < 2"), "id", "v", 4, block).collect()}
    assert [few[i] for i in range(90)] == pytest.approx((u @ u[:2].T).mean(1).tolist(), abs=1e-6)
    assert vectors.top_k_score(df, df.limit(0), "id", "v", 4, block).count() == 0


def test_near_pairs_without_a_broadcast(spark, tmp_path):
    r = np.random.default_rng(8)
    rows = [(int(k), "ab"[k % 2], float(x), float(y)) for k, (x, y) in zip(r.permutation(300), r.uniform(-9, 9, (300, 2)).round(1))]
    rows += [(k + 1000, *v) for k, *v in rows[:60]]  # copies at distance 0
    df = spark.createDataFrame(rows, "k long, g string, x double, y double")
    df.write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")  # files tell their size
    got = joins.near_pairs(df, "k", "g", "x", "y", 1.5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # the driver held one side before
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and np.hypot(a[2] - b[2], a[3] - b[3]) < 1.5)
    assert sorted((p["a"], p["b"]) for p in got.collect()) == want


def test_md5_of_many_keys():
    keys = ["", "7", "123456789", "grün", "x" * 40, "y" * 41, "z" * 300, None, "8"]
    for rep in (1, 37, 200):
        high, low = stats.Shuffles(keys).of(rep)
        want = [hashlib.md5((str(rep) if k is None else f"{k}#{rep}").encode()).hexdigest() for k in keys]
        assert [f"{int(h):016x}{int(x):016x}" for h, x in zip(high, low)] == want
    same = np.array([5, 5, 5, 9], np.uint64)  # leading bits that agree
    assert stats._flagged(same, np.array([3, 1, 2, 0], np.uint64), np.array([0, 0, 0, 1], np.uint64), np.array([0, 1, 3])).tolist() == [1, 2, 3]


def test_permutations_take_no_replicated_rows(spark):
    """By brute force, with null groups, flags and values and one large group; no rows are made for each replicate."""
    r = np.random.default_rng(3)
    rows = [(i, None if i % 50 == 0 else f"g{min(int(r.integers(40)), 12)}", None if i % 31 == 0 else int(r.random() < 0.3), None if i % 17 == 0 else float(r.normal())) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, f int, y double")
    got = stats.permutation_test(df, "id", "g", "f", "y", 30)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString() and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    mean = lambda flags, f: np.mean([v[3] for v, x in zip(rows, flags) if x == f and v[3] is not None])
    seen = round(mean([v[2] for v in rows], 1) - mean([v[2] for v in rows], 0), 9)
    exceed = 0
    for rep in range(1, 31):
        flags = [0] * len(rows)
        for g in {v[1] for v in rows}:
            own = sorted((v for v in rows if v[1] == g), key=lambda v: hashlib.md5(f"{v[0]}#{rep}".encode()).hexdigest())
            for v in own[: sum(v[2] or 0 for v in own)]:
                flags[v[0]] = 1
        exceed += abs(round(mean(flags, 1) - mean(flags, 0), 9)) >= abs(seen)
    assert tuple(got.first()) == (pytest.approx(seen, abs=1e-6), exceed, pytest.approx((exceed + 1) / 31, abs=1e-6))


def test_lm_trains_on_every_position():
    """Each id of each training text is a target once, after the ids that stand before it; that is the query's default."""
    scorer, _ = small_scorer(["one two three " * 400, "x", ""])
    texts = pa.array(["one two three " * 400, None, "x"])
    got, whole = lm.lessons(scorer, texts, np.array([1, 2, 3])), scorer.lay_out(*lm.split_words(texts))
    assert got["valid"].sum() == lm.encode_words(["one", "two", "three"], scorer.path)[1].sum() * 400 + len(lm.encode_words(["x"], scorer.path)[0]) + 3
    assert all((got[k] == whole[k]).all() for k in ("before", "token", "row", "valid", "lead"))
    assert inspect.signature(lm.fit).parameters["every"].default == 1
    assert lm.lessons(scorer, texts, np.array([1, 2, 3]), 8)["valid"].sum() < got["valid"].sum() / 4
