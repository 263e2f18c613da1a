"""Sequential learners and searches: bandits, a greedy determinantal choice, mutual information by near neighbours."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import exprs as E

RACE = "seed long, arm string, pulls long, reward double"


def _uniform(*parts) -> float:
    """In [0, 1), from the first 32 bits of md5 of the parts joined by '#'."""
    return int(hashlib.md5("#".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2.0**32


def race_one(arms: list[str], rates: list[float], seed: int, steps: int, rule: str, c: float = 1.0, gamma: float = 0.1) -> tuple[list[int], list[float]]:
    """Pulls and rewards of each arm. ``ucb1``: each arm once, then the largest mean + c * sqrt(2 ln t / n), ties to the first arm.
    ``exp3``: weights by importance-weighted rewards, mixed with gamma of an even choice."""
    k = len(arms)
    pulls, total, logw = [0] * k, [0.0] * k, np.zeros(k)
    for t in range(1, steps + 1):
        if rule == "ucb1":
            at = t - 1 if t <= k else max(range(k), key=lambda i: (total[i] / pulls[i] + c * math.sqrt(2 * math.log(t) / pulls[i]), -i))
            share = 1.0
        else:
            w = np.exp(logw - logw.max())
            p = (1 - gamma) * w / w.sum() + gamma / k
            at = min(int(np.searchsorted(np.cumsum(p), _uniform("pick", seed, t), "right")), k - 1)
            share = float(p[at])
        got = float(_uniform(arms[at], seed, t) < rates[at])
        pulls[at] += 1
        total[at] += got
        logw[at] += gamma * got / share / k
    return pulls, total


def race(arms: DataFrame, arm: str, rate: str, seeds: int, steps: int, rule: str = "ucb1") -> DataFrame:
    """A race a seed, seeds in parallel. The arms are a small table (one row an arm); each pull depends on all before it."""
    table = sorted((r[0], float(r[1])) for r in arms.select(F.col(arm).cast("string"), rate).where(F.col(arm).isNotNull() & F.col(rate).isNotNull()).collect())
    names, rates = [x[0] for x in table], [x[1] for x in table]
    if not names:
        return arms.sparkSession.createDataFrame([], RACE)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seed = int(group["id"].iloc[0])
        pulls, total = race_one(names, rates, seed, steps, rule)
        return pd.DataFrame({"seed": seed, "arm": names, "pulls": pulls, "reward": total})

    return arms.sparkSession.range(seeds).groupBy("id").applyInPandas(run, RACE)


def determinantal(df: DataFrame, key: str, vec: str, k: int, least: float = 1e-9) -> DataFrame:
    """Greedy choice of k rows with the largest determinant of dot products: pick, key, gain (log of the residual's square).

    A step is one narrow pass and one row to the driver: residual squares are |v|^2 less the squares along at most k chosen
    directions, held as literals; lineage doesn't grow. Ties go to the smaller key; it ends where nothing new is left.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("_k"), F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    basis: list[np.ndarray] = []
    picked: list = []
    while len(picked) < k:
        left = E.dot("_v", "_v")
        for u in basis:
            along = E.dot(F.col("_v"), F.array(*[F.lit(float(x)) for x in u]))
            left = left - along * along
        top = rows.withColumn("_d", F.round(left, 9)).where(~F.col("_k").isin([p[0] for p in picked]) if picked else F.lit(True)).orderBy(F.desc("_d"), "_k").limit(1).collect()
        if not top or top[0]["_d"] <= least:
            break
        v = np.array(top[0]["_v"])
        for u in basis:
            v = v - (v @ u) * u
        basis.append(v / np.linalg.norm(v))
        picked.append((top[0]["_k"], float(np.log(top[0]["_d"]))))
    schema = f"pick int, {key} {rows.schema['_k'].dataType.simpleString()}, gain double"
    return df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(picked, 1)], schema)


def ksg(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Kraskov's first estimator in nats: max-norm neighbours, strict counts on each side."""
    harmonic = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, len(x) + 2))))
    psi = lambda n: harmonic[n - 1] - np.euler_gamma
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    eps = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    nx, ny = (dx < eps).sum(1) - 1, (dy < eps).sum(1) - 1
    return float(psi(k) + psi(len(x)) - np.mean(psi(np.maximum(nx, 0) + 1) + psi(np.maximum(ny, 0) + 1)))


def mutual_information(df: DataFrame, key: str, x: str, y: str, *, k: int = 3, block: int = 512) -> DataFrame:
    """Estimates in blocks of about ``block`` rows (by hash of the key), averaged by size: memory holds block^2 distances, work grows
    with the rows. Every row counts but those of blocks of k rows or fewer. Returns n, blocks, mi."""
    rows = df.dropna(subset=[key, x, y]).select(F.col(key).alias("_k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    blocks = max(1, math.ceil(rows.count() / block))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("_k"), F.lit(blocks)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_k", "x", "y"])
        if len(g) <= k:
            return pd.DataFrame({"n": [0], "mi": [0.0]})
        return pd.DataFrame({"n": [len(g)], "mi": [ksg(g["x"].to_numpy(), g["y"].to_numpy(), k)]})

    got = dealt.groupBy("_b").applyInPandas(run, "n long, mi double").where("n > 0")
    return got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("blocks"), F.round(F.try_divide(F.sum(F.col("n") * F.col("mi")), F.sum("n")), 6).alias("mi"))
