"""Prediction across groups, residual permutations, power, calibration of proxies, geometry and stability of clusterings."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.exprs import col, dot, ratio, shuffle_key, unit, wilson
from gaugeline.operators.alloc import every
from gaugeline.operators.inference import agreement, newton_logistic
from gaugeline.operators.stats import replicates
from gaugeline.operators.vectors import mean_vector
from gaugeline.operators.windows import midrank

# ---- prediction across groups
def leave_group_out(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Simple regression of each group by all others: n, slope, rmse. Sums of each group are taken once; the others' sums are the
    total less its own, so nothing is read again. NULL where the others have no spread; rows with a NULL don't count."""
    d = df.dropna(subset=[x, y, group]).select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sums = {"n": F.count(F.lit(1)), "sx": F.sum("x"), "sy": F.sum("y"), "xx": F.sum(F.col("x") * F.col("x")), "xy": F.sum(F.col("x") * F.col("y")), "yy": F.sum(F.col("y") * F.col("y"))}
    g = d.groupBy(group).agg(*[e.alias(k) for k, e in sums.items()])
    total = g.agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
    g = g.crossJoin(F.broadcast(total)).select(*g.columns, *[(F.col(f"t_{k}") - F.col(k)).alias(f"o_{k}") for k in sums])
    g = g.withColumn("b", F.try_divide(F.col("o_n") * F.col("o_xy") - F.col("o_sx") * F.col("o_sy"), F.col("o_n") * F.col("o_xx") - F.col("o_sx") * F.col("o_sx")))
    g = g.withColumn("a", F.try_divide(F.col("o_sy") - F.col("b") * F.col("o_sx"), F.col("o_n")))
    a, b = F.col("a"), F.col("b")
    sse = F.col("yy") - 2 * a * F.col("sy") - 2 * b * F.col("xy") + F.col("n") * a * a + 2 * a * b * F.col("sx") + b * b * F.col("xx")
    return g.select(group, "n", b.alias("slope"), F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("rmse"))


def ridge_nested(df: DataFrame, xs: list[str], y: str, group: str, lambdas: list[float], folds: int = 5) -> DataFrame:
    """Ridge with folds of whole groups; for each outer fold the penalty with the least inner error over the other folds is used:
    fold, n, penalty, mse. One pass sums a Gram matrix of len(xs) + 2 columns a fold; errors follow from these matrices."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    d = df.dropna(subset=[*xs, y, group]).select(F.pmod(F.crc32(F.col(group).cast("string").cast("binary")), F.lit(folds)).cast("int").alias("fold"), *[c.alias(f"_{i}") for i, c in enumerate(cols)])
    m = len(cols)
    cells = [(i, j) for i in range(m) for j in range(i, m)]
    grams = np.zeros((folds, m, m))
    for r in d.groupBy("fold").agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"c{i}_{j}") for i, j in cells]).collect():
        for i, j in cells:
            grams[r["fold"], i, j] = grams[r["fold"], j, i] = r[f"c{i}_{j}"]

    def fit(g: np.ndarray, penalty: float) -> np.ndarray:
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        c = g[1:, 1:] - n * np.outer(mean, mean)  # centred; the penalty is on standardised columns and not on the intercept
        scale = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 1e-24))
        beta = np.linalg.solve(c[:-1, :-1] + penalty * n * np.diag(scale**2), c[:-1, -1])
        return np.concatenate(([mean[-1] - mean[:-1] @ beta], beta))

    def sse(g: np.ndarray, w: np.ndarray) -> float:
        v = np.concatenate((w, [-1.0]))
        return float(v @ g @ v)

    out, full = [], [f for f in range(folds) if grams[f, 0, 0] > 0]
    for f in full:
        rest = [k for k in full if k != f]
        if len(rest) < 2:
            continue
        inner = [sum(sse(grams[k], fit(grams[[q for q in rest if q != k]].sum(0), p)) for k in rest) for p in lambdas]
        best = lambdas[int(np.argmin(inner))]
        n = grams[f, 0, 0]
        out.append((f, int(n), float(best), float(sse(grams[f], fit(grams[rest].sum(0), best)) / n)))
    return df.sparkSession.createDataFrame(out, "fold int, n long, penalty double, mse double")


def stage_gates(df: DataFrame, stage: str, xs: list[str], stages: int, *, ridge: float = 1e-3) -> list[list[float]]:
    """Continuation ratio: for gate j, the coefficients of P(stage > j | stage >= j, x), by Newton's method. A gate that all or none
    of its rows pass gets a smoothed constant."""
    out = []
    for j in range(stages - 1):
        rows = df.where(F.col(stage) >= j).withColumn("_pass", (F.col(stage) > j).cast("int"))
        n, k = rows.dropna(subset=[*xs, stage]).agg(F.count(F.lit(1)), F.sum("_pass")).first()
        if not k or k == n:
            p = ((k or 0) + 0.5) / (n + 1)
            out.append([math.log(p / (1 - p)), *[0.0] * len(xs)])
        else:
            out.append([float(r["coef"]) for r in newton_logistic(rows, xs, "_pass", ridge=ridge).collect()])
    return out


def stage_probabilities(df: DataFrame, gates: list[list[float]], xs: list[str], out: str = "stages") -> DataFrame:
    """Array of the probability of each stage: products of the gates passed, times the one not passed. NULL where an x is NULL."""
    passed, shares = F.lit(1.0), []
    for g in gates:
        eta = sum((F.lit(b) * F.col(x) for b, x in zip(g[1:], xs)), F.lit(g[0]))
        p = 1 / (1 + F.exp(-eta))
        shares.append(passed * (1 - p))
        passed = passed * p
    known = F.lit(True)
    for x in xs:
        known = known & F.col(x).isNotNull()
    return df.withColumn(out, F.when(known, F.array(*shares, passed)))


# ---- permutations and resampling
def residual_permutation(df: DataFrame, key: str, group: str, x: str, z: str, y: str, reps: int = 30) -> DataFrame:
    """Coefficient of x beside z, against residuals of y on z that are shuffled within groups: n, coef, exceed, p.

    With x and y both freed of z, the fitted part of y drops out, so a replicate is a sum of products. Groups are split over the
    replicates; a replicate of one group is one sort."""
    d = df.dropna(subset=[key, group, x, y, z]).select(key, group, *[F.col(c).cast("double").alias(c) for c in (x, y, z)])
    line = d.agg(*[f(c, z).alias(f"{k}_{c}") for c in (x, y) for k, f in (("b", F.regr_slope), ("a", F.regr_intercept))])
    free = d.crossJoin(F.broadcast(line)).select(key, group, *[(F.col(c) - F.col(f"a_{c}") - F.col(f"b_{c}") * F.col(z)).alias(f"_{c}") for c in (x, y)])
    many, w = replicates(free, reps), Window.partitionBy("rep", group)
    a = many.select("rep", group, F.col(f"_{x}").alias("u"), F.row_number().over(w.orderBy(key)).alias("i"))
    b = many.select("rep", group, F.col(f"_{y}").alias("v"), F.row_number().over(w.orderBy(shuffle_key(F.col("rep"), key), key)).alias("i"))
    slope = lambda p, q: F.round(F.try_divide(F.sum(F.col(p) * F.col(q)), F.sum(F.col(p) * F.col(p))), 9)
    null = a.join(b, ["rep", group, "i"]).groupBy("rep").agg(slope("u", "v").alias("m"))
    seen = free.agg(F.count(F.lit(1)).alias("n"), slope(f"_{x}", f"_{y}").alias("coef"))
    return _exceed(null, seen, reps)


def _exceed(null: DataFrame, seen: DataFrame, reps: int) -> DataFrame:
    """Replicates at least as far from zero as the observed one, and (exceed + 1) / (reps + 1)."""
    both = null.crossJoin(F.broadcast(seen)).groupBy("n", "coef").agg(F.sum((F.abs("m") >= F.abs("coef")).cast("int")).alias("exceed"))
    return both.select("n", F.round("coef", 6).alias("coef"), "exceed", F.round((F.col("exceed") + 1) / (reps + 1.0), 6).alias("p"))


def auc_permutation(df: DataFrame, key: str, score: str, label: str, group: str, reps: int = 30) -> DataFrame:
    """AUC (ties half) of each group against shuffled labels: group, n, auc, exceed (as far from 0.5), p. Ranks are made once; a
    shuffle takes the first n+ rows of a group in hash order."""
    d = df.dropna(subset=[key, score, label, group]).select(key, group, F.col(label).cast("int").alias("_y"), score)
    w = Window.partitionBy(group)
    d = d.select(key, group, "_y", midrank(score, group).alias("_r"), F.sum("_y").over(w).alias("_p"), F.count(F.lit(1)).over(w).alias("_n"))
    area = lambda rank: F.try_divide(F.sum(rank) - F.first("_p") * (F.first("_p") + 1) / 2, F.first("_p") * (F.first("_n") - F.first("_p")))
    seen = d.groupBy(group).agg(F.first("_n").alias("n"), area(F.when(F.col("_y") == 1, F.col("_r"))).alias("auc")).where("auc is not null")
    place = F.row_number().over(Window.partitionBy("rep", group).orderBy(shuffle_key(F.col("rep"), key), key))
    null = replicates(d, reps).withColumn("_i", place).groupBy("rep", group).agg(area(F.when(F.col("_i") <= F.col("_p"), F.col("_r"))).alias("m"))
    far = lambda c: F.round(F.abs(F.col(c) - 0.5), 9)
    both = null.join(seen, group).groupBy(group, "n", "auc").agg(F.sum((far("m") >= far("auc")).cast("int")).alias("exceed"))
    return both.select(group, "n", F.round("auc", 6).alias("auc"), "exceed", F.round((F.col("exceed") + 1) / (reps + 1.0), 6).alias("p"))


def did_bootstrap(df: DataFrame, unit_col: str, treated, after, y: str, reps: int = 40) -> DataFrame:
    """Difference of differences and its percentile interval when whole units are drawn: units, did, lo, hi. A unit shrinks to the
    sums and counts of four cells before it is repeated."""
    cell = lambda t, a: (col(treated) == F.lit(bool(t))) & (col(after) == F.lit(bool(a)))
    cells = [(t, a) for t in (1, 0) for a in (1, 0)]
    val = F.col(y).cast("double")
    u = df.where(F.col(unit_col).isNotNull()).groupBy(unit_col).agg(*[F.coalesce(F.sum(F.when(cell(t, a), val)), F.lit(0.0)).alias(f"s{t}{a}") for t, a in cells], *[F.count(F.when(cell(t, a), val)).alias(f"c{t}{a}") for t, a in cells])
    mean = lambda t, a: F.try_divide(F.sum(f"s{t}{a}"), F.sum(f"c{t}{a}"))
    did = mean(1, 1) - mean(1, 0) - (mean(0, 1) - mean(0, 0))
    u = u.withColumn("_i", F.row_number().over(Window.orderBy(unit_col)) - 1).withColumn("_n", F.count(F.lit(1)).over(every()))
    draw = F.conv(F.substring(shuffle_key(F.col("rep"), "_i"), 1, 8), 16, 10).cast("long") % F.col("_n")
    drawn = replicates(u.select("_i", "_n"), reps).select("rep", draw.alias("_i")).join(u, "_i")
    got = drawn.groupBy("rep").agg(did.alias("m")).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    seen = u.agg(F.count(F.lit(1)).alias("units"), did.alias("did"))
    return seen.crossJoin(got).select("units", *[F.round(c, 5).alias(c) for c in ("did", "lo", "hi")])


def sign_test(pairs: DataFrame, d: str) -> DataFrame:
    """Two-sided exact sign test of differences; zeros and NULL don't count: n, up, p. The tail is summed by its ratio of terms."""
    t = pairs.agg(F.count(F.when(F.col(d) != 0, 1)).alias("n"), F.count(F.when(F.col(d) > 0, 1)).alias("up"))
    k = F.least(F.col("up"), F.col("n") - F.col("up"))
    start = F.struct((F.col("n") * F.lit(-math.log(2))).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["log"] + F.log((F.col("n") - i) / (i + 1))).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda s: s["sum"])
    return t.select("n", "up", F.round(F.when(F.col("n") > 0, F.least(F.lit(1.0), 2 * tail)), 6).alias("p"))


def exact_order_test(df: DataFrame, key: str, columns: list[str], y: str, most: int = 8) -> DataFrame:
    """Largest absolute Spearman correlation of ``columns`` with y over all orders of at most ``most`` rows: n, observed, p (exact)."""
    rows = df.dropna(subset=[key, y, *columns]).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"all orders of more than {most} rows")
    n = len(rows)
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    centred = lambda v: np.array(rank(v)) - (n + 1) / 2
    unit_of = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v * np.nan
    out = [(n, None, None)]
    if n >= 2:
        xs, target = np.array([unit_of(centred([r[c] for r in rows])) for c in columns]), unit_of(centred([r[y] for r in rows]))
        orders = np.array(list(itertools.permutations(range(n))))
        null = np.abs(xs @ target[orders].T)
        null = null[~np.isnan(null).any(1)].max(0).round(9) if not np.isnan(target).any() and not np.isnan(xs).all() else None
        if null is not None:
            out = [(n, round(float(null[0]), 6), round(float((null >= null[0]).mean()), 6))]
    return df.sparkSession.createDataFrame(out, "n int, observed double, p double")


# ---- power, floors, budgets
def simulated_power(spark, cells: list[tuple[int, float, float]], reps: int = 100, z: float = 1.96) -> DataFrame:
    """Share of simulated two-arm studies whose rates differ by over z pooled errors: n, p0, p1, power, mde. Draws are md5 hashes."""
    grid = spark.createDataFrame(cells, "n int, p0 double, p1 double").select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = lambda arm: F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(arm), F.col("n").cast("string"), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    d = grid.select("*", F.explode(F.expr("sequence(1, n)")).alias("i")).groupBy("n", "p0", "p1", "rep").agg(F.sum((u("a") < F.col("p0")).cast("int")).alias("k0"), F.sum((u("b") < F.col("p1")).cast("int")).alias("k1"))
    pool = (F.col("k0") + F.col("k1")) / (2.0 * F.col("n"))
    hit = F.abs(F.col("k1") - F.col("k0")) / F.col("n") > z * F.sqrt(2 * pool * (1 - pool) / F.col("n"))
    mde = (z + 0.8416) * F.sqrt(2 * F.col("p0") * (1 - F.col("p0")) / F.col("n"))
    return d.groupBy("n", "p0", "p1").agg(F.round(F.avg(hit.cast("int")), 6).alias("power")).select("n", "p0", "p1", "power", F.round(mde, 6).alias("mde"))


def trapezoid_floor(spark, points: list[int], rhos: list[float], sigma: float) -> DataFrame:
    """Error of a trapezoid average of equally correlated points: sigma * sqrt((1 - rho) * sum w^2 + rho * (sum w)^2)."""
    grid = spark.createDataFrame([(m, r) for m in points for r in rhos], "m int, rho double")
    w2 = (F.col("m") - 2 + 0.5) / ((F.col("m") - 1) * (F.col("m") - 1))  # inner weights 1 / (m - 1), ends half of it; they sum to 1
    return grid.select("m", "rho", F.round(F.lit(sigma) * F.sqrt((1 - F.col("rho")) * w2 + F.col("rho")), 6).alias("floor"))


def budget_to_share(df: DataFrame, arm: str, budget: str, value: str, share: float = 0.95) -> DataFrame:
    """Where the running sum of ``value`` by ``budget`` first reaches a share of its total, linear between points."""
    g = df.dropna(subset=[arm, budget]).groupBy(arm, budget).agg(F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("_v"))
    w = Window.partitionBy(arm).orderBy(budget)
    g = g.withColumn("_c", F.sum("_v").over(w)).withColumn("_t", F.sum("_v").over(Window.partitionBy(arm)) * share)
    g = g.withColumn("_b", F.lag("_c").over(w)).withColumn("_p", F.lag(budget).over(w)).where(F.col("_c") >= F.col("_t"))
    at = F.when(F.col("_b").isNull(), F.col(budget).cast("double")).otherwise(F.col("_p") + (F.col(budget) - F.col("_p")) * ratio(F.col("_t") - F.col("_b"), F.col("_c") - F.col("_b")))
    return g.groupBy(arm).agg(F.round(F.min_by(at, budget), 6).alias("budget"))


def pick_quality(df: DataFrame, round_col: str, arm: str, score: str, value: str) -> DataFrame:
    """The arm each round's score picks against the best by value: round, picked, right, regret, chance_regret (of an even pick)."""
    top = lambda by: F.max_by(F.struct(arm, value), F.struct(F.col(by), F.col(arm)))
    g = df.dropna(subset=[round_col, arm, score, value]).groupBy(round_col).agg(top(score).alias("s"), top(value).alias("v"), F.avg(value).alias("m"))
    return g.select(round_col, F.col(f"s.{arm}").alias("picked"), (F.col(f"s.{arm}") == F.col(f"v.{arm}")).cast("int").alias("right"), F.round(F.col(f"v.{value}") - F.col(f"s.{value}"), 6).alias("regret"), F.round(F.col(f"v.{value}") - F.col("m"), 6).alias("chance_regret"))


def quota_scan(df: DataFrame, cell: list[str], order: str, quota: int, total: int) -> DataFrame:
    """First ``quota`` rows of each cell in scan order, then overflow rows in that order until ``total``: order, phase."""
    d = df.select(*cell, order).withColumn("_i", F.row_number().over(Window.partitionBy(*cell).orderBy(order)))
    kept = d.where(F.col("_i") <= quota).select(order, F.lit("quota").alias("phase"))
    room = max(0, total - kept.count())
    over = d.where(F.col("_i") > quota).orderBy(order).limit(room).select(order, F.lit("overflow").alias("phase"))
    return kept.union(over)


def acquisition(df: DataFrame, by: str, good: Column, bad: Column, unsure: Column) -> DataFrame:
    """Lower bound of one rate, times that of another, times a mean uncertainty: by, n, score."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(good.cast("int")).alias("_g"), F.sum(bad.cast("int")).alias("_b"), F.avg(unsure.cast("double")).alias("_u"))
    return g.select(by, "n", F.round(wilson("_g", "n")[0] * wilson("_b", "n")[0] * F.col("_u"), 9).alias("score"))


def proxy_gate(df: DataFrame, proxy: str, truth: str, noise: float, z: float = 1.645) -> DataFrame:
    """Linear calibration of a proxy: n, slope, intercept, the residual's spread less known noise, support, and whether the lower
    bound of the slope is above zero."""
    p, q = F.col(proxy).cast("double"), F.col(truth).cast("double")
    t = df.dropna(subset=[proxy, truth]).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(q, p).alias("slope"), F.regr_intercept(q, p).alias("intercept"), F.regr_sxx(q, p).alias("sxx"), F.regr_syy(q, p).alias("syy"), F.min(p).alias("lo"), F.max(p).alias("hi"))
    s2 = F.try_divide(F.greatest(F.col("syy") - F.col("slope") ** 2 * F.col("sxx"), F.lit(0.0)), F.when(F.col("n") > 2, F.col("n") - 2))
    low = F.col("slope") - z * F.sqrt(F.try_divide(s2, F.col("sxx")))
    return t.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round(F.sqrt(F.greatest(s2 - noise * noise, F.lit(0.0))), 6).alias("excess"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), (low > 0).alias("passed"))


# ---- geometry of clusters and vectors
def cluster_cards(df: DataFrame, key: str, vec: str, cluster: str, top: int = 3) -> DataFrame:
    """cluster, size, share, spread (mean distance to the centre), and the ``top`` keys nearest to the centre, ties to the smaller.
    Centres (a row a cluster) are joined by cluster; rows shrink to a distance, and a bounded list a cluster is kept."""
    c = mean_vector(df, vec, cluster)
    away = F.sqrt(F.aggregate(F.zip_with(vec, "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    d = df.select(key, vec, cluster).join(F.broadcast(c.select(cluster, "centre")), cluster).select(cluster, key, F.round(away, 9).alias("_d"))
    near = d.withColumn("_i", F.row_number().over(Window.partitionBy(cluster).orderBy("_d", key))).where(F.col("_i") <= top)
    near = near.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", key))), lambda x: x[key].cast("string")), ",").alias("nearest"))
    g = d.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("_d"), 6).alias("spread"))
    return g.join(near, cluster).select(cluster, "size", F.round(F.col("size") / F.sum("size").over(every()), 6).alias("share"), "spread", "nearest")


def margins(df: DataFrame, vec: str, cluster: str, most: int = 10_000) -> DataFrame:
    """Mean distance to the own centre and mean margin (nearest other centre less own), a row a cluster. Centres are held as one
    broadcast array; more than ``most`` clusters are refused."""
    c = mean_vector(df, vec, cluster).select(F.struct(F.col(cluster).alias("c"), F.col("centre").alias("v")).alias("x"))
    if c.count() > most:
        raise ValueError(f"more than {most} clusters")
    held = c.agg(F.collect_list("x").alias("_all"))
    away = lambda v: F.sqrt(F.aggregate(F.zip_with(vec, v, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    d = df.where(F.col(vec).isNotNull() & F.col(cluster).isNotNull()).crossJoin(F.broadcast(held)).select(cluster, F.transform("_all", lambda x: F.struct((x["c"] == F.col(cluster)).alias("own"), away(x["v"]).alias("d"))).alias("_a"))
    own = F.array_min(F.transform(F.filter("_a", lambda x: x["own"]), lambda x: x["d"]))
    other = F.array_min(F.transform(F.filter("_a", lambda x: ~x["own"]), lambda x: x["d"]))
    return d.select(cluster, own.alias("o"), (other - own).alias("m")).groupBy(cluster).agg(F.round(F.avg("o"), 6).alias("own"), F.round(F.avg("m"), 6).alias("margin"))


def group_shape(df: DataFrame, key: str, vec: str, group: str, least: int = 30) -> DataFrame:
    """Distance of each vector to the mean of its group, or to the overall mean where the group has fewer than ``least`` rows."""
    whole = mean_vector(df, vec).select(F.col("centre").alias("_w"))
    sizes = df.where(F.col(vec).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    c = mean_vector(df, vec, group).select(group, "centre").join(sizes, group)
    d = df.select(key, vec, group).join(F.broadcast(c), group).crossJoin(F.broadcast(whole))
    to = F.when(F.col("_n") >= least, F.col("centre")).otherwise(F.col("_w"))
    away = F.sqrt(F.aggregate(F.zip_with(vec, to, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    return d.select(key, F.round(away, 6).alias("distance"))


def sequence_features(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """Mean, deviation (of the rows), first, last and length of each sequence, each standardised over all sequences."""
    names = ["mean", "sd", "first", "last", "length"]
    g = df.dropna(subset=[key, order, x]).groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min_by(x, order).cast("double").alias("first"), F.max_by(x, order).cast("double").alias("last"), F.count(F.lit(1)).cast("double").alias("length"))
    whole = g.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.round((F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(1e-9)), 5)
    return g.crossJoin(F.broadcast(whole)).select(key, *[z(c).alias(c) for c in names])


# ---- clusterings
def spherical_kmeans(df: DataFrame, key: str, vec: str, k: int, seed: int = 1) -> DataFrame:
    """k-means by cosine. Zero vectors have no direction and are left out."""
    rows = df.select(key, F.transform(vec, lambda x: x.cast("double")).alias("_d")).where(dot("_d", "_d") > 0)
    rows = rows.select(key, array_to_vector(unit("_d")).alias("_x"))
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster", distanceMeasure="cosine").fit(rows).transform(rows).select(key, "cluster")


def mixture(df: DataFrame, key: str, vec: str, k: int, dims: int | None = None, seed: int = 1) -> DataFrame:
    """Gaussian mixture over whole vectors, or over their first ``dims`` components where asked: key, cluster."""
    rows = df.select(key, array_to_vector(F.transform(F.slice(vec, 1, dims) if dims else F.col(vec), lambda x: x.cast("double"))).alias("_x"))
    return GaussianMixture(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(rows).transform(rows).select(key, "cluster")


def seed_stability(df: DataFrame, key: str, vec: str, k: int, seeds: list[int]) -> DataFrame:
    """Agreement (ARI, NMI) of the clusterings by each seed with that by the first."""
    runs = [spherical_kmeans(df, key, vec, k, s).withColumnRenamed("cluster", f"c{s}") for s in seeds]
    out = None
    for s, r in zip(seeds[1:], runs[1:]):
        got = agreement(runs[0].join(r, key), f"c{seeds[0]}", f"c{s}").withColumn("seed", F.lit(s))
        out = got if out is None else out.unionByName(got)
    return out
