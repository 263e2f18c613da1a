"""Regressions, agreement of labelings, resampling of whole groups, budget sweeps. Each is one or two aggregations."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.exprs import col, ratio, shuffle_key
from gaugeline.operators.stats import replicates
from gaugeline.operators.windows import demean


def ols(df: DataFrame, xs: list[str], y: str, group: str | None = None) -> DataFrame:
    """OLS with an intercept, or with a fixed effect of each group: term, coef, se. The Gram matrix of len(xs) + 1 columns is summed
    in one pass and solved on the driver; groups are demeaned, not made into columns. NULL where the matrix is singular."""
    rows = df.dropna(subset=[*xs, y, *([group] if group else [])])
    names = [*xs, y]
    by = [group] if group else []
    d = rows.select(*by, *[demean(F.col(c).cast("double"), *by).alias(f"_{i}") for i, c in enumerate(names)])
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    groups = F.countDistinct(group) if group else F.lit(1)
    got = d.agg(F.count(F.lit(1)).alias("n"), groups.alias("g"), *[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"c{i}_{j}") for i, j in cells]).first()
    gram, p = np.zeros((len(names), len(names))), len(xs)
    for i, j in cells:
        gram[i, j] = gram[j, i] = got[f"c{i}_{j}"] or 0.0
    a, b = gram[:p, :p], gram[:p, p]
    free, out = got["n"] - got["g"] - p, [(x, None, None) for x in xs]
    if free > 0 and np.linalg.matrix_rank(a) == p:
        beta, inverse = np.linalg.solve(a, b), np.linalg.inv(a)
        s2 = (gram[p, p] - beta @ b) / free
        out = [(x, float(beta[i]), float(np.sqrt(max(s2 * inverse[i, i], 0.0)))) for i, x in enumerate(xs)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double")


def cluster_robust_slope(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Slope with fixed effects and the sandwich error over groups, with the small-sample factor G / (G - 1)."""
    d = df.select(group, demean(x, group).alias("a"), demean(y, group).alias("b")).where("a is not null and b is not null")
    g = d.groupBy(group).agg(F.sum(F.col("a") * F.col("a")).alias("xx"), F.sum(F.col("a") * F.col("b")).alias("xy"))
    w = Window.partitionBy()
    g = g.withColumn("slope", F.try_divide(F.sum("xy").over(w), F.sum("xx").over(w)))
    score = F.col("xy") - F.col("slope") * F.col("xx")
    t = g.agg(F.count(F.lit(1)).alias("groups"), F.max("slope").alias("slope"), F.sum("xx").alias("xx"), F.sum(score * score).alias("meat"))
    se = F.try_divide(F.sqrt(F.col("meat") * F.try_divide(F.col("groups"), F.col("groups") - 1)), F.col("xx"))
    return t.select("groups", F.round("slope", 5).alias("slope"), F.round(se, 5).alias("se"), F.round(F.try_divide(F.col("slope"), se) ** 2, 2).alias("wald"))


def newton_logistic(df: DataFrame, xs: list[str], y: str, *, ridge: float = 1e-6, steps: int = 12) -> DataFrame:
    """Logistic regression by Newton's method: term, coef, se. A step is one aggregation of gradient and Hessian."""
    rows = df.dropna(subset=[*xs, y]).select(F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_0"), *[F.col(x).cast("double").alias(f"_{i}") for i, x in enumerate(xs, 1)])
    p = len(xs) + 1
    beta, hess = np.zeros(p), np.eye(p)
    for _ in range(steps):
        eta = sum((F.lit(float(beta[i])) * F.col(f"_{i}") for i in range(1, p)), F.lit(float(beta[0])))
        prob = 1 / (1 + F.exp(-eta))
        cells = [(i, j) for i in range(p) for j in range(i, p)]
        got = rows.withColumn("_p", prob).agg(*[F.sum((F.col("_y") - F.col("_p")) * F.col(f"_{i}")).alias(f"g{i}") for i in range(p)], *[F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_{i}") * F.col(f"_{j}")).alias(f"h{i}_{j}") for i, j in cells]).first()
        grad = np.array([got[f"g{i}"] or 0.0 for i in range(p)]) - ridge * beta
        hess = ridge * np.eye(p)
        for i, j in cells:
            v = got[f"h{i}_{j}"] or 0.0
            hess[i, j] += v
            if i != j:
                hess[j, i] += v
        move = np.linalg.solve(hess, grad)
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            break
    se = np.sqrt(np.diag(np.linalg.inv(hess)))
    return df.sparkSession.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(["(intercept)", *xs], beta, se, strict=True)], "term string, coef double, se double")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of two labelings: rows, adjusted Rand index, mutual information over the mean of the entropies. Only cell counts are kept."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    wa, wb, w = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    c = c.withColumns({"ra": F.sum("o").over(wa), "rb": F.sum("o").over(wb), "t": F.sum("o").over(w)})
    pairs = lambda x: x * (x - 1) / 2
    o, ra, rb, t = (F.col(x) for x in ("o", "ra", "rb", "t"))
    s = c.agg(
        F.max("t").alias("t"), F.sum(pairs(o)).alias("s"), F.sum(o * (ra - 1) / 2).alias("sa"), F.sum(o * (rb - 1) / 2).alias("sb"),
        F.sum(o / t * F.log(o * t / (ra * rb))).alias("mi"), (-F.sum(o / t * F.log(ra / t))).alias("ha"), (-F.sum(o / t * F.log(rb / t))).alias("hb"),
    )
    chance = F.col("sa") * F.col("sb") / pairs(F.col("t"))
    return s.select(F.col("t").cast("long").alias("n"), F.round(F.try_divide(F.col("s") - chance, (F.col("sa") + F.col("sb")) / 2 - chance), 6).alias("ari"), F.round(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), 6).alias("nmi"))


def two_factor(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Sums of squares of cell means: each factor and their interaction (cells weigh the same; all cells should be there)."""
    c = df.groupBy(a, b).agg(F.avg(y).alias("m"))
    c = c.withColumns({"ma": F.avg("m").over(Window.partitionBy(a)), "mb": F.avg("m").over(Window.partitionBy(b)), "mm": F.avg("m").over(Window.partitionBy())})
    m, ma, mb, mm = (F.col(x) for x in ("m", "ma", "mb", "mm"))
    return c.agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum((ma - mm) ** 2), 5).alias("ss_a"), F.round(F.sum((mb - mm) ** 2), 5).alias("ss_b"), F.round(F.sum((m - ma - mb + mm) ** 2), 5).alias("ss_ab"))


def cluster_bootstrap(df: DataFrame, unit: str, y: str, reps: int = 40) -> DataFrame:
    """Percentile interval of the mean when whole units are drawn. Rows shrink to a sum and count a unit before they are repeated."""
    u = df.groupBy(unit).agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count(y).alias("_c"))
    u = u.withColumn("_i", F.row_number().over(Window.orderBy(unit)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    draw = F.conv(F.substring(shuffle_key(F.col("rep"), "_i"), 1, 8), 16, 10).cast("long") % F.col("_n")
    drawn = replicates(u.select("_i", "_n"), reps).select("rep", draw.alias("_i"))
    means = drawn.join(u.select("_i", "_s", "_c"), "_i").groupBy("rep").agg((F.sum("_s") / F.sum("_c")).alias("m"))
    return means.agg(F.count(F.lit(1)).alias("reps"), F.round(F.percentile("m", F.lit(0.025)), 5).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 5).alias("hi"))


def max_statistic(df: DataFrame, unit: str, arm: str, y: str, reps: int = 30) -> DataFrame:
    """Largest arm mean against shuffles of each unit's values over its arms: observed, exceed, p."""
    w = Window.partitionBy(unit)
    rows = df.groupBy(unit, arm).agg(F.avg(y).alias("_m")).withColumn("_i", F.row_number().over(w.orderBy(arm)))
    seen = rows.groupBy(arm).agg(F.avg("_m").alias("m")).agg(F.round(F.max("m"), 9).alias("observed"))
    place = F.row_number().over(Window.partitionBy("rep", unit).orderBy(shuffle_key(F.col("rep"), unit, arm), arm))
    moved = replicates(rows.select(unit, arm), reps).select("rep", unit, arm, place.alias("_i"))
    null = moved.join(rows.select(unit, "_i", "_m"), [unit, "_i"]).groupBy("rep", arm).agg(F.avg("_m").alias("m")).groupBy("rep").agg(F.round(F.max("m"), 9).alias("m"))
    both = null.crossJoin(seen).groupBy("observed").agg(F.sum((F.col("m") >= F.col("observed")).cast("int")).cast("long").alias("exceed"))
    return both.select(F.round("observed", 6).alias("observed"), "exceed", F.round((F.col("exceed") + 1) / (reps + 1.0), 6).alias("p"))


def weighted_corr(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted means and correlation from sums."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0)).select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"))])
    s = rows.agg(F.sum("w").alias("w"), *[F.sum(F.expr(f"w * {e}")).alias(n) for n, e in (("x", "x"), ("y", "y"), ("xx", "x * x"), ("yy", "y * y"), ("xy", "x * y"))])
    mx, my = F.col("x") / F.col("w"), F.col("y") / F.col("w")
    var = (F.col("xx") / F.col("w") - mx * mx) * (F.col("yy") / F.col("w") - my * my)
    return s.select(F.round(mx, 4).alias("mean_x"), F.round(my, 6).alias("mean_y"), F.round(F.try_divide(F.col("xy") / F.col("w") - mx * my, F.sqrt(F.greatest(var, F.lit(0.0)))), 6).alias("r"))


def excess_spread(df: DataFrame, group: str, success) -> DataFrame:
    """Spread of the groups' rates, and what binomial noise leaves of it."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(col(success).cast("double")).alias("r"))
    t = g.agg(F.count(F.lit(1)).alias("groups"), F.var_samp("r").alias("v"), F.avg(F.col("r") * (1 - F.col("r")) / F.col("n")).alias("e"))
    return t.select("groups", F.round(F.sqrt("v"), 6).alias("sd"), F.round(F.sqrt(F.greatest(F.col("v") - F.col("e"), F.lit(0.0))), 6).alias("sd_true"))


def leave_one_out(df: DataFrame, group: str, y: str) -> DataFrame:
    """Mean of all other groups' rows, for each group."""
    g = df.groupBy(group).agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    w = Window.partitionBy()
    return g.select(group, "n", F.round(ratio(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")), 6).alias("others"))


def halving(df: DataFrame, arm: str, stage: str, y: str, rounds: int) -> DataFrame:
    """Successive halving: after round r the better half by the mean of stages up to r stays. Returns arm, rounds survived."""
    sums = df.groupBy(arm, stage).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(y).alias("n"))  # a row an arm and stage
    alive = sums.select(arm).distinct().withColumn("survived", F.lit(0))
    for r in range(1, rounds + 1):
        means = sums.where(F.col(stage) <= r).groupBy(arm).agg(F.round(F.sum("s") / F.sum("n"), 9).alias("_m"))
        live = F.col("survived") == r - 1
        rows = alive.join(means, arm, "left").withColumn("_k", F.row_number().over(Window.partitionBy(live).orderBy(F.desc_nulls_last("_m"), arm)))
        keep = live & (F.col("_k") <= F.ceil(F.sum(live.cast("int")).over(Window.partitionBy()) / 2))
        alive = rows.select(arm, F.when(keep, r).otherwise(F.col("survived")).alias("survived"))
    return alive


def signs(dim: int, out: int, seed: int) -> list[list[float]]:
    """Signs by md5(i#j#seed), i and j from 1."""
    return [[1.0 if hashlib.md5(f"{i}#{j}#{seed}".encode()).hexdigest()[0] < "8" else -1.0 for i in range(1, dim + 1)] for j in range(1, out + 1)]


def sign_projection(df: DataFrame, key: str, vec: str, dim: int, out: int, seed: int = 0) -> DataFrame:
    """Projection on seeded sign vectors over sqrt(out): key, p1..pout."""
    def one(row: list[float]) -> Column:
        z = F.zip_with(F.col(vec), F.array(*[F.lit(s) for s in row]), lambda a, s: a.cast("double") * s)
        return F.round(F.aggregate(z, F.lit(0.0), lambda a, x: a + x) / float(np.sqrt(out)), 5)

    return df.select(key, *[one(r).alias(f"p{j}") for j, r in enumerate(signs(dim, out, seed), 1)])
