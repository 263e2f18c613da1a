"""Designs of comparisons: halves, relabellings, noise floors, slopes, shares, profiles, evaluation sets, paths and reference sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.exprs import cosine, shuffle_key
from gaugeline.operators import vectors
from gaugeline.operators.windows import even_picks, tiles


# ---- halves and names
def alternate_halves(df: DataFrame, run: str) -> DataFrame:
    """``half`` 0 or 1 by turns over the sorted distinct runs (which are few); a null run has none."""
    runs = df.select(run).where(F.col(run).isNotNull()).distinct()
    return df.join(runs.withColumn("half", (F.row_number().over(Window.orderBy(run)) - 1) % 2), run, "left")


def cross_fitted_flag(df: DataFrame, run: str, level: str, y: str, bottom: int, least: int) -> DataFrame:
    """``flag`` 1 where the other half's ``bottom`` levels of lowest mean y (of ``least`` rows or more, ties by level) hold the row's."""
    halved = alternate_halves(df, run)
    means = halved.where(F.col("half").isNotNull()).groupBy("half", level).agg(F.avg(y).alias("_m"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    low = means.withColumn("_r", F.row_number().over(Window.partitionBy("half").orderBy(F.round("_m", 9), level))).where(F.col("_r") <= bottom)
    return halved.join(low.select((1 - F.col("half")).alias("half"), level, F.lit(1).alias("flag")), ["half", level], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def assert_canonical(df: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Rows and distinct values, if every value is among ``names``; a null or another value raises an error."""
    strange = F.max(F.when(~F.coalesce(F.col(value).isin(names), F.lit(False)), F.coalesce(F.col(value), F.lit("null"))))
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("names"), strange.alias("_s"))
    return seen.select(F.when(F.col("_s").isNull(), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("not canonical: "), "_s")).cast("long")).alias("n"), "names")


def arm_family(arm: str, families: dict[str, str], other: str) -> Column:
    """Family of an arm whose repeat suffix ``_j<number>`` is stripped: by its first prefix in ``families``."""
    base, out = F.regexp_replace(arm, r"_j\d+$", ""), F.lit(other)
    for prefix, family in reversed(families.items()):
        out = F.when(base.startswith(prefix), family).otherwise(out)
    return out


# ---- counters and lists
def two_source_counters(df: DataFrame, key: str, source: str, first: str, second: str, won: Column, spread: str) -> DataFrame:
    """Per key: rows and wins of two sources and the mean of ``spread``, nulls skipped; a source without rows counts 0."""
    of = lambda s, x: F.coalesce(F.sum(F.when(F.col(source) == s, x)), F.lit(0)).cast("long")
    names = [(first, "first"), (second, "second")]
    return df.groupBy(key).agg(*[of(s, x).alias(f"{out}_{what}") for s, out in names for what, x in (("n", F.lit(1)), ("k", won.cast("int")))], F.avg(spread).alias("spread"))


def ordered_lists(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each key's values in order, and the mean absolute step between neighbours (null for one value). Lists are an episode's, not a table's."""
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_l"))
    xs = F.transform("_l", lambda s: s[value])
    steps = F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: F.abs(b - a))
    return lists.select(key, xs.alias("values"), F.try_divide(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), F.size(xs) - 1).alias("step"))


def map_rows(df: DataFrame, key: str, maps: str, counts: DataFrame, name: str) -> DataFrame:
    """(key, name, value) of each entry of a map column, with the counts of (key, name); no count is 0."""
    rows = df.select(key, F.explode(maps).alias(name, "value"))
    return rows.join(counts, [key, name], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def trimmed(df: DataFrame, group: str, order: list[str], k: int, least: int) -> DataFrame:
    """Without the first and last k rows of each group of over ``least`` rows."""
    w = Window.partitionBy(group)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_m", F.count(F.lit(1)).over(w))
    return rows.where((F.col("_m") <= least) | ((F.col("_i") > k) & (F.col("_i") <= F.col("_m") - k))).drop("_i", "_m")


def resampled_path(df: DataFrame, key: str, order: list[str], value: str, points: int) -> DataFrame:
    """(key, i, value): each key's ordered values at ``points`` even places, linear in between; one row gives a constant."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(key, F.col(value).cast("double").alias("_a"), (F.row_number().over(w) - 1).alias("_j"), F.lead(F.col(value).cast("double")).over(w).alias("_b"))
    at = F.col("i") * (F.col("_m") - 1)
    places = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_m")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    places = places.select(key, "i", F.floor(at / F.lit(points - 1)).cast("int").alias("_j"), ((at % (points - 1)) / F.lit(float(points - 1))).alias("_f"))
    return places.join(rows, [key, "_j"]).select(key, "i", F.when(F.col("_f") == 0, F.col("_a")).otherwise(F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("value"))


def nearest_cell(df: DataFrame, cells: DataFrame, most: int = 10_000) -> DataFrame:
    """``cell``: of (t, h, x, cell) rows the one of least |t - t'|, then |h - h'| + |x - x'|, then name. At most ``most`` cells, else an error."""
    held = cells.agg(F.collect_list(F.struct("t", "h", "x", "cell")).alias("_c"), F.count(F.lit(1)).alias("_n"))
    held = held.select(F.when(F.col("_n") <= most, F.col("_c")).otherwise(F.raise_error(F.lit(f"over {most} cells")).cast(held.schema["_c"].dataType)).alias("_c"))
    far = lambda c: F.struct(F.abs(F.col("t") - c["t"]).alias("a"), (F.abs(F.col("h") - c["h"]) + F.abs(F.col("x") - c["x"])).alias("b"), c["cell"].alias("cell"))
    return df.crossJoin(F.broadcast(held)).withColumn("cell", F.array_min(F.transform("_c", far))["cell"]).drop("_c")  # one row


def heat_index(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """``ix, iy``: bins between exact quantiles, left-closed, held in 0..bins-1; null for null."""
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = df.agg(F.percentile(x, cuts).alias("_ex"), F.percentile(y, cuts).alias("_ey"))  # one row
    place = lambda v, e: F.when(F.col(v).isNotNull(), F.size(F.filter(e, lambda q: q <= F.col(v))))
    return df.crossJoin(F.broadcast(edges)).withColumn("ix", place(x, "_ex")).withColumn("iy", place(y, "_ey")).drop("_ex", "_ey")


# ---- components, floors, slopes
def nested_components(df: DataFrame, by: str, draw: str, y: str) -> DataFrame:
    """Variance of draws beyond that of the repeats within them: sd_seed, sd_draw = sqrt(max(0, (MSB - MSW) / n0)) and F, per ``by``."""
    d = df.where(F.col(y).isNotNull()).groupBy(by, draw).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum((F.col(y) * F.col(y))).alias("q"))
    g = d.groupBy(by).agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("q").alias("q"))
    msb = F.try_divide(F.col("b") - F.col("s") * F.col("s") / F.col("n"), (F.col("d") - 1).cast("double"))
    msw = F.try_divide(F.col("q") - F.col("b"), (F.col("n") - F.col("d")).cast("double"))
    n0 = F.try_divide(F.col("n") - F.col("nn") / F.col("n"), (F.col("d") - 1).cast("double"))
    sd = lambda v: F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))
    return g.select(by, F.col("d").alias("draws"), "n", sd(msw).alias("sd_seed"), sd(F.try_divide(msb - msw, n0)).alias("sd_draw"), F.try_divide(msb, msw).alias("f"))


def seed_spread(df: DataFrame, size: str, seed: str, won: Column) -> DataFrame:
    """Per size: seeds, mean rate, sd between seeds net of binomial noise (null for one seed), and the slope of the mean on ln size over all sizes."""
    r = df.groupBy(size, seed).agg(F.count(F.lit(1)).alias("n"), F.avg(won.cast("double")).alias("r"))
    g = r.groupBy(size).agg(F.count(F.lit(1)).alias("seeds"), F.avg("r").alias("mean"), F.var_samp("r").alias("v"), F.avg(F.col("r") * (1 - F.col("r")) / F.col("n")).alias("e"))
    slope = g.agg(F.regr_slope("mean", F.log(size)).alias("slope"))  # one row
    net = F.when(F.col("v").isNotNull(), F.sqrt(F.greatest(F.col("v") - F.col("e"), F.lit(0.0))))
    return g.crossJoin(F.broadcast(slope)).select(size, "seeds", "mean", net.alias("sd_seed"), F.sqrt("e").alias("noise"), "slope")


def noise_floor(nulls: DataFrame, by: str, d: str, sigma: float) -> DataFrame:
    """The larger of the sd of null differences and the evaluation's own sigma."""
    return nulls.groupBy(by).agg(F.count(d).alias("n"), F.greatest(F.stddev_samp(d), F.lit(sigma)).alias("floor"))


def t_quantile(p: float, df: int) -> float:
    """Of Student's t: the distribution function is Simpson's rule over the density, inverted by bisection."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(t: float, n: int = 2000) -> float:
        h = t / n
        f = [(1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
        return 0.5 + scale * h / 3 * (f[0] + f[n] + 4 * sum(f[1:n:2]) + 2 * sum(f[2:n:2]))

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def null_pair_mde(pairs: DataFrame, cluster: str, d: str, most: int = 30) -> DataFrame:
    """Smallest detectable effect from null pairs, clustered: (t95 + t80) * sd of cluster means / sqrt(n). Beyond ``most`` clusters t is the last's."""
    g = pairs.groupBy(cluster).agg(F.avg(d).alias("_m")).agg(F.count("_m").alias("clusters"), F.stddev_samp("_m").alias("sd"))
    t = F.lit(None).cast("double")
    for n in range(2, most + 1):
        t = F.when(F.col("clusters") >= n, F.lit(t_quantile(0.95, n - 1) + t_quantile(0.80, n - 1))).otherwise(t)
    return g.select("clusters", "sd", (t * F.col("sd") / F.sqrt(F.col("clusters").cast("double"))).alias("mde"))


def dose_slopes(df: DataFrame, added: str, zone: str, y: str, dose: float) -> DataFrame:
    """Mean gain a unit of dose in the zone that was added to (own) and in others (cross), against rows with nothing added (null)."""
    m = df.groupBy(added, zone).agg(F.avg(y).alias("_m"))
    base = m.where(F.col(added).isNull()).select(zone, F.col("_m").alias("_b"))
    gain = (F.col("_m") - F.col("_b")) / dose
    return m.where(F.col(added).isNotNull()).join(base, zone).agg(F.avg(F.when(F.col(added) == F.col(zone), gain)).alias("own"), F.avg(F.when(F.col(added) != F.col(zone), gain)).alias("cross"))


def relabelling_hits(df: DataFrame, profile: str, arm: str, seed: str, y: str, cut: float) -> DataFrame:
    """(hits, ways): every choice of an ordered pair of arms as the null pair in each profile, by the number of other arms that
    beat the pair's mean by over ``cut`` with one sign in all seeds. Profiles' histograms are convolved, so choices aren't listed."""
    v = df.groupBy(profile, arm, seed).agg(F.round(F.avg(y), 9).alias("v"))
    i, j, k = (v.select(profile, seed, F.col(arm).alias(f"_{x}"), F.col("v").alias(f"_v{x}")) for x in "ijk")
    pair = i.join(j, [profile, seed]).where("_i <> _j")
    adv = pair.join(k, [profile, seed]).where("_k <> _i and _k <> _j").withColumn("_a", F.round(F.col("_vk") - (F.col("_vi") + F.col("_vj")) / 2, 9))  # arms are few
    one = adv.groupBy(profile, "_i", "_j", "_k").agg((F.round(F.avg("_a"), 9) > cut).alias("_big"), (F.min(F.sign("_a")) == F.max(F.sign("_a"))).alias("_same"))
    per = one.groupBy(profile, "_i", "_j").agg(F.sum((F.col("_big") & F.col("_same")).cast("int")).alias("hits")).groupBy(profile, "hits").agg(F.count(F.lit(1)).alias("ways"))
    hists = [r["h"] for r in per.groupBy(profile).agg(F.map_from_entries(F.collect_list(F.struct("hits", "ways"))).alias("h")).orderBy(profile).collect()]  # one small map a profile
    total = {0: 1}
    for h in hists:
        new: dict[int, int] = {}
        for a, x in total.items():
            for b, z in h.items():
                new[a + b] = new.get(a + b, 0) + x * z
        total = new
    return df.sparkSession.createDataFrame(sorted(total.items()) if hists else [], "hits long, ways long")


# ---- shares, profiles, sets
def distributed(df: DataFrame, key: str, available: str, wanted: Column, within: list[str]) -> DataFrame:
    """``given``: integers in proportion to what is available, no more than that, summing to min(wanted, all available) in each
    group: floors first, the rest by largest remainder, ties by key. Integer arithmetic, so no rounding decides."""
    w = Window.partitionBy(*within)
    rows = df.withColumn("_t", F.sum(available).over(w)).withColumn("_w", F.greatest(F.least(wanted.cast("long"), F.col("_t")), F.lit(0)))
    whole = F.when(F.col("_t") > 0, F.expr(f"_w * {available} div _t")).otherwise(0)
    rows = rows.withColumn("_q", whole).withColumn("_r", F.when(F.col("_t") > 0, F.col("_w") * F.col(available) % F.col("_t")).otherwise(0))
    rows = rows.withColumn("_left", F.col("_w") - F.sum("_q").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("_r"), key)))
    return rows.withColumn("given", F.col("_q") + (F.col("_k") <= F.col("_left")).cast("int")).drop("_t", "_w", "_q", "_r", "_left", "_k")


def profile_counts(strata: list[str], n: int, starved: str | None = None) -> dict[str, int]:
    """Rows of each stratum: equal floors, or a twentieth (2 at least) for a starved one and the rest dealt evenly, remainder to the first."""
    if starved is None:
        return {s: n // len(strata) for s in strata}
    few = max(2, round(n / 20))
    others = [s for s in strata if s != starved]
    return {s: (n - few) // len(others) + (i < (n - few) % len(others)) for i, s in enumerate(others)} | {starved: few}


def profile_draw(df: DataFrame, key: str, stratum: str, counts: dict[str, int], seed: int) -> DataFrame:
    """That many rows of each stratum by a seeded hash of the key; all of a stratum that has fewer."""
    want = F.lit(0)
    for s, n in counts.items():
        want = F.when(F.col(stratum) == s, n).otherwise(want)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(shuffle_key(seed, key), key))).where(F.col("_r") <= want).drop("_r")


def evaluation_set(df: DataFrame, key: str, score: str, n: int, strata: int = 3) -> DataFrame:
    """n rows, as many in each equal-count stratum of the score, evenly spread over its order; rows without a score are left out."""
    if n % strata:
        raise ValueError(f"{n} rows don't divide into {strata} strata")
    return even_picks(tiles(df.where(F.col(score).isNotNull()), strata, [score, key], "stratum"), n // strata, ["stratum"], [score, key])


def hash_normal(seed: int, *parts: str) -> Column:
    """A standard normal number from two hashes of the parts (Box-Muller)."""
    u = lambda s: (F.conv(F.substring(shuffle_key(s, *parts), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(-2 * F.log(u(seed))) * F.cos(2 * math.pi * u(seed + 1))


def paid_probe(truth: Column, decoy: Column, fidelity: float, noise: float, cost: float, seed: int, *parts: str) -> Column:
    """What a paid proxy says of a marginal value: truth by fidelity, decoy by the rest, noise that shrinks with the cost's root."""
    return fidelity * truth + (1 - abs(fidelity)) * decoy + hash_normal(seed, *parts) * (noise / math.sqrt(max(cost, 1e-9)))


def positive_shares(df: DataFrame, value: str, budget: float) -> DataFrame:
    """``share`` of the budget by positive values; equal where none is positive. Rows are arms, so few."""
    w, pos = Window.partitionBy(), F.greatest(F.col(value), F.lit(0.0))
    total = F.sum(pos).over(w)
    return df.withColumn("share", F.when(total > 0, budget * pos / total).otherwise(budget / F.count(F.lit(1)).over(w)))


def correlated_vector(df: DataFrame, key: str, value: str, c: float, seed: int) -> DataFrame:
    """``signal`` of mean 0 and sd 1 whose correlation with ``value`` is exactly c: noise made orthogonal, then mixed. Rows are arms, so few."""
    w = Window.partitionBy()
    z = lambda x: (F.col(x) - F.avg(x).over(w)) / F.stddev_pop(x).over(w)
    d = df.withColumn("_z", z(value)).withColumn("_v", hash_normal(seed, key)).withColumn("_v", F.col("_v") - F.avg("_v").over(w))
    d = d.withColumn("_o", F.col("_v") - F.sum(F.col("_v") * F.col("_z")).over(w) / F.sum(F.col("_z") * F.col("_z")).over(w) * F.col("_z"))
    return d.withColumn("signal", c * F.col("_z") + math.sqrt(max(0.0, 1 - c * c)) * z("_o")).drop("_z", "_v", "_o")


def fit_spec(df: DataFrame, columns: list[str], block: list[str]) -> DataFrame:
    """One row of means and scales to freeze: each column's population sd, and one for the block (root of its summed variances); 0 becomes 1."""
    var = lambda x: F.col(f"_v_{x}")
    fitted = df.agg(*[F.avg(x).alias(f"_m_{x}") for x in columns + block], *[F.var_pop(x).alias(f"_v_{x}") for x in columns + block])
    scale = lambda v: F.when(v > 0, F.sqrt(v)).otherwise(1.0)
    whole = scale(sum((var(x) for x in block), F.lit(0.0)))
    return fitted.select(*[f"_m_{x}" for x in columns + block], *[scale(var(x)).alias(f"_s_{x}") for x in columns], *[whole.alias(f"_s_{x}") for x in block])


def apply_spec(df: DataFrame, spec: DataFrame, columns: list[str]) -> DataFrame:
    """``z_<column>`` by a frozen spec, whatever rows it was fitted on."""
    return df.crossJoin(F.broadcast(spec)).select(*df.columns, *[((F.col(x) - F.col(f"_m_{x}")) / F.col(f"_s_{x}")).alias(f"z_{x}") for x in columns])  # one row


# ---- reference sets
def reference_distance(df: DataFrame, refs: DataFrame, key: str, vec: str, block: int = 50_000) -> DataFrame:
    """Euclidean distance of each row to the nearest of a stated reference set, which is met in blocks; null without references, and
    for vectors that are null or hold a null (those that aren't finite are nobody's nearest). Products of blocks find the references that may be nearest; their distances are then
    taken from the differences."""

    def work(x: np.ndarray, y: np.ndarray) -> list:
        y = np.unique(y[np.isfinite(y).all(1)], axis=0)
        if not len(y) or x.shape[1] != y.shape[1]:
            return [None] * len(x)
        out, long, most = np.full(len(x), np.inf), (y * y).sum(1), (y * y).sum(1).max()
        for run in vectors.runs(x, y):
            part, own = x[run], (x[run] * x[run]).sum(1)
            d = part @ y.T
            d *= -2
            d += long
            d += own[:, None]
            # Rounding moves a product by less than this share of the squared lengths, so the nearest is among these.
            i, j = np.nonzero(d <= d.min(1, keepdims=True) + 1e-12 * x.shape[1] * (own[:, None] + most))
            for lo in range(0, len(i), 1 << 14):
                at = slice(lo, lo + (1 << 14))
                np.minimum.at(out[run], i[at], ((part[i[at]] - y[j[at]]) ** 2).sum(1))
        return [None if bad else float(v) for v, bad in zip(out, np.isnan(x).any(1))]

    near = vectors.met_in_blocks(df, refs, key, vec, work, "double", block)
    return near.groupBy(key).agg(F.sqrt(F.min("out")).alias("distance"))


def mode_menu(df: DataFrame, modes: DataFrame, key: str, vec: str, k: int, most: int = 1000) -> DataFrame:
    """Largest cosine with any mode, and mean of the k largest, for each row; at most ``most`` modes, else an error."""
    n = modes.count()
    if n > most:
        raise ValueError(f"{n} modes: over {most}")
    held = modes.agg(F.collect_list(vec).alias("_ms"))
    sims = df.select(key, vec).crossJoin(F.broadcast(held)).select(key, F.sort_array(F.transform("_ms", lambda m: F.round(cosine(vec, m), 9)), asc=False).alias("_s"))
    top = F.slice("_s", 1, k)
    return sims.select(key, F.get("_s", F.lit(0)).alias("best"), (F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).alias("coverage"))


def gated_draw(df: DataFrame, key: str, features: list[str], place: list[str], n: int, eps: float, seed: int) -> DataFrame:
    """n rows for one pull: 3 n by a seeded hash (all, if fewer), then farthest points over standardised features from the first
    of them; a point whose ``place`` lies within eps of a kept one is visited but not kept. The order of ``pick`` is the walk's."""
    pool = df.where(F.concat(*[F.col(c).cast("string") for c in features + place]).isNotNull()).orderBy(shuffle_key(seed, key), key).limit(3 * n)  # 3 n is the rule

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_o").reset_index(drop=True)
        x = p[features].to_numpy(float)
        sd = x.std(0)
        x, at = (x - x.mean(0)) / [s if s > 0 else 1.0 for s in sd], p[place].to_numpy(float)
        near, open_, kept = ((x - x[0]) ** 2).sum(1), [True] * len(p), [0]
        open_[0] = False
        while len(kept) < n and any(open_):
            i = max((j for j in range(len(p)) if open_[j]), key=lambda j: (near[j], -j))
            open_[i] = False
            near = near.clip(max=((x - x[i]) ** 2).sum(1))
            if (((at[kept] - at[i]) ** 2).sum(1) > eps * eps).all():
                kept.append(i)
        if len(kept) < n:
            raise ValueError(f"only {len(kept)} of {n} rows pass the novelty gate")
        return pd.DataFrame({key: p[key].to_numpy()[kept], "pick": range(n)})

    ordered = pool.select(key, *dict.fromkeys(features + place), shuffle_key(seed, key).alias("_o"))
    return ordered.groupBy(F.lit(1).alias("_all")).applyInPandas(walk, f"{key} {dict(df.dtypes)[key]}, pick long")
