"""Rank statistics, variance components, tests and resampling. Shuffles are orders of md5(id#seed)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.exprs import col, ratio, shuffle_key
from gaugeline.operators.windows import midrank, midranked


def auc(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC with ties at half, for each group: positives, negatives, auc (NULL if a class is missing)."""
    groups = groups or []
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*groups, F.col(label).cast("int").alias("_y"), F.col(score).alias("_x"))
    rows = known.withColumn("_r", midrank("_x", *groups)) if groups else midranked(known, "_x", "_r")
    g = rows.groupBy(*groups).agg(F.sum("_y").cast("long").alias("pos"), F.sum(1 - F.col("_y")).cast("long").alias("neg"), F.sum(F.when(F.col("_y") == 1, F.col("_r"))).alias("_s"))
    return g.select(*groups, "pos", "neg", F.round(F.try_divide(F.col("_s") - F.col("pos") * (F.col("pos") + 1) / 2, (F.col("pos") * F.col("neg")).cast("double")), 6).alias("auc"))


def within_auc(df: DataFrame, score: str, label: str, group: str, least: int = 3) -> DataFrame:
    """AUC in each group with enough of both classes, weighted by pairs."""
    g = auc(df, score, label, [group]).where((F.col("pos") >= least) & (F.col("neg") >= least))
    w = F.col("pos") * F.col("neg")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.round(F.try_divide(F.sum(F.col("auc") * w), F.sum(w)), 5).alias("auc"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    rows = midranked(midranked(rows, "_x", "_a"), "_y", "_b")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("_x", "_y"), 6).alias("pearson"), F.round(F.corr("_a", "_b"), 6).alias("spearman"))


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Each row once for each replicate; select what is needed first."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)


def md5_pairs(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of one-block messages, (16, n) padded little-endian words: the digests' first and last eight bytes as big-endian numbers."""
    start = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
    a, b, c, d = (np.full(blocks.shape[1], x, np.uint32) for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn, g = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += blocks[g]
        f += _SINES[i]
        np.right_shift(f, np.uint32(32) - _TURNS[turn, i % 4], out=t)
        np.left_shift(f, _TURNS[turn, i % 4], out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b, c, d = ((x + y).byteswap().astype(np.uint64) for x, y in zip((a, b, c, d), start))
    return (a << np.uint64(32)) | b, (c << np.uint64(32)) | d


class Shuffles:
    """MD5 of ``key#rep`` for many keys and one replicate after another, as ``shuffle_key`` orders rows."""

    def __init__(self, keys: list[str | None]):
        self.keys, texts, self.parts = keys, [None if k is None else k.encode() for k in keys], []
        size = np.array([99 if t is None else len(t) for t in texts])
        self.slow = np.flatnonzero(size > 40)  # null or long keys one by one
        for n in np.unique(size[size <= 40]):
            at = np.flatnonzero(size == n)
            whole = np.zeros((len(at), 64), np.uint8)
            whole[:, :n] = np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), n)
            self.parts.append((at, int(n), np.ascontiguousarray(whole.view("<u4").T)))

    def of(self, rep: int) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.zeros(len(self.keys), np.uint64), np.zeros(len(self.keys), np.uint64)
        for at, n, words in self.parts:
            tail = f"#{rep}".encode()
            rest = np.frombuffer(bytes(n) + tail + b"\x80" + bytes(55 - n - len(tail)) + (8 * (n + len(tail))).to_bytes(8, "little"), "<u4")
            for lo in range(0, len(at), 1 << 13):
                run = slice(lo, lo + (1 << 13))
                high[at[run]], low[at[run]] = md5_pairs(words[:, run] | rest[:, None])
        for i in self.slow:
            digest = hashlib.md5((f"{self.keys[i]}#{rep}" if self.keys[i] is not None else str(rep)).encode()).digest()
            high[i], low[i] = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")
        return high, low


def _flagged(high: np.ndarray, low: np.ndarray, group: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Rows at the places ``cut`` when sorted by group (numbers from 0, in order) and digest. Group and leading bits make one number;
    where two rows of it are equal, all is sorted by the whole digests."""
    bits = np.uint64(max(1, int(group[-1]).bit_length()))
    both = (group << (np.uint64(64) - bits)) | (high >> bits)
    order = np.argsort(both)
    sorted_ = both[order]
    if (sorted_[1:] == sorted_[:-1]).any():
        order = np.lexsort((low, high, group))
    return order[cut]


def permutation_test(df: DataFrame, key: str, group: str, flag: str, y: str, reps: int = 50) -> DataFrame:
    """Difference of means between flagged and other rows, labels shuffled within groups: observed, exceed, p = (c + 1) / (B + 1).
    In each replicate a group's rows of least md5(key#rep) are flagged, as many as it has. Rows are dealt once by their group; each task makes
    all replicates of whole groups from them, so replicates take no disk. A task holds the rows of its largest group."""
    base = df.select(F.col(key).cast("string").alias("_k"), F.col(group).alias("_g"), F.col(flag).cast("int").alias("_f"), F.col(y).cast("double").alias("_y"))
    diff = lambda f: F.avg(F.when(f == 1, F.col("_y"))) - F.avg(F.when(f == 0, F.col("_y")))
    seen = base.agg(F.round(diff(F.col("_f")), 9).alias("observed"))

    def whole(batches: Iterator[pd.DataFrame], least: int = 1 << 16) -> Iterator[pd.DataFrame]:
        """Runs of whole groups of about ``least`` rows or more; rows come in the order of their groups."""
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= least:
                p = pd.concat(held, ignore_index=True)
                new = np.flatnonzero(_changes(p["_h"], p["_g"]))
                if len(new) > 1:
                    yield p.iloc[: new[-1]]
                    p = p.iloc[new[-1] :]
                held, rows = [p], 0 if len(new) == 1 else len(p)
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((reps + 1, 4))  # sum and count of the flagged, and of the others
        for p in whole(batches):
            if not len(p):
                continue
            number = np.cumsum(_changes(p["_h"], p["_g"])) - 1
            f = p["_f"].to_numpy(float)
            known = np.bincount(number, ~np.isnan(f)) > 0  # flags that are all null flag nobody
            want = np.bincount(number, np.nan_to_num(f))
            p, number = p[known[number]], number[known[number]]
            if not len(p):
                continue
            want, number = want[known], np.unique(number, return_inverse=True)[1].astype(np.uint64)
            value = p["_y"].to_numpy(float)
            has, value = ~np.isnan(value), np.nan_to_num(value)
            place = np.arange(len(p)) - np.searchsorted(number, number)
            cut = np.flatnonzero(place < want[number.astype(int)])
            keys, s, n = Shuffles(p["_k"].tolist()), value.sum(), has.sum()
            for rep in range(1, reps + 1):
                at = _flagged(*keys.of(rep), number, cut)
                a, m = value[at].sum(), has[at].sum()
                total[rep] += a, m, s - a, n - m
        yield pd.DataFrame({"rep": range(1, reps + 1), "a": total[1:, 0], "m": total[1:, 1], "b": total[1:, 2], "n": total[1:, 3]})

    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # by number: few bytes are much work
    # The hash stands before the group, so that equal groups are neighbours whatever their type.
    dealt = base.withColumn("_h", F.xxhash64("_g")).repartition(parts, "_h").sortWithinPartitions("_h", "_g").select("_h", F.col("_g").cast("string").alias("_g"), "_k", "_f", "_y")
    sums = dealt.mapInPandas(run, "rep int, a double, m double, b double, n double").groupBy("rep").agg(*[F.sum(c).alias(c) for c in "ambn"])
    null = sums.select("rep", F.round(F.try_divide("a", "m") - F.try_divide("b", "n"), 9).alias("null"))
    return null.crossJoin(seen).groupBy("observed").agg(F.sum((F.abs("null") >= F.abs("observed")).cast("int")).cast("long").alias("exceed")).select(F.round("observed", 6).alias("observed"), "exceed", F.round((F.col("exceed") + 1) / (reps + 1.0), 6).alias("p"))


def _changes(*columns: pd.Series) -> np.ndarray:
    """Whether a row differs from the one before it (nulls are equal); the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        v, gone = c.to_numpy(), c.isna().to_numpy()
        out[1:] |= (gone[1:] != gone[:-1]) | ((v[1:] != v[:-1]) & ~gone[1:])
    return out


def sign_flip(pairs: DataFrame, key: str, d: str, reps: int = 100) -> DataFrame:
    """Mean paired difference against random signs."""
    sign = F.when(F.substring(shuffle_key(F.col("rep"), key), 1, 1) < "8", 1).otherwise(-1)
    null = replicates(pairs.select(key, F.col(d).alias("_d")), reps).groupBy("rep").agg(F.round(F.avg(F.col("_d") * sign), 9).alias("m"))
    seen = pairs.agg(F.round(F.avg(d), 9).alias("observed"), F.count(d).alias("pairs"))
    return null.crossJoin(seen).groupBy("observed", "pairs").agg(F.sum((F.abs("m") >= F.abs("observed")).cast("int")).cast("long").alias("exceed")).select("pairs", F.round("observed", 6).alias("observed"), "exceed", F.round((F.col("exceed") + 1) / (reps + 1.0), 6).alias("p"))


def split_half(df: DataFrame, unit: str, level: str, y: str, splits: int = 20, least: int = 2) -> DataFrame:
    """Mean correlation over random halves of units of the levels' means, and its Spearman-Brown value."""
    half = (F.substring(shuffle_key(F.col("rep"), unit), 1, 1) < "8").cast("int")
    g = replicates(df.select(unit, level, F.col(y).cast("double").alias("_y")), splits).groupBy("rep", level).agg(
        F.avg(F.when(half == 1, F.col("_y"))).alias("a"), F.avg(F.when(half == 0, F.col("_y"))).alias("b"), F.sum(half).alias("na"), F.sum(1 - half).alias("nb"))
    r = g.where((F.col("na") >= least) & (F.col("nb") >= least)).groupBy("rep").agg(F.corr("a", "b").alias("r")).agg(F.avg("r").alias("r"))
    return r.select(F.round("r", 5).alias("r"), F.round(2 * F.col("r") / (1 + F.col("r")), 5).alias("reliability"))


def bootstrap_mean(df: DataFrame, key: str, group: str, y: str, reps: int = 100) -> DataFrame:
    """Percentile interval of a group's mean; draws are positions hash mod n within the group."""
    w = Window.partitionBy(group)
    rows = df.select(group, key, F.col(y).cast("double").alias("_y")).withColumn("_i", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    draw = F.conv(F.substring(shuffle_key(F.col("rep"), group, "_i"), 1, 8), 16, 10).cast("long") % F.col("_n")
    drawn = replicates(rows.select(group, "_i", "_n"), reps).select(group, "rep", draw.alias("_i"))
    means = drawn.join(rows.select(group, "_i", "_y"), [group, "_i"]).groupBy(group, "rep").agg(F.avg("_y").alias("m"))
    return means.groupBy(group).agg(F.round(F.percentile("m", F.lit(0.025)), 5).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 5).alias("hi"))


def variance_components(df: DataFrame, group: str, y: str) -> DataFrame:
    """One-way random effects, unbalanced: between and within variance, ICC, eta squared, F."""
    g = df.groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    s = g.withColumn("_all", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy()))
    t = s.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("n") * (F.col("m") - F.col("_all")) ** 2).alias("ssb"), F.sum(F.coalesce("v", F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"))
    t = t.withColumn("msb", F.col("ssb") / (F.col("k") - 1)).withColumn("msw", F.col("ssw") / (F.col("N") - F.col("k"))).withColumn("n0", (F.col("N") - F.col("q") / F.col("N")) / (F.col("k") - 1))
    t = t.withColumn("between", F.greatest((F.col("msb") - F.col("msw")) / F.col("n0"), F.lit(0.0)))
    return t.select(F.col("k").alias("groups"), F.round("between", 4).alias("between"), F.round("msw", 4).alias("within"), F.round(F.col("between") / (F.col("between") + F.col("msw")), 6).alias("icc"), F.round(F.col("ssb") / (F.col("ssb") + F.col("ssw")), 6).alias("eta_sq"), F.round(F.col("msb") / F.col("msw"), 5).alias("f"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two labels over all cells, empty ones too: statistic, degrees of freedom, Cramer's V."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra, rb = c.groupBy(a).agg(F.sum("o").alias("ra")), c.groupBy(b).agg(F.sum("o").alias("rb"))
    cells = ra.crossJoin(rb).join(c, [a, b], "left").withColumn("o", F.coalesce("o", F.lit(0))).withColumn("t", F.sum("o").over(Window.partitionBy()))
    e = F.col("ra") * F.col("rb") / F.col("t")
    s = cells.agg(F.sum((F.col("o") - e) ** 2 / e).alias("x"), F.countDistinct(a).alias("na"), F.countDistinct(b).alias("nb"), F.max("t").alias("t"))
    return s.select(F.round("x", 5).alias("chi2"), ((F.col("na") - 1) * (F.col("nb") - 1)).alias("df"), F.round(F.sqrt(F.col("x") / (F.col("t") * (F.least("na", "nb") - 1))), 6).alias("cramers_v"))


def fe_slope(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """OLS of the demeaned y on the demeaned x, with its standard error (a slope and the groups' means are fitted)."""
    w = Window.partitionBy(group)
    d = df.select(group, (F.col(x) - F.avg(x).over(w)).alias("a"), (F.col(y) - F.avg(y).over(w)).alias("b"))
    t = d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("g"), F.sum(F.col("a") * F.col("a")).alias("xx"), F.sum(F.col("a") * F.col("b")).alias("xy"), F.sum(F.col("b") * F.col("b")).alias("yy"))
    slope = F.col("xy") / F.col("xx")
    return t.select("n", F.round(slope, 5).alias("slope"), F.round(F.sqrt((F.col("yy") - slope * F.col("xy")) / (F.col("n") - F.col("g") - 1) / F.col("xx")), 5).alias("se"))


def hazard(df: DataFrame, steps: str, ended, width: int) -> DataFrame:
    """Of those at risk at a window's start, how many end in (lo, lo + width]."""
    rows = df.select(F.ceil(F.col(steps) / width).cast("long").alias("bin"), col(ended).cast("int").alias("_e"))
    g = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_e").cast("long").alias("events"))
    risk = F.sum("n").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("at_risk", risk).select("bin", "at_risk", "events", F.round(ratio("events", "at_risk"), 6).alias("hazard"))


def harmonic_contrast(df: DataFrame, strata: str, flag, y: str) -> DataFrame:
    """Mean difference over strata, weighted by 1 / (1/n1 + 1/n0)."""
    f = col(flag)
    g = df.groupBy(strata).agg(F.sum(f.cast("int")).alias("n1"), F.sum((~f).cast("int")).alias("n0"), F.avg(F.when(f, F.col(y))).alias("m1"), F.avg(F.when(~f, F.col(y))).alias("m0")).where("n1 > 0 and n0 > 0")
    w = 1 / (1 / F.col("n1") + 1 / F.col("n0"))
    return g.agg(F.count(F.lit(1)).alias("strata"), F.round(F.sum(w * (F.col("m1") - F.col("m0"))) / F.sum(w), 6).alias("contrast"))


def percentile_ci(x: str | Column, lo: float = 0.025, hi: float = 0.975) -> tuple[Column, Column]:
    return F.percentile(col(x), F.lit(lo)), F.percentile(col(x), F.lit(hi))
