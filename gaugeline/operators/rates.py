"""Grouped rates, multi-dimension summaries, shrinkage and profile scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.exprs import col, ratio, wilson


def rate_block(df: DataFrame, by: list[str], success, digits: int = 6) -> DataFrame:
    """by, n, k, rate, lo, hi: one aggregation with partial sums."""
    y = col(success).cast("int")
    out = df.groupBy(*by).agg(F.count(y).alias("n"), F.sum(y).cast("long").alias("k"))
    lo, hi = wilson("k", "n")
    return out.select(*by, "n", "k", F.round(ratio("k", "n"), digits).alias("rate"), F.round(lo, digits).alias("lo"), F.round(hi, digits).alias("hi"))


def summary(df: DataFrame, dims: list[str], success) -> DataFrame:
    """Overall and each dimension alone, in one pass of GROUPING SETS: dimension, bucket, n, k, rate."""
    labels = [F.col(d).cast("string").alias(d) for d in dims]
    base = df.select(*labels, col(success).cast("int").alias("_y"))
    base.createOrReplaceTempView("_gl_summary")
    sets = ", ".join(f"({d})" for d in dims)
    which = "case " + " ".join(f"when grouping({d}) = 0 then '{d}'" for d in dims) + " else 'overall' end"
    return df.sparkSession.sql(f"""select {which} as dimension, coalesce({", ".join(dims)}, 'all') as bucket, count(_y) as n, cast(sum(_y) as bigint) as k,
        round(sum(_y) / count(_y), 6) as rate from _gl_summary group by grouping sets ((), {sets})""")


def weakest(buckets: DataFrame, min_n: int, top: int) -> DataFrame:
    return buckets.where((F.col("n") >= min_n) & (F.col("dimension") != "overall")).orderBy("rate", "dimension", "bucket").limit(top)


def shares(df: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Counts and their share of all (or of a group)."""
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(ratio("n", F.sum("n").over(Window.partitionBy(*(within or [])))), 6))


def shrunken_rate(df: DataFrame, key: str, y, k: float) -> DataFrame:
    """(k * overall mean + n * rate) / (k + n); the overall mean is one aggregated row."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(col(y).cast("double")).alias("s"))
    mean = g.agg((F.sum("s") / F.sum("n")).alias("mu"))
    return g.crossJoin(mean).select(key, "n", F.round((k * F.col("mu") + F.col("s")) / (k + F.col("n")), 6).alias("encoded"))


def failure_profile(df: DataFrame, key: str, fail) -> DataFrame:
    """p_fail, the key's share of failures, and its base share."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(col(fail).cast("int")).cast("long").alias("fails"))
    w = Window.partitionBy()
    return g.select(key, "n", "fails", ratio("fails", "n").alias("p_fail"), ratio("fails", F.sum("fails").over(w)).alias("fail_share"), ratio("n", F.sum("n").over(w)).alias("base_share"))


def pooled_variance(df: DataFrame, group: str, x: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.var_samp(x).alias("v")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.round(F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1), 4).alias("pooled"))


def nested_mean(df: DataFrame, outer: list[str], inner: list[str], x: str) -> DataFrame:
    """Mean of the inner groups' means."""
    means = df.groupBy(*outer, *inner).agg(F.avg(x).alias("_m"))
    return means.groupBy(*outer).agg(F.count(F.lit(1)).alias("repeats"), F.round(F.avg("_m"), 6).alias("mean"))


def exactly_once(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are missing, doubled or unexpected; empty if all are found once."""
    counts = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(*key).distinct().withColumn("_e", F.lit(True)).join(counts, key, "full")
    state = F.when(F.col("_e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "doubled")
    return both.select(*key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), state.alias("problem")).where("problem is not null")
