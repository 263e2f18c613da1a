"""Budgets and eliminations over small tables of arms or regions, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.exprs import shuffle_key


def every():
    """The window of all rows; these tables have a row an arm or region."""
    return Window.partitionBy()


def proportional(df: DataFrame, score: str, budget: float) -> DataFrame:
    """Budget by positive score; nothing where no score is positive."""
    s = F.greatest(F.col(score), F.lit(0.0))
    return df.withColumn("alloc", F.coalesce(F.try_divide(budget * s, F.sum(s).over(every())), F.lit(0.0)))


def water_fill(df: DataFrame, score: str, cap: str, budget: float) -> DataFrame:
    """Budget by score, no row above its cap; the excess goes to the others by score. Closed form: caps fill in order of cap / score."""
    w = Window.orderBy(F.col(cap) / F.col(score), F.desc(score))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_l", (budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum(score).over(every()) - F.coalesce(F.sum(score).over(before), F.lit(0.0)))).withColumn("_i", F.row_number().over(w))
    level = F.min(F.when(F.col("_l") <= F.col(cap) / F.col(score), F.struct("_i", "_l"))).over(every())["_l"]
    return rows.withColumn("_level", level).withColumn("alloc", F.least(F.col(cap).cast("double"), F.coalesce(F.col("_level") * F.col(score), F.col(cap).cast("double")))).drop("_l", "_i", "_level")


def largest_remainder(df: DataFrame, weight: str, total: int, tie: str) -> DataFrame:
    """Whole numbers that add up to total, by weight."""
    x = total * F.col(weight) / F.sum(weight).over(every())
    rows = df.withColumn("_x", F.round(x, 9)).withColumn("_f", F.floor("_x").cast("long"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), tie))
    return rows.withColumn("_r", rank).withColumn("alloc", F.col("_f") + (F.col("_r") <= total - F.sum("_f").over(every())).cast("int")).drop("_x", "_f", "_r")


def stratified_sample(df: DataFrame, strata: str, key: str, k: int, seed: int = 0) -> DataFrame:
    w = Window.partitionBy(strata).orderBy(shuffle_key(seed, key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def elimination(pulls: DataFrame, arm: str, round_col: str, delta: str, z: float, floor: float) -> DataFrame:
    """Mean +- z * max(sd, floor) / sqrt(n) of each arm; of the arms at the last round, those whose upper bound is below the best
    lower bound are out, the leader never."""
    g = pulls.groupBy(arm).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean"), F.coalesce(F.stddev_samp(delta), F.lit(0.0)).alias("sd"), F.max(round_col).alias("last"))
    half = z * F.greatest("sd", F.lit(floor)) / F.sqrt("n")
    g = g.withColumn("lcb", F.col("mean") - half).withColumn("ucb", F.col("mean") + half).withColumn("_live", F.col("last") == F.max("last").over(every()))
    best = F.max(F.when(F.col("_live"), F.col("lcb"))).over(every())
    leader = F.row_number().over(Window.orderBy(F.desc("_live"), F.desc("mean"), arm)) == 1
    return g.withColumn("survives", F.col("_live") & ((F.col("ucb") >= best) | leader)).drop("_live")


def greedy_ladder(df: DataFrame, region: str, gains: str, budget: int) -> DataFrame:
    """Steps of positive gain, the largest first, up to the budget; gains fall along each region's ladder."""
    steps = df.select(region, F.posexplode(gains).alias("step", "gain")).where("gain > 0").orderBy(F.desc("gain"), region, "step").limit(budget)
    return steps.groupBy(region).agg(F.count(F.lit(1)).alias("alloc"), F.round(F.sum("gain"), 6).alias("gain"))


def metered(df: DataFrame, cost: str, order: list[str], budget: float) -> DataFrame:
    """Charges in order while the running sum stays within the budget."""
    return df.withColumn("spent", F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("spent") <= budget)
