"""Filters, derived columns, encodings and set differences on any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_status(df: DataFrame, status: str, wanted: str, arm: str, not_arm: str) -> DataFrame:
    """Rows of one status whose arm isn't ``not_arm``; a null arm is none, so it stays."""
    return df.where((F.col(status) == wanted) & ~F.col(arm).eqNullSafe(F.lit(not_arm)))


def flag_members(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """``out``: whether the row's key is among ``members``; null keys aren't. Members count once however often they occur."""
    known = members.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return df.join(known, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def impute_median(df: DataFrame, value: str) -> DataFrame:
    """Nulls become the column's exact median; a column of nulls stays null."""
    return df.crossJoin(F.broadcast(df.agg(F.percentile(value, 0.5).alias("_median")))).withColumn(value, F.coalesce(F.col(value).cast("double"), "_median")).drop("_median")  # one row


def ordinal_depth(stages: list[Column]) -> Column:
    """How many of the ordered stages were reached, without a gap; a null stage counts as not reached."""
    depth = F.lit(len(stages))
    for i in reversed(range(len(stages))):
        depth = F.when(F.coalesce(stages[i], F.lit(False)), depth).otherwise(F.lit(i))
    return depth.cast("int")


def progress(value: Column, lo: Column, hi: Column) -> Column:
    """Share of the way from lo to hi, clipped to 0..1; null where the way has no length."""
    return F.when(hi != lo, F.least(F.greatest((value - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))


def grid_cell(df: DataFrame, tiers: DataFrame, key: str, tier: str, x: Column, y: Column) -> DataFrame:
    """``cell`` like t0h1x2: the key's tier (1 where unknown) and two band numbers."""
    named = df.join(tiers.select(key, tier), key, "left")
    return named.withColumn("cell", F.concat(F.lit("t"), F.coalesce(tier, F.lit(1)).cast("string"), F.lit("h"), x.cast("string"), F.lit("x"), y.cast("string"))).drop(tier)


def round_grid(df: DataFrame, x: str, y: str, size: float, order: str) -> DataFrame:
    """Cells of a grid, rounded half to even: one row each with its rows and a dense number by first appearance in ``order``."""
    cells = df.groupBy(F.bround(F.col(x) / size).cast("long").alias("cx"), F.bround(F.col(y) / size).cast("long").alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return cells.withColumn("cell_id", F.dense_rank().over(Window.orderBy("first")) - 1)  # cells are few


def encode_levels(value: Column, levels: list[str]) -> Column:
    """Number of a level in the given order; null for others."""
    code = F.lit(None).cast("int")
    for i, level in enumerate(levels):
        code = F.when(value == level, F.lit(i)).otherwise(code)
    return code


def dummies(df: DataFrame, value: str, levels: list[str], *, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each level; null and unknown values are 0 in all."""
    return df.select("*", *[F.coalesce((F.col(value) == level).cast("int"), F.lit(0)).alias(f"{value}_{level}") for level in levels[int(drop_first) :]])


def ordered_union(first: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """Rows of ``first`` (part 0) and ``rest`` (part 1); a key in both, or twice, raises an error."""
    both = first.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return both.withColumn("_n", n).withColumn("part", F.when(F.col("_n") == 1, F.col("part")).otherwise(F.raise_error(F.concat(F.lit("key occurs again: "), F.col(key).cast("string"))).cast("int"))).drop("_n")


def roster_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two rosters has: ``dropped`` or ``added``. Null keys don't count."""
    mark = lambda a, b, what: a.select(key).distinct().join(b.select(key), key, "left_anti").where(F.col(key).isNotNull()).withColumn("change", F.lit(what))
    return mark(old, new, "dropped").union(mark(new, old, "added"))


def map_changes(a: Column, b: Column) -> Column:
    """Sorted keys whose values differ between two maps, with those that only one has."""
    return F.array_sort(F.map_keys(F.map_filter(F.map_zip_with(a, b, lambda k, x, y: ~x.eqNullSafe(y)), lambda k, v: v)))


def merge_aliases(df: DataFrame, alias: Column, rate: str, weight: str) -> DataFrame:
    """Weighted mean rate of the rows of each name; null where the weights sum to nothing."""
    total = F.sum(weight)
    return df.groupBy(alias.alias("name")).agg(F.when(total != 0, F.sum(F.col(rate) * F.col(weight)) / total).alias("rate"), total.alias("weight"))


def ordinal_rank(df: DataFrame, value: str, key: str, within: list[str]) -> DataFrame:
    """Rank from 0 by value without ties: equal values by key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(value, key)) - 1)


def top_concentration(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of the highest scores (ties by key) and each one's share of their sum."""
    top = df.orderBy(F.desc(score), key).limit(k)  # k is the feature
    return top.withColumn("share", F.col(score) / F.sum(score).over(Window.partitionBy()))


def largest_budget(counts: DataFrame, n: str, budgets: list[int], times: int = 3) -> DataFrame:
    """The largest budget b such that every group has at least ``times`` * b rows; null if none fits."""
    fits = [F.when(F.min(n) >= times * b, F.lit(b)) for b in budgets]
    return counts.agg((F.greatest(*fits) if len(fits) > 1 else fits[0]).alias("budget"), F.min(n).alias("least"))


def clip_to_budget(df: DataFrame, spend: str, order: list, within: list[str], budget: float) -> DataFrame:
    """``granted``: of each row's spend, in order, what the budget of its group still covers."""
    before = F.coalesce(F.sum(spend).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(spend), F.lit(budget) - before)))


def log_loss(df: DataFrame, p: Column, y: Column) -> DataFrame:
    """Mean log loss and Brier score of probabilities of class 1, clipped by 1e-15; rows with a null don't count."""
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    ok = p.isNotNull() & y.isNotNull()
    return df.where(ok).agg(F.count(F.lit(1)).alias("n"), F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg((q - y) * (q - y)).alias("brier"))
