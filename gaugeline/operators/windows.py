"""Group-relative and ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.exprs import col


def demean(x, *groups: str) -> Column:
    return col(x) - F.avg(col(x)).over(Window.partitionBy(*groups))


def zscore(x: str, group: str, fallback: str, min_n: int = 30, floor: float = 1e-9) -> Column:
    """Population z within the group, or within the fallback group where the group is small."""
    def z(w):
        return (F.col(x) - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(floor))

    g, f = Window.partitionBy(group), Window.partitionBy(fallback)
    return F.when(F.count(F.lit(1)).over(g) < min_n, z(f)).otherwise(z(g))


def midrank(v: str, *groups: str) -> Column:
    """Rank with ties at their average."""
    return F.rank().over(Window.partitionBy(*groups).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*groups, v)) - 1) / F.lit(2.0)


def in_ranges(df: DataFrame, value: str, parts: int = 256) -> DataFrame:
    """``_range`` of a number (null: the first) and the rows ``_before`` it and in all (``_all``): an order of the whole table without one task that sorts it."""
    edges = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("_e"))  # one row
    place = F.coalesce(F.when(F.col(value).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(value)))), F.lit(-1))
    rows = df.crossJoin(F.broadcast(edges)).withColumn("_range", place).drop("_e")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # at most parts + 1 rows
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    return rows.join(F.broadcast(sizes), "_range")


def tiles(df: DataFrame, k: int, order: list[str], out: str = "tile") -> DataFrame:
    """Tiles 0..k-1 whose sizes differ by one at most, the larger first. The first order column is a number."""
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    rows = in_ranges(df, order[0]).withColumn("_at", at)
    tile = F.expr(f"case when _at < (_all % {k}) * (_all div {k} + 1) then _at div (_all div {k} + 1) else _all % {k} + (_at - (_all % {k}) * (_all div {k} + 1)) div greatest(_all div {k}, 1) end")
    return rows.withColumn(out, tile.cast("int")).drop("_range", "_before", "_all", "_at")


def midranked(df: DataFrame, value: str, out: str) -> DataFrame:
    """``midrank`` of the whole table: ranks within ranges of the value, plus the rows before."""
    return in_ranges(df, value).withColumn(out, F.col("_before") + midrank(value, "_range")).drop("_range", "_before", "_all")


def even_picks(df: DataFrame, n: int, group: list[str], order: list[str]) -> DataFrame:
    """n rows spread evenly over each group's order."""
    w = Window.partitionBy(*group)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.count(F.lit(1)).over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_m") - 1) / float(max(n - 1, 1))).cast("int"))
    return rows.where(F.array_contains(picks, F.col("_i"))).drop("_i", "_m")


def islands(df: DataFrame, by: str, order: list[str], condition) -> DataFrame:
    """Runs of consecutive rows for which the condition holds: by, first order value, length."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.withColumn("_c", col(condition)).withColumn("_n", F.row_number().over(w))
    held = rows.where("_c").withColumn("_g", F.col("_n") - F.row_number().over(w))
    return held.groupBy(by, "_g").agg(F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def prefix_offsets(length: str, group: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0))


def alternating_demean(df: DataFrame, x: str, factors: list[str], sweeps: int = 8, every: int = 4) -> DataFrame:
    """Multi-factor demeaning by alternating projections; lineage is cut every few sweeps."""
    out = df.withColumn("resid", F.col(x))
    for i in range(sweeps):
        for f in factors:
            out = out.withColumn("resid", demean("resid", f))
        if (i + 1) % every == 0 and df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            out = out.checkpoint()
    return out


def capped(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")
