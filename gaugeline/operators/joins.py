"""Joins beyond equality: threshold gates, matching, pairing, nearest centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.exprs import dot, shuffle_key


def epsilon_gate(pool: DataFrame, used: DataFrame, by: str, x: str, y: str, eps: float) -> DataFrame:
    """Pool rows with no used row of the same label closer than eps (strictly). Points are put on a grid of eps cells, so
    only the nine neighbouring cells are compared, however large a label is."""
    cell = lambda d, c: F.floor(d[c] / eps)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    u = used.select(F.col(by).alias("_b"), F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_n", around)
    u = u.withColumn("_cx", F.floor(F.col("_x") / eps) + F.col("_n.i")).withColumn("_cy", F.floor(F.col("_y") / eps) + F.col("_n.j"))
    near = F.sqrt((pool[x] - u["_x"]) ** 2 + (pool[y] - u["_y"]) ** 2) < eps
    return pool.join(u, (pool[by] == u["_b"]) & (cell(pool, x) == u["_cx"]) & (cell(pool, y) == u["_cy"]) & near, "left_anti")


def near_pairs(df: DataFrame, key: str, by: str, x: str, y: str, tol: float) -> DataFrame:
    """Pairs a < b of one label closer than tol, found over a grid of tol cells: a cell meets itself and four of its neighbours, so
    each two cells meet once. Both sides are dealt by cell and none is broadcast, however small it is thought to be."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    a = df.select(F.col(key).alias("_ka"), F.col(by).alias("_b"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / tol).alias("_i"), F.floor(F.col(y) / tol).alias("_j"))
    b = df.select(F.col(key).alias("_kb"), F.col(by).alias("_b"), F.col(x).alias("_u"), F.col(y).alias("_v"), F.floor(F.col(x) / tol).alias("_p"), F.floor(F.col(y) / tol).alias("_q"), around.alias("_n"))
    b = b.select("_kb", "_b", "_u", "_v", (F.col("_p") + F.col("_n.i")).alias("_i"), (F.col("_q") + F.col("_n.j")).alias("_j"), ((F.col("_n.i") == 0) & (F.col("_n.j") == 0)).alias("_own"))
    d = F.sqrt((F.col("_x") - F.col("_u")) ** 2 + (F.col("_y") - F.col("_v")) ** 2)
    once = F.when(F.col("_own"), F.col("_ka") < F.col("_kb")).otherwise(F.col("_ka") != F.col("_kb"))
    met = a.hint("merge").join(b.hint("merge"), ["_b", "_i", "_j"]).where(once & (d < tol))
    return met.select(F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"), F.round(d, 6).alias("distance"))


def exact_match(a: DataFrame, b: DataFrame, cell: list[str], key: str, seed: int = 0) -> DataFrame:
    """From each cell that both sides have, as many rows of each as the smaller side has, by seeded hash."""
    na, nb = (d.groupBy(*cell).agg(F.count(F.lit(1)).alias(n)) for d, n in ((a, "_na"), (b, "_nb")))
    quota = na.join(nb, cell).select(*cell, F.least("_na", "_nb").alias("_k"))
    w = Window.partitionBy(*cell).orderBy(shuffle_key(seed, key), key)
    pick = lambda d, side: d.join(quota, cell).withColumn("_r", F.row_number().over(w)).where("_r <= _k").select(*cell, key, F.lit(side).alias("side"))
    return pick(a, "a").unionByName(pick(b, "b"))


def nearest_centre(points: DataFrame, centres: DataFrame, key: str, vec: str, centre: str, centre_vec: str) -> DataFrame:
    """The centre of least squared distance. Centres are a model's parameters: few, and checked before they're broadcast."""
    n = centres.count()
    if n > 10_000:
        raise ValueError(f"{n} centres: assign them in blocks")
    diff = F.zip_with(vec, centre_vec, lambda x, y: x.cast("double") - y)
    d = points.crossJoin(F.broadcast(centres)).withColumn("_d", F.round(dot(diff, diff), 9))
    return d.groupBy(key).agg(F.min(F.struct("_d", centre)).alias("_m")).select(key, F.col(f"_m.{centre}").alias("nearest"), F.round(F.sqrt("_m._d"), 6).alias("distance"))


def control_delta(df: DataFrame, round_col: str, arm: str, control: str, x: str) -> DataFrame:
    """Each arm's mean less its round's control arm's."""
    m = df.groupBy(round_col, arm).agg(F.avg(x).alias("_m"))
    c = F.max(F.when(F.col(arm) == control, F.col("_m"))).over(Window.partitionBy(round_col))
    return m.select(round_col, arm, F.round(F.col("_m") - c, 6).alias("delta")).where(F.col(arm) != control)


def paired(a: DataFrame, b: DataFrame, key: list[str], x: str) -> DataFrame:
    """Rows of both sides by key: a, b and their difference."""
    return a.select(*key, F.col(x).alias("a")).join(b.select(*key, F.col(x).alias("b")), key).withColumn("d", F.col("a") - F.col("b"))


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, default if not isinstance(default, (int, float, str)) else F.lit(default)))
