"""Approximate nearest neighbours by collision counting with virtual rehashing.

Vectors are scaled to length 1 and projected on ``projections`` random lines; for each line the projections of a block
are one sorted array. A query's windows, centred on its own projections, expand round by round (virtual rehashing: the
window's radius grows by ``ratio``); a vector collides where it lies in a window. Vectors that collide on at least a share
``threshold`` of the lines are verified by their exact cosine.

A query's last radius is found on a sample of at most ``sample`` vectors of its length (by hash, broadcast): the first at
which ``floor`` and a share ``beta`` of them are candidates. The candidates among all rows follow from that radius alone, so
answers don't depend on partitions or blocks, and as the sample is part of the rows there are at least k of them. All rows
are indexed: in blocks of about ``block`` vectors, each searched for every block of about ``query_block`` queries. Blocks
meet by a shuffle on their numbers; no query passes through the driver, and a task holds one block of each.

Components of a vector are scaled by a power of two before anything is multiplied, which changes no digit of a cosine but
keeps very large and very small vectors from overflow.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; a query
meets vectors of its own length only (those of any but the ``lengths`` commonest lengths are all verified); rows with the
query's id are never its answers; rows that share a query's id are one query, with the largest score against any of them;
ties go to the smaller id; repeated candidates answer once; fewer candidates than k give them all; ids may be of any
ordered type; an empty table gives an empty result; other columns aren't returned, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by a power of two to a largest component near one, and their norms."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])
    return v, np.sqrt((v * v).sum(1))


class CollisionIndex:
    """Sorted projections of a block of unit vectors on each line."""

    def __init__(self, unit: np.ndarray, lines: np.ndarray):
        self.n, self.m = len(unit), lines.shape[1]
        proj = (unit @ lines).T  # (m, n)
        self.order = np.argsort(proj, axis=1, kind="stable")
        self.sorted = np.take_along_axis(proj, self.order, axis=1)

    def collisions(self, at: np.ndarray, radius: np.ndarray):
        """For each query (rows of ``at``) and its radius, every vector's number of lines on which it lies in the window.

        Whichever is fewer is counted: what lies in the windows or, where they are wide, what lies outside on either end.
        """
        lo = np.stack([np.searchsorted(self.sorted[j], at[:, j] - radius, "left") for j in range(self.m)], 1)
        hi = np.stack([np.searchsorted(self.sorted[j], at[:, j] + radius, "right") for j in range(self.m)], 1)
        inside = (hi - lo).sum(1) * 2 < self.m * self.n
        for low, high, narrow in zip(lo.tolist(), hi.tolist(), inside.tolist(), strict=True):
            if narrow:
                yield np.bincount(np.concatenate([o[x:y] for o, x, y in zip(self.order, low, high)]), minlength=self.n)
            else:
                ends = [o[:x] for o, x in zip(self.order, low)] + [o[y:] for o, y in zip(self.order, high)]
                yield self.m - np.bincount(np.concatenate(ends), minlength=self.n)

    def radius(self, at: np.ndarray, need: int, least: int, start: float, ratio: float) -> np.ndarray:
        """The first radius at which ``need`` vectors have ``least`` collisions (infinite if there aren't so many vectors)."""
        out = np.full(len(at), np.inf)
        left, r = np.arange(len(at) if need < self.n else 0), start
        while len(left):
            done = np.array([(n >= least).sum() >= need for n in self.collisions(at[left], np.full(len(left), r))])
            out[left[done]] = r
            left, r = left[~done], r * ratio
        return out


def _lines(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, projections)) / np.sqrt(dim)


def search(vectors: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 64, threshold: float = 0.8, beta: float = 0.22, floor: int = 256, start: float = 0.12, ratio: float = 1.07, sample: int = 4096, lengths: int = 4, block: int = 32_768, query_block: int = 16_384, seed: int = 23) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``queries`` holds, against all rows."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.groupBy("id", "v").agg(F.max("q").alias("q")).withColumns({"d": F.size("v"), "h": F.xxhash64("id", "v")})  # repeated rows are one
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("q")).orderBy(F.desc("n"), "d").collect()  # a row for each length
    total, asked = sum(r["n"] for r in sizes), sum(r["q"] for r in sizes)
    least = math.ceil(threshold * projections)
    picked = {}
    for r in sizes[:lengths]:
        got = rows.where(F.col("d") == r["d"]).orderBy("h", "id").limit(sample).select("v").toPandas()["v"]
        picked[r["d"]] = np.stack(got.to_numpy()).astype(float)
    held = spark.sparkContext.broadcast(picked)  # at most lengths * sample vectors

    def radii(batches):
        index = {}
        for b in batches:
            out = np.full(len(b), np.inf)
            for d, at in b.groupby("d").indices.items():
                if d in held.value:
                    lines = _lines(d, projections, seed)
                    if d not in index:
                        u, n = scaled(held.value[d])
                        index[d] = CollisionIndex(u / n[:, None], lines)
                    u, n = scaled(np.stack(b["v"].iloc[at].to_numpy()))
                    few = len(held.value[d])
                    out[at] = index[d].radius(u / n[:, None] @ lines, min(few, max(floor, int(beta * few))), least, start, ratio)
            yield b.assign(r=out)

    blocks, query_blocks = -(-total // block) or 1, -(-asked // query_block) or 1
    rows_out = f"query_id {kind}, vec_id {kind}, score double"

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": right["id"].iloc[:0], "vec_id": left["id"].iloc[:0], "score": np.zeros(0)})
        lines = _lines(int(left["d"].iloc[0]), projections, seed)
        ids, rank = np.unique(left["id"].to_numpy(), return_inverse=True)
        (u, n), (a, m) = scaled(np.stack(left["v"].to_numpy())), scaled(np.stack(right["v"].to_numpy()))
        index = CollisionIndex(u / n[:, None], lines)
        radius, asked_ids, found = right["r"].to_numpy(float), right["id"].to_numpy(), []
        for lo in range(0, len(a), 256):
            part = slice(lo, lo + 256)
            ends = np.isinf(radius[part])
            counts = index.collisions(a[part] / m[part, None] @ lines, np.where(ends, 9.0, radius[part]))
            for i, (every, hits) in enumerate(zip(ends, counts, strict=True), lo):
                c = np.arange(len(u)) if every else np.flatnonzero(hits >= least)
                c = c[left["id"].to_numpy()[c] != asked_ids[i]]
                near = (u[c] @ a[i]) / (n[c] * m[i])
                if len(c) > k:
                    c = c[near >= np.partition(near, -k)[-k] - 1e-9]
                near = (u[c] * a[i]).sum(1) / (n[c] * m[i])  # summed row by row alike, so that equal vectors score equally
                by = np.lexsort((rank[c], -near))
                _, once = np.unique(rank[c][by], return_index=True)  # a repeated id answers once
                by = by[np.sort(once)][:k]
                found.append((np.full(len(by), i), rank[c][by], near[by]))
        i, c, near = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": asked_ids[i], "vec_id": ids[c], "score": near})

    asking = rows.where("q").select("id", "v", "d", "h").mapInPandas(radii, f"id {kind}, v array<double>, d int, h long, r double")
    asking = asking.select("id", "v", "d", "r", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(query_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vb"))
    index = rows.select("id", "v", "d", F.pmod(F.xxhash64("h", F.lit(2)), F.lit(blocks)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")).alias("qb"))
    key = ["d", "vb", "qb"]
    found = index.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(one, rows_out)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 50 == 0)
