"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Everything here is DataFrame and SQL functions. Sources get targets by weight, none above
``max_epochs`` times its own size. Each source is dealt by a seeded hash into shards, and each shard's
token stream is cut into blocks of about ``block_tokens``. Blocks are apportioned twice by highest
quotients: to sources by target (in blocks of the source's own mean size), then to a source's shards by their blocks. A shard takes its quota
as whole passes plus blocks chosen by a seeded bijection of block numbers.

Scale: shards a source are 1.5 * sqrt(rows), or fewer where a source has not SHARD_BLOCKS blocks for each, so both the rows of a shard and the shards of a source
grow with the root of the input and a source with a third of all rows is spread over many tasks. One
shuffle carries rows (the join with the quotas and the prefix sums use the same partitioning).

Defined cases: null text has size 0; a null source is a source of its own, ordered last; documents of
size 0 take 0; repeated rows are rows of their own; an empty table gives an empty result. Columns
``size, source_size, target, taken`` replace input columns of those names; all others are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import Hidden, cut

#: A prime above any shard's number of blocks: i * PRIME + c is a bijection modulo that number.
PRIME = 2654435761
#: A shard holds about so many blocks at least, so that blocks of thin sources are as large as others.
SHARD_BLOCKS = 8
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(df: DataFrame, votes: str, seats: str, order: list, within: list[str], out: str) -> DataFrame:
    """Add ``out``: integer seats by highest quotients votes / (2k - 1), ties by ``order``.

    Seats that any divisor near the mean one gives are granted outright; only the seats around that
    number compete, about four a row, so the rows ranked grow with the rows, not with the seats.
    """
    w = Window.partitionBy(*within)
    key = [*within, "_sl_pos"]
    x = F.col(seats) * F.col(votes) / F.col("_sl_sum")
    slack = x / F.col(seats) * (F.col("_sl_n") / 2 + 1) + F.lit(1.5)
    live = (F.col(seats) > 0) & (F.col("_sl_sum") > 0)
    base = (
        df.withColumn("_sl_sum", F.sum(F.col(votes).cast("double")).over(w))
        .withColumn("_sl_n", F.count(F.lit(1)).over(w))
        .withColumn("_sl_pos", F.row_number().over(w.orderBy(*order)))
        .withColumn("_sl_base", F.when(live, F.greatest(F.lit(0), F.floor(x - slack))).otherwise(0).cast("long"))
        .withColumn("_sl_top", F.when(live & (F.col(votes) > 0), F.ceil(x + slack)).otherwise(0).cast("long"))
        .withColumn("_sl_left", F.col(seats) - F.sum("_sl_base").over(w))
    )
    more = (
        base.where(F.col("_sl_top") > F.col("_sl_base"))
        .select(*key, F.col(votes).alias("_v"), "_sl_left", F.explode(F.sequence(F.col("_sl_base") + 1, F.col("_sl_top"))).alias("_k"))
        .withColumn("_q", F.col("_v") / (2 * F.col("_k") - 1))
        .withColumn("_r", F.row_number().over(w.orderBy(F.desc("_q"), "_sl_pos", "_k")))
        .where(F.col("_r") <= F.col("_sl_left"))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_sl_more"))
    )
    return (
        base.join(more, key, "left")
        .withColumn(out, F.col("_sl_base") + F.coalesce("_sl_more", F.lit(0)))
        .drop("_sl_sum", "_sl_n", "_sl_pos", "_sl_base", "_sl_top", "_sl_left", "_sl_more")
    )


def source_targets(totals: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Water-filling in closed form: sources by cap / weight; the first level not above its cap holds for all the rest.

    Sources are a catalogue (some thousands at most), so their windows run in one task.
    """
    every, by_name, by_cap = Window.partitionBy(), Window.orderBy("_null", "_src"), Window.orderBy("_ratio", "_pos")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    return (
        totals.withColumn("_pos", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(wheel, ((F.col("_pos") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_i", F.row_number().over(by_cap))
        .withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_i", "_level"))).over(every)["_level"])
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))))
        .select("_null", "_src", "_pos", "source_size", "target", "_blocks")
    )


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, block_tokens: int = 32, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target and taken (tokens the mix takes)."""
    shards = max(1, math.ceil(1.5 * math.sqrt(docs.count())))
    own_names = Hidden(docs)
    id_col, text_col, source_col = own_names[id_col], own_names[text_col], own_names[source_col]
    rows = own_names.df.withColumns({
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "_null": F.col(source_col).isNull(),
        "_src": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "_hash": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)),  # with the text, so that null ids spread too
    })
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.col("_hash"), F.lit(1)), F.lit(shards)).cast("int"))
    cell = ["_null", "_src", "_shard"]
    fine, _ = cut(rows.groupBy(*cell).agg(F.sum("size").alias("_tokens")), "mix-shards")
    own = fine.groupBy("_null", "_src").agg(F.sum("_tokens").alias("source_size"))
    own, _ = cut(own.withColumn("_own", F.least(F.lit(shards), F.greatest(F.lit(1), F.expr(f"source_size div {SHARD_BLOCKS * block_tokens}")))), "mix-sources")
    coarse = F.expr(f"cast(_shard * _own div {shards} as int)")
    sums = fine.join(F.broadcast(own.drop("source_size")), ["_null", "_src"]).withColumn("_shard", coarse).groupBy(*cell).agg(F.sum("_tokens").alias("_tokens"))
    rows = rows.join(F.broadcast(own.drop("source_size")), ["_null", "_src"]).withColumn("_shard", coarse).drop("_own")
    sums, _ = cut(sums.withColumn("_n", F.when(F.col("_tokens") > 0, F.greatest(F.lit(1), F.round(F.col("_tokens") / block_tokens))).otherwise(0).cast("long")), "mix-cells")
    totals = sums.groupBy("_null", "_src").agg(F.sum("_tokens").alias("source_size"), F.sum("_n").alias("_blocks"))
    goals = source_targets(totals, weights, max_epochs).withColumn("_goal", F.expr("if(source_size > 0, target * _blocks / source_size, 0D)"))
    goals = goals.withColumn("_all", F.round(F.sum("_goal").over(Window.partitionBy())).cast("long"))
    goals = sainte_lague(goals, "_goal", "_all", ["_pos"], [], "_seats").withColumn("_seats", F.least("_seats", max_epochs * F.col("_blocks")))
    goals, _ = cut(goals.select("_null", "_src", "source_size", "target", "_seats"), "mix-goals")
    quotas = sainte_lague(sums.join(goals, ["_null", "_src"]), "_n", "_seats", ["_shard"], ["_null", "_src"], "_quota")
    quotas = quotas.withColumn("_quota", F.least("_quota", max_epochs * F.col("_n")))
    order = Window.partitionBy(*cell).orderBy("_hash", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    mixed = (
        rows.join(quotas, cell)
        .withColumn("_a", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .withColumn("_rest", F.expr("if(_n > 0, _quota % _n, 0)"))
        .withColumn("_c", F.expr(f"if(_n > 0, pmod(xxhash64({seed}, _src, _shard), _n), 0)"))
    )
    chosen = f"""aggregate(sequence(_a * _n div _tokens, (_a + size - 1) * _n div _tokens), 0L, (s, i) -> s + if(
        pmod(i * {PRIME}L + _c, _n) < _rest,
        least(_a + size, ((i + 1) * _tokens + _n - 1) div _n) - greatest(_a, (i * _tokens + _n - 1) div _n), 0L))"""
    taken = F.expr(f"if(size = 0, 0L, size * (_quota div _n) + if(_rest = 0, 0L, {chosen}))")
    return own_names.show(mixed, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), taken=taken)


def op1_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
