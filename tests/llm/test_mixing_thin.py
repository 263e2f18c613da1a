"""Thin sources of short texts beside a huge one get their targets."""

import pytest
from pyspark.sql import functions as F

from gaugeline.llm import mixing


def test_a_thin_source_gets_its_target(spark):
    huge = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.lit("huge").alias("source"))
    thin = spark.range(60_000, 60_250).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 8).alias("text"), F.lit("thin").alias("source"))
    least = spark.range(70_000, 70_002).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("tiny").alias("source"))
    rows = mixing.mix_sources(huge.union(thin).union(least)).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    got = {r["source"]: (r["target"], r["taken"]) for r in rows}
    assert got["thin"][0] == 6000 and got["thin"][1] == pytest.approx(6000, rel=0.03)
    assert got["tiny"] == (30, 30) and got["huge"][1] == pytest.approx(got["huge"][0], rel=0.001)
