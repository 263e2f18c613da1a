"""The pipeline's stages on the small tables."""

import corpus_pipeline as P
from gaugeline.llm import simhash
from tests.conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "mixing":
            assert out.columns == columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        counts.append(docs.count())
        if name == "near_dedup":
            named = simhash.cluster(docs)
            assert named.select("component_id").distinct().count() == docs.count()
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] >= counts[5] > 0.5 * counts[0]
