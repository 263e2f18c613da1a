"""Models: edges, folds, k-means, logistic regression out of fold."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_edges(df: DataFrame, columns: list[str], tie: str, parts: int) -> DataFrame:
    """One row of arrays ``<column>_edges``: the order statistics at n * i // parts."""
    out = None
    for c in columns:
        ranked = df.select(c, F.row_number().over(Window.orderBy(c, tie)).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
        edges = [F.max(F.when(F.col("_i") == F.floor(F.col("_n") * i / parts) + 1, F.col(c))) for i in range(1, parts)]
        row = ranked.agg(F.array(*edges).alias(f"{c}_edges"))
        out = row if out is None else out.crossJoin(row)
    return out


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Folds of whole groups, dealt to and fro by size."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    i = F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1
    j = i % (2 * k)
    return df.join(g.select(group, F.when(j < k, j).otherwise(2 * k - 1 - j).alias("fold")), group)


def kmeans(df: DataFrame, key: str, vec: str, k: int, seed: int = 1) -> DataFrame:
    rows = df.select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_x"))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(key, "cluster")


def logistic_oof(df: DataFrame, key: str, group: str, features: list[str], label: str, folds: int) -> DataFrame:
    """Standardised logistic regression with L2, each row predicted by a model that never saw its group."""
    rows = group_folds(df.dropna(subset=[*features, label]).select(key, group, *features, label), group, folds).persist()
    made = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", regParam=0.01, maxIter=25)])
    parts = []
    for f in range(folds):
        model = made.fit(rows.where(F.col("fold") != f))
        parts.append(model.transform(rows.where(F.col("fold") == f)).select(key, "fold", F.round(vector_to_array("_p")[1], 6).alias("p")))
    return reduce(DataFrame.unionByName, parts)
