"""Sources and sinks: ids from file names, positional JSON tables, nested documents, schema-stable rows, fingerprints."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(ddl: str) -> T.StructType:
    """A schema from "name type, ..." without a session."""
    kind = lambda k: T.ArrayType(_KINDS[k[6:-1]]) if k.startswith("array<") else _KINDS[k]
    return T.StructType([T.StructField(n, kind(k)) for n, k in (x.split() for x in ddl.split(", "))])


PULLS = _schema("pull_id string, arm string, round_j int, slot string, B int, demo_ids array<bigint>, dataset_path string, per_repeat_means array<double>, overall_mean double, delta double, per_stratum_means_json string, status string, note string, started_at string, finished_at string")
EPISODES = _schema("episode_id string, phase string, arm string, pull_id string, policy_id string, start_id string, repeat_idx int, success boolean, failure_stage string, ee_min_dist double, max_lift double, min_sink_dist double, steps int, wall_time_s double, category string, h double, w double, x_rel double, y_rel double, side int, yaw double, layout_id int, style_id int")


def path_part(pattern: str, group: int = 1) -> Column:
    """A capture of the row's file path; NULL where it doesn't match."""
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern, group)
    return F.when(found != "", found)


def read_episode_files(spark: SparkSession, path: str, pattern: str = r"episode_(\d+)") -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path).withColumn("episode", path_part(pattern).cast("long"))


def read_csv_coerced(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strings cast to the schema; whatever doesn't parse, and NaN, is NULL."""
    kinds = _schema(schema)
    raw = spark.read.csv(path, header=True)
    nan = lambda c: F.when(~F.isnan(c), c)
    casts = [F.col(f.name).try_cast(f.dataType) for f in kinds]
    return raw.select(*[(nan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name) for f, c in zip(kinds, casts, strict=True)])


def read_nested(spark: SparkSession, path: str, field: str = "episodes") -> DataFrame:
    """One row for each element of a document's list."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode(field).alias("_e")).select("_e.*")


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """{"fields": [...], "rows": [[...]], "cats": [{...}]} with ``cat`` an index of cats: one row each, ``category`` decoded."""
    doc = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "fields array<string>, rows array<array<double>>, cats array<struct<name: string>>").alias("d")).select("d.*")
    rows = doc.select("fields", "cats", F.explode("rows").alias("r"))
    names = doc.select("fields").first()[0]
    out = rows.select("cats", *[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out.withColumn("category", F.get("cats", F.col("cat").cast("int"))["name"]).drop("cats") if "cat" in names else out.drop("cats")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One row a line; blank lines are skipped, lines that don't parse raise an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def run_parts(pattern: str, names: list[str]) -> list[Column]:
    """Captures of the file path as columns, such as N and seed of ``N(\\d+)_seed(\\d+)``; NULL where it doesn't match."""
    return [path_part(pattern, i).alias(n) for i, n in enumerate(names, 1)]


def read_runs(spark: SparkSession, root: str, file: str, pattern: str, names: list[str], schema: str) -> DataFrame:
    """JSON results ``file`` anywhere under ``root`` with the parts of their constructed run names; files of other names are left out."""
    docs = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", file).json(root)
    parts = run_parts(pattern, names)
    return docs.select(*parts, *[F.col(c) for c in docs.columns]).where(F.col(names[0]).isNotNull())


def discover_results(spark: SparkSession, root: str) -> DataFrame:
    """(model, kind, task, rate, n) of every result file under ``root``, whose first folder names the model.

    ``eval_log.json`` (kind dp): the task and rate of its ``success_rate/<task>`` key, n its ``test/sim_max_reward_`` keys.
    ``stats.json`` (kind pi0): its ``success_rate`` and ``num_episodes``; the task is the folder two levels up. Ordered by nothing.
    """
    base = root.rstrip("/").rpartition("/")[2]
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "{eval_log,stats}.json").text(root)
    doc = files.select(F.from_json("value", "map<string,string>").alias("d"), F.col("_metadata.file_path").alias("path"), path_part(f"/{base}/([^/]+)/").alias("model"))
    logged = F.filter(F.map_keys("d"), lambda k: k.startswith("success_rate/"))
    dp, key = F.col("path").endswith("/eval_log.json"), F.get(logged, F.lit(0))
    return doc.select(
        "model",
        F.when(dp, "dp").otherwise("pi0").alias("kind"),
        F.when(dp, F.coalesce(F.substring_index(key, "/", -1), F.lit("?"))).otherwise(F.get(F.reverse(F.split("path", "/")), F.lit(2))).alias("task"),
        F.try_element_at("d", F.when(dp, F.coalesce(key, F.lit("?"))).otherwise("success_rate")).try_cast("double").alias("rate"),
        F.when(dp, prefixed_count("d", "test/sim_max_reward_")).otherwise(F.try_element_at("d", F.lit("num_episodes")).try_cast("int")).alias("n"),
    )


def write_json_atomic(spark: SparkSession, value: object, path: str) -> None:
    """One small JSON document: written beside its place through Hadoop's file system, then renamed, so readers never see half of it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kind = jvm.org.apache.hadoop.fs.FileContext
    rename, create = jvm.org.apache.hadoop.fs.Options.Rename, jvm.org.apache.hadoop.fs
    target, beside = create.Path(path), create.Path(path + ".tmp")
    out = target.getFileSystem(conf).create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode("utf-8")))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    kind.getFileContext(target.toUri(), conf).rename(target.getFileSystem(conf).makeQualified(beside), target.getFileSystem(conf).makeQualified(target), over)


def write_first_episodes(frames: DataFrame, n: int, path: str) -> None:
    """The episodes below n, by the index's own filter, so other row groups aren't read."""
    frames.where(F.col("episode_index") < n).write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, most: int = 1000, digits: int = 4) -> str:
    """A report table of a small result; over ``most`` rows is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: aggregate before reporting")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def prefixed_count(map_col: str, prefix: str) -> Column:
    return F.size(F.map_filter(map_col, lambda k, v: k.startswith(prefix)))


def stable(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order; missing ones are NULL."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def subset(frames: DataFrame, chosen: DataFrame, order: str = "position") -> DataFrame:
    """Frames of the chosen episodes (first occurrence of each), renumbered densely, with a running global index."""
    w = Window.partitionBy("episode_index").orderBy(order)
    ids = chosen.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("new_episode", F.row_number().over(Window.orderBy(order)) - 1)
    sizes = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("_n")).join(ids.select("episode_index", "new_episode"), "episode_index")
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("new_episode").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = frames.join(starts.select("episode_index", "new_episode", "_start"), "episode_index")
    return out.withColumn("index", F.col("_start") + F.col("frame_index")).withColumn("episode_index", F.col("new_episode")).drop("new_episode", "_start")
