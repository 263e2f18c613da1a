"""Helpers that the training-data operators share: the shared folder, cutting lineage, held-out folds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a temporary one in local mode, as in tests; on a cluster, an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = spark.conf.get("spark.gaugeline.shared", None)
    if not made:
        folder = tempfile.mkdtemp(prefix="gaugeline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        made = "file://" + folder
        spark.conf.set("spark.gaugeline.shared", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table in the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Hidden:
    """A table under column names of our own (``df``), so that no name of an operator clashes with one of the caller's."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"_u{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """Our name of a column of the caller's (exact, else without regard to case as Spark resolves it)."""
        if name in self.names:
            return f"_u{self.names.index(name)}"
        return f"_u{[n.lower() for n in self.names].index(name.lower())}"

    def show(self, df: DataFrame, *, put: dict[str, Column] | None = None, **added: Column) -> DataFrame:
        """The caller's columns with those of ``put`` in place, then ``added`` ones, which replace columns of their names."""
        put = {n.lower(): c for n, c in (put or {}).items()}
        gone = {n.lower() for n in added}
        kept = [put.get(n.lower(), F.col(f"_u{i}")).alias(n) for i, n in enumerate(self.names) if n.lower() not in gone]
        return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def fold(id_col: str | Column) -> Column:
    """crc32 of the id's text, mod 5; a null id counts as the empty text (remainder 0)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
