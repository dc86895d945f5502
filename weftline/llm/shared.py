"""Where intermediate tables go: the shared folder the cluster names.

``spark.checkpoint.dir`` is read from the session.  Only where it is unset and the
session is local (tests) a temporary folder is created and set as checkpoint folder; on a
cluster that is an error.
Intermediate tables are written there as Parquet and read back, which cuts
lineage and survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a fresh temporary one where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are removed when the block ends; what is needed longer is ``written``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for p in self.paths:
            remove(self.spark, p)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def flattened(df: DataFrame) -> DataFrame:
    """``df`` with columns named by place, c0, c1 and so on: no name can clash, whatever the case and signs of the old ones."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, the first of each, beside which others may differ in case only."""
    at = {n: df.columns.index(n) for n in names if n in df.columns}
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"no column {', '.join(missing)}")
    return flattened(df).select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
