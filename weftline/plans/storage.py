"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The named folder; only where none is named, and the session is local (tests), a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
        named = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/crawl/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that go when the block ends; what is needed longer is written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for p in self.paths:
            remove(self.spark, p)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and reread: lineage ends here, and a lost executor loses nothing."""
        path = fresh(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and reread for good."""
    return Scratch(df.sparkSession).stored(df, name)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files give fewer parts than there are: for work that costs more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
