"""Small tables that several steps derive from are written once, so that plans over them stay small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where it is unset, a folder of our own on one machine, an error on a cluster."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="tabwarden-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
