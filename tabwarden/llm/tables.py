"""Reading the corpus tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where it is unset, as in tests, a folder of our own on one machine, an error on a cluster."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="tabwarden-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """As `written`, with aggregates of `df` that are taken as it is written."""
    seen = Observation()
    out = written(df.observe(seen, *(measures or (F.count(F.lit(1)).alias("n"),))), name)
    return out, seen.get


def held_out(id_col: str, parts: int, part: int = 2):
    """crc32 of the id as text, modulo `parts`, is `part`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
