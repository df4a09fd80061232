"""Tables that are written once and read several times, in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local session gets a folder of its own, on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """One folder for all that an application stores for itself: whoever runs it may delete it when the application has ended."""
    return f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps read it instead of making it again."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
