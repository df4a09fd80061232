"""Session plumbing shared by the operators: importable workers, a shared scratch folder, cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 2000  # rows of text that go to Python at once, if the session has Spark's own setting for narrow rows (10,000)

HOT, HOT_KEYS = 100_000, 1_000_000  # rows of a key that one task takes at most in a join; keys beyond it that are broadcast at most


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where the driver was started from another folder, and keep batches of texts small."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, TEXT_ROWS)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own.

    On a cluster executors would each write to their own disk, so there an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing will read it again."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, single: DataFrame, key: str, hot: int | None) -> DataFrame:
    """Inner join of ``rows`` to ``single``, one row a key, whose column n is at least the key's number of rows.

    Keys with n > ``hot`` are broadcast, so their rows aren't shuffled into one task; the caller picks ``hot`` so that there
    are at most HOT_KEYS of them. None: no key is that large. n is not in the result.
    """
    if hot is None:
        return rows.join(single.drop("n"), key)
    large = F.broadcast(single.where(F.col("n") > hot).drop("n"))
    others = rows.join(F.broadcast(single.where(F.col("n") > hot).select(key)), key, "left_anti")
    return rows.join(large, key).unionByName(others.join(single.where(F.col("n") <= hot).drop("n"), key))


def hot_beyond(rows: int, most: int) -> int | None:
    """``hot`` for ``rows`` rows, of which a key has ``most`` or fewer: None if no key has more than HOT.

    Fewer than HOT_KEYS keys can have more rows than ``hot``.
    """
    return max(HOT, rows // HOT_KEYS) if most > HOT else None
