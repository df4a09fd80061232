"""Which keys a table has, in hash buckets: a batch reads only the buckets that its own keys fall into.

The index is a ``Levels`` table. A run has so many buckets that each holds about PER_BUCKET keys, sorted, in a folder of
its own with Bloom filters, so a read skips the other buckets' folders and, inside a file, row groups without the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .levels import Levels

PER_BUCKET, MOST_BITS = 50_000, 14
KEYS = "key string"


def bucket(key: Column | str, bits: int) -> Column:
    """The bucket of a key among 2**bits; a bucket is split in two by one more bit."""
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")


def _bucketed(rows: DataFrame, path: str, count: int) -> int:
    bits = min(MOST_BITS, max(0, (count // PER_BUCKET).bit_length()))
    keyed = rows.select("key", bucket("key", bits).alias("bucket")).repartition(1 << min(bits, 10), "bucket").sortWithinPartitions("bucket", "key")
    keys = max(PER_BUCKET, count >> bits)  # of a bucket; a filter whose keys aren't told takes 1 MB, more than they do
    bloom = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": keys}
    keyed.write.mode("overwrite").options(compression="zstd", **bloom).partitionBy("bucket").parquet(path)
    return bits


class KeyIndex:
    """The keys of the batches that were added to ``folder``. Keys are strings and not null."""

    def __init__(self, spark: SparkSession, folder: str):
        self.levels = Levels(spark, folder, KEYS, merge=lambda both: both, write=_bucketed)

    def holds(self, batch: int) -> bool:
        return self.levels.holds(batch)

    def add(self, batch: int, keys: DataFrame) -> None:
        """Remember ``keys`` (key), all of them new, as those of a batch."""
        self.levels.add(batch, keys)

    def candidates(self, keys: DataFrame, but: int | None = None) -> DataFrame:
        """Stored keys of the buckets that ``keys`` (key) fall into.

        Only so many keys' buckets pass the driver as tell that they fall into nearly all: four times the buckets. If there
        are more keys, all buckets are read, so of a large batch only the first rows are looked at beforehand.
        """
        spark, parts = self.levels.spark, []
        runs = [r for r in self.levels.manifest.runs() if r.rows and not (r.first == r.last == but)]
        finest = max([r.bits for r in runs], default=0)
        most = 4 << finest
        touched = [r[0] for r in keys.where("key is not null").select(bucket("key", finest)).take(most)] if runs else []
        touched = set(touched if len(touched) < most else range(1 << finest))
        for run, path in zip(runs, self.levels.manifest.paths(runs), strict=True):
            own = sorted({b % (1 << run.bits) for b in touched})
            stored = spark.read.schema(f"{KEYS}, bucket int").option("basePath", path).parquet(path)
            parts.append(stored.where(F.col("bucket").isin(own)).select("key"))
        return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], KEYS))

    def known(self, keys: DataFrame, but: int | None = None) -> DataFrame:
        """Those of ``keys`` (key) that are stored."""
        return self.candidates(keys, but).join(keys.select("key"), "key", "left_semi")
