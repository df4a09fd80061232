"""Batches of a stream, merged by levels: a read meets as many folders as the number of batches has bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.manifest import Manifest, Run


class Levels:
    """A table in ``folder`` that batches are added to.

    A batch is a run of level 0; two runs of one level are merged into one of the next, as in counting. What is written
    for a batch takes effect with its manifest alone: a batch that failed before it is written again, one that runs again
    after it changes nothing. ``write`` may lay a run out (and says with how many bits of buckets); by default it is Parquet.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str, int], int] | None = None):
        self.spark, self.folder, self.schema, self.merge, self.write = spark, folder.rstrip("/"), schema, merge, write
        self.manifest = Manifest(spark, folder)

    def read(self, runs: list[Run] | None = None) -> DataFrame:
        """All rows of the runs, unmerged: each at most 1 + log2(batches) times."""
        runs = self.manifest.runs() if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*self.manifest.paths(runs))

    def holds(self, batch: int) -> bool:
        return any(r.first <= batch <= r.last for r in self.manifest.runs())

    def _written(self, rows: DataFrame, first: int, last: int, level: int, count: int | None) -> Run:
        name = f"run-{level}-{first}-{last}"
        path = f"{self.folder}/{name}"
        if self.write:
            return Run(name, first, last, level, count, self.write(rows, path, count))
        rows.write.mode("overwrite").parquet(path)
        return Run(name, first, last, level, self.spark.read.schema(self.schema).parquet(path).count())

    def add(self, batch: int, rows: DataFrame) -> None:
        """Add a batch, in one step with all runs that it is merged with. Batches come in ascending order.

        With ``write``, ``rows`` should be cheap to read twice, as they are counted first; else what was written is counted.
        """
        if self.holds(batch):
            return
        runs, old = self.manifest.runs(), []
        while runs and runs[-1].level == len(old):
            old.insert(0, runs.pop())
        count = sum(r.rows for r in old) + rows.count() if self.write else None
        both = self.merge(self.read(old).unionByName(rows)) if old else rows
        runs.append(self._written(both, old[0].first if old else batch, batch, len(old), count))
        self.manifest.commit(runs)
