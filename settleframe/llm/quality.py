"""Quality: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations, the parts are added up
row by row of the matrix in Spark, and the driver solves one system of fixed size. Calibration needs only a histogram of
raw scores. Both read all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ready, written
from .textbytes import WORDLIKE, mix, slices, words

FEATURES, WIDTH, RIDGE = 192, 3.0, 1e-2
BINS = 1000  # of raw scores, for the calibration
GROUPS = 64  # partitions' sums are first added up in so many groups
NAMES = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digits", "symbols", "beyond_ascii", "spaces", "line_ends",
    "log_line_length", "distinct_words", "again", "pairs_again", "marks_by_word", "long_words",
)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = ~(_SPACE | WORDLIKE | _UPPER)


def statistics(column: pa.Array) -> np.ndarray:
    """NAMES of each whole text; a null or empty text has zeros."""
    out = np.zeros((len(column), len(NAMES)))
    for piece in slices(column):
        found, data = words(piece, WORDLIKE), piece.data
        begin, end = piece.bounds[:-1], piece.bounds[1:]
        size, n = (end - begin).astype(float), np.diff(found.first).astype(float)

        def share(mask: np.ndarray, begin=begin, end=end, size=size) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask)])
            return (sums[end] - sums[begin]) / np.maximum(size, 1)

        def mean(values: np.ndarray, first=found.first, n=n) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values)])
            return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)

        length = (found.end - found.start).astype(float)
        average = mean(length)
        doc = np.repeat(np.arange(piece.n, dtype=np.uint64), np.diff(found.first))
        same = np.zeros(len(length), dtype=bool)
        same[1:] = (found.hash[1:] == found.hash[:-1]) & (doc[1:] == doc[:-1])
        pairs = mix(np.concatenate([found.hash[:-1] * np.uint64(3) + found.hash[1:], found.hash[-1:]]))
        lines, symbols = share(data == 10), share(_SYMBOL[data])
        rows = out[piece.first : piece.first + piece.n]
        rows[:, 0], rows[:, 1], rows[:, 2] = np.log1p(size), np.log1p(n), average
        rows[:, 3] = np.sqrt(np.maximum(mean(length**2) - average**2, 0))
        rows[:, 4], rows[:, 5], rows[:, 6] = share(_UPPER[data]), share(_DIGIT[data]), symbols
        rows[:, 7], rows[:, 8], rows[:, 9] = share(data >= 128), share(_SPACE[data]), lines
        rows[:, 10] = np.log1p(size / (1 + lines * size))
        rows[:, 11] = _distinct(found.hash, found.first) / np.maximum(n, 1) * np.log1p(n)
        rows[:, 12], rows[:, 13] = mean(same), 1 - _distinct(pairs, found.first) / np.maximum(n, 1)
        rows[:, 14], rows[:, 15] = symbols * size / np.maximum(n, 1), mean(length > 15)
        rows[size == 0] = 0
    return out


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(values[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], dtype=float)


def described(text: Column | str) -> Column:
    """An array column of the statistics."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = statistics(column)
            bounds = np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(rows.ravel()))

    return F.arrow_udf(run, "array<double>")(text)


@dataclass
class Model:
    """Standardisation, kernel features, ridge weights, and the steps of the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.centre) / self.scale, -5, 5)
        draw = np.random.default_rng(11)
        waves, turns = draw.normal(0, 1 / WIDTH, (len(NAMES), FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES)
        return np.concatenate([np.ones((len(z), 1)), z, np.cos(z @ waves + turns) * np.sqrt(2 / FEATURES)], axis=1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.features(rows) @ self.weight, 0, 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.at, self.value)


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), len(NAMES))


def _sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 + len(NAMES) + FEATURES
        total = np.zeros((size, size + 1))
        for batch in batches:
            x, y = model.features(_rows(batch.column(0))), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=float)
            total += x.T @ np.concatenate([x, y[:, None]], axis=1)
        bounds = np.arange(0, total.size + 1, size + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(total.ravel()))], ["i", "sums"])

    return run


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [parts["i"].iloc[0]], "sums": [np.sum(np.stack(parts["sums"].to_list()), axis=0)]})


def _monotone(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(labelled: DataFrame) -> Model:
    """A model from all (stats, quality) rows; rows with a null, or a quality other than 0 and 1, are ignored. Without rows every score is 0.5."""
    spark = ready(labelled.sparkSession)
    rows = labelled.select("stats", "quality").where("stats is not null and quality in (0, 1)")
    of = [F.col("stats")[k] for k in range(len(NAMES))]
    first = rows.agg(F.count(F.lit(1)), F.avg("quality"), *[F.avg(x) for x in of], *[F.stddev_pop(x) for x in of]).first()
    size = len(NAMES)
    model = Model(np.zeros(size), np.ones(size), np.zeros(1 + size + FEATURES), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not first[0]:
        return model
    model.centre, spread = np.array(first[2 : 2 + size]), np.array(first[2 + size :])
    model.scale = np.where(spread > 1e-9, spread, 1.0)
    shape = "i long, sums array<double>"
    parts = rows.mapInArrow(_sums(model), shape).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    groups = parts.groupBy("i", "group").applyInPandas(_added, shape)
    sums = groups.groupBy("i").applyInPandas(_added, shape).collect()
    total = np.array([r.sums for r in sorted(sums)])
    gram, right = total[:, :-1], total[:, -1]
    model.weight = np.linalg.solve(gram + RIDGE * first[0] / len(gram) * np.eye(len(gram)), right)
    raw = rows.select(raw_score("stats", spark.sparkContext.broadcast(model)).alias("raw"), "quality")
    bins = raw.groupBy(F.floor(F.col("raw") * BINS).alias("bin")).agg(F.avg("raw").alias("at"), F.avg("quality").alias("value"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    model.at = np.array([b["at"] for b in bins])
    model.value = _monotone(np.array([b["value"] for b in bins]), np.array([b["n"] for b in bins]))
    return model


def raw_score(stats: Column | str, model) -> Column:
    return F.arrow_udf(lambda column: pa.array(model.value.raw(_rows(column))), "double")(stats)


def quality_score(stats: Column | str, model) -> Column:
    """Scores from 0 to 1 of statistics (a non-null array column); ``model`` is a broadcast Model."""
    return F.arrow_udf(lambda column: pa.array(model.value.score(_rows(column))), "double")(stats)


def text_score(text: Column | str, model) -> Column:
    """Scores of whole texts in one pass: as ``quality_score(described(text), model)``, but with one Python worker a task instead of two."""
    return F.arrow_udf(lambda column: pa.array(model.value.score(statistics(column))), "double")(text)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written once for fitting and scoring."""
    ready(docs.sparkSession)
    return written(docs.select("doc_id", described("text").alias("stats")), "statistics")


def fit_labels(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of ``stats`` that ``labels`` (doc_id, quality) covers; of an id's labels the greatest holds."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return fit(stats.select("doc_id", "stats").join(marks, "doc_id"))


def scored(stats: DataFrame, model: Model, into: str = "score") -> DataFrame:
    return stats.withColumn(into, quality_score("stats", ready(stats.sparkSession).sparkContext.broadcast(model)))
