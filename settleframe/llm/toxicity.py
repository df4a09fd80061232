"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, so a misspelling shares most vectors with the word it stands for. A bag is a
run of ``SPAN`` words; a document is as toxic as its worst run, as one insult in a long text counts. Training looks at
runs: first every run of a toxic document carries its label, then only those that the model itself finds worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import least_draws
from .runtime import ready
from .textbytes import BASE, WORDLIKE, Slice, mix, powers, slices, words

SAMPLE_DOCS = 1200  # different labelled documents that are read for each label, whole, at most
BUCKETS, DIMENSIONS, GRAMS = 1 << 17, 8, (3, 4, 5)
SPAN = 6
FOLDS = 5  # of the labelled documents: a document's raw score for calibration comes from a model that hasn't seen it
ROUNDS, EPOCHS, BATCH, RATE = 3, 3, 2048, 0.5
STEPS = 16  # an epoch takes at least, so a small sample has smaller batches
RESULT = "struct<score:double,logit:double>"


def _grams(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets with their words' numbers, and each text's range of words. Texts and words are bounded by spaces."""
    found = words(piece, WORDLIKE, hashed=False)
    n = len(found.start)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), found.first
    sizes = found.end - found.start + 2
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    owner = np.repeat(np.arange(n), sizes)
    within = np.arange(total) - begin[owner]
    inner = (within > 0) & (within < sizes[owner] - 1)
    line = np.full(total, 32, dtype=np.uint64)
    line[inner] = found.low[(found.start[owner] + within - 1)[inner]]
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((line + np.uint64(1)) * powers(BASE, total))])
    back = powers(pow(BASE, -1, 1 << 64), total)
    buckets, owners = [], []
    for width in GRAMS:
        at = np.flatnonzero(within + width <= sizes[owner])
        value = mix((prefix[at + width] - prefix[at]) * back[at] + np.uint64(width))
        buckets.append((value & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners), found.first


@dataclass
class Model:
    """What scoring needs: each bucket's share in the toxic logit, the bias, and the calibration of a document's worst run."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def worst(self, piece: Slice) -> np.ndarray:
        """Each text's largest logit over its runs of words; without words that of the bias."""
        buckets, owners, first = _grams(piece)
        n = int(first[-1])
        top = np.full(piece.n, self.bias)
        if not n:
            return top
        each = np.bincount(owners, self.weight[buckets], n)
        doc = np.repeat(np.arange(piece.n), np.diff(first))
        each[1:][(each[1:] == each[:-1]) & (doc[1:] == doc[:-1])] = 0  # a word said again and again in one text counts once
        total = np.concatenate([[0.0], np.cumsum(each)])
        count = np.concatenate([[0.0], np.cumsum(np.bincount(owners, minlength=n))])
        begin = np.arange(n)
        end = np.minimum(begin + SPAN, first[doc + 1])
        begin = np.maximum(np.minimum(begin, end - SPAN), first[doc])  # the last runs are whole if the text has so many words
        runs = (total[end] - total[begin]) / np.maximum(count[end] - count[begin], 1) + self.bias
        full = np.flatnonzero(np.diff(first))
        top[full] = np.maximum.reduceat(runs, first[:-1][full])
        return top

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -30, 30)))


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training bags: bucket ids, bounds of the bags, and each bag's text. A run that a text repeats counts once.

    Small slices keep the driver's memory low.
    """
    buckets, sizes, docs = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for piece in slices(pa.array(texts, pa.string()), 1 << 18):
        ids, owners, first = _grams(piece)
        if not len(ids):
            continue
        per = -(-np.diff(first) // SPAN)
        doc = np.repeat(np.arange(piece.n), np.diff(first))
        bags = ((np.cumsum(per) - per)[doc] + (np.arange(len(doc)) - first[doc]) // SPAN)[owners]
        ids, size, of = ids[np.argsort(bags, kind="stable")], np.bincount(bags, minlength=int(per.sum())), np.repeat(np.arange(piece.n), per)
        begin = np.cumsum(size) - size
        name = np.add.reduceat(mix(ids.astype(np.uint64) + np.uint64(1)), begin)  # of the bag's n-grams in any order
        _, kept = np.unique(mix(name ^ mix(of.astype(np.uint64) + np.uint64(1))), return_index=True)
        kept.sort()
        got, size = _take(ids, np.concatenate([begin, [len(ids)]]), kept)
        buckets.append(got.astype(np.int32))
        sizes.append(size)
        docs.append(of[kept] + piece.first)
    return np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(docs)


def _means(margin: np.ndarray, ids: np.ndarray, bounds: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Each bag's mean margin; without n-grams minus infinity."""
    out = np.full(len(bounds) - 1, -np.inf)
    for k in range(0, len(out), step):
        part = bounds[k : k + step + 1]
        sums = np.concatenate([[0.0], np.cumsum(margin[ids[part[0] : part[-1]]])])
        size = np.diff(part)
        mean = (sums[part[1:] - part[0]] - sums[part[:-1] - part[0]]) / np.maximum(size, 1)
        out[k : k + step] = np.where(size > 0, mean, -np.inf)
    return out


def _take(ids: np.ndarray, bounds: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = bounds[bags + 1] - bounds[bags]
    begin = np.cumsum(sizes) - sizes
    return ids[np.repeat(bounds[bags] - begin, sizes) + np.arange(int(sizes.sum()))], sizes


def train(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Model:
    """Fit embeddings and softmax together by Adagrad, and calibrate on scores of texts by models that haven't seen them.

    Each of FOLDS models leaves out a fold; the final one learns from all. Without texts of both labels the model is flat.
    """
    toxic = np.asarray(toxic, dtype=np.int64)
    bags = _runs(texts)
    base = np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3)
    if not len(bags[0]) or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS), float(np.log(base / (1 - base))))
    fold = np.zeros(len(texts), dtype=np.int64)
    for label in (0, 1):  # each label is dealt out evenly
        own = np.flatnonzero(toxic == label)
        fold[own] = np.arange(len(own)) % FOLDS
    logit = np.full(len(texts), np.log(base / (1 - base)))
    for k in range(FOLDS):
        left_out, others = np.flatnonzero(fold == k), fold != k
        if len(left_out) and 0 < toxic[others].sum() < others.sum():
            model = _learned(*bags, toxic, others, seed)
            logit[left_out] = np.concatenate([model.worst(p) for p in slices(pa.array([texts[j] for j in left_out], pa.string()))])
    model = _learned(*bags, toxic, np.ones(len(texts), dtype=bool), seed)
    model.slope, model.offset = _calibrated(logit, toxic)
    return model


def _learned(ids: np.ndarray, bounds: np.ndarray, docs: np.ndarray, toxic: np.ndarray, used: np.ndarray, seed: int) -> Model:
    """Embeddings and softmax from the bags of the texts that are ``used``, uncalibrated."""
    draw = np.random.default_rng(seed)
    usable = np.flatnonzero(used[docs] & (np.diff(bounds) > 0))
    vectors = draw.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax, bias = draw.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    seen = np.full((BUCKETS, DIMENSIONS), 1e-6, dtype=np.float32)
    label = toxic[docs]
    for turn in range(ROUNDS):
        if turn:  # of a toxic text's runs only the worst, and those nearly as bad, stay toxic
            margin = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
            run = _means(margin, ids, bounds)
            best = np.full(len(toxic), -np.inf)
            np.maximum.at(best, docs, run)
            middle = np.median(run[np.isfinite(run)])
            label = toxic[docs] * ((run == best[docs]) | (run > middle + 0.7 * (best[docs] - middle)))
        bad, good = usable[label[usable] == 1], usable[toxic[docs[usable]] == 0]
        for _ in range(EPOCHS):
            order = draw.permutation(np.concatenate([bad, draw.choice(good, min(len(good), 6 * len(bad) + 1000), replace=False)]))
            step = min(BATCH, max(64, len(order) // STEPS))
            for k in range(0, len(order), step):
                bags = order[k : k + step]
                got, sizes = _take(ids, bounds, bags)
                mean = np.add.reduceat(vectors[got], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                z = mean @ softmax + bias
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(bags)), label[bags]] -= 1
                weight = np.where(label[bags] == 1, (label[bags] == 0).sum() / max(1, (label[bags] == 1).sum()), 1.0).clip(1, 10)[:, None]
                z = (z * weight).astype(np.float32)
                back = (z @ softmax.T) / sizes[:, None]
                softmax -= RATE * 0.1 * (mean.T @ z) / len(bags)
                bias -= RATE * 0.1 * z.mean(0)
                spread = np.repeat(np.arange(len(bags)), sizes)
                touched, where = np.unique(got, return_inverse=True)
                grad = np.stack([np.bincount(where, back[spread, d], len(touched)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
                seen[touched] += grad**2
                vectors[touched] -= RATE * 0.3 * grad / np.sqrt(seen[touched])
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on one score, by Newton steps with a small ridge."""
    scale = x.std() or 1.0
    a, b = 1.0 / scale, -x.mean() / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 1e-2 * a * scale**2, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2 * scale**2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step * [scale, 1]).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit(docs: DataFrame, marks: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``marks`` (doc_id, toxic): SAMPLE_DOCS different documents a label, drawn by a hash.

    Null texts and ids, and labels other than 0 and 1, are ignored; of an id's labels the greatest holds. A document is an
    id with a text: repeated rows count once, different texts of an id count each. The drawn documents are read whole.
    """
    of_id = marks.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id", "text", F.lit(17)).alias("draw")
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "text", draw)
    chosen = least_draws(texts.select("doc_id", "draw").join(of_id, "doc_id"), "toxic", SAMPLE_DOCS)  # ids and hashes are shuffled, not texts
    rows = texts.select("text", "draw").join(F.broadcast(chosen), "draw").groupBy("draw", "toxic").agg(F.first("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.draw, r.text))
    return train([r.text for r in rows], np.array([r.toxic for r in rows], dtype=np.int64))


def toxicity(text: Column | str, model) -> Column:
    """A struct column (score, logit) of whole texts; ``model`` is a broadcast Model. Null and empty texts have no words."""

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            logit = np.concatenate([model.value.worst(p) for p in slices(column)] or [np.zeros(0)])
            yield pa.StructArray.from_arrays([pa.array(model.value.score(logit)), pa.array(logit)], ["score", "logit"])

    return F.arrow_udf(judge, RESULT)(text)


def scored(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into`` (score, logit). The model is broadcast: BUCKETS numbers."""
    spark = ready(docs.sparkSession)
    return docs.withColumn(into, toxicity("text", spark.sparkContext.broadcast(model)))
