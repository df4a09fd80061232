"""Language-model scoring: a hashed maximum-entropy model over classes of words, and an exact unigram base.

The words that occur most are classes of their own, the other words are classed by their last two bytes, so unseen words
have a class too. A class is found in two softmax steps of SIDE choices. Each step adds up hashed features of the history:
the word before, the two words before together, and the skips to the second and third word before. Inside a class a word
has its smoothed share of the class's count, and one share is left for unseen words, so the probabilities add up to one.

Training reads every document outside the held-out fold: in each round each partition takes minibatch steps from the
shared model on its documents, and its changes, weighted by how often it met a feature, are added up in Spark. Counts
cover all documents. The HEAD most frequent words are looked up in a broadcast table, all others by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ready, removed, written
from .textbytes import NOT_SPACE, Slice, mix, slices, words

FOLD, HELD = 5, 1
SIDE = 16  # choices of a softmax step; SIDE * SIDE classes, the first half of them single words
SINGLE = SIDE * SIDE // 2
BITS = (15, 16)  # rows of features of the two steps, as powers of two
RATE, ROUNDS = 0.4, 2
HEAD = 1 << 20  # words in the broadcast table, at most: 40 MB
SLAB_TOKENS = 1 << 21  # tokens that are counted together in a task
ROWS = 512  # of features, in a row that partitions send
END, BEFORE = (int(x) for x in mix(np.array([1, 2], dtype=np.uint64)))  # the end of a text, and what comes before its first word
_ODD = [int(x) | 1 for x in mix(np.arange(11, 21, dtype=np.uint64))]
_U = np.uint64
_ONES = np.ones(SIDE, dtype=np.float32)


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves HELD over FOLD; a null id is held out, so nothing is learned from it."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLD == HELD, F.lit(True))


@dataclass
class Tokens:
    """Tokens of a slice: hashes, classes by spelling, each one's text, each text's first token, and places in the text."""

    hash: np.ndarray
    spelled: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    place: np.ndarray


def tokens(piece: Slice) -> Tokens:
    """The words of each text in lower case, then its end."""
    found = words(piece, NOT_SPACE)
    n, texts = len(found.start), np.arange(piece.n)
    count = np.diff(found.first)
    begin = found.first[:-1] + texts
    doc = np.repeat(texts, count + 1)
    hashes, spelled = np.full(n + piece.n, END, dtype=np.uint64), np.full(n + piece.n, SINGLE, dtype=np.int16)
    at = np.arange(n) + np.repeat(texts, count)
    hashes[at] = found.hash
    last = found.low[found.end - 1].astype(np.int64)
    second = np.where(found.end - found.start > 1, found.low[np.maximum(found.end - 2, 0)], 0).astype(np.int64)
    spelled[at] = _SPELLING[last] * SIDE + _SECOND[second] + SINGLE
    return Tokens(hashes, spelled, doc, begin, np.arange(n + piece.n) - begin[doc])


_SPELLING = (mix(np.arange(1, 257, dtype=np.uint64)) % _U(SIDE // 2)).astype(np.int64)
_SECOND = (mix(np.arange(1001, 1257, dtype=np.uint64)) % _U(SIDE)).astype(np.int64)


def _history(t: Tokens) -> list[np.ndarray]:
    """A number for each feature of each token's history."""

    def earlier(k: int) -> np.ndarray:
        out = np.full(len(t.hash), BEFORE, dtype=np.uint64)
        out[k:] = np.where(t.place[k:] >= k, t.hash[:-k], _U(BEFORE))
        return out

    one, two, three = (earlier(k) for k in (1, 2, 3))
    return [one * _U(_ODD[0]), one * _U(_ODD[1]) + two * _U(_ODD[2]), two * _U(_ODD[3]), three * _U(_ODD[4])]


@dataclass
class Model:
    """Weights of both steps, the classes' first shares, and the single words by class."""

    single: np.ndarray  # hashes of the words that are classes of their own
    bias: tuple[np.ndarray, np.ndarray]
    weight: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: tuple(np.zeros((1 << b, SIDE), dtype=np.float32) for b in BITS))

    def __post_init__(self) -> None:
        for k in range(5, 10_000):  # a multiplier that sends the single words to places of their own
            odd = int(mix(np.array([k], dtype=np.uint64))[0]) | 1
            place = (self.single * _U(odd)) >> _U(48)
            if len(np.unique(place)) == len(place):
                break
        self.odd, self.table = odd, np.full(1 << 16, -1, dtype=np.int16)
        self.table[place.astype(np.int64)] = np.arange(len(self.single))

    def classes(self, t: Tokens) -> np.ndarray:
        at = self.table[((t.hash * _U(self.odd)) >> _U(48)).astype(np.int64)]
        return np.where((at >= 0) & (self.single[at] == t.hash), at, t.spelled).astype(np.int64) if len(self.single) else t.spelled.astype(np.int64)

    def steps(self, t: Tokens) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
        """Of each softmax step: its number, rows of features, log probabilities of all choices, and the choice taken."""
        chosen, history = self.classes(t), _history(t)
        first = chosen // SIDE
        salt = (first + 1).astype(np.uint64) * _U(_ODD[5])
        for k, (rows, bias, choice) in enumerate((
            ([(h >> _U(64 - BITS[0])).astype(np.int64) for h in history], self.bias[0], first),
            ([(((h ^ salt) * _U(_ODD[6])) >> _U(64 - BITS[1])).astype(np.int64) for h in history], self.bias[1][first], chosen % SIDE),
        )):
            z = self.weight[k].take(rows[0], axis=0)
            z += bias
            for r in rows[1:]:
                z += self.weight[k].take(r, axis=0)
            np.clip(z, -40, 40, out=z)
            z -= np.log(np.exp(z) @ _ONES)[:, None]
            yield k, rows, z, choice

    def log_classes(self, t: Tokens) -> np.ndarray:
        """log10 of the probability of each token's class after its history."""
        out = np.zeros(len(t.hash))
        for _, _, z, choice in self.steps(t):
            out += z[np.arange(len(z)), choice]
        return out / np.log(10.0)


class Learner:
    """A partition's model: minibatch steps with rates that shrink by feature."""

    def __init__(self, model: Model):
        self.model = Model(model.single, tuple(b.copy() for b in model.bias), tuple(w.copy() for w in model.weight))
        self.seen = [np.full_like(w, 1.0) for w in model.weight]
        self.met = [np.zeros(len(w)) for w in model.weight]

    def step(self, t: Tokens) -> None:
        for k, rows, z, choice in self.model.steps(t):
            slope = np.exp(z, out=z)
            slope[np.arange(len(z)), choice] -= 1
            weight, at = self.model.weight[k], np.concatenate(rows)
            change = np.empty_like(weight)
            for c in range(SIDE):
                change[:, c] = np.bincount(at, np.tile(slope[:, c].astype(np.float64), len(rows)), len(weight))
            self.met[k] += np.bincount(at, minlength=len(weight))
            self.seen[k] += change * change
            change *= RATE
            change /= np.sqrt(self.seen[k])
            weight -= change


class Lookup:
    """Places of hashes in a sorted array, by their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(1, min(20, len(hashes).bit_length()))
        self.first = np.searchsorted(hashes >> _U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, -1 where it isn't there."""
        lead = (wanted >> _U(64 - self.bits)).astype(np.int64)
        at, stop = self.first[lead], self.first[lead + 1]
        behind = np.flatnonzero(at < stop)
        while len(behind):
            behind = behind[self.hashes[at[behind]] < wanted[behind]]
            at[behind] += 1
            behind = behind[at[behind] < stop[behind]]
        inside = at < stop
        out = np.full(len(wanted), -1, dtype=np.int32)
        out[inside] = np.where(self.hashes[at[inside]] == wanted[inside], at[inside], -1)
        return out


# ---- counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, held) to counts of tokens by hash, for so many tokens at once that memory is bounded."""
    held: list[tuple[np.ndarray, np.ndarray, bool]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        for out in (False, True):
            if not (mine := [x for x in held if x[2] == out]):
                continue
            hashes, first, n = np.unique(np.concatenate([x[0] for x in mine]), return_index=True, return_counts=True)
            spelled = np.concatenate([x[1] for x in mine])[first]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n * (not out)), pa.array(n), pa.array(spelled.astype(np.int32))], ["hash", "train", "total", "spelled"])
        held.clear()

    for batch in batches:
        for piece in slices(batch.column(0)):
            t, out = tokens(piece), batch.column(1).slice(piece.first, piece.n).to_numpy(zero_copy_only=False)[:]
            apart = out[t.doc]
            for side in (False, True):
                if (pick := apart == side).any():
                    held.append((t.hash[pick], t.spelled[pick], side))
            if sum(len(x[0]) for x in held) >= SLAB_TOKENS:
                yield from flush()
    yield from flush()


@dataclass
class Counts:
    """Counts of all tokens: a written table, and what of it is bounded in size."""

    table: DataFrame  # hash, train, total, spelled
    tokens: int  # in training texts
    kinds: int  # of them
    head: dict[str, np.ndarray]  # the HEAD most frequent
    rest: bool  # whether there are more
    single: np.ndarray
    class_tokens: np.ndarray  # in training texts, by class
    class_kinds: np.ndarray


def count(docs: DataFrame) -> Counts:
    """Count the tokens of all ``docs`` (text, held). Only tables of bounded size come to the driver: HEAD words, and one row a class."""
    partial = docs.mapInArrow(_counted, "hash bigint, train bigint, total bigint, spelled int")
    table = written(partial.groupBy("hash").agg(F.sum("train").alias("train"), F.sum("total").alias("total"), F.max("spelled").alias("spelled")), "tokens")
    single = [r.hash for r in table.where("train > 0").orderBy(F.desc("train"), "hash").limit(SINGLE).select("hash").collect()]
    by_total = table.groupBy("total").count().orderBy(F.desc("total")).limit(HEAD).collect()  # counts that occur: few, and HEAD of them hold HEAD words
    least, n = None, 0
    for r in by_total:
        n += r["count"]
        if n > HEAD:
            break
        least = r.total
    rest = n > HEAD or len(by_total) == HEAD
    head = table.where(F.col("total") >= least).toArrow() if least is not None else table.limit(0).toArrow()
    order = np.argsort(head["hash"].to_numpy().view(np.uint64))
    head = {c: head[c].to_numpy()[order] for c in head.column_names}
    apart = F.array_position(F.array(*[F.lit(x) for x in single]), F.col("hash")).cast("int") - 1 if single else F.lit(-1)
    by_class = table.where("train > 0").groupBy(F.when(apart >= 0, apart).otherwise(F.col("spelled")).alias("class")).agg(F.sum("train").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    tokens_of, kinds_of = np.zeros(SIDE * SIDE, dtype=np.int64), np.zeros(SIDE * SIDE, dtype=np.int64)
    for r in by_class:
        tokens_of[r["class"]], kinds_of[r["class"]] = r.n, r.kinds
    return Counts(table, int(tokens_of.sum()), int(kinds_of.sum()), head, rest, np.array(single, dtype=np.int64).view(np.uint64), tokens_of, kinds_of)


def first_model(counts: Counts) -> Model:
    """A model of the classes' shares alone, smoothed by half a token a class."""
    share = (counts.class_tokens + 0.5).reshape(SIDE, SIDE)
    first = share.sum(1)
    return Model(counts.single, (np.log(first / first.sum()).astype(np.float32), np.log(share / first[:, None]).astype(np.float32)))


# ---- training


def _learned(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(model.value)
        for batch in batches:
            for piece in slices(batch.column(0)):
                learner.step(tokens(piece))
        for k, (new, old, met) in enumerate(zip(learner.model.weight, model.value.weight, learner.met, strict=True)):
            change = (new - old) * met[:, None]
            for at in range(0, len(new), ROWS):
                if met[at : at + ROWS].any():
                    row = [[k], [at], [change[at : at + ROWS].ravel()], [met[at : at + ROWS]]]
                    yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.list_(pa.float32())), pa.array(row[3], pa.list_(pa.float32()))], ["step", "at", "change", "met"])

    return run


_CHANGES = "step int, at int, change array<float>, met array<float>"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by (step, at): one pair of arrays for each is held, however many partitions have sent some."""
    sums: dict[tuple[int, int], list[np.ndarray]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        keys, parts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), (batch.column(2), batch.column(3))
        for r, key in enumerate(keys):
            new = [p[r].values.to_numpy().astype(np.float64) for p in parts]
            have = sums.setdefault(key, [np.zeros(len(x)) for x in new])
            for a, b in zip(have, new, strict=True):
                a += b
    for (k, at), (change, met) in sums.items():
        arrays = [pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([change.astype(np.float32)], pa.list_(pa.float32())), pa.array([met.astype(np.float32)], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(arrays, schema.names)


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """``model`` after ``rounds`` rounds over ``docs`` (text, turn); a round takes the documents whose turn it is.

    Without documents the model stays as it is.
    """
    spark = docs.sparkSession
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        changes = docs.where(F.col("turn") == turn).select("text").mapInArrow(_learned(sent), _CHANGES)
        total = changes.repartition(F.col("step"), F.col("at")).mapInArrow(_added, _CHANGES).collect()
        weight = tuple(w.copy() for w in model.weight)
        for r in total:
            met = np.array(r.met, dtype=np.float32)[:, None]
            weight[r.step][r.at : r.at + ROWS] += np.array(r.change, dtype=np.float32).reshape(-1, SIDE) / np.maximum(met, 1)
        model = Model(model.single, model.bias, weight)
        sent.unpersist()
    return model


# ---- scoring


@dataclass
class Scorer:
    """All that scoring needs: the model, the most frequent words with their values, and what unseen words give."""

    model: Model
    lookup: Lookup
    base: np.ndarray
    inside: np.ndarray
    known: np.ndarray
    unseen_base: float
    unseen_inside: np.ndarray  # by class
    rest: bool


def scorer(model: Model, counts: Counts) -> Scorer:
    """Values of words: log10 of (c + 0.5) over all tokens, and over their class's."""
    head = counts.head
    below = counts.tokens + 0.5 * (counts.kinds + 1)
    class_below = np.log10(counts.class_tokens + 0.5 * (counts.class_kinds + 1))
    single = np.isin(head["hash"].view(np.uint64), counts.single)
    over = np.log10(head["train"] + 0.5)
    inside = np.where(single, 0.0, over - class_below[head["spelled"]])
    return Scorer(model, Lookup(head["hash"].view(np.uint64)), over - np.log10(below), inside, head["train"] > 0, float(np.log10(0.5 / below)), np.log10(0.5) - class_below, counts.rest)


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rest array<bigint>"


def _scored(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = shared.value
        for batch in batches:
            parts = [_of_piece(s, piece) for piece in slices(batch.column("text"))]
            if not parts:
                continue
            tokens_, known, base, score, lists = zip(*parts, strict=True)
            rest = pa.chunked_array([pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(h)) for o, h in lists]).combine_chunks()
            columns = [batch.column("doc_id"), batch.column("held_out"), *[pa.array(np.concatenate(x)) for x in (tokens_, known, base, score)], rest]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    return run


def _of_piece(s: Scorer, piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Per text: tokens, known ones, base and model score, and the tokens that the broadcast table lacks (as if unseen)."""
    t = tokens(piece)
    at = s.lookup.of(t.hash)
    there = at >= 0
    base, inside, known = np.full(len(at), s.unseen_base), s.unseen_inside[t.spelled], np.zeros(len(at))
    base[there], inside[there], known[there] = s.base[at[there]], s.inside[at[there]], s.known[at[there]]
    both = s.model.log_classes(t) + inside
    add = lambda x: np.bincount(t.doc, x, piece.n)
    lacks = np.flatnonzero(~there) if s.rest else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(t.doc[lacks], minlength=piece.n))])
    n = np.bincount(t.doc, minlength=piece.n)
    return n, add(known).astype(np.int64), add(base), add(both), (offsets, t.hash[lacks].view(np.int64))


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have one token, their end. A null id is held out. Repeated rows are each learned from, and scored
    alike. If nothing can be learned from, every token is unseen, base_score is 0 and the score is that of equal classes.
    An empty table has no rows. Other columns are ignored. A word is known by 64 bits of hash.
    """
    spark = ready(docs.sparkSession)
    held = held_out("doc_id")
    turn = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(rounds)).alias("turn")
    counts = count(docs.select("text", held.alias("held")))
    model = train(docs.where(~held).select("text", turn), first_model(counts), rounds)
    shared = spark.sparkContext.broadcast(scorer(model, counts))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(_scored(shared), _SCORES)
    if counts.rest:
        rows = _with_rest(rows, counts.table)
    removed(spark, counts.table)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _with_rest(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with what the words that the broadcast table lacks add to an unseen word's values.

    Such a word is rarer in all documents together than each of HEAD others, so no key of this join is hot.
    """
    rows = written(rows.withColumn("seq", F.monotonically_increasing_id()), "scores")
    found = rows.where("size(rest) > 0").select("seq", F.explode("rest").alias("hash")).join(table.where("train > 0").select("hash", "train"), "hash")
    more = found.groupBy("seq").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10((F.col("train") + 0.5) / 0.5)).alias("more"))
    joined = rows.join(more, "seq", "left")
    for c in ("base_score", "score"):
        joined = joined.withColumn(c, F.col(c) + F.coalesce("more", F.lit(0.0)))
    return written(joined.withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).drop("seq", "rest"), "scores-whole")
