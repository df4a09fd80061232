"""Near-duplicate groups of documents: a signature-coordinate inverted join.

Each distinct shingle set gets a MinHash signature. A set is posted under its (coordinate, value) pairs, but only under
a prefix of them: two sets that agree on ``match`` of ``coordinates`` must share one of the ``coordinates - match + 1``
rarest pairs of each, in any common order. Values that occur once fill most prefixes and post nothing, and a value that
a shared passage makes common comes last. Sets that meet in posting lists form candidate groups; inside a group, the
lists are merged by counting collisions, skipping sets that already share a component, and pairs that collide
``match`` times are confirmed on the full sets. Groups beyond ``block`` sets are cut into blocks: first against the
group's most central set, then what that leaves over, in those blocks that hold one of its posted values. Nothing is
dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .runtime import hot_beyond, ready, spread_join, written
from .textbytes import NOT_SPACE, mix, shingles, slices, words

COORDINATES, MATCH, BLOCK = 64, 32, 512  # a pair of similarity 0.8 agrees on fewer than 32 of 64 once in 50 million
BLOCK_BYTES = 32 << 20  # spelled sets of a block, about
BROADCAST_IDS = 1_000_000  # ids sent to every executor at once: 8 MB; beyond it the join shuffles
SALTS = 32


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_607)
    return draw.integers(1, 1 << 63, n, dtype=np.uint64), draw.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for piece in slices(column):
        values, bounds = shingles(words(piece, NOT_SPACE), width)
        for i in range(piece.n):
            yield np.unique(values[bounds[i] : bounds[i + 1]])


def _name(values: np.ndarray) -> bytes | None:
    return blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Tokens (set, coordinate): equal iff coordinate and least hash are equal."""
    out = np.zeros((len(sets), n), dtype=np.uint64)
    flips, factors = _seeds(n)
    full = [i for i, s in enumerate(sets) if len(s)]
    for at in range(0, len(full), 256):
        some = full[at : at + 256]
        values = np.concatenate([sets[i] for i in some])
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])])[:-1]
        for k in range(n):
            out[some, k] = np.minimum.reduceat((values ^ flips[k]) * factors[k], begin)
    return mix(out + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def row_key(id_col: Column | str, text_col: Column | str) -> Column:
    """A number for each (id, text): rows that share an id but not a text are told apart by it."""
    return F.xxhash64(id_col, text_col)


def _featurize(width: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(2), width))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            tokens = _signatures(sets, coordinates).view(np.int64)[sizes > 0]
            bounds = np.concatenate([[0], np.cumsum(np.where(sizes > 0, coordinates, 0))]).astype(np.int32)
            names, lists = pa.array([_name(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(tokens.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), names, lists], ["doc_id", "row_key", "n_shingles", "set_name", "tokens"]
            )

    return run


def _spell(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), width))
            names, members = pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, members], ["row_key", "set_name", "members"])

    return run


class _Lists:
    """Inverted lists of the rows of a group; ``hits(row)`` counts each row's collisions with one of them."""

    def __init__(self, rows: list[np.ndarray]):
        values, codes = np.unique(np.concatenate(rows), return_inverse=True)
        sizes = np.array([len(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(codes, kind="stable")
        self.owners, self.begin = owner[order], np.searchsorted(codes[order], np.arange(len(values) + 1))
        self.codes, self.bounds, self.n = codes, np.concatenate([[0], np.cumsum(sizes)]), len(rows)

    def hits(self, row: int, match: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that collide with ``row`` at least ``match`` times, and how often.

        Such a row is in one of the row's ``n - match + 1`` shortest lists. Those are merged by counting; the longer ones
        are then only probed for the rows found, by binary search, and rows that can no longer reach ``match`` are skipped.
        """
        of = self.codes[self.bounds[row] : self.bounds[row + 1]]
        of = of[np.argsort(self.begin[of + 1] - self.begin[of], kind="stable")]
        first = len(of) - match + 1
        if first <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        rows, count = np.unique(np.concatenate([self.owners[self.begin[c] : self.begin[c + 1]] for c in of[:first]]), return_counts=True)
        for k, c in enumerate(of[first:], first):
            reach = count + (len(of) - k) >= match
            if not reach.all():
                rows, count = rows[reach], count[reach]
            some = self.owners[self.begin[c] : self.begin[c + 1]]
            at = np.minimum(np.searchsorted(some, rows), len(some) - 1)
            count = count + (some[at] == rows)
        full = count >= match
        return rows[full], count[full]


def _merge(group: pd.DataFrame, match: int, percent: int, asked: np.ndarray, inside: bool) -> pd.DataFrame:
    """Links that join components of a group, found by merging the lists of the rows ``asked``.

    With ``inside``, rows that the first row's component took in by then are skipped: a pair of different components
    still has one row that is asked.
    """
    names, label = group["cls"].to_numpy(), group["label"].to_numpy().copy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["members"]]
    sizes, lists, full = np.array([len(s) for s in sets]), _Lists(list(group["tokens"])), None
    links = []
    for i in asked:
        if inside and i != asked[0] and label[i] == label[asked[0]]:
            continue
        close, _ = lists.hits(i, match)
        like = 100 * np.minimum(sizes[close], sizes[i]) >= percent * np.maximum(sizes[close], sizes[i])
        close = close[(label[close] != label[i]) & like]
        if not len(close):
            continue
        if len(close) > 8:
            full = full or _Lists(sets)
            found, count = full.hits(i, 1)
            at = np.minimum(np.searchsorted(found, close), len(found) - 1)
            shared = np.where(found[at] == close, count[at], 0)
        else:
            shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in close])
        for j in close[100 * shared >= percent * (sizes[close] + sizes[i] - shared)]:
            if label[j] != label[i]:
                links.append((names[i], names[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _inside(match: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["central", "cls"], ascending=[False, True], ignore_index=True)
        return _merge(group, match, percent, np.arange(len(group)), True)

    return run


def _across(match: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["asks", "cls"], ascending=[False, True]).drop_duplicates("cls", ignore_index=True)
        return _merge(group, match, percent, np.flatnonzero(group["asks"]), False)

    return run


def _with_group(rows: DataFrame, groups: DataFrame, key: str | list[str]) -> DataFrame:
    """Join ``groups``, one row for each ``key`` (a column or several), to ``rows`` (with a column cls), of which one key may have a third.

    Few groups are broadcast. Beyond BROADCAST_IDS each is repeated for every salt, and rows are dealt by key and salt.
    """
    if groups.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(groups), key)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, [*([key] if isinstance(key, str) else key), "salt"]).drop("salt")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, match: int = MATCH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id of its group), kept (it is that document), row_key, chosen.

    Words are runs of anything but space and \\x09-\\x0D after lower-casing A-Z; a set is the distinct ``width``-word
    shingles, or the whole sequence if that is shorter. Documents are linked if 100 * intersection >= percent * union.
    Null and empty texts, and texts without words, have no shingles and are alone. Repeated rows each get a row.
    Rows that share an id but not a text are grouped each by its own text. A null id is linked to its group but never its
    least, and never kept; in a group without other ids component_id is null. ``chosen`` marks one (id, text) of each
    group, told by ``row_key``: that of the least id, null ids last; rows without shingles are all chosen.
    Other columns of ``docs`` are ignored.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col).cast("long"), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    schema = "doc_id long, row_key long, n_shingles long, set_name binary, tokens array<long>"
    made = written(docs.mapInArrow(_featurize(width, coordinates), schema), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")
    classes = made.where("set_name is not null").groupBy("set_name").agg(best, F.first("n_shingles").alias("size"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    # numbers are stored with the table, so each class keeps its own
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    joined = _joined(docs, classes, width, percent, coordinates, match, block)
    more = joined.select(F.col("node").alias("cls"), "label").unionByName(joined.select(F.col("label").alias("cls"), "label").distinct())
    more = written(more.join(classes.select("cls", "set_name", "best"), "cls"), "joined")
    least = more.groupBy("label").agg(F.min("best").alias("least"))
    of_set = written(_with_group(more.select("cls", "label", "set_name"), least, "label").select("set_name", "least"), "components")
    own = made.where("set_name is not null").drop("tokens")
    bests = classes.select("set_name", "best", "n").join(of_set, "set_name", "left").select("set_name", F.coalesce("least", "best").alias("least"), "n")
    rows = made.count()
    found = spread_join(own, bests, "set_name", hot_beyond(rows, rows)).drop("set_name")
    alone = made.where("set_name is null").select("doc_id", "row_key", "n_shingles", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key").alias("least"))
    both = found.unionByName(alone)
    component = F.col("least.doc_id")
    chosen = (F.col("row_key") == F.col("least.row_key")) & F.col("doc_id").eqNullSafe(component)
    return both.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "row_key", chosen.alias("chosen")
    )


def _joined(docs: DataFrame, classes: DataFrame, width: int, percent: int, coordinates: int, match: int, block: int) -> DataFrame:
    """(node, label): each class that isn't the least of its component, with that least one."""
    posted = classes.select("cls", F.explode("tokens").alias("token"))
    common = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a token has one posting a class; those of a family's common values stay where they are
    n = classes.count()
    hot = hot_beyond(n * coordinates, n)
    common = common.withColumn("others", F.col("n"))
    # of a set's tokens, those that others have too, rarest first; unshared ones take up the prefix without a posting
    shared = spread_join(posted, common, "token", hot).withColumnRenamed("others", "n").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t")).where(F.size("t") >= match)
    prefix = F.slice("t", F.lit(1), F.size("t") - F.lit(match - 1))
    central = F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("central")
    postings = written(shared.select("cls", central, F.transform(prefix, lambda x: x["token"]).alias("prefix")), "postings")
    lists = postings.select("cls", "central", F.explode("prefix").alias("token"))
    most_central = F.max(F.struct("central", (-F.col("cls")).alias("r"))).alias("h")
    heads = lists.groupBy("token").agg(most_central, F.count(F.lit(1)).alias("n")).where("n > 1")
    met = spread_join(lists, heads.select("token", (-F.col("h.r")).alias("head"), "n"), "token", hot).where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct()
    groups = connected(written(met, "met"))
    groups = groups.select(F.col("node").alias("cls"), F.col("label").alias("grp")).unionByName(groups.select(F.col("label").alias("cls"), F.col("label").alias("grp")).distinct())

    of_class = postings.select("cls", "central").join(classes.select("cls", "set_name", "size", "tokens", F.col("best.row_key").alias("row_key")), "cls")
    ids = written(groups.join(of_class, "cls"), "members")
    # a group's most central set goes to all its blocks; sizes and centres are one row a group
    sizes = ids.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("spelled"), most_central)
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("spelled") * 8 / BLOCK_BYTES)).cast("int")
    sizes = written(sizes.select("grp", (-F.col("h.r")).alias("centre"), blocks.alias("blocks")), "groups")
    wanted = ids.select("row_key").distinct()
    wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted
    spelled = docs.select("row_key", "text").join(wanted, "row_key", "left_semi").mapInArrow(_spell(width), "row_key long, set_name binary, members binary")
    spelled = spelled.join(ids, ["row_key", "set_name"]).dropDuplicates(["cls"]).select("cls", "grp", "central", "tokens", "members")
    members = written(_with_group(spelled, sizes, "grp").withColumn("label", F.col("cls")), "sets")

    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = members.withColumn("part", F.explode(F.when(F.col("cls") == F.col("centre"), everywhere).otherwise(F.array(own))))
    links = written(dealt.groupBy("grp", "part").applyInPandas(_inside(match, percent), "a long, b long"), "links")
    joined = connected(links)
    large = members.where("blocks > 1").drop("label").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    large = written(large.withColumn("label", F.coalesce("label", "cls")), "large")
    if large.isEmpty():
        return joined
    # what the centre's component left over is asked against other blocks
    main = large.where("cls = centre").select("grp", F.col("label").alias("main"))
    asks = written(_with_group(large, main, "grp").where("label <> main").drop("main"), "asks")
    if asks.isEmpty():
        return joined
    # a set is asked only in those blocks, but its own, that hold a set with one of its posted values
    posted = postings.select("cls", F.explode("prefix").alias("token"))
    holds = posted.join(large.select("cls", "grp", own.alias("part")), "cls").select("grp", "token", "part").distinct()
    asked = posted.join(asks.select("cls", "grp", own.alias("home"), F.octet_length("members").alias("spelled")), "cls")
    visits = asked.join(holds, ["grp", "token"]).where("part <> home").select("cls", "grp", "part", "spelled").distinct()
    visits = written(visits, "visits")
    if visits.isEmpty():
        return joined
    deals = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("spelled") / BLOCK_BYTES)).cast("int")
    deals = written(visits.groupBy("grp", "part").agg(deals.alias("deals")), "deals")
    visits = _with_group(visits, deals, ["grp", "part"]).withColumn("deal", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("deals")).cast("int"))
    asks = visits.select("cls", "part", "deal").join(asks, "cls").withColumn("asks", F.lit(True))
    told = _with_group(large.withColumn("part", own), deals, ["grp", "part"])
    told = told.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).withColumn("asks", F.lit(False)).drop("deals")
    pairs = asks.unionByName(told).groupBy("grp", "part", "deal").applyInPandas(_across(match, percent), "a long, b long")
    return connected(joined.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(pairs))
