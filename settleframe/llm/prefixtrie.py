"""The trie of conversation prefixes, with sums over subtrees from an Euler tour.

A prefix is known by sums of hashes of its turns with their depths, so prefixes need no chain of hashing and a
conversation of any length is cut into chunks. A node is a prefix, named by its least conversation and its depth. Each
node gives two arcs, in and out; siblings follow each other by number. Ranking that tour (``listrank``) gives each arc's
place and the sums of leaves and saved tokens before it; a subtree's sums are the difference of its node's two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .listrank import BOUND, NONE, list_ranks
from .positions import in_order, placed
from .runtime import ready, removed, written

GROUP, HEADS = 5, 9  # the contract's conversations of one base, and its first turns: crc32 modulo HEADS
CHUNK = 1 << 12  # turns of a conversation that are summed together
PIECE = 1 << 10  # ids that are joined in one text
_PIECES = 4  # of 32 bits each, of a hash


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, n, turn_hash, bytes): each turn by its place from 0 and its conversation's turns, texts left behind.

    Turns are ordered by turn, null first, then by role, then by a hash of role and text. A null role or text is empty.
    Rows of a null conv_id belong to no conversation and go.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.substring(name, 1, 32)).alias("turn_hash"), F.octet_length(text).cast("long").alias("bytes"), F.rand(11).alias("salt")
    )
    slim = written(slim, "turns")
    out = placed(slim, ["conv_id"], ["turn", "role", "turn_hash", "salt"], "turns-placed").select("conv_id", "place", "n", "turn_hash", "bytes")
    removed(slim.sparkSession, slim)
    return out


def as_they_are(found: DataFrame) -> DataFrame:
    """(conv_id, depth, length, turn_hash, bytes) of conversations as they are, with a row of depth 0 for each."""
    own = found.select("conv_id", (F.col("place") + 1).alias("depth"), F.col("n").alias("length"), "turn_hash", "bytes")
    return own.unionByName(_tops(found.where("place = 0").select("conv_id", F.col("n").alias("length"))))


def _tops(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("binary").alias("turn_hash"), F.lit(0).cast("long").alias("bytes"))


def rebuilt(found: DataFrame) -> DataFrame:
    """Like ``as_they_are``, with each conversation c rebuilt as the contract has it.

    It gets the first h turns of c - c % GROUP, h being crc32(c) % HEADS, then its own after its first h. A base's at most
    HEADS - 1 first turns go to the at most 2 * GROUP - 1 conversations that have it; nothing else is moved.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    convs = found.where("place = 0").select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "rebuilt-lengths")
    lend = convs.where("given > 0").select("base", "conv_id", "given", "length")
    first = found.where(f"place < {HEADS - 1} and conv_id % {GROUP} = 0").withColumnRenamed("conv_id", "base")
    lent = first.join(lend, "base").where("place < given").select("conv_id", (F.col("place") + 1).alias("depth"), "length", "turn_hash", "bytes")
    # a long conversation's rows meet its one row here: adaptive execution splits them
    own = found.alias("t").join(convs.alias("c"), "conv_id").where("place >= h")
    own = own.select("conv_id", (F.col("c.given") + F.col("t.place") - F.col("c.h") + 1).alias("depth"), "c.length", "turn_hash", "bytes")
    return own.unionByName(lent).unionByName(_tops(convs))


def _pieces() -> list[Column]:
    """A turn at its depth as _PIECES numbers below 2**32; the row of depth 0 has zeros."""
    out = []
    for mixed in (F.xxhash64("turn_hash", "depth"), F.xxhash64("depth", "turn_hash")):
        out += [F.shiftrightunsigned(mixed, 32), mixed.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))]
    return [F.when(F.col("depth") > 0, p).otherwise(F.lit(0).cast("long")) for p in out]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


def _prefixes(rows: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, depth, length, bytes, key, parent_key): prefix sums over depth, chunk by chunk."""
    names = [f"x{k}" for k in range(_PIECES)]
    rows = rows.select("*", *[p.alias(x) for x, p in zip(names, _pieces(), strict=True)], F.expr(f"depth div {chunk}").alias("chunk"))
    totals = rows.where(F.col("length") >= chunk).groupBy("conv_id", "chunk").agg(*[F.sum(x).alias(x) for x in names])
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "chunk", *[F.sum(x).over(earlier).alias(f"c{x}") for x in names])
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("conv_id", "depth", "length", "bytes", "chunk", *names, *[F.sum(x).over(upto).alias(f"s{x}") for x in names])
    joined = local.join(carried, ["conv_id", "chunk"], "left")
    sums = [F.col(f"s{x}") + F.coalesce(f"c{x}", F.lit(0)) for x in names]
    parent = F.when(F.col("depth") > 0, _key(F.col("depth") - 1, [s - F.col(x) for s, x in zip(sums, names, strict=True)]))
    return joined.select("conv_id", "depth", "length", "bytes", _key(F.col("depth"), sums).alias("key"), parent.alias("parent_key"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order to (key, least, ids): texts of at most PIECE ids."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["key", "least", "ids"])

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PIECE):
                yield piece()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one hash a key; only the hash is held, however many pieces there are."""
    key, sha = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if sha is None or k != key:
                if sha is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])


def _ends(prefixes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the prefixes that are whole conversations."""
    whole = prefixes.where("depth = length").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = whole.mapInArrow(_joined, "key binary, least bigint, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "least").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(rows: DataFrame, bound: int = BOUND, chunk: int = CHUNK) -> DataFrame:
    """One row for each node of the trie of ``rows`` (conv_id, depth, length, turn_hash, bytes; conversations with a row of depth 0).

    conv_id (least member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    then enter and leave, the places of the node's arcs in the tour. Empty input has no nodes, not even a root.
    """
    spark = ready(rows.sparkSession)
    prefixes = written(_prefixes(rows, chunk), "prefixes")
    nodes = prefixes.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("parent_key").alias("parent_key")
    )
    nodes = written(nodes, "nodes")
    # numbers by parent, so siblings are in a row; a range's last one is followed by the next range's first
    numbered = in_order(nodes, ["parent_key", "conv_id"], "nodes-in-order")
    starts = numbered.groupBy(F.shiftright("seq", 33).alias("part")).agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
    after = starts.select(F.col("most").alias("seq"), F.lead("least").over(Window.orderBy("part")).alias("then"))  # one row a range
    kids = numbered.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n_children")
    )
    own = written(numbered.join(kids, "key", "left").join(F.broadcast(after), "seq", "left"), "nodes-with-children")
    parents = own.where("first is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("seq").alias("parent"), F.col("last").alias("last_sibling"))
    # the many children of one parent meet its one row here: adaptive execution splits them
    tree = own.join(parents, "parent_key", "left").select(
        "key", "seq", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved"),
        F.coalesce(2 * F.col("first"), 2 * F.col("seq") + 1).alias("then_in"),
        F.when(F.col("parent").isNull(), F.lit(NONE)).when(F.col("seq") == F.col("last_sibling"), 2 * F.col("parent") + 1).otherwise(2 * F.coalesce("then", F.col("seq") + 1)).cast("long").alias("then_out"),
    )
    tree = written(tree, "tree")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    leaf = (F.col("n_children") == 0).cast("long")
    arc = lambda number, following, leaves, saved: F.struct(number.alias("arc"), following.alias("next"), one.alias("steps"), leaves.alias("leaves"), saved.alias("saved"))
    both = F.array(arc(2 * F.col("seq"), F.col("then_in"), leaf, F.col("own_saved")), arc(2 * F.col("seq") + 1, F.col("then_out"), none, none))
    near = tree.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    ranks = list_ranks(near.select(F.explode(both).alias("a")).select("a.*"), bound)
    pick = lambda s, side: F.max(F.when(F.col("arc") % 2 == side, F.col(s)))
    sums = ranks.groupBy(F.shiftright("arc", 1).alias("seq")).agg(
        pick("steps", 0).alias("enter"), pick("steps", 1).alias("leave"), *[(pick(s, 1) - pick(s, 0)).alias(s) for s in ("leaves", "saved")]
    )
    out = tree.join(sums, "seq").join(_ends(prefixes), "key", "left")
    for table in (nodes, numbered, own):
        removed(spark, table)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "enter", "leave",
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: see ``turns`` for nulls and ties, ``rebuilt`` and ``trie``. Repeated rows are turns each."""
    return trie(rebuilt(turns(conversations)))
