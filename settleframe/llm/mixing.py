"""Mixing sources to target weights, in DataFrame functions alone.

A source's documents are hashed into blocks. Its target is met by whole passes over all its blocks, and by a partial pass
over blocks in a permuted order, of which the last is filled part by part, and its last part document by document.
Output shards come from a splitting tree: at each node the units (blocks in a pass) that the sources still have to place
are divided between two halves by a draw without replacement, so each source's share is multivariate hypergeometric, down
to a quota for each shard and source. Shards then take disjoint runs of each source's permuted units, and rows are
shuffled inside their shard by a hash. The tree and the plan hold BLOCKS rows for each source and pass, at most; sources
may be many: only their sizes, one row each, are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import removed, written

BLOCKS = 512  # of each source, and parts of a block
SHARDS, SEED = 16, 9
SPAN_BITS = 12  # ranges of the draw, by which a node's units are ranked
WEIGHTS = (1, 2, 3)  # repeated over the sources in code-point order, null last
MOST = 3  # passes over a source


def size_of(text: Column | str) -> Column:
    """Words, as runs of anything but space and \\x09-\\x0D; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(*columns: Column) -> Column:
    """A number in [0, 2**60) from the MD5 of the columns as text, the same in every engine; null reads as '~'."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights share the total, and what exceeds MOST times a source's size is shared again.

    Sources are capped in the order of size over weight; the first k are capped for the least k that leaves none above.
    One row a source is sorted in one task; no documents are.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("long"))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    up, everything = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = weighed.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(everything) - MOST * F.coalesce(F.sum("source_size").over(up), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0))).alias("shared"),
    )
    # uncapped from the first source on whose fair share of what is left stays within its cap
    fits = F.col("weight") * F.col("left") <= MOST * F.col("source_size") * F.col("shared")
    ranked = ranked.withColumn("fits", fits)
    onward = by.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("fits"), F.struct("left", "shared")), ignorenulls=True).over(onward)
    ranked = ranked.withColumn("rest", first)
    target = F.when(F.col("rest").isNull(), (MOST * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("rest.left")).cast("double") / F.col("rest.shared"))
    return ranked.select("source", "source_size", target.alias("target"))


def _plan(blocks: DataFrame) -> DataFrame:
    """(source, block, words) to each block's whole passes and the words of a further, partial one.

    A source's target, rounded, is so many passes over all its blocks, and then blocks in a permuted order. At most
    BLOCKS rows of a source are sorted together.
    """
    sizes = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    order = Window.partitionBy("source").orderBy(_key(F.lit("order"), F.col("block"), F.col("source")), "block")
    reach = blocks.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reach = reach.alias("r").join(sizes.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.target")
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    room = goal - passes * F.col("source_size") - F.col("before")
    return reach.select("source", "block", "words", "source_size", "target", passes.alias("passes"), F.greatest(F.lit(0), F.least("words", room)).alias("more"))


def _split(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, quota): how many units (source, block, pass) of each source a shard gets.

    A node of the tree has the shards from low up to high. It gives each half its share of places, to the units that come
    first in a seeded permutation. Of the permutation only the sources' counts are kept. A unit's rank in a node is its
    rank in a range of the draw and the count of the ranges before, so no task sorts a node.
    """
    rows = written(units.withColumn("low", F.lit(0)).withColumn("high", F.lit(shards)), "split-0")
    for level in range((shards - 1).bit_length()):
        drawn = _key(F.lit("split"), F.lit(seed), F.lit(level), F.col("pass"), F.col("block"), F.col("source"))
        dealt = rows.withColumn("drawn", drawn).withColumn("span", F.shiftright("drawn", 60 - SPAN_BITS))
        inside = Window.partitionBy("low", "span").orderBy("drawn", "pass", "block", F.col("source").asc_nulls_last())
        spans = dealt.groupBy("low", "span").agg(F.count(F.lit(1)).alias("own"))
        node = Window.partitionBy("low")
        before = F.coalesce(F.sum("own").over(node.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spans = spans.select("low", "span", before.alias("before"), F.sum("own").over(node).alias("n"))
        ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(spans), ["low", "span"])  # at most shards * 2**SPAN_BITS rows
        ranked = ranked.withColumn("middle", F.expr("(low + high) div 2").cast("int"))
        left = F.col("before") + F.col("rank") <= F.expr("n * (middle - low) div (high - low)")
        halves = ranked.select("source", "block", "pass", F.when(left, F.col("low")).otherwise(F.col("middle")).alias("low"), F.when(left, F.col("middle")).otherwise(F.col("high")).alias("high"))
        above, rows = rows, written(halves, f"split-{level + 1}")
        removed(rows.sparkSession, above)
    return rows.groupBy("source", F.col("low").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def _placed(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, block, units): the passes of each block that are taken, each with its shard."""
    last = F.col("passes") - F.when(F.col("more") > 0, F.lit(0)).otherwise(F.lit(1))
    units = plan.where("words > 0 and (passes > 0 or more > 0)").select("source", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pass"))
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = _split(units, shards, seed).withColumn("last", F.sum("quota").over(upto)).withColumn("first", F.col("last") - F.col("quota") + 1)
    order = Window.partitionBy("source").orderBy(_key(F.lit("unit"), F.lit(seed), F.col("pass"), F.col("block"), F.col("source")), "pass", "block")
    units = units.withColumn("unit", F.row_number().over(order))
    placed = units.alias("u").join(runs.alias("q"), F.col("u.source").eqNullSafe(F.col("q.source")) & F.col("unit").between(F.col("first"), F.col("last")))
    return placed.groupBy("u.source", "u.block").agg(F.sort_array(F.collect_list(F.struct("u.pass", "q.shard"))).alias("units"))


def _keyed(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, source, size, block and part of each document, and further columns."""
    number = _key(F.lit("block"), F.col("doc_id"), F.col("source"))
    rows = docs.select("doc_id", "source", *also, size_of("text").alias("size"), number.alias("number"))
    return rows.withColumn("block", (F.col("number") % BLOCKS).cast("int")).withColumn("part", F.expr(f"cast(number div {BLOCKS} % {BLOCKS} as int)")).drop("number")


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for c in columns:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def _parts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, block, part, part_words, part_more): of each source's one block that is taken in part, what each part gives."""
    partial = plan.where("more > 0 and more < words").select("source", "block", "more")
    by = rows.alias("r").join(partial.alias("p"), _same("r", "p", "block")).groupBy("r.source", "r.block", "r.part").agg(F.sum("r.size").alias("part_words"), F.max("p.more").alias("more"))
    order = Window.partitionBy("source").orderBy(_key(F.lit("part"), F.col("part"), F.col("source")), "part").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("more") - F.coalesce(F.sum("part_words").over(order), F.lit(0))
    return by.select("source", "block", "part", "part_words", F.greatest(F.lit(0), F.least("part_words", room)).alias("part_more"))


def _planned(rows: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The plan of blocks with their units, and that of parts."""
    blocks = written(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    plan = written(_plan(blocks), "plan")
    units = written(plan.alias("p").join(_placed(plan, shards, seed).alias("q"), _same("p", "q", "block"), "left").select("p.*", "q.units"), "units")
    return units, written(_parts(rows, plan), "parts")


def _filled(rows: DataFrame, plan: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with source_size, target, units (pass, shard, words of the document), and taken, their words."""
    own = [f"d.{c}" for c in rows.columns]
    joined = rows.alias("d").join(plan.alias("p"), _same("d", "p", "block"))
    joined = joined.select(*own, "p.source_size", "p.target", "p.passes", "p.more", "p.words", "p.units")
    joined = joined.alias("d").join(parts.alias("q"), _same("d", "q", "block", "part"), "left").select("d.*", "q.part_words", "q.part_more")
    inside = F.coalesce((F.col("part_more") > 0) & (F.col("part_more") < F.col("part_words")), F.lit(False))
    gives = F.when(F.col("part_words").isNotNull(), F.col("part_more")).otherwise(F.col("more"))
    whole = joined.where(~inside).withColumn("again", F.when(gives > 0, F.col("size")).otherwise(F.lit(0)))
    # the one part of each source that is taken in part
    before = Window.partitionBy("source").orderBy(_key(F.lit("document"), F.col("doc_id"), F.col("source")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = joined.where(inside)
    some = some.withColumn("again", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part_more") - F.coalesce(F.sum("size").over(before), F.lit(0)))))
    both = whole.unionByName(some)
    words = lambda u: F.when(u["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("again")).cast("long")
    units = F.transform(F.coalesce("units", F.array()), lambda u: F.struct(u["pass"].alias("pass"), u["shard"].alias("shard"), words(u).alias("words")))
    both = both.withColumn("units", F.filter(units, lambda u: u["words"] > 0))
    total = F.aggregate("units", F.lit(0).cast("long"), lambda s, u: s + u["words"])
    return both.select(*rows.columns, "source_size", "target", "units", total.alias("taken"))


def taken(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, units (pass, shard, words of the document), and taken, their words.

    Documents are taken whole, except that the last one of a source's partial pass gives as many first words as are
    missing, so a source's words taken are its target, rounded. None is taken more than MOST times. Null texts and texts
    without words have size 0 and taken 0. Null sources are one source. Repeated rows each count; ties of a permuted order
    are settled by number, id and size. Other columns are ignored.
    """
    rows = written(_keyed(docs), "sizes")
    return _filled(rows, *_planned(rows, shards, seed)).drop("block", "part")


def mixture(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: doc_id, source, text, pass, words, shard, and place, an order inside the shard.

    A row is a document in a pass. Its text is whole, but for each source's last document, which is cut to its first
    ``words`` words.
    """
    rows = _filled(_keyed(docs, "text"), *_planned(written(_keyed(docs), "sizes"), shards, seed))
    each = rows.select("doc_id", "source", "text", "size", F.explode("units").alias("u")).select("doc_id", "source", "text", "size", "u.*")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(first).alias("text")
    place = _key(F.lit("place"), F.lit(seed), F.col("pass"), F.col("doc_id")).alias("place")
    return each.select("doc_id", "source", text, "pass", "words", "shard", place)


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix dealt into one partition for each shard, in its order there."""
    return mixture(docs, shards, seed).repartitionById(shards, F.col("shard")).sortWithinPartitions("place", "doc_id", "pass")


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and placed: 'pass:shard:words' of each time it is taken, by commas."""
    placed = F.array_join(F.transform("units", lambda u: F.concat_ws(":", u["pass"], u["shard"], u["words"])), ",").alias("placed")
    return taken(docs, shards, seed).select("doc_id", "size", "source_size", "target", "taken", placed)
