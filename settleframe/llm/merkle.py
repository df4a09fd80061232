"""A Merkle manifest of a dataset: leaves of rows, a tree for each source, and a tree over the sources' subroots.

Each level of a tree is one pass of windows over runs of FAN nodes. Lag and lead columns of fixed offsets, masked by a
node's slot and its run's length, hold its siblings, and the first child of a run hashes its parent from them. Siblings
are handed down from the root as an array by level, so a proof costs one join a level, of a sixteenth of the rows below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import placed
from .runtime import removed, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EACH = 5  # the contract tampers where this divides the id's crc32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | str = "text") -> Column:
    """The leaf of a row of documents, with another text in the place of its own."""
    text = F.col(text) if isinstance(text, str) else text
    return digest(*[field(text if c == "text" else F.col(c)) for c in FIELDS])


def tampered(text: Column | str = "text") -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(F.col(text) if isinstance(text, str) else text, _UPPER, _LOWER)


def _siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, place, n, digest) with ``run``, ``slot``, and the joined digests ``left`` and ``right`` of a node in its run."""
    slot, run = F.col("place") % FAN, F.floor(F.col("place") / FAN).cast("long")
    rows = nodes.withColumn("run", F.expr(f"place div {FAN}")).withColumn("slot", slot.cast("int"))
    length = F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN)
    by = Window.partitionBy("tree", "run").orderBy("place")
    earlier = [F.when(F.col("slot") >= k, F.lag("digest", k).over(by)).otherwise(F.lit("")) for k in range(FAN - 1, 0, -1)]
    later = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(by)).otherwise(F.lit("")) for k in range(1, FAN)]
    return rows.withColumn("left", F.concat(*earlier)).withColumn("right", F.concat(*later))


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level: the first child of each run hashes its parent."""
    first = nodes.where("slot = 0")
    return first.select("tree", F.col("run").alias("place"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))


def _levels(nodes: DataFrame, what: str) -> tuple[list[DataFrame], DataFrame]:
    """The written levels above ``nodes`` while a tree has more than one node, each with its siblings; and the roots (tree, digest)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], [nodes.where("n = 1").select("tree", "digest")]
    below = _siblings(nodes.where("n > 1"))
    while most > 1:
        above = _parents(below)
        most = -(-most // FAN)
        below = written(_siblings(above), what)
        roots.append(below.where("n = 1").select("tree", "digest"))
        levels.append(below)
        below = below.where("n > 1")
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def _step() -> Column:
    return F.array(F.struct("left", "right"))


def _steps_down(levels: list[DataFrame], above: DataFrame | None) -> DataFrame | None:
    """(tree, place, steps) of the lowest of ``levels``: what each node is to be joined with, from itself to the top.

    ``above`` has (tree, steps), what follows a tree's root; None: nothing does.
    """
    steps = None
    for level in reversed(levels):
        tops = level.where("n = 1").select("tree", "place")
        if above is not None:
            tops = tops.join(above, "tree").select("tree", "place", "steps")
        else:
            tops = tops.withColumn("steps", F.array().cast(_STEPS))
        rest = level.where("n > 1")
        if steps is not None:
            up = rest.alias("c").join(steps.alias("p"), (F.col("c.tree") == F.col("p.tree")) & (F.col("c.run") == F.col("p.place")))
            tops = tops.unionByName(up.select("c.tree", "c.place", F.concat(F.array(F.struct("c.left", "c.right")), F.col("p.steps")).alias("steps")))
        steps = tops
    return steps


def _proved(nodes: DataFrame, levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """``nodes`` (tree, place, n, digest and more) with ``steps`` to the top.

    The windows over a run and the join to its parent have the same keys, so the nodes are dealt out once.
    """
    single = nodes.where("n = 1")
    single = single.join(above, "tree") if above is not None else single.withColumn("steps", F.array().cast(_STEPS))
    if not levels:
        return single
    parents = _steps_down(levels, above).select("tree", F.col("place").alias("run"), F.col("steps").alias("up"))
    many = _siblings(nodes.where("n > 1")).join(parents, ["tree", "run"])
    many = many.withColumn("steps", F.concat(_step(), F.col("up")))
    return many.select(*single.columns).unionByName(single)


def proof(steps: Column | str = "steps") -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    steps = F.col(steps) if isinstance(steps, str) else steps
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, steps: Column | str = "steps") -> Column:
    """The root that ``start`` and the siblings in ``steps`` make."""
    steps = F.col(steps) if isinstance(steps, str) else steps
    return F.aggregate(steps, start, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, steps (left and right siblings, from the leaf to the root), and changed.

    ``changed`` is another leaf for some rows, null for the rest; it plays no part in the tree and is carried along.
    Leaves of a source ascend by doc_id, null ids first, equal ids by leaf; a null source is a source of its own and comes
    first. Null values are ``-`` and empty ones ``0:``, so they differ. Repeated rows are leaves each. An empty table has
    no rows. Other columns are ignored. Texts are read once, hashed, and not shuffled.
    """
    changed = F.lit(None).cast("string") if changed is None else changed
    spark = docs.sparkSession
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf().alias("digest"), changed.alias("changed")), "leaves")
    names = written(slim.groupBy("source").agg(F.count(F.lit(1)).alias("leaves")), "sources")
    sources = placed(names, [], ["source"], "trees").select("source", F.col("place").alias("tree"), F.col("n").alias("trees"))
    rows = placed(slim.withColumn("salt", F.rand(3)), ["source"], ["doc_id", "digest", "salt"], "leaves-placed").drop("salt")
    for table in (slim, names):
        removed(spark, table)
    named = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    nodes = named.select("r.doc_id", "r.source", "r.digest", "r.changed", "r.place", "r.n", "s.tree")
    levels, subroots = _levels(nodes, "level")
    in_order = subroots.join(sources.select("tree", "trees"), "tree")
    subroots = written(in_order.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("n"), "digest"), "subroots")
    above, root = _levels(subroots, "level-of-sources")
    root = F.broadcast(root.select("tree", F.col("digest").alias("root")))  # one row
    tops = _proved(subroots, above, None).join(root, "tree")
    tops = written(tops.select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), "root", "steps"), "tops")
    return _proved(nodes, levels, tops.select("tree", "steps")).join(tops.drop("steps"), "tree").select(
        "doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", "steps", "changed"
    )


def audit(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: see ``manifest`` for nulls, ties and repeats.

    Where TAMPER_EACH divides the unsigned crc32 of the id (a null id never), the text's A-Z are lower-cased before the root is made anew.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EACH == 0
    rows = manifest(docs, F.when(hit, leaf(tampered())))
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
