"""Exact histogram of encoded lengths; its suffix sums answer totals, quantiles and truncated totals for any context limit."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import ready, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20  # a larger file isn't sent to executors
#: fixed value: how byte-level BPE cuts a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STEP = 64  # lengths in a group of the two-level sums
#: fixed value: white space as the pattern's engine has it
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANK = 10_000  # a longer run of white space would overflow the pattern engine's stack, so it is cut by hand
_LONG = re.compile(f"[{_BLANKS}]{{{LONG_BLANK},}}")
_encoders: dict[int, object] = {}


def _encoder(vocabulary: Broadcast):
    """The encoder of a broadcast vocabulary file, made once a worker."""
    import tiktoken

    content = vocabulary.value
    key = hash(content)
    if key not in _encoders:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in content.splitlines() if line.strip())}
        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def tokens(encoder, text: str) -> int:
    """How many tokens the whole text has.

    The pattern takes a run of white space as one piece, but for its last character if text follows: that one may begin
    the next piece. A long run is cut there by hand, which gives the same pieces.
    """
    total, at = 0, 0
    for run in _LONG.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoder.encode_ordinary(text[at:] if at else text))


def vocabulary_of(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file, read by the driver and sent to the executors; its size is checked."""
    if Path(path).stat().st_size > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encoded_length(text: Column | str, vocabulary: Broadcast) -> Column:
    """A long column: tokens of the whole text; null and empty have none."""

    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary)
        for column in columns:
            yield pa.array([tokens(encoder, text) if text else 0 for text in column.to_pylist()], pa.int64())

    return F.arrow_udf(count, "long")(text)


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length. Repeated rows count each; no rows give no rows."""
    sent = vocabulary_of(ready(docs.sparkSession), vocabulary)
    return docs.select(encoded_length("text", sent).alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length L that occurs: n_docs of it; docs_at_least and tokens_at_least of length L or more; docs_at_most;
    truncated_total, what all documents have if cut to L tokens; and quantile, the share of documents of at most L.

    Sums are taken inside groups of STEP lengths and then over the groups, so no task sorts all lengths.
    """
    rows = lengths.withColumn("step", F.expr(f"n_tokens div {STEP}"))
    step = Window.partitionBy("step").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("d", F.sum("n_docs").over(step)).withColumn("t", F.sum(F.col("n_docs") * F.col("n_tokens")).over(step))
    groups = lengths.groupBy(F.expr(f"n_tokens div {STEP}").alias("step")).agg(F.sum("n_docs").alias("gd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("gt"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select(
        "step", F.coalesce(F.sum("gd").over(above), F.lit(0)).alias("ad"), F.coalesce(F.sum("gt").over(above), F.lit(0)).alias("at"),
        F.sum("gd").over(whole).alias("docs"), F.sum("gt").over(whole).alias("tokens"),
    )
    docs_at_least, tokens_at_least = F.col("d") + F.col("ad"), F.col("t") + F.col("at")
    longer = docs_at_least - F.col("n_docs")
    tokens_longer = tokens_at_least - F.col("n_docs") * F.col("n_tokens")
    at_most = F.col("docs") - longer
    return rows.join(groups, "step").select(
        "n_tokens", "n_docs", docs_at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"), at_most.alias("docs_at_most"),
        (F.col("tokens") - tokens_longer + longer * F.col("n_tokens")).alias("truncated_total"), (at_most / F.col("docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_longer, tokens, truncated_tokens) for each limit, from the suffix sums."""
    asked = F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context")
    total = F.max("tokens_at_least")
    kept = sums.select(asked, "n_tokens", "n_docs", "docs_at_least", "tokens_at_least")
    over = F.col("n_tokens") > F.col("context")
    out = kept.groupBy("context").agg(F.coalesce(F.max(F.when(over, F.col("docs_at_least"))), F.lit(0)).alias("docs_longer"), total.alias("tokens"), F.coalesce(F.max(F.when(over, F.col("tokens_at_least"))), F.lit(0)).alias("tl"))
    return out.select("context", "docs_longer", "tokens", (F.col("tokens") - F.col("tl") + F.col("docs_longer") * F.col("context")).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents doesn't pass."""
    asked = sums.select(F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"), "n_tokens", "quantile")
    return asked.where("quantile >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The suffix sums of the documents' encoded lengths.

    The histogram is written first: both branches of the sums read it, and texts are encoded once. Null and empty texts
    have length 0; repeated rows each count; an empty table gives no rows; columns besides text are ignored.
    """
    return suffix_sums(written(histogram(docs, vocabulary), "lengths"))
