"""The registered queries of the operators here, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, langid, maxent, merkle, mixing, prefixtrie, quality, tokencount, toxicity, urlfilter, warc
from .folds import held_out
from .near_dups import near_duplicates
from .oracle import ORACLE_SQL

KEEP_QUALITY = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its number of 4-word shingles, its group by similarity 0.8, and whether it stays: see ``near_duplicates``."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its fold, language by compression, score, margin and whether it is rejected.

    Null texts and texts without a letter are und, with score 0. Equal texts have equal rows. Without labelled texts all are und.
    """
    docs = _table(spark, sf_dir, "documents")
    dictionaries = langid.fit(docs.where(~held_out("doc_id")))
    out = langid.identified(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.margin", "language.rejected")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as its record was read back from a WARC archive: see ``warc.write_archive`` for ties, nulls and repeats."""
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its fold, toxicity score and prediction. Null and empty texts have the score of a text without words."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    out = toxicity.scored(docs.select("doc_id", "text"), model)
    score = F.col("toxicity.score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with host, path, rule and verdict: see ``urlfilter.filtered`` for nulls and ties."""
    return urlfilter.filtered(_table(spark, sf_dir, "pages")).drop("globs")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its edited text and the next document: see ``fingerprint.fingerprints``."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its fold, quality score and prediction. Null and empty texts are scored by statistics of 0."""
    stats = quality.measured(_table(spark, sf_dir, "documents"))
    model = quality.fit_labels(stats, _table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    score = F.col("score")
    return quality.scored(stats, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (score >= KEEP_QUALITY).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its words, hit words and benchmark items: see ``decontam.contamination``."""
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its source's target, the words taken of it, and where they are placed: see ``mixing.taken``."""
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each encoded length that occurs with its documents and suffix sums: see ``tokencount.suffix_sums``."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node of the trie of rebuilt conversations: see ``prefixtrie.turns``, ``rebuilt`` and ``trie`` for nulls, ties and repeats."""
    return prefixtrie.rebuilt_trie(_table(spark, sf_dir, "conversations")).drop("enter", "leave")


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its tokens, exact unigram base and model score: see ``maxent.scored`` for nulls and repeats."""
    return maxent.scored(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its leaf, roots, proof, and whether its tampered text still proves: see ``merkle.manifest`` and ``audit``."""
    return merkle.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dups, op2_language, op3_warc, op4_toxicity, op5_url_filter, op6_fingerprint, op7_quality, op8_decontamination, op9_mixing,
        op10_token_counts, op11_prefix_trie, op12_lm_scores, op13_merkle,
    )
}
__all__ = ["ORACLE_SQL", "QUERIES"]
