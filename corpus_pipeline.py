"""A corpus pipeline in five stages: quality, language, near-duplicates, benchmark passages, and the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settleframe.llm import decontam, langid, mixing, quality
from settleframe.llm.folds import held_out
from settleframe.llm.near_dups import BROADCAST_IDS, near_duplicates, row_key
from settleframe.llm.runtime import ready, written

KEEP_QUALITY = 0.3


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least KEEP_QUALITY.

    The model learns from all labelled documents outside the held-out fold, without labels every score is 0.5. Null and
    empty texts are scored like any other, by statistics of 0. Repeated rows are scored each, alike. Columns that clash
    with the statistics' names are left as they are. The statistics are made again for scoring, so texts aren't shuffled.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    model = ready(spark).sparkContext.broadcast(quality.fit_labels(quality.measured(docs), labels))
    return docs.where(quality.text_score("text", model) >= KEEP_QUALITY)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that compression tells by more than a narrow margin.

    Null and empty texts, and texts without a letter, go, and all do if nothing labelled could be learned from. Of equal
    sizes the first language by name counts, with a margin of 0: such a text goes. Repeated rows are judged alike.
    """
    dictionaries = langid.fit(docs.where(~held_out("doc_id")))
    return docs.where(~langid.language("text", ready(spark) and dictionaries)["rejected"])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id, null ids last.

    Rows that share an id but not a text are told apart by ``row_key``, so each stands in its own group. Of repeated rows
    of the document that stays, one stays. Null and empty texts, and texts without words, are in no group: all stay.
    """
    number = f"_row_{len(docs.columns)}"  # a name that clashes with none
    while number in docs.columns:
        number += "_"
    found = written(near_duplicates(docs).select("doc_id", "n_shingles", "row_key", "chosen"), "groups")
    out = found.where("not chosen").select("row_key").distinct()
    again = found.where("chosen and n_shingles > 0").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key")

    def few(keys: DataFrame) -> DataFrame:
        keys = keys.withColumnRenamed("row_key", number)
        return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys

    keyed = docs.withColumn(number, row_key(F.col("doc_id").cast("long"), F.col("text")))
    left = keyed.join(few(out), number, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    again = few(again)
    once = left.join(again, number, "left_semi").dropDuplicates([number])
    return left.join(again, number, "left_anti").unionByName(once).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Null and empty texts hold none and stay, as do all texts if the benchmark is empty. Repeated rows are judged alike.
    """
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="_contamination")
    return found.where(F.col("_contamination")["n_hit"] == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of what is left, then what else ``mixing.mixed`` tells.

    Null texts and texts without words have size 0 and taken 0; a null source is a source of its own; repeated rows each
    count; ties of the permuted order are settled by id and size.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality", good), ("language", in_a_language), ("near_duplicates", one_of_each), ("decontamination", uncontaminated), ("mixing", mixed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents``; empty tables give no rows. Each stage's rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
