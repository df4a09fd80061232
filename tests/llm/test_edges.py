"""Every registered query over empty tables, and over tables with nulls in any column, repeated rows and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from settleframe.llm import queries
from settleframe.llm.runtime import scratch

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, toxicity string, language string, size string, contamination string",
    "labels": "doc_id bigint, quality int, toxic int, text string, score double",
    "benchmark": "item_id string, text string, n_hit long",
    "pages": "page_id bigint, url string, html string, rule string, payload_digest string",
    "conversations": "conv_id bigint, turn bigint, role string, text string, depth string, seq string",
}


def _saved(spark, rows):
    folder = scratch(spark, "edges")
    for name, schema in TABLES.items():
        width = len(schema.split(", "))
        full = [(*r, *["x" if c.endswith("string") else None for c in schema.split(", ")[len(r) :]]) for r in rows.get(name, [])]
        assert all(len(r) == width for r in full)
        spark.createDataFrame(full, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark):
    return _saved(spark, {})


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(4)
    prose = lambda: " ".join(draw.choice(["stone", "river", "and", "the", "under", "house"]) for _ in range(40))
    docs = [(k, prose() + (" vilewretch" if k % 3 == 0 else ""), "en" if k % 2 else "de", "s") for k in range(40)]
    docs += [docs[0], (None, None, None, None), (None, prose(), None, "t"), (50, None, "en", None), (51, "", None, "s"), (52, " \n\t", "en", "s"), (53, "ü\U0001f600 \x00 !", None, ""), (-7, "word " * 30_000, "en", "s")]
    labels = [(k, int(k % 2), int(k % 3 == 0)) for k in range(40)] + [(None, 1, 1), (3, None, None), (3, 1, 1), (50, 0, 0), (51, None, 1)]
    pages = [(1, "http://a.com/", "<p>"), (1, "http://a.com/", "<p>"), (None, None, None), (2, None, "<p>"), (3, "x", None), (4, "http://b.net/es/" + "y" * 9000, "ü" * 9000)]
    return _saved(spark, {"documents": docs, "labels": labels, "benchmark": [("b", "the under river"), (None, "stone"), ("c", None), ("b", "")], "pages": pages, "conversations": [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, "user", "y")]})


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op10_token_counts", "op11_prefix_trie")])
def test_odd_rows_each_have_a_result(spark, odd, name):
    table, key = ("pages", "page_id") if name in ("op3_warc", "op5_url_filter") else ("documents", "doc_id")
    want = sorted(str(r[0]) for r in spark.read.parquet(f"{odd}/{table}.parquet").select(key).collect())
    got = queries.QUERIES[name](spark, odd)
    assert len(set(got.columns)) == len(got.columns) and sorted(str(r[key]) for r in got.collect()) == want
    if "score" in got.columns and name != "op12_lm_scores":
        assert got.where("score is null or score < 0 or score > 1").count() == 0
    if "predicted" in got.columns:
        assert got.where(F.col("predicted") != (F.col("score") >= (0.3 if "quality" in name else 0.5)).cast("int")).count() == 0


def test_tokens_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert queries.QUERIES["op10_token_counts"](spark, odd).agg(F.max("docs_at_most")).first()[0] == docs.count()
