"""The stages of the corpus pipeline, each against brute force on its own input."""

import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from settleframe.llm import langid, quality
from settleframe.llm.folds import held_out
from settleframe.llm.runtime import scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, value string, grp string"
ALPHABET = {"en": "the of and with under over there then", "de": "der die und mit unter über dort dann", "fr": "le de et avec sous près alors puis"}


@pytest.fixture(scope="module")
def sf_dir(spark):
    draw, rows, marks = random.Random(8), [], []
    passage = " ".join(f"question{k}" for k in range(14))

    def prose(lang, n=60):
        return " ".join(draw.choice(ALPHABET[lang].split()) + draw.choice(["", "e", "s", "en"]) + str(draw.choice("abcdefgh")) for _ in range(n))

    for k in range(120):
        lang = list(ALPHABET)[k % 3]
        rows.append([prose(lang) + (f" {passage} " if k % 29 == 5 else ""), lang, 1])
    for k in range(60):
        rows.append([" ".join("$#%" * draw.randrange(1, 4) + str(draw.randrange(10**6)) for _ in range(60)), "en", 0])
    for k in range(0, 40, 4):  # near copies: the last word of a text is another one
        rows.append([rows[k][0].rsplit(" ", 1)[0] + f" other{k}", rows[k][1], 1])
    rows += [[rows[7][0], "de", 1], [None, "en", 0], ["", None, 0], ["!!! 123", "fr", 0], [prose("en", 20_000), "en", 1]]
    made = [(k, t, lang, f"s{k % 4}" if k % 5 else None, len(t or ""), "x", "y") for k, (t, lang, _) in enumerate(rows)]
    made += [made[7], (None, prose("fr"), "fr", "s1", 1, "x", "y")]
    marks = [(k, q, 0) for k, (_, _, q) in enumerate(rows) if k % 7]
    folder = scratch(spark, "pipeline-test")
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*marks, (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b0", passage), ("b1", None), (None, "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def _shingles(text):
    w = [x.lower() for x in re.findall("[^\x20\x09-\x0d]+", text or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def _one_of_each(rows):
    sets, label = [_shingles(r.text) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * max(1, len(sets[a] | sets[b])):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for r, g in zip(rows, label, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    return sorted({least[g] for g in label if g in least}), sum(r.doc_id is None for r in rows)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    model = quality.fit_labels(quality.measured(docs), labels)
    dictionaries = None
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        if name == "language":
            dictionaries = langid.fit(docs.where(~held_out("doc_id")))
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        after = docs.collect()
        seen[name] = after
        assert len(after) == len(before) if name == "mixing" else docs.columns == columns
        ids = sorted(r.doc_id for r in after if r.doc_id is not None)
        if name == "quality":
            want = [r for r in before if model.score(quality.statistics(pa.array([r.text], pa.string())))[0] >= corpus_pipeline.KEEP_QUALITY]
            assert sorted(map(repr, want)) == sorted(map(repr, after))
            assert {k for k in range(120)} <= set(ids) and not {k for k in range(120, 180)} & set(ids)
        elif name == "language":
            judged = langid.identified(spark.createDataFrame(before, SCHEMA), dictionaries, "l").where("not l.rejected").drop("l").collect()
            assert sorted(map(repr, judged)) == sorted(map(repr, after))
            assert {k for k in range(120)} <= set(ids) and all(langid.has_letter(r.text) for r in after)
        elif name == "near_duplicates":
            want, alone = _one_of_each(before)
            assert ids == want and len(after) - len(ids) == alone and len(after) < len(before)
        elif name == "decontamination":
            hit = {r.doc_id for r in before if "question0 question1 question2" in r.text}
            assert hit and ids == sorted(r.doc_id for r in before if r.doc_id is not None and r.doc_id not in hit)
    sizes = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in seen["decontamination"]}
    assert {r.doc_id: r.size for r in seen["mixing"]} == sizes and all(0 <= r.taken <= 3 * r.size for r in seen["mixing"])
    source = {r.doc_id: r.source for r in seen["decontamination"]}
    targets = {source[r.doc_id]: r.target for r in seen["mixing"]}
    assert np.isclose(sum(targets.values()), sum(sizes.values()))
    for s, target in targets.items():
        assert sum(r.taken for r in seen["mixing"] if source[r.doc_id] == s) == round(target)


def test_different_texts_of_one_id_both_stay(spark):
    a, b = " ".join(f"stone{k}" for k in range(40)), " ".join(f"river{k}" for k in range(40))
    rows = [(1, a), (1, b), (2, f"{a} more"), (3, f"{b} more"), (1, a), (None, f"{b} most"), (None, None), (None, None), (4, ""), (4, "")]
    made = spark.createDataFrame([(k, t, "en", "s", 1, "x", "y") for k, t in rows], SCHEMA.replace("value", "row_key").replace("grp", "_row_7"))
    left = corpus_pipeline.one_of_each(spark, made, "")
    assert left.columns == made.columns
    want = [(1, a), (1, b), (None, None), (None, None), (4, ""), (4, "")]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)


def test_run_is_the_stages_in_order_and_survives_empty_tables(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "mixing"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and got.count() > 100
    empty = scratch(spark, "pipeline-empty")
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").where(F.lit(False)).write.parquet(f"{empty}/{table}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
