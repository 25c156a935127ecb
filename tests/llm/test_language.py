from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import language


def test_held_out_accuracy(spark):
    folder = DATA.replace("0.001", "0.01")
    out = language.op9_language_id(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    out = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) and (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all() and set(out.lang_pred) <= {*docs.lang, "und"}


def test_edges(spark, edge_dir, edges):
    out = language.op9_language_id(spark, edge_dir).toPandas()
    assert len(out) == edges.count()
    texts = {r.doc_id: r.text for r in edges.collect()}
    for row in out.itertuples():
        text = texts[None if np.isnan(row.doc_id) else int(row.doc_id)]
        assert (row.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert row.score == 0 if row.lang_pred == "und" else 0 < row.score <= 1
    kept = language.recognised(edges, language.fitted(edges))
    assert kept.columns == edges.columns and kept.count() == (out.lang_pred != "und").sum()
    named = language.identify(edges.withColumnRenamed("size", "lang_pred"), language.fitted(edges))
    assert named.count() == len(out) and named.columns.count("lang_pred") == 1


def test_empty_and_nothing_to_learn(spark, empty_dir, edges):
    assert language.op9_language_id(spark, empty_dir).count() == 0
    model = language.learn(edges.withColumn("lang", language.F.lit(None).cast("string")))
    assert model is None and language.recognised(edges, model).count() == 0


def test_pipeline_keeps_texts_without_labels(spark, edges):
    docs = edges.withColumn("lang", language.F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(r.doc_id, r.text) for r in edges.collect() if any(c.isalpha() for c in r.text or "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want)) and want


def test_prediction_takes_effect(spark, sample):
    """A null lang is filled, and other languages than those wanted go; both are beyond ``lettered``."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fitted(docs)
    bare = docs.withColumn("lang", language.F.lit(None).cast("string"))
    filled = {r.doc_id: r.lang for r in language.recognised(bare, model).collect()}
    truth = dict(zip(sample.doc_id, sample.lang, strict=True))
    known = [i for i in filled if truth[i] is not None]
    assert len(filled) == language.lettered(bare).count() and sum(filled[i] == truth[i] for i in known) > 0.98 * len(known)
    wanted = model.languages[:2]
    some = [r.lang for r in language.recognised(bare, model, wanted).collect()]
    assert 0 < len(some) < len(filled) and set(some) == set(wanted)
    assert {r.lang for r in language.recognised(docs, model).collect()} <= set(model.languages)


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert not apart or min(apart) >= (1 if n < 4 else 4)


def test_decoding_mends_a_wrong_bit():
    model = language.Model(list("abcd"), language.codewords(4), np.zeros((language.BUCKETS, 7), np.float32), np.zeros(7, np.float32))
    for k in range(4):
        model.bias = 3 * model.code[k].copy()
        model.bias[2] *= -0.5
        assert model.losses(np.zeros((1, language.BUCKETS), np.float32)).argmin() == k
