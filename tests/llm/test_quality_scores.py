from __future__ import annotations

import zlib

import numpy as np
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import quality


def test_held_out(spark):
    folder = DATA.replace("0.001", "0.1")
    out = quality.op2_quality(spark, folder).toPandas()
    assert len(out) == 10_000 and (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    out = out.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    good, bad = held.score[held.quality == 1], held.score[held.quality == 0]
    assert (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.99
    assert ((held.score - held.quality) ** 2).mean() < 0.02
    assert (out.predicted == (out.score >= 0.5)).all()


def test_edges(spark, edge_dir, edges):
    out = quality.op2_quality(spark, edge_dir).toPandas()
    assert len(out) == edges.count() and out.score.between(0, 1).all()
    blank = out[out.doc_id.isin([1, 2, 4])].score
    assert blank.nunique() == 1
    for i in (8,):
        assert out[out.doc_id == i].score.nunique() == 1


def test_empty(spark, empty_dir):
    assert quality.op2_quality(spark, empty_dir).count() == 0


def test_one_class_and_none():
    x = np.zeros((5, quality.FEATURES))
    assert quality.fit(x, np.ones(5)).score(x).tolist() == [1.0] * 5
    assert quality.fit(x[:0], np.ones(0)).score(x).tolist() == [0.5] * 5


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, quality.FEATURES))
    y = rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))
    p = quality.fit(x[:2000], y[:2000]).score(x[2000:])
    assert abs(p.mean() - y[2000:].mean()) < 0.06
    high = p > 0.9
    assert y[2000:][high].mean() == pytest.approx(p[high].mean(), abs=0.12)
