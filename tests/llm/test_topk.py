from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pandas as pd

from tests.llm.conftest import DATA
from tidewatt.llm import topk


def brute(rows, k=20):
    good = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for m, (j, v) in enumerate(good) if m != n)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_sample_and_sql(spark):
    rows = pd.read_parquet(f"{DATA}/embeddings.parquet")
    got = found(topk.op3_top_k(spark, DATA))
    assert got == brute(list(zip(rows.vec_id, rows.embedding, strict=True)))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    assert sorted(con.sql(topk.OP3_SQL).fetchall()) == got


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "RUN", 3)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(1)
    rows = [(i, [float(rng.choice([0.5, -0.25, 1.0])) for _ in range(3)]) for i in range(300)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan"), 1.0]), (460, [float("inf")]), (None, [1.0]), (480, []), (500, [2.0]), (20, rows[20][1]), (20, rows[20][1]), (520, [1e9, -1e9, 3e8])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, block string, run int")
    assert found(topk.top_k(docs)) == brute(rows)


def test_empty_and_few(spark, empty_dir):
    assert topk.op3_top_k(spark, empty_dir).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert found(topk.top_k(few)) == [(0, 1, 1, 64 * 128)]


def test_blocks_below_the_kth_score_are_not_scored():
    rng = np.random.default_rng(0)
    blocks = []
    for b in range(10):
        m = (rng.integers(0, 5, (64, 4)) + 20 * b).astype(np.float64)
        kind, data = topk._pack(m)
        blocks.append({"block": b, "ids": np.arange(64 * b, 64 * b + 64).tobytes(), "n": 64, "width": 4, "kind": kind, "vectors": data})
    q = np.ones((1, 4))
    asked = {"own_block": np.array([99]).tobytes(), "own_place": np.array([0]).tobytes(), "ids": np.array([0]).tobytes(), "n": 1, "width": 4, "kind": 4, "vectors": q.astype(np.int32).tobytes()}
    scored = []
    top, *_ = topk.search(asked, blocks, 20, scored)
    assert scored == [1] and (top.id // 64 == 9).all()
