from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)]]


def brute(docs, items, share=25):
    own = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, x in items for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, _), (words, f) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[:share * len(order) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_sample(spark, folder):
    docs, items = (pd.read_parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)), [(None, t) for t in items.text])
    assert found(importance.op11_importance(spark, folder)) == want


@pytest.mark.parametrize("words", [0, 20, 1 << 17])
def test_edges_with_dictionaries_of_all_sizes(spark, edges, edge_dir, monkeypatch, words):
    real = importance.dictionary
    monkeypatch.setattr(importance, "dictionary", lambda *tables: real(*tables, words=words))
    items = pd.read_parquet(f"{DATA}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    want = brute(docs, [(None, t) for t in items.text])
    assert found(importance.op11_importance(spark, edge_dir)) == want


def test_resample_keeps_columns_and_draws_the_target(spark, sample):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("rank", importance.F.lit("x"))
    target = docs.filter("lang = 'en'")
    got = importance.resample(docs, target, share=20)
    rows = importance.importance(docs, target, share=20).filter("rank is not null").collect()
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in rows)
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))


def test_empty(spark, empty_dir):
    assert importance.op11_importance(spark, empty_dir).count() == 0


def test_composed_checksums():
    rng = random.Random(3)
    a, b = ([rng.randbytes(rng.choice([0, 1, 7, 64, 300, 70_000])) for _ in range(200)] for _ in range(2))
    got = importance.joined(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_very_long_text_in_pieces(monkeypatch):
    """Pieces of a text give the features of the whole, with words longer than a piece."""
    monkeypatch.setattr(importance, "CHUNK_BYTES", 50)
    rng = random.Random(9)
    text = "".join(rng.choice(["Ab1 ", "é.", "x" * 130 + " ", "  ", "\n", "word", "z "]) for _ in range(500))
    made = pickle.loads(pickle.dumps(importance.Dictionary([b"ab1", "é".encode(), b"z"])))
    data = np.frombuffer(text.encode(), np.uint8)
    parts = list(made.features(data, np.array([0, len(data)])))
    assert len(parts) > 5
    words, want = features(text)
    assert sum(len(w) for w, _, _ in parts) == len(words)
    assert Counter(np.concatenate([b for _, _, b in parts]).tolist()) == Counter(want)
