from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pandas as pd
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, length=35):
    split = [(i, WORDS.findall(t or "")) for i, t in docs]
    starts = Counter(tuple(w[k:k + length]) for _, w in split for k in range(len(w) - length + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if starts[tuple(w[k:k + length])] > 1:
                gone |= set(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_sample(spark, folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    assert found(substrings.op5_substrings(spark, folder)) == brute(list(zip(docs.doc_id, docs.text, strict=True)))


def test_edges(spark, edges, edge_dir):
    got = found(substrings.op5_substrings(spark, edge_dir))
    assert got == brute([(r.doc_id, r.text) for r in edges.collect()])
    kept = substrings.remove(edges)
    assert kept.columns == edges.columns and kept.count() == len(got)


def test_empty(spark, empty_dir):
    assert substrings.op5_substrings(spark, empty_dir).count() == 0


def test_random_texts(spark, tmp_path):
    """Few words, so that runs repeat in many ways: across texts, inside one, with a period, at edges; and shards that are cut."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    docs = []
    for i in range(300):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))] if i % 3 else [f"u{rng.randrange(10**6)}" for _ in range(50)]
        if i % 2:
            low = rng.randrange(45)
            words[10:10] = passage[low:low + rng.randrange(30, 60)]
        if i % 10 == 0:
            words += ["x", "y", "z"] * rng.randrange(5, 80)
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert found(substrings.op5_substrings(spark, str(tmp_path))) == brute(docs)


def test_automaton_counts():
    rng = random.Random(1)
    for _ in range(200):
        spans = [([rng.choice("abc") for _ in range(rng.randrange(1, 14))], rng.randrange(1, 3)) for _ in range(rng.randrange(1, 5))]
        made = substrings.Automaton()
        for words, n in spans:
            made.add(words, n)
        made.count()
        starts = Counter()
        for words, n in spans:
            for k in range(len(words) - 3):
                starts[tuple(words[k:k + 4])] += n
        for words, _ in spans:
            want = {j for k in range(len(words) - 3) if starts[tuple(words[k:k + 4])] > 1 for j in range(k, k + 4)}
            assert {j for low, high in made.repeated(words, 4) for j in range(low, high)} == want
