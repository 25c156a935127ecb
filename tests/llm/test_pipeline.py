from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pandas as pd

from tests.llm.conftest import DATA
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_mixing import filled, words
from tests.llm.test_neardup import brute as brute_groups
from tests.llm.test_tokens import digests, model  # noqa: F401


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_stages_against_brute_force(spark, model):  # noqa: F811
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]

    spoken = steps["language"](spark, docs, DATA).cache()
    assert spoken.columns == docs.columns
    assert sorted(i for i, _ in pairs(spoken)) == sorted(i for i, t in pairs(docs) if any(c.isalpha() for c in t or ""))

    single = steps["near_duplicates"](spark, spoken, DATA).cache()
    assert sorted(i for i, _ in pairs(single)) == sorted(r[0] for r in brute_groups(pairs(spoken)) if r[3])

    items = pd.read_parquet(f"{DATA}/benchmark.parquet")
    clean = steps["decontamination"](spark, single, DATA).cache()
    assert sorted(i for i, _ in pairs(clean)) == sorted(r[0] for r in brute_hits(pairs(single), list(zip(items.item_id, items.text, strict=True))) if not r[-1])

    mixed = steps["mixing"](spark, clean, DATA).cache()
    assert mixed.columns == docs.columns
    sizes, taken, most = Counter(), Counter(), 0
    for r in clean.collect():
        sizes[r.source] += words(r.text)
        most = max(most, words(r.text))
    for r in mixed.collect():
        taken[r.source] += words(r.text)
    for source, target in filled(sizes).items():
        assert abs(taken[source] - target) <= 2 * most

    out = sorted(map(tuple, steps["tokens"](spark, mixed, DATA).collect()))
    want = digests(model, sorted(pairs(mixed)))
    assert [(r[0], *r[2:]) for r in out] == [(r[0], *r[2:]) for r in want]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == out


def test_edges_and_empty(spark, edge_dir, empty_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, docs, edge_dir)
        assert kept.columns == docs.columns and 0 < kept.count() <= 3 * docs.count(), name
    assert corpus_pipeline.run(spark, edge_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
