from __future__ import annotations

import hashlib
import re

import pandas as pd
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[i:i + size]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[i:i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    ids |= {str(x) for x in own if x is not None}
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_sample(spark, folder):
    docs, items = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))
    assert sum(r[-1] for r in want) >= 3
    assert found(decontaminate.op10_decontaminate(spark, folder)) == want


def test_edges(spark, edges, tmp_path, edge_dir):
    items = [(1, "One"), (2, "a, b"), (3, "ZWEI drei VIER fünf"), (4, None), (5, ""), (6, "word " * 20), (None, "no id"), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (7, "sieben"), (8, "not there at all"), (9, "one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    got = found(decontaminate.op10_decontaminate(spark, str(tmp_path)))
    assert got == brute([(r.doc_id, r.text) for r in edges.collect()], items)
    kept = decontaminate.clean(edges, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == edges.columns and kept.count() == sum(not r[-1] for r in got)


def test_empty(spark, empty_dir, edges):
    assert decontaminate.op10_decontaminate(spark, empty_dir).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(edges, none).count() == edges.count()
