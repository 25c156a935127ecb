from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import suffixes


def removed(texts, length):
    """For each text the marks of its bytes that are covered by a string that starts at two places or more."""
    starts = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int32)
        for k in range(len(t) - length + 1):
            if starts[t[k:k + length]] > 1:
                gone[k] += 1
                gone[k + length if k + length < len(gone) else -1] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


def brute(docs, length=400):
    raw = [(t or "").encode() for _, t in docs]
    out = []
    for (i, _), t, gone in zip(docs, raw, removed(raw, length), strict=True):
        runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_sample(spark, folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    assert found(suffixes.op13_suffixes(spark, folder)) == brute(list(zip(docs.doc_id, docs.text, strict=True)))


def test_edges(spark, edges, edge_dir):
    got = found(suffixes.op13_suffixes(spark, edge_dir))
    assert got == brute([(r.doc_id, r.text) for r in edges.collect()])
    kept = suffixes.remove(edges)
    assert kept.columns == edges.columns and kept.count() == len(got)
    assert Counter(r.text is None for r in kept.collect()) == Counter(r.text is None for r in edges.collect())


def test_empty(spark, empty_dir):
    assert suffixes.op13_suffixes(spark, empty_dir).count() == 0


def _texts(rng):
    """Few letters, passages cut at all places, periods, and characters of several bytes."""
    passage = "".join(rng.choice("abcdefghij é") for _ in range(900))
    out = []
    for i in range(120):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(600))) if i % 3 else "".join(chr(rng.randrange(32, 400)) for _ in range(300))
        if i % 2:
            low = rng.randrange(500)
            at = rng.randrange(len(text) + 1)
            text = text[:at] + passage[low:low + rng.randrange(300, 900)] + text[at:]
        if i % 10 == 0:
            text += "xyz" * rng.randrange(100, 400)
        out.append((i, text))
    return out


@pytest.mark.parametrize("shard_spans", [2, 5, 4096])
def test_random_texts_with_shards_of_all_sizes(spark, monkeypatch, shard_spans):
    """Shards that are parted down to single windows give what whole ones give; long rows come in pieces."""
    monkeypatch.setattr(suffixes, "PART_BYTES", 700)
    docs = _texts(random.Random(4))[:60 if shard_spans == 2 else 120]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.runs for r in suffixes.repeated_runs(table, 60, 20, shard_spans=shard_spans).collect()}
    raw = [t.encode() for _, t in docs]
    for (i, _), t, gone in zip(docs, raw, removed(raw, 60), strict=True):
        have = np.zeros(len(t), bool)
        for r in got.get(i, []):
            have[r["low"]:r["high"]] = True
        assert (have == gone).all(), i


def test_remove_keeps_characters_whole(spark):
    body = "é" * 300
    docs = spark.createDataFrame([(1, "a" + body + "b", 1), (2, "ü" + body + "ö", 2)], "doc_id long, text string, n int")
    got = {r.doc_id: r.text for r in suffixes.remove(docs).collect()}
    assert got[1].startswith("a") and got[1].endswith("b") and len(got[1]) <= 4 and got[2][0] == "ü" and got[2][-1] == "ö" and len(got[2]) <= 4


def test_sorting_against_the_library():
    rng = random.Random(8)
    for trial in range(60):
        base = bytes(rng.choice(b"ab\0") for _ in range(80))
        strings = [base[:rng.randrange(81)] + bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 200))]
        order, lengths = suffixes.sorted_strings(strings, shallow=rng.choice([8, 16, 32, 64]))
        assert sorted(order.tolist()) == list(range(len(strings)))
        own = [strings[k] for k in order]
        assert own == sorted(strings)
        for k in range(1, len(own)):
            a, b = own[k - 1], own[k]
            want = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lengths[k] == want
