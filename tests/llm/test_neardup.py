from __future__ import annotations

import random
import re
from collections import defaultdict

import pandas as pd
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import neardup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Every two texts that share a shingle are compared."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    places = defaultdict(list)
    for k, own in enumerate(sets):
        for s in own:
            places[s].append(k)
    for pair in {(a, b) for own in places.values() for a in own for b in own if a < b}:
        both = len(sets[pair[0]] & sets[pair[1]])
        if 100 * both >= 85 * len(sets[pair[0]] | sets[pair[1]]):
            root[find(pair[0])] = find(pair[1])
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(docs)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_sample(spark, folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)))
    assert found(neardup.op4_near_duplicates(spark, folder)) == want


def test_edges(spark, edges, edge_dir):
    got = found(neardup.op4_near_duplicates(spark, edge_dir))
    assert got == brute([(r.doc_id, r.text) for r in edges.collect()])
    kept = neardup.unique(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r[3] for r in got)


def test_ids_on_several_texts_and_repeats(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = c + " more"
    rows = [(5, a, "s"), (5, b, "s"), (3, b, "s"), (None, c, "s"), (None, c, "t"), (None, near, "s"), (7, "seven", "t"), (7, "seven", "s"), (7, "seven", "s"), (9, None, "s"), (9, " ", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(str(tuple(r)) for r in neardup.unique(docs).collect()) == sorted(str(r) for r in rows if r != rows[1])
    single = [tuple(r) for r in neardup.unique(docs, repeats=False).collect()]
    assert sorted(map(str, (r for r in single if r[0] is not None))) == sorted(map(str, [rows[0], rows[2], rows[7], rows[9], rows[10]]))
    assert sum(r[0] is None for r in single) == 1 and set(single) <= set(rows)


def test_empty(spark, empty_dir):
    assert neardup.op4_near_duplicates(spark, empty_dir).count() == 0


def test_large_group_in_chunks(spark, tmp_path, monkeypatch):
    """Changed copies of one text, some far from each other but linked by others; lists and clusters are cut."""
    monkeypatch.setattr(neardup, "CHUNK", 40)
    monkeypatch.setattr(neardup, "SET_CHUNK", 30)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    chain = list(base)
    for i in range(260, 300):
        chain[(i * 7) % 150] = f"y{i}"
        docs.append((i, " ".join(chain)))
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert found(neardup.op4_near_duplicates(spark, str(tmp_path))) == brute(docs)


def test_copies_without_ids_are_one_class(spark, tmp_path, monkeypatch):
    """Thousands of rows of one text and no id: one post for each list, one set to confirm."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text)] * 3000 + [(None, text.replace("w59", "v59")), (4, "other"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    staged = {}
    real = neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, label="stage": staged.setdefault(label, []).append(real(df, label)) or staged[label][-1])
    got = neardup.op4_near_duplicates(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and got.component_id.notna().sum() == 1
    assert staged["classes"][0].count() == 3 and staged["posts"][0].count() == 3 * neardup.PREFIX
    assert staged["clusters"][0].count() == 2 and staged["confirmed"][0].count() == 1


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60) if i % 20] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(7, 7)]
    got = {r.id: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == touched
    for x in touched:
        for y in touched:
            assert (got[x] == got[y]) == (find(x) == find(y))
