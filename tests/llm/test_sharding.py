from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import DATA
from tidewatt.llm import sharding


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 3), (3, 2), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = sharding.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def laws(out, docs):
    n = len(out)
    counts = Counter(out.shard)
    assert n == len(docs) and all(n // 16 <= counts[s] <= -(-n // 16) for s in range(16))
    for _, rows in out.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    assert (out.law == "rows").all() and out.grown_shard.isna().all()
    by = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert by == sorted(zip(out.doc_id.fillna(-1).astype(int), out["size"], out.text_crc32, strict=True))
    order = out.sort_values(["shard", "slot"])
    assert (order.place.diff().dropna() >= 0).all()
    seen, last = set(), None
    for key in zip(order["size"], order.text_crc32, strict=True):  # equal texts lie together
        assert key == last or key not in seen
        seen.add(key)
        last = key


def test_sample(spark, sample):
    laws(sharding.op6_hilbert_shards(spark, DATA).toPandas(), list(zip(sample.doc_id, sample.text, strict=True)))


def test_edges(spark, edges, edge_dir):
    laws(sharding.op6_hilbert_shards(spark, edge_dir).toPandas(), [(r.doc_id, r.text) for r in edges.collect()])


def test_empty(spark, empty_dir):
    assert sharding.op6_hilbert_shards(spark, empty_dir).count() == 0


def test_files_hold_boxes(spark, sample, tmp_path):
    sharding.write_shards(spark.read.parquet(f"{DATA}/documents.parquet"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(sample)
    langs = [r.n for r in back.groupBy("shard").agg({"lang": "count"}).toDF("shard", "n").collect()]
    assert max(langs) - min(langs) <= 1
    assert back.select("shard", "lang").distinct().count() < 16 * 4  # most shards lack some language
