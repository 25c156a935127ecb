from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA
from tidewatt.llm import mixing


def filled(sizes):
    """Targets by handing the excess over again until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**share, **{s: 3 * sizes[s] for s in full}}
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken(spark, sample):
    out = mixing.op7_mix_sources(spark, DATA).toPandas().merge(sample, on="doc_id")
    sizes = {s: sum(map(words, g.text)) for s, g in sample.groupby("source")}
    want = filled(sizes)
    assert len(out) == len(sample) and (out["size"] == out.text.map(words)).all()
    for source, rows in out.groupby("source"):
        assert rows.target.iloc[0] == pytest.approx(want[source])
        assert (rows.source_size == sizes[source]).all()
        assert abs(rows.taken.sum() - want[source]) <= 2 * rows["size"].max()
    assert (out.taken <= 3 * out["size"]).all()


def test_sql_and_reruns(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    key = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.sql(mixing.OP7_SQL).df()[key].sort_values("doc_id", ignore_index=True)
    for _ in range(2):
        got = mixing.op7_mix_sources(spark, DATA).toPandas()[key].sort_values("doc_id", ignore_index=True)
        assert got.astype(float).equals(want.astype(float))


def test_edges(spark, edges, edge_dir):
    out = mixing.op7_mix_sources(spark, edge_dir).toPandas()
    assert len(out) == edges.count() and out.target.notna().all() and (out.taken <= 3 * out["size"]).all()
    kept = mixing.mix(edges)
    assert kept.columns == edges.columns
    assert sum(words(r.text) for r in kept.collect()) == out.taken.sum()


def test_empty(spark, empty_dir):
    assert mixing.op7_mix_sources(spark, empty_dir).count() == 0


def test_rows_alike_in_everything(spark, monkeypatch):
    """Repeated rows, some with nulls in different columns, are copied in blocks; each keeps its total."""
    monkeypatch.setattr(mixing, "COPY_BLOCK", 7)
    rows = [(1, "a b", "s", None, "x")] * 50 + [(1, "a b", "s", "x", None)] * 20 + [(i, "c d e", "t", None, None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, other string").withColumn("tags", F.create_map(F.lit("k"), F.col("text")))
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    want = {r.source: r.n for r in mixing.copies(sized, ["doc_id"]).groupBy("source").agg(F.sum("n_copies").alias("n")).collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    counts = Counter((r.source, r.lang) for r in got.collect())
    assert counts["s", None] + counts["s", "x"] == want["s"] and counts["t", None] == want["t"]
    rate = want["s"] / 70
    assert abs(counts["s", "x"] - 20 * rate) <= 1


def test_one_source_holds_most(spark):
    rows = [(i, "w " * (1 + i % 50), "big" if i % 10 else "small", None, None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    taken = {r.source: r.n for r in mixing.mix(docs).selectExpr("source", "size(split(trim(text), ' ')) n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    want = filled({"big": sum(1 + i % 50 for i in range(4000) if i % 10), "small": sum(1 + i % 50 for i in range(4000) if not i % 10)})
    for source, n in taken.items():
        assert abs(n - want[source]) <= 100
