from __future__ import annotations

import numpy as np
import pytest

from tests.llm.conftest import DATA
from tidewatt.llm import whitening


def brute(vectors):
    """Sums, covariance eigenpairs and whitened rows of the quantised vectors by the library."""
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = fit.astype(float) - (s / n).astype(float)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1][:, :4]
    deviation = ((n * x - s) ** 2).sum(1)
    with np.errstate(all="ignore"):
        white = (x.astype(float) - (s / n).astype(float)) @ vecs / np.sqrt(values[:4])
    return n, deviation, white, values[:4] / values.sum()


def check(out, ids, vectors):
    n, deviation, white, explained = brute(vectors)
    out = out.sort_values(["vec_id", "component"], ignore_index=True)
    k = white.shape[1]
    order = np.argsort(ids, kind="stable")
    assert out.vec_id.tolist() == np.repeat(np.asarray(ids)[order], k).tolist() and out.component.tolist() == list(range(1, k + 1)) * len(ids)
    assert (out.n == n).all() and out.deviation.tolist() == np.repeat(deviation[order], k).tolist()
    got, want = out.whitened.to_numpy().reshape(-1, k), white[order]
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - sign * want).max() < 1e-7
    assert np.allclose(out.explained.to_numpy().reshape(-1, k)[0], explained, rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_sample(spark, folder):
    given = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    check(whitening.op12_whitening(spark, folder).toPandas(), given.vec_id.tolist(), given.embedding.tolist())


def test_edges(spark, tmp_path):
    """Copies, nulls, NaN, infinities, other lengths, huge entries and more partitions than one task merges."""
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=6) * [9, 4, 2, 1, 0.5, 0.1]).tolist()) for i in range(400)]
    good += [(1000 + i, good[3][1]) for i in range(50)] + [(2000, [1e3, -1e3, 0.0, 0.0, 0.0, -0.001])]
    bad = [(-1, None), (-2, []), (-3, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (-4, [float("nan")] * 6), (-5, [float("-inf")] * 6), (-6, [1.0] * 5), (-7, [1e300] * 6)]
    rows = [(i, v, "c", 4) for i, v in good + bad]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int").repartition(40).write.parquet(str(tmp_path / "embeddings.parquet"))
    check(whitening.op12_whitening(spark, str(tmp_path)).toPandas(), [i for i, _ in good], [v for _, v in good])
    table = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    kept = whitening.whiten(table, components=2)
    assert kept.columns == [*table.columns, "whitened"] and kept.count() == len(good) and {len(r.whitened) for r in kept.collect()} == {2}


@pytest.mark.parametrize("vectors, live", [([[1.0, 2.0, 3.0]], 0), ([[1.0, 2.0, 3.0], [1.0, 2.5, 3.0]] * 3, 1), ([[0.5]], 0)])
def test_components_without_variance(spark, tmp_path, vectors, live):
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = whitening.op12_whitening(spark, str(tmp_path)).toPandas()
    width = len(vectors[0])
    assert len(out) == len(vectors) * min(4, width) and out.whitened.notna().sum() == live * len(vectors)
    assert out.identity_error.max() < 1e-12 and out.explained.sum() == pytest.approx(len(vectors) if live else 0)


def test_null_id_and_empty(spark, empty_dir, tmp_path):
    assert whitening.op12_whitening(spark, empty_dir).count() == 0
    spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening.op12_whitening(spark, str(tmp_path)).filter("vec_id IS NULL").count() == 2


def test_deviation_is_exact_beyond_doubles():
    made = whitening.Whitening(10**6, [7, -3], np.ones(1), np.ones((2, 1)), 1.0, 0.0)
    x = np.array([[10**3, 5], [2**40, 1]])
    want = [(10**6 * 10**3 - 7) ** 2 + (5 * 10**6 + 3) ** 2]
    assert made.deviation(x[:1]) == want and made.deviation(x) == [*want, None]


def _matches(made, rows):
    rows = np.asarray(rows, float)
    centred = rows - rows.mean(0)
    scatter = centred.T @ centred
    size = max(1.0, np.abs(scatter).max())
    assert np.allclose(made.mean, rows.mean(0)) and made.n == len(rows)
    assert np.abs(made.vectors.T @ made.vectors - np.eye(rows.shape[1])).max() < 1e-10
    assert np.abs((made.vectors * made.values) @ made.vectors.T - scatter).max() < 1e-11 * size
    assert (np.diff(made.values) >= 0).all()


def test_rank_one_updates_and_merges():
    """Random rows, rows that repeat (equal eigenvalues), rows in few dimensions and one of each axis (all deflated)."""
    rng = np.random.default_rng(1)
    kinds = [rng.normal(size=(300, 12)), rng.integers(-2, 3, (200, 12)), np.repeat(rng.normal(size=(3, 12)), 40, 0), np.eye(12), np.vstack([np.eye(12)] * 3),
             rng.normal(size=(90, 12)) * 10.0 ** -np.arange(12), np.zeros((5, 12)), rng.normal(size=(2, 12))]
    for rows in kinds:
        whole = whitening.Spectrum.empty(12)
        for at in range(0, len(rows), 37):
            whole.add(np.asarray(rows[at:at + 37], float))
        _matches(whole, rows)
        single = whitening.Spectrum.empty(12)
        for row in rows[:60]:
            single.add(np.asarray(row, float)[None])
        _matches(single, rows[:60])
        parts = whitening.Spectrum.empty(12)
        for at in range(0, len(rows), 50):
            one = whitening.Spectrum.empty(12)
            one.add(np.asarray(rows[at:at + 50], float))
            parts.merge(one)
        _matches(parts, rows)
