"""Quality scores from random-indexing word vectors (operator 2).

Words are runs of letters and digits or of other signs, hashed into a fixed
number of buckets. Each bucket has a sparse random index vector; its word
vector is the sum of the index vectors that its occurrences in all documents
have around them, scaled to length one. The table of word vectors has a fixed
size (``BUCKETS`` x ``DIMENSIONS`` numbers, 2 MB), whatever the corpus, and is
broadcast. A document is pooled into the mean and the spread of its words'
vectors and the mean product of vectors one to four words apart.

A network of two layers, in numpy, is fitted to a bounded sample of labelled
rows (``SAMPLE_ROWS``); a quarter of them, kept from the fitting, sets the
temperature by which its output is divided, so that scores are probabilities.

Task sums of the word vectors are added up by blocks of buckets; pooled
vectors, not texts, are written and joined with labels.

Defined results: null and empty texts, and texts of white space only, have
vectors of zeros and get the score of those; without labelled rows of both
classes every score is the share of label 1, or 0.5 without any; of labels
that repeat a doc_id the largest counts, null labels do not; rows that repeat
get the same score; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.common import Words, read_table, slices, word_hashes
from tidewatt.llm.language import fold
from tidewatt.session import stage

BUCKETS = 1 << 14
DIMENSIONS = 32
#: Places on each side of a word that count as around it.
REACH = 2
GAPS = (1, 2, 3, 4)
BLOCK = 64
SAMPLE_ROWS = 8000
#: Text bytes that are pooled at once.
PART_BYTES = 1 << 18
HIDDEN = 32
FEATURES = 2 * DIMENSIONS + len(GAPS) + 2

_KIND = np.full(256, 2, np.uint8)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[[32, 9, 10, 11, 12, 13]] = 0


def index_vectors() -> np.ndarray:
    """Four entries of 1 or -1 in each bucket's vector."""
    rng = np.random.default_rng(5)
    out = np.zeros((BUCKETS, DIMENSIONS), np.int8)
    for _ in range(4):
        out[np.arange(BUCKETS), rng.integers(0, DIMENSIONS, BUCKETS)] = rng.choice([-1, 1], BUCKETS)
    return out


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and where each row's words begin. Words are kept in their case: capitals are words of their own."""
    data = data[int(offsets[0]):int(offsets[-1])]
    at = offsets - offsets[0]
    kind = _KIND[data]
    cut = np.empty(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[at] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    real = kind[start] > 0
    words = Words(data, start[real], end[real], np.searchsorted(start[real], at))
    return (word_hashes(words) >> np.uint64(64 - 14)).astype(np.int64), words.first


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what is around each bucket's words, over all rows of a task, in blocks of buckets."""
    index = index_vectors()
    total = None
    for _, data, offsets in slices(batches, limit=PART_BYTES):
        word, first = buckets(data, offsets)
        if not len(word):
            continue
        total = np.zeros((BUCKETS, DIMENSIONS), np.int64) if total is None else total
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        around = np.zeros((len(word), DIMENSIONS), np.int8)
        vector = index[word]
        for gap in range(1, REACH + 1):
            same = (row[gap:] == row[:-gap])[:, None]
            around[gap:] += vector[:-gap] * same
            around[:-gap] += vector[gap:] * same
        order = np.argsort(word, kind="stable")
        held, begin = np.unique(word[order], return_index=True)
        total[held] += np.add.reduceat(around[order].astype(np.int32), begin, axis=0)
    if total is not None:
        blocks = total.reshape(-1, BLOCK * DIMENSIONS)
        yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "sums"])


def _add_up(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BLOCK * DIMENSIONS, np.int64)
    for frame in frames:
        for sums in frame["sums"]:
            total += np.frombuffer(sums, np.int64)
    yield pd.DataFrame({"block": [key[0]], "sums": [total.astype(np.float32).tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets, from all of ``docs``."""
    parts = docs.select("text").mapInArrow(_around, "block int, sums binary")
    sums = parts.groupBy("block").applyInPandas(_add_up, "block int, sums binary").collect()
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIMENSIONS), np.float32)
    for r in sums:  # BUCKETS // BLOCK rows, however many documents
        table[r["block"]] = np.frombuffer(r["sums"], np.float32)
    table = table.reshape(BUCKETS, DIMENSIONS)
    table -= table.sum(0) / max(1, np.abs(table).sum(1).astype(bool).sum()) * np.abs(table).sum(1, keepdims=True).astype(bool)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    word, first = buckets(data, offsets)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES), np.float32)
    if not len(word):
        return out
    some = np.flatnonzero(n)
    begin, count = first[:-1][some], n[some, None]
    vector = table[word]
    mean = np.add.reduceat(vector, begin, axis=0) / count
    square = np.add.reduceat(vector * vector, begin, axis=0) / count
    out[some, :DIMENSIONS] = mean
    out[some, DIMENSIONS:2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
    row = np.repeat(np.arange(len(n)), n)
    for k, gap in enumerate(GAPS):
        if len(word) > gap:
            near = np.einsum("ij,ij->i", vector[gap:], vector[:-gap]) * (row[gap:] == row[:-gap])
            out[:, 2 * DIMENSIONS + k] = np.bincount(row[gap:], near, minlength=len(n)) / np.maximum(n - gap, 1)
    out[some, -2] = np.linalg.norm(mean, axis=1)
    out[some, -1] = np.log1p(n[some])
    return out


@dataclass
class Network:
    """Two layers; ``temperature`` divides the output. Without layers, every score is ``share``."""

    share: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def output(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.output(x.astype(np.float64)) / self.temperature, -40, 40)))


def _fit_layers(x: np.ndarray, y: np.ndarray, steps: int, seed: int) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(seed)
    value = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in value]
    size = min(256, len(x))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), size)
        a, t = x[at], y[at]
        hidden = np.tanh(a @ value[0] + value[1])
        slope = (1 / (1 + np.exp(-np.clip(hidden @ value[2] + value[3], -40, 40))) - t) / size
        back = slope[:, None] * value[2] * (1 - hidden * hidden)
        grads = [a.T @ back + 1e-4 * value[0], back.sum(0), hidden.T @ slope + 1e-4 * value[2], slope.sum()]
        for k, grad in enumerate(grads):
            state[k][0] = 0.9 * state[k][0] + 0.1 * grad
            state[k][1] = 0.999 * state[k][1] + 0.001 * grad * grad
            value[k] = value[k] - 0.01 * (state[k][0] / (1 - 0.9**step)) / (np.sqrt(state[k][1] / (1 - 0.999**step)) + 1e-8)
    return tuple(value)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 3000, seed: int = 1) -> Network:
    """Fit the layers to three quarters of the rows and the temperature to the rest."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Network(float(y.mean()) if len(y) else 0.5)
    kept = np.arange(len(y)) % 4 == 3
    if len(set(y[~kept])) < 2:
        kept[:] = False
    shift, scale = x[~kept].mean(0), x[~kept].std(0) + 1e-6
    made = Network(float(y.mean()), shift, scale, _fit_layers((x[~kept] - shift) / scale, y[~kept], steps, seed))
    if kept.any():
        out, t = made.output(x[kept]), y[kept]
        tried = np.geomspace(0.25, 8, 61)
        made.temperature = float(min(tried, key=lambda v: np.mean(np.logaddexp(0, np.where(t > 0, -out, out) / v))))
    return made


def sample(pooled_rows: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """About ``bound`` labelled rows that are not held out, chosen by a hash of doc_id; all if there are fewer."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label")).filter(fold() != 1)
    part = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = known.filter(part < min(1.0, bound / max(1, known.count())))
    got = pooled_rows.filter("NOT held_out").join(some, "doc_id").select("doc_id", "label", "x").toPandas()
    got = got.sort_values(["doc_id", "x"], ignore_index=True).sample(frac=1, random_state=2)
    return np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), FEATURES), (got["label"] > 0).to_numpy()


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    shared = spark.sparkContext.broadcast(word_vectors(docs))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, limit=PART_BYTES):
            x = pooled(shared.value, data, offsets)
            yield pa.record_batch([rows.column("doc_id"), rows.column("held_out"), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "held_out", "x"])

    rows = docs.select("doc_id", (fold() == 1).alias("held_out"), "text").mapInArrow(pool, "doc_id long, held_out boolean, x binary")
    rows = stage(rows, "pooled")
    network = fit(*sample(rows, read_table(spark, sf_dir, "labels")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float32).reshape(part.num_rows, FEATURES)
            value = network.score(x)
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
