"""Embedding whitening by incremental eigendecomposition (operator 12).

Vectors are quantised to whole numbers; the fit list is each distinct one once.

1. A task keeps the spectrum (eigenvalues and eigenvectors) of the scatter of
   the vectors it has seen, with their mean. A block of vectors, centred on its
   own mean, is brought to at most as many rows as there are dimensions by an
   orthogonal triangularisation, which leaves its scatter as it is. Each of
   those rows is a rank-one update of the spectrum, and so is the way from one
   mean to the other. (An update for each vector instead would cost 50 times as
   much for blocks of 4,096 vectors of 64 dimensions, for the same scatter.)
2. A rank-one update solves the secular equation: components that the new row
   does not touch, and all but one direction of each set of equal eigenvalues,
   are deflated first; the roots between the poles are found by rational
   interpolation kept inside brackets; eigenvectors come from the row that has
   exactly those roots, so that they stay orthogonal.
3. Spectra of tasks are merged in a tree, ``FAN`` at a time: every eigenvector of
   one, scaled, is a rank-one update of the other, and the difference of the
   means is one more.
4. Rayleigh-Ritz: the distributed covariance of the vectors projected on the
   merged basis is diagonalised, which turns the basis into eigenvectors to
   double precision whatever the updates have lost.

Only spectra (a square of the dimensions) leave a task, never vectors.

Defined results: vectors that are null or empty, hold null or non-finite
entries or entries of which 256 times leaves 2 ** 53, or have another length
than most vectors (of the lengths most frequent alike, the longest counts) take
no part; a null vec_id is a row like others; rows that repeat all get a
result; a component without variance (fewer distinct vectors than dimensions)
has whitened null and is left out of the identity error, which is 0 if none is
left; deviation is null where it is beyond a long; no rows give no rows; other
columns are not looked at, ``whiten`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tidewatt.llm.common import read_table
from tidewatt.session import stage

SCALE = 256
COMPONENTS = 4
BLOCK = 4096
#: Spectra or sums that one task merges.
FAN = 16
_EPS = np.finfo(np.float64).eps
_ITERATIONS = 60


def quantised(column: str = "embedding") -> Column:
    """The vector in whole numbers, or null where it takes no part."""
    x = F.transform(F.col(column), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    most = F.lit(float(2**53) / SCALE)
    # NaN is above all numbers in comparisons, so the upper bound keeps it out
    good = F.forall(column, lambda c: F.coalesce((c.cast("double") < most) & (c.cast("double") > -most), F.lit(False)))
    return F.when(F.col(column).isNotNull() & (F.size(column) > 0) & good, x)


# --- spectra ----------------------------------------------------------------

def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """d[i] - root[j] for the roots of 1 + rho * sum(z2 / (d - x)); d rises strictly, z2 is positive.

    Root j lies between d[j] and d[j + 1], the last one above all. Each is
    held as its distance from the nearer pole, so that differences are exact.
    """
    k = len(d)
    column = np.arange(k)
    after = np.append(d[1:], d[-1] + rho * z2.sum())
    middle = (after - d) / 2
    with np.errstate(all="ignore"):
        at_middle = 1 + rho * (z2[:, None] / ((d[:, None] - d) - middle)).sum(0)
    near = np.where((at_middle >= 0) | (column == k - 1), column, column + 1)
    origin = d[near]
    gap = d[:, None] - origin
    low = np.where(near == column, 0.0, -middle)
    high = np.where(near == column, np.where(column == k - 1, after - d, middle), 0.0)
    x = (low + high) / 2
    left = column[:, None] <= column
    for _ in range(_ITERATIONS):
        with np.errstate(all="ignore"):
            apart = gap - x
            term = rho * z2[:, None] / apart
            slope = term / apart
            f = 1 + term.sum(0)
            below, above = np.where(left, slope, 0).sum(0), np.where(left, 0, slope).sum(0)
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            one, two = apart[column, column], apart[np.minimum(column + 1, k - 1), column]
            c = f - one * below - two * above
            a = (one + two) * f - one * two * (below + above)
            b = one * two * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            tail = f - one * below
            step[-1] = one[-1] + one[-1] ** 2 * below[-1] / tail[-1]
            new = x + step
            inside = (new > low) & (new < high) & np.isfinite(new)
            new = np.where(inside, new, (low + high) / 2)
            root_found = np.abs(f) <= 4 * _EPS * (1 + np.abs(term).sum(0))
            done = root_found | (np.abs(new - x) <= 2 * _EPS * np.abs(new))
        x = np.where(root_found, x, new)
        if done.all():
            break
    return gap - x


@dataclass
class Spectrum:
    """Eigenvalues, in rising order, and eigenvectors (columns) of the scatter of n vectors, and their mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def update(self, v: np.ndarray, rho: float = 1.0) -> None:
        """Add rho * v v^T to the scatter, rho being positive."""
        z = self.vectors.T @ v
        norm2 = float(z @ z)
        if not rho * norm2 > 0:
            return
        z /= np.sqrt(norm2)
        rho *= norm2
        d = self.values
        near = 8 * _EPS * max(abs(d[-1]), rho)
        # equal eigenvalues: one reflection leaves one of their directions in touch with the new row
        begin = np.flatnonzero(np.append(True, np.diff(d) > near))
        for low, high in zip(begin, np.append(begin[1:], len(d)), strict=True):
            if high - low > 1:
                own = z[low:high].copy()
                size = np.sqrt(own @ own)
                if size > 0:
                    size = np.copysign(size, own[-1])
                    own[-1] += size
                    part = self.vectors[:, low:high]
                    self.vectors[:, low:high] = part - np.outer(part @ own, own * (2 / (own @ own)))
                    z[low:high] = 0
                    z[high - 1] = -size
        live = np.flatnonzero(rho * np.abs(z) > near)
        if len(live):
            d_live = d[live]
            apart = _roots(d_live, z[live] ** 2, rho)
            # the row that has exactly these roots
            k = len(live)
            pole = np.where(np.arange(k)[:, None] > np.arange(k), np.arange(k), np.arange(1, k + 1))
            with np.errstate(all="ignore"):
                ratio = -apart[:, :-1] / (d_live[np.minimum(pole[:, :-1], k - 1)] - d_live[:, None])
            exact = np.sqrt(np.abs(np.prod(ratio, 1) * apart[:, -1]))
            turn = np.copysign(exact, z[live])[:, None] / apart
            turn /= np.sqrt((turn * turn).sum(0))
            self.values[live] = d_live - np.diagonal(apart)
            self.vectors[:, live] = self.vectors[:, live] @ turn
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _moved(self, n: int, mean: np.ndarray) -> None:
        """Take in the distance to the mean of ``n`` further vectors, whose own scatter is taken in apart."""
        both = self.n + n
        if self.n and n:
            self.update(mean - self.mean, self.n * n / both)
        self.mean = self.mean + (mean - self.mean) * (n / both)
        self.n = both

    def add(self, block: np.ndarray) -> None:
        mean = block.mean(0)
        for row in np.linalg.qr(block - mean, mode="r"):
            self.update(row)
        self._moved(len(block), mean)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector, value)
        if other.n:
            self._moved(other.n, other.mean)


# --- distributed sums and merges --------------------------------------------

def _matrices(batches: Iterator[pa.RecordBatch], limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``limit`` rows and their vectors x (all of one length) as a matrix of whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            part = batch.slice(at, limit)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _numbers(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a, np.float64).tobytes() for a in arrays]


def _folded(parts: DataFrame, merge: Callable[[list[dict]], dict]) -> dict | None:
    """All rows of ``parts`` (with a column part) merged into one, FAN at a time, by tasks; only that one comes to the driver."""
    schema = parts.schema
    names = [c for c in parts.columns if c != "part"]

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = merge(frame.sort_values("part")[names].to_dict("records"))
        return pd.DataFrame([{"part": key[0], **out}])[schema.names]

    parts = stage(parts, "parts")
    left = parts.agg(F.max("part")).first()[0]
    if left is None:
        return None
    while True:
        parts = stage(parts.groupBy(F.expr(f"part div {FAN}").alias("group")).applyInPandas(merged, schema), "parts")
        left //= FAN
        if not left:
            return parts.first().asDict()


_SPECTRUM = "part long, n long, high binary, low binary, mean binary, vals binary, vectors binary"
_CUT = 20


def _spectra(width: int) -> Callable:
    """One row of each task: number and sum (exact, in two halves) of its vectors, and their spectrum."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, high, low = Spectrum.empty(width), np.zeros(width, object), np.zeros(width, object)
        for _, x in _matrices(batches):
            high = high + (x >> _CUT).sum(0).astype(object)
            low = low + (x & ((1 << _CUT) - 1)).sum(0).astype(object)
            own.add(x.astype(np.float64))
        if own.n:
            sums = [" ".join(map(str, s)).encode() for s in (high, low)]
            row = [TaskContext.get().partitionId(), own.n, *sums, *_numbers(own.mean, own.values, own.vectors)]
            yield pa.record_batch([pa.array([v]) for v in row], names=["part", "n", "high", "low", "mean", "vals", "vectors"])

    return grow


def _merge_spectra(width: int) -> Callable[[list[dict]], dict]:
    def merge(rows: list[dict]) -> dict:
        total = None
        sums = {c: np.zeros(width, object) for c in ("high", "low")}
        for r in rows:
            for c in sums:
                sums[c] = sums[c] + np.array([int(v) for v in bytes(r[c]).split()], object)
            mean, values = (np.frombuffer(r[c], np.float64).copy() for c in ("mean", "vals"))
            one = Spectrum(r["n"], mean, values, np.frombuffer(r["vectors"], np.float64).reshape(width, width).copy())
            if total is None:
                total = one
            else:
                total.merge(one)
        packed = dict(zip(("mean", "vals", "vectors"), _numbers(total.mean, total.values, total.vectors), strict=True))
        return {"n": total.n, **{c: " ".join(map(str, s)).encode() for c, s in sums.items()}, **packed}

    return merge


def _products(basis: np.ndarray, centre: np.ndarray) -> Callable:
    """One row of each task: the sum of products of its vectors, centred and projected on the basis."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((basis.shape[1],) * 2), False
        for _, x in _matrices(batches):
            y = (x - centre) @ basis
            total += y.T @ y
            any_ = True
        if any_:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array(_numbers(total))], names=["part", "total"])

    return add


def _covariance(fit: DataFrame, basis: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    def merge(rows: list[dict]) -> dict:
        return {"total": _numbers(sum(np.frombuffer(r["total"], np.float64) for r in rows))[0]}

    total = _folded(fit.mapInArrow(_products(basis, centre), "part long, total binary"), merge)["total"]
    return np.frombuffer(total, np.float64).reshape(basis.shape[1], -1) / n


@dataclass
class Whitening:
    """Components (columns, by falling eigenvalue) of the covariance of n distinct vectors with the sums ``sums``."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    total: float
    identity_error: float

    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        with np.errstate(all="ignore"):
            return np.where(self.values > 0, ((x - self.centre()) @ self.components) / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum) ** 2, exact; None beyond a long."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach * reach * max(1, x.shape[1]) < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        out = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1).tolist()
        return [v if v < 2**63 else None for v in out]


def _usual_length(rows: DataFrame) -> int | None:
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return lengths["width"] if lengths else None


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors x (whole numbers, all of one length) of ``rows``; None without rows."""
    width = _usual_length(rows)
    if width is None:
        return None
    distinct = stage(rows.filter(F.size("x") == width).select("x").distinct(), "fit")
    merged = _folded(distinct.mapInArrow(_spectra(width), _SPECTRUM), _merge_spectra(width))
    n = merged["n"]
    sums = [(int(h) << _CUT) + int(v) for h, v in zip(*(bytes(merged[c]).split() for c in ("high", "low")), strict=True)]
    made = Whitening(n, sums, np.zeros(0), np.zeros(0), 0.0, 0.0)
    basis = np.frombuffer(merged["vectors"], np.float64).reshape(width, width)
    basis = np.linalg.qr(basis[:, ::-1])[0]
    values, turn = np.linalg.eigh(_covariance(distinct, basis, made.centre(), n))
    values, turn = values[::-1], turn[:, ::-1]
    made.total = float(values.sum())
    own = (basis @ turn)[:, :components]
    own /= np.sqrt((own * own).sum(0))
    own *= np.where(own[np.abs(own).argmax(0), np.arange(own.shape[1])] < 0, -1.0, 1.0)
    kept = values[:components]
    made.values, made.components = np.where(kept > width * _EPS * values[0], kept, 0.0), own
    live = made.values > 0
    if live.any():
        scaled = own[:, live] / np.sqrt(made.values[live])
        made.identity_error = float(np.abs(_covariance(distinct, scaled, made.centre(), n) - np.eye(int(live.sum()))).max())
    return made


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vectors`` without the rows that take no part, with column ``whitened``: an array of as many entries as components."""
    vectors = vectors.drop("whitened")
    x = stage(vectors.withColumn("x", quantised(column)).filter("x IS NOT NULL").select("x"), "vectors")
    made = fit(x, components)
    names = vectors.columns
    schema = StructType(list(vectors.schema.fields)).add("whitened", ArrayType(DoubleType()))
    if made is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _matrices(batches):
            out = pa.array([[None if np.isnan(v) else v for v in row] for row in made.project(own).tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("row").field(i) for i in range(len(names))] + [out], names=[*names, "whitened"])

    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = vectors.select(row, quantised(column).alias("x")).filter(F.size("x") == made.components.shape[0])
    return rows.mapInArrow(project, schema)


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of all embeddings, whitened."""
    vectors = read_table(spark, sf_dir, "embeddings")
    rows = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised().alias("x")).filter("x IS NOT NULL"), "vectors")
    made = fit(rows)
    if made is None:
        return spark.createDataFrame([], _SCHEMA)
    width, k = made.components.shape
    explained = made.values / made.total if made.total > 0 else np.zeros(k)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            m = part.num_rows
            yield pa.record_batch([
                part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, made.n)),
                pa.array([v for v in made.deviation(x) for _ in range(k)], pa.int64()), pa.array(made.project(x).reshape(-1), from_pandas=True),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, made.identity_error))], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    return rows.filter(F.size("x") == width).mapInArrow(emit, _SCHEMA)
