"""A linear forecaster trained in rounds, with its validation history.

The squared loss of a linear model over any rows is a function of the sums of
products of their columns. Those are added up in one pass over training and
validation rows, whatever their number; all rounds of all trials are then steps
on a matrix as wide as the model has inputs. Only the absolute error needs the
rows again: one pass scores the models of all rounds, or of all trials, at once.

A round is one step of gradient descent with momentum on standardised inputs.
The rate rises over the first rounds, falls when the validation loss stays flat,
and training stops when it has not fallen for some rounds; the weights of the
best round are kept.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WindowError
from ..schema import (
    MAX_ROUNDS, MIN_RATE, PATIENCE, RATE_FACTOR, RATE_PATIENCE, SEARCH_PATIENCE, SEARCH_ROUNDS, TRIALS, WARMUP_ROUNDS,
)

# A loss has to fall by more than this to count as better.
MIN_DELTA = 1e-7
# Inputs of less variance are constant.
MIN_VARIANCE = 1e-12
SEARCH_SPACE = {
    "learning_rate": [0.1, 0.3, 0.6, 0.9],
    "momentum": [0.0, 0.5, 0.8, 0.9, 0.95],
    "l2": [0.0, 1e-4, 1e-3, 1e-2],
    "warmup": [0, WARMUP_ROUNDS],
}


@dataclass(frozen=True)
class Settings:
    """How to train; the rate is relative to the number of inputs that vary, and safe up to 1 + momentum."""

    learning_rate: float = 0.9
    momentum: float = 0.9
    l2: float = 0.0
    warmup: int = WARMUP_ROUNDS
    rounds: int = MAX_ROUNDS
    patience: int = PATIENCE


@dataclass
class Moments:
    """Products of (1, inputs..., label), summed over the rows of each split."""

    inputs: list[str]
    sums: dict[str, np.ndarray] = field(default_factory=dict)

    def rows(self, split: str) -> int:
        return int(self.sums[split][0, 0]) if split in self.sums else 0


@dataclass
class Trained:
    """Models of all rounds (rows: intercept, weights), the history, and the round that is kept (from 1)."""

    inputs: list[str]
    models: np.ndarray
    history: dict[str, list[float]]
    best: int

    def model(self) -> PipelineModel:
        """The kept model as a pipeline of one SQL expression, which is compiled with the rest of the query."""
        intercept, *weights = self.models[self.best - 1].tolist()
        terms = [f"{w!r}D * `{c}`" for w, c in zip(weights, self.inputs, strict=True) if w]
        return PipelineModel([SQLTransformer(statement=f"SELECT *, ({' + '.join([f'{intercept!r}D', *terms])}) AS scaled_yhat FROM __THIS__")])


def _finite(batch: pa.RecordBatch, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(1, inputs..., label) of the rows without nulls or NaN, and which rows those are."""
    columns = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]
    x = np.column_stack([np.ones(batch.num_rows), *columns])
    whole = np.isfinite(x).all(1)
    return x[whole], whole


def moments(rows: DataFrame, inputs: Sequence[str], label: str = "label", split: str = "split") -> Moments:
    """Sums over the whole table; a task gives one row for each split and pair of columns."""
    names = [*inputs, label]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x, whole = _finite(batch, names)
            part = np.asarray(batch.column(split).to_pylist(), object)[whole]
            for value in set(part.tolist()):
                own = x[part == value]
                total[value] = total.get(value, 0.0) + own.T @ own
        for value, sums in total.items():
            n = sums.size
            yield pa.record_batch([pa.array([value] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(sums.reshape(-1))], names=[split, "cell", "value"])

    width = len(names) + 1
    out = Moments(list(inputs))
    added = rows.select(split, *names).mapInArrow(add, f"{split} string, cell int, value double").groupBy(split, "cell").agg(F.sum("value").alias("value"))
    for r in added.collect():  # as many rows as pairs of columns and splits
        out.sums.setdefault(r[split], np.zeros((width, width))).reshape(-1)[r["cell"]] = r["value"]
    return out


def train(sums: Moments, settings: Settings = Settings()) -> Trained:
    """Train on the split ``train``; the split ``val``, or without one ``train`` itself, says when to stop."""
    if not sums.rows("train"):
        raise WindowError("no training rows")
    mean = sums.sums["train"] / sums.sums["train"][0, 0]
    held = sums.sums["val"] / sums.sums["val"][0, 0] if sums.rows("val") else mean
    centre = mean[0, 1:]
    spread = mean[1:, 1:] - np.outer(centre, centre)
    variance = np.diagonal(spread)[:-1]
    live = variance > MIN_VARIANCE
    scale = np.where(live, np.sqrt(np.where(live, variance, 1.0)), 1.0)
    a = np.where(np.outer(live, live), spread[:-1, :-1] / np.outer(scale, scale), 0.0)
    b = np.where(live, spread[:-1, -1] / scale, 0.0)
    v, step = np.zeros(len(b)), np.zeros(len(b))
    rate, best, best_round, wait, flat = settings.learning_rate, np.inf, 0, 0, 0
    models, history = [], {"loss": [], "val_loss": [], "learning_rate": []}
    for number in range(1, settings.rounds + 1):
        used = rate * min(1.0, number / settings.warmup) if settings.warmup else rate
        slope = 2.0 * (a @ v - b) + 2.0 * settings.l2 * v
        step = settings.momentum * step - used / max(1, live.sum()) * slope
        v = v + step
        weights = v / scale
        model = np.concatenate([[centre[-1] - weights @ centre[:-1]], weights])
        signed = np.append(model, -1.0)
        loss, val_loss = signed @ mean @ signed, signed @ held @ signed
        models.append(model)
        for name, value in (("loss", loss), ("val_loss", val_loss), ("learning_rate", used)):
            history[name].append(float(value))
        if val_loss < best - MIN_DELTA:
            best, best_round, wait, flat = val_loss, number, 0, 0
            continue
        wait, flat = wait + 1, flat + 1
        if flat >= RATE_PATIENCE:
            rate, flat = max(rate * RATE_FACTOR, MIN_RATE), 0
        if wait >= settings.patience:
            break
    return Trained(sums.inputs, np.array(models), history, best_round)


def _scorer(models: np.ndarray, names: Sequence[str]) -> Callable:
    signed = np.column_stack([models, -np.ones(len(models))]).T

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(models)), 0
        for batch in batches:
            x, _ = _finite(batch, names)
            for at in range(0, len(x), 1024):
                total += np.abs(x[at:at + 1024] @ signed).sum(0)
            n += len(x)
        yield pa.record_batch([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(total), pa.array(np.full(len(models), n))], names=["model", "total", "n"])

    return score


def absolute_errors(rows: DataFrame, models: np.ndarray, inputs: Sequence[str], label: str = "label") -> list[float]:
    """Mean absolute error of every model over ``rows``, in one pass."""
    names = [*inputs, label]
    scored = rows.select(*names).mapInArrow(_scorer(models, names), "model int, total double, n long")
    means = scored.groupBy("model").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("error")).orderBy("model")
    return [float("nan") if r["error"] is None else r["error"] for r in means.collect()]


def search_points(trials: int = TRIALS, seed: int = 42) -> list[Settings]:
    """Distinct random settings, the same for a seed."""
    distinct = int(np.prod([len(v) for v in SEARCH_SPACE.values()]))
    if trials > distinct:
        raise ValueError(f"{trials} trials asked for, but the search space has {distinct} points")
    draw, points = random.Random(seed), []
    while len(points) < trials:
        point = Settings(**{k: draw.choice(v) for k, v in SEARCH_SPACE.items()}, rounds=SEARCH_ROUNDS, patience=SEARCH_PATIENCE)
        if point not in points:
            points.append(point)
    return points


def search(rows: DataFrame, sums: Moments, points: Sequence[Settings], label: str = "label", split: str = "split") -> list[dict]:
    """Every trial with its settings, rounds, best round, val_loss and val_mae; the rows are passed over once for all."""
    trained = [train(sums, p) for p in points]
    held = rows.where(F.col(split) == ("val" if sums.rows("val") else "train"))
    errors = absolute_errors(held, np.array([t.models[t.best - 1] for t in trained]), sums.inputs, label)
    return [
        {"trial": i, **asdict(p), "rounds": len(t.models), "best_round": t.best, "val_loss": t.history["val_loss"][t.best - 1], "val_mae": e}
        for i, (p, t, e) in enumerate(zip(points, trained, errors, strict=True))
    ]
