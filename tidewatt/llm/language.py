"""Language identification by error-correcting output codes (operator 9).

Each language has a codeword of bits. For every bit a binary classifier, a
logistic one over hashed counts of runs of one to four bytes, predicts on
which side a text lies. Decoding is weighted by loss: a language's loss is the
sum, over the bits, of the logistic loss of the classifier's margin against
the language's bit; the language of least loss is chosen, and the text is
flagged as ambiguous where the next one is closer than a margin.

The classifiers are fitted on the driver from a bounded sample of labelled
rows (``SAMPLE_ROWS`` in all, shared by the languages), chosen by a hash of
the text; scoring reads every whole text, in byte blocks, where Spark has it.

Defined results: a null text, or one without a letter, is ``und`` with score
0; so is every text if there is no labelled row to learn from, where the
pipeline keeps all texts with a letter (``lettered``); rows that repeat get the
same answer; ties between languages go to the first by name;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatt.llm.common import LOWER, read_table, slices

UNKNOWN = "und"
BUCKETS = 2048
RUNS = (1, 2, 3, 4)
#: Rows that the classifiers are fitted on, at most about as many.
SAMPLE_ROWS = 2400
#: Losses closer than this leave the choice of language open.
MARGIN = 0.7
_LETTERS = bytes([*range(65, 91), *range(97, 123)])


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 3; 1 is held out. A null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def run_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, the square roots of the shares of its hashed runs of bytes; rows of zeros for empty texts."""
    at = offsets - offsets[0]
    text = LOWER[data[int(offsets[0]):int(offsets[-1])]].astype(np.uint32)
    rows = len(at) - 1
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at)) * BUCKETS
    total = np.zeros(rows * BUCKETS)
    key = np.zeros(len(text), np.uint32)
    stop = np.repeat(at[1:], np.diff(at))
    for n in range(1, max(RUNS) + 1):
        size = len(text) - n + 1
        if size <= 0:
            break
        key = key[:size] * np.uint32(0x01000193) + text[n - 1:] + np.uint32(n)
        if n in RUNS:
            whole = np.arange(size) + n <= stop[:size]
            bucket = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            total += np.bincount((row[:size] + bucket)[whole], minlength=rows * BUCKETS)
    counts = total.reshape(rows, BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """One row of -1 and 1 for each of n languages.

    Up to seven languages: every way to part them in two, once. More: of some
    hundred random codes the one whose nearest two rows differ most.
    """
    if n <= 7:
        masks = range(1, 1 << max(n - 1, 0)) if n > 1 else [1]
        return np.array([[1 if i and mask >> (i - 1) & 1 else -1 for mask in masks] for i in range(n)], np.float32)
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each language (columns) for each row of run_counts."""
        margin = x @ self.weight + self.bias
        return np.logaddexp(0, -margin) @ np.maximum(self.code, 0).T + np.logaddexp(0, margin) @ np.maximum(-self.code, 0).T


def fit(x: np.ndarray, y: list[str], steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model | None:
    """Fit the classifiers of all bits together; every language weighs the same."""
    languages = sorted(set(y))
    if not languages:
        return None
    code = codewords(len(languages))
    own = np.array([languages.index(v) for v in y])
    sign = code[own]
    share = (1 / np.bincount(own, minlength=len(languages)))[own, None].astype(np.float32) / len(languages)
    weight, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, steps + 1):
        margin = np.clip(sign * (x @ weight + bias), -50, 50)
        slope = -sign / (1 + np.exp(margin)) * share
        for value, grad, k in ((weight, x.T @ slope + decay * weight, 0), (bias, slope.sum(0), 2)):
            state[k] += 0.1 * (grad - state[k])
            state[k + 1] += 0.001 * (grad * grad - state[k + 1])
            value -= rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, code, weight, bias)


def sample_rows(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """About ``bound`` rows, as many of each label as there are, chosen by a hash of the text; all rows if there are fewer."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows
    each = bound / len(counts)
    part = F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (part < F.lit(min(1.0, each / n))))
    return rows.filter(keep)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        for low in range(0, rows.num_rows, 128):
            some = rows.slice(low, 128)
            x = run_counts(data, offsets[low:low + 129])
            yield pa.record_batch([some.column("label"), pa.array([v.tobytes() for v in x], pa.binary())], names=["label", "x"])


def learn(labelled: DataFrame, bound: int = SAMPLE_ROWS) -> Model | None:
    """A model from rows with text and lang (those without a language or a letter are left out)."""
    rows = labelled.select("text", F.col("lang").alias("label")).filter(r"label IS NOT NULL AND text RLIKE '\\p{L}'")
    got = sample_rows(rows, "label", bound).mapInArrow(_features, "label string, x binary").toPandas()
    got = got.sort_values(["label", "x"], ignore_index=True)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), BUCKETS)
    return fit(x, got["label"].tolist())


def has_letter(text: bytes) -> bool:
    """A plain letter is found at once; only texts without one are decoded."""
    return text[:64].translate(None, _LETTERS) != text[:64] or any(map(str.isalpha, text.decode()))


def predict(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, of each row."""
    rows = len(offsets) - 1
    names, score, open_ = [UNKNOWN] * rows, np.zeros(rows), np.zeros(rows, bool)
    if model is None:
        return names, score, open_
    for low in range(0, rows, 128):
        losses = model.losses(run_counts(data, offsets[low:min(low + 128, rows) + 1]))
        order = np.sort(losses, 1)
        chance = np.exp(order[:, :1] - losses)
        for k, best in enumerate(losses.argmin(1)):
            text = bytes(data[offsets[low + k]:offsets[low + k + 1]])
            if has_letter(text):
                names[low + k], score[low + k] = model.languages[best], 1 / chance[k].sum()
                open_[low + k] = order.shape[1] > 1 and order[k, 1] - order[k, 0] < MARGIN
    return names, score, open_


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` and, of each row, lang_pred, lang_score and lang_ambiguous; column text is read, all others are handed on, but for earlier ones of those three names."""
    docs = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    names = docs.columns
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            lang, value, open_ = predict(model, data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(value), pa.array(open_)], names=[*names, "lang_pred", "lang_score", "lang_ambiguous"])

    return docs.mapInArrow(score, schema)


def fitted(docs: DataFrame) -> Model | None:
    return learn(docs.filter(fold() != 1))


def recognised(docs: DataFrame, model: Model | None, languages: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that the model takes for one of ``languages`` (unless given: all it has learnt).

    A null lang becomes the predicted one; a stated lang stays. Texts without a letter have no language and go.
    """
    wanted = None if languages is None else set(languages)
    at = docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            found, _, _ = predict(model, data, offsets)
            lang = pc.coalesce(rows.column(at), pa.array(found, rows.column(at).type))
            columns = [lang if k == at else c for k, c in enumerate(rows.columns)]
            held = [v != UNKNOWN and (wanted is None or v in wanted) for v in found]
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names).filter(pa.array(held, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter: what can be told without a model."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            yield rows.filter(pa.array([has_letter(bytes(data[low:high])) for low, high in zip(offsets[:-1], offsets[1:], strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (fold() == 1).alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    model = fitted(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            lang, value, open_ = predict(model, data, offsets)
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(value), pa.array(open_)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(score, schema)

