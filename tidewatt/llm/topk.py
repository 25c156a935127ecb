"""Exact search of the largest inner products, block at a time (operator 3).

Vectors, quantised to whole numbers, are put in order of vec_id and cut into
blocks. A block is one row: its forward index (the matrix of its vectors) and
the largest and smallest value of each component. A component that is positive
in a query is a term whose maximum in a block is the component's largest
value, one that is negative a term with the smallest; their sum, weighted by
the query, bounds every score in the block.

A task holds a block of queries and a run of blocks. Each query takes the
blocks in the order of their bounds and scores them whole until the bound of
the next is below its k-th score so far; a bound equal to it is still scored,
for ties. The tops of the runs are merged per query.

All queries meet all blocks, in blocks, as the task has it; pruning saves
scoring, and only the k best of each run are emitted.

Defined results: vectors that are null or hold null or non-finite components,
and rows without a vec_id, take no part; shorter vectors count as filled with
zeros; rows that repeat a vec_id are rows of their own, of which a query only
leaves out itself; no rows give no rows; scores beyond the range of a long are
cut to it; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import read_table
from tidewatt.llm.neardup import _groups as groups
from tidewatt.session import stage

K = 20
EVERY = 20
SCALE = 64
BLOCK = 512
#: Blocks of a run, and queries of a block of queries.
RUN = 16
QUERIES = 1024
_EXACT = 2.0**53


def valid(column: str = "embedding") -> Column:
    """Not null, and every component a finite number."""
    # comparisons put NaN above all numbers, so the upper bound keeps it out
    finite = F.forall(column, lambda x: F.coalesce((x < F.lit(float("inf"))) & (x > F.lit(float("-inf"))), F.lit(False)))
    return F.coalesce(F.col(column).isNotNull() & finite, F.lit(False))


def _pack(matrix: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as 4- or 8-byte integers, or beyond those as floating numbers (kind 4, 8 or 0)."""
    most = np.abs(matrix).max(initial=0)
    kind = 4 if most < 2**31 else 8 if most < 2**62 else 0
    return kind, matrix.astype({4: np.int32, 8: np.int64, 0: np.float64}[kind]).tobytes()


def _unpack(kind: int, data: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(data, {4: np.int32, 8: np.int64, 0: np.float64}[kind])
    return flat.reshape(-1, width) if width else np.zeros((len(flat), 0))


_BLOCK_FIELDS = "run int, block long, ids binary, n int, width int, kind int, vectors binary"


def _cut(every: int):
    """Sorted vectors as blocks; a run is what one task has, or a part of it."""

    def block(run: int, number: int, ids: np.ndarray, rows: list) -> pa.RecordBatch:
        width = max(map(len, rows), default=0)
        matrix = np.zeros((len(rows), width))
        for k, row in enumerate(rows):
            matrix[k, :len(row)] = np.floor(SCALE * np.asarray(row, np.float64))
        kind, data = _pack(matrix)
        return pa.RecordBatch.from_pylist([{"run": run, "block": number, "ids": ids.tobytes(), "n": len(ids), "width": width, "kind": kind, "vectors": data}], schema=pa.schema([
            ("run", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.int32()), ("vectors", pa.binary())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, rows = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_numpy(zero_copy_only=False), strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == every:
                    yield block(part, (part << 32) + number, np.array(ids, np.int64), rows)
                    number, ids, rows = number + 1, [], []
        if ids:
            yield block(part, (part << 32) + number, np.array(ids, np.int64), rows)

    return cut


def blocks_of(vectors: DataFrame) -> DataFrame:
    """Block rows of ``vectors`` (vec_id, embedding), written; about RUN blocks share a run."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & valid()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    parts = max(1, -(-rows.count() // (BLOCK * RUN)))
    cut = rows.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").mapInArrow(_cut(BLOCK), _BLOCK_FIELDS)
    return stage(cut, "blocks")


def _collect_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries out of blocks of vectors: own rows (block and place), ids and vectors."""
    task, number = TaskContext.get().partitionId(), 0
    held, count = [], 0

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        width = max(v.shape[1] for _, _, _, v in rows)
        matrix = np.concatenate([np.pad(v.astype(np.float64), ((0, 0), (0, width - v.shape[1]))) for _, _, _, v in rows])
        kind, data = _pack(matrix)
        joined = [np.concatenate([r[i] for r in rows]).astype(np.int64) for i in range(3)]
        return pa.record_batch([pa.array([(task << 20) + number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in joined), pa.array([len(joined[0])], pa.int32()), pa.array([width], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())],
                               names=["queries", "own_block", "own_place", "ids", "n", "width", "kind", "vectors"])

    for batch in batches:
        for b in batch.to_pylist():
            ids = np.frombuffer(b["ids"], np.int64)
            at = np.flatnonzero(ids % EVERY == 0)
            if not len(at):
                continue
            held.append((np.full(len(at), b["block"]), at, ids[at], _unpack(b["kind"], b["vectors"], b["width"])[at]))
            count += len(at)
            if count >= QUERIES:
                yield pack(held)
                held, count, number = [], 0, number + 1
    if held:
        yield pack(held)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating numbers as long as they stay exact, else by Python's whole numbers."""
    if a.shape[1] * np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) < _EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.vectorize(lambda x: float(min(max(int(x), -2**63), 2**63 - 1024)), otypes=[float])(whole)


class Top:
    """The k best (score, id, row) of each query so far; empty places have a score of minus infinity."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def merge(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in scores (queries ``at`` x rows) of rows in order of their ids."""
        best = np.argsort(-score, axis=1, kind="stable")[:, :self.k]
        score = np.concatenate([self.score[at], np.take_along_axis(score, best, 1)], 1)
        ids = np.concatenate([self.id[at], ids[best]], 1)
        order = np.lexsort((ids, -score), axis=-1)[:, :self.k]
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def search(queries: dict, blocks: list[dict], k: int, scored: list | None = None) -> tuple[Top, np.ndarray, np.ndarray, np.ndarray]:
    """Top of each query over a run of blocks; ``scored`` gets the number of queries scored in each block visited."""
    own_block, own_place, ids = (np.frombuffer(queries[c], np.int64) for c in ("own_block", "own_place", "ids"))
    width = max([queries["width"], *(b["width"] for b in blocks)])

    def wide(row: dict) -> np.ndarray:
        matrix = _unpack(row["kind"], row["vectors"], row["width"]).astype(np.float64)
        return np.pad(matrix.reshape(row["n"], -1), ((0, 0), (0, width - row["width"])))

    q, own = wide(queries), [wide(b) for b in blocks]
    bound = np.maximum(q, 0) @ np.array([m.max(0) for m in own]).reshape(len(own), width).T + np.minimum(q, 0) @ np.array([m.min(0) for m in own]).reshape(len(own), width).T
    bound *= np.where(bound > 0, 1 + 1e-12, 1 - 1e-12)  # above any rounding
    order = np.argsort(-bound, axis=1, kind="stable")
    top = Top(len(q), k)
    alive = np.ones(len(q), bool)
    for turn in range(len(blocks)):
        now = order[:, turn]
        alive &= bound[np.arange(len(q)), now] >= top.score[:, -1]
        if not alive.any():
            break
        for b in np.unique(now[alive]):
            at = np.flatnonzero(alive & (now == b))
            score = _product(q[at], own[b])
            mine = np.flatnonzero(own_block[at] == blocks[b]["block"])
            score[mine, own_place[at[mine]]] = -np.inf
            top.merge(at, score, np.frombuffer(blocks[b]["ids"], np.int64))
            if scored is not None:
                scored.append(len(at))
    return top, own_block, own_place, ids


def _score(k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["queries", "run"]):
            rows = group.to_pylist()
            asked, blocks = [r for r in rows if r["own_block"] is not None], [r for r in rows if r["own_block"] is None]
            if not asked or not blocks:
                continue
            top, own_block, own_place, ids = search(asked[0], blocks, k)
            q, place = np.nonzero(np.isfinite(top.score))
            yield pa.record_batch([pa.array(x) for x in (own_block[q], own_place[q], ids[q], top.id[q, place], top.score[q, place].astype(np.int64))], names=["own_block", "own_place", "query_id", "vec_id", "score"])

    return score


def top_k(vectors: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best rows for each vector whose vec_id is divisible by EVERY."""
    blocks = blocks_of(vectors)
    n = blocks.agg(F.sum("n")).first()[0] or 0
    asked = stage(blocks.repartition(max(1, -(-n // (EVERY * QUERIES)))).mapInArrow(_collect_queries, "queries long, own_block binary, own_place binary, ids binary, n int, width int, kind int, vectors binary"), "queries")
    common = ["queries", "run", "block", "own_block", "own_place", "ids", "n", "width", "kind", "vectors"]
    meet = asked.select("queries").crossJoin(blocks.select("run").distinct())
    of_queries = meet.join(asked, "queries").withColumn("block", F.lit(None).cast("long")).select(*common)
    of_blocks = meet.join(blocks, "run").withColumns({"own_block": F.lit(None).cast("binary"), "own_place": F.lit(None).cast("binary")}).select(*common)
    work = of_queries.unionByName(of_blocks).repartition("queries", "run").sortWithinPartitions("queries", "run")
    found = work.mapInArrow(_score(k), "own_block long, own_place long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("own_block", "own_place").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query vector."""
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
