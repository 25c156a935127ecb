"""Words, hashes and tables shared by the operators of this package.

Texts are handled as one byte buffer per Arrow batch, so that splitting and
hashing words costs a few numpy passes and no Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.session import scratch_path

#: Bytes of text that are worked on at once inside one Arrow batch.
CHUNK_BYTES = 1 << 20
#: A bitmap is made in 2 ** BLOCK_BITS blocks.
BLOCK_BITS = 8

_rng = np.random.default_rng(20240601)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """As many partitions as the session shuffles into, or as the input has if that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def stage_packed(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Like ``stage``, for tables with text: written with a stronger compression, at ``path`` if it is given."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(column: str = "text") -> list:
    """Two columns that name a text: 128 bits of two hashes with different seeds; null counts as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins (one more entry than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunked(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, low + 65536, n)
        yield low, high
        low = high


@dataclass
class Words:
    """The words of some rows: ``start`` and ``end`` are places in ``data``; row r has words ``first[r]:first[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool) -> Words:
    """Words are runs of bytes marked in ``inside``; no word crosses a row."""
    base = int(offsets[0])
    data = data[base:int(offsets[-1])]
    if lower:
        data = LOWER[data]
    at = offsets - base
    mark = inside[data]
    new = mark.copy()
    new[1:] &= ~mark[:-1]
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    edge = at[:-1][at[:-1] < len(data)]
    new[edge] = mark[edge]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = mark[edge]
    start = np.flatnonzero(new)
    return Words(data, start, np.flatnonzero(last) + 1, np.searchsorted(start, at))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BYTE_BASE, np.uint64))])
    return _powers


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    length = words.end - words.start
    if not len(length):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    value = _BYTE_VALUE[words.data[place + np.repeat(words.start, length)]]
    value *= _powers_to(int(length.max()))[place]
    return mixed(np.add.reduceat(value, begin))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries (one for each place where n entries are left)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, power, part, size = None, 0, {1: _WORD_BASE}, h, 1
    left = n
    while left:
        if left & 1:
            tail = part[done:done + len(h) - n + 1]
            out = tail if out is None else out * power[size] + tail
            done += size
        left >>= 1
        if left:
            part = part[:-size] * power[size] + part[size:]
            power[2 * size] = power[size] * power[size]
            size *= 2
    return mixed(out + np.uint64(n))


def whole_runs(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks, for each place of gram_hashes, whether its n words lie in one row."""
    if total < n:
        return np.zeros(0, bool)
    stop = np.repeat(first[1:], np.diff(first))
    return np.arange(total - n + 1) + n <= stop[:total - n + 1]


class Bitmap:
    """Set of keys that may hold others too; its size does not depend on them.

    Keys are mixed before they are placed: those that are minima of hashes would crowd the low blocks.
    """

    def __init__(self, keys: DataFrame, bits: int) -> None:
        """``keys`` has key. Blocks of the bitmap are made by tasks; all of them together are 2 ** bits / 8 bytes."""
        self.bits = bits
        inner = bits - BLOCK_BITS

        def fill(block: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = np.zeros(1 << inner, bool)
            for frame in frames:
                part[frame["bit"].to_numpy()] = True
            yield pd.DataFrame({"block": [block[0]], "part": [np.packbits(part).tobytes()]})

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = mixed(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
                block, bit = at >> np.uint64(inner), at & np.uint64((1 << inner) - 1)
                yield pa.record_batch([pa.array(block.astype(np.int32)), pa.array(bit.view(np.int64))], names=["block", "bit"])

        rows = keys.select("key").mapInArrow(place, "block int, bit long")
        self.map = np.zeros((1 << BLOCK_BITS, (1 << inner) // 8), np.uint8)
        for r in rows.groupBy("block").applyInPandas(fill, "block int, part binary").collect():
            self.map[r["block"]] = np.frombuffer(r["part"], np.uint8)
        self.map = self.map.reshape(-1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = mixed(keys) >> np.uint64(64 - self.bits)
        return (self.map[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1


#: Tables that a worker keeps from task to task for one operator; they go when it comes to another's texts.
KEPT_TABLES: list[dict] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on from task to task and would keep its largest batch's."""
    pa.default_memory_pool().release_unused()
    if _trim:  # not every C library has it
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of Arrow batches with a bounded number of text bytes, with those bytes and the rows' offsets."""
    for table in KEPT_TABLES:
        table.clear()
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for low, high in chunked(offsets, limit):
            yield batch.slice(low, high - low), data, offsets[low:high + 1]
        del batch, data, offsets
        give_back()
