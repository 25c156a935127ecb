"""Importance resampling towards a target distribution (operator 11).

Documents are drawn by how much more often their hashed features (words and
pairs of adjacent words) occur in a target table than in the corpus.

1. The distinct words of corpus and target are counted. The most frequent, up to
   ``DICTIONARY_WORDS`` of them, make up an Aho-Corasick dictionary: a pattern is
   a word between two delimiters, its payload the word's CRC-32 and length.
   Its size is bounded by ``DICTIONARY_WORDS`` and ``DICTIONARY_LENGTH``
   whatever the corpus; it is broadcast as a list of words, and a worker makes
   the automaton once.
2. A scan of a text emits the payloads of its words in order. The CRC of two
   adjacent words with a space between is composed of their payloads: the
   first one's CRC, moved on by as many zero bytes as the second is long, and
   the second one's. Nothing is hashed twice. Words that the bounded
   dictionary does not hold (rare or long ones) emit nothing; they get their
   payload from their bytes and take part alike.
3. One scan counts the buckets of the corpus, one those of the target. The
   gain of a bucket is the logarithm of the ratio of its smoothed shares.
4. A second scan of the corpus gives each document the mean gain of its
   features, to which noise that depends on doc_id alone is added (Gumbel), so
   that the highest scores are a draw without replacement.
5. The rank is a distributed sort: rows are dealt by range of score, and a
   table with one row for each part gives the number of rows before.

Defined results: a null text has no words; documents without features have
weight 0 and are never drawn; a null doc_id counts as an empty text for the
noise and comes first among equal scores; rows that repeat are documents of
their own, with the same score; an empty target has no counts, so the smoothed
shares alone tell buckets apart; no documents give no rows; other columns are
not looked at. ``resample`` keeps all columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.common import ALNUM, CHUNK_BYTES, LOWER, read_table, slices, split_words, text_key, word_hashes
from tidewatt.llm.sharding import ranked
from tidewatt.session import stage

BUCKETS = 10_000
#: Bounds of the dictionary: its words, and the bytes of each.
DICTIONARY_WORDS = 1 << 17
DICTIONARY_LENGTH = 64
#: Percentage of documents drawn, and the words that a document needs to be drawn.
SHARE = 25
LEAST_WORDS = 20
NOISE = "7:"
_POLYNOMIAL = 0xEDB88320
_WORD = ALNUM[LOWER]


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    """CRCs moved on by one zero byte, without the inversions at begin and end."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(_POLYNOMIAL) * (crc & np.uint32(1)))
    return crc


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, as a table for each byte, of many CRCs."""
    out = table[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _moves() -> list[np.ndarray]:
    """Tables of moving a CRC on by 1, 2, 4, ... zero bytes."""
    tables = [np.stack([_zero_byte(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])]
    while len(tables) < 31:
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


_MOVES = _moves()
_SPACE = np.uint32(zlib.crc32(b" "))


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings put together, of their CRCs and the length of the second."""
    moved = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero((length >> k) & 1)
        moved[some] = _apply(_MOVES[k], moved[some])
    return moved ^ second


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows as they are, or one very long row in pieces that end with whole words."""
    low, stop = int(offsets[0]), int(offsets[-1])
    if len(offsets) > 2 or stop - low <= 2 * CHUNK_BYTES:
        yield data, offsets
        return
    while low < stop:
        high = min(low + CHUNK_BYTES, stop)
        while high < stop:
            ends = np.flatnonzero(~_WORD[data[high:high + CHUNK_BYTES]])
            high = min(high + (int(ends[0]) if len(ends) else CHUNK_BYTES), stop)
            if len(ends):
                break
        yield data, np.array([low, high], np.int64)
        low = high


class Dictionary:
    """Words with payloads (CRC-32, and length above it) and the automaton that finds them between delimiters."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = b" ".join(words)
        self.automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return {"words": self.words, "automaton": None}

    def _ready(self) -> ahocorasick.Automaton:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for word in self.words.split():
                self.automaton.add_word(f" {word.decode('latin-1')} ", self._payload(word))
            if len(self.automaton):
                self.automaton.make_automaton()
        return self.automaton

    @staticmethod
    def _payload(word: bytes) -> int:
        return len(word) << 32 | zlib.crc32(word)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Payload and row of every word of the rows, in order."""
        words = split_words(data, offsets, ALNUM, lower=True)
        row = words.row()
        payload = np.full(len(row), -1, np.int64)
        found = self._ready()
        if len(found) and len(row):
            # rows with one delimiter before each of them and all others in their place
            own = np.diff(offsets)
            text = np.full(len(words.data) + len(own) + 1, 32, np.uint8)
            place = np.arange(len(words.data)) + np.repeat(np.arange(1, len(own) + 1), own)
            text[place] = np.where(ALNUM[words.data], words.data, np.uint8(32))
            emitted = np.fromiter(found.iter(text.tobytes().decode("latin-1")), [("end", np.int64), ("payload", np.int64)])
            payload[np.searchsorted(words.end + row + 1, emitted["end"])] = emitted["payload"]
        for k in np.flatnonzero(payload < 0).tolist():
            payload[k] = self._payload(words.data[words.start[k]:words.end[k]].tobytes())
        return payload, row

    def features(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For the rows, or pieces of them, the row of each word, and row and bucket of each feature."""
        before = None
        for part, at in _pieces(data, offsets):
            payload, row = self.scan(part, at)
            crc, length = (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32
            own = row
            if before is not None:  # the last word of the piece before is the first of a pair, and no feature of its own
                crc, length, row = np.append(before[0], crc), np.append(before[1], length), np.append(0, row)
            pair = np.flatnonzero(row[1:] == row[:-1])
            spaced = _apply(_MOVES[0], crc[pair]) ^ _SPACE
            pairs = joined(spaced, crc[pair + 1], length[pair + 1])
            single = crc[len(crc) - len(own):]
            yield own, np.append(own, row[pair]), np.append(single, pairs).astype(np.int64) % BUCKETS
            if len(crc) and len(offsets) == 2:
                before = crc[-1:], length[-1:]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words (short ones) of parts of the input and how often they occur."""
    for _, data, offsets in slices(batches):
        for part, at in _pieces(data, offsets):
            words = split_words(part, at, ALNUM, lower=True)
            _, first, n = np.unique(word_hashes(words), return_index=True, return_counts=True)
            short = words.end[first] - words.start[first] <= DICTIONARY_LENGTH
            found = [words.data[words.start[k]:words.end[k]].tobytes() for k in first[short]]
            yield pa.record_batch([pa.array(found, pa.binary()), pa.array(n[short])], names=["word", "n"])


def dictionary(*texts: DataFrame, words: int = DICTIONARY_WORDS) -> Dictionary:
    """The most frequent words of the tables' column text, ``words`` at most.

    Words are taken by levels of frequency (sixteen for each doubling) from the
    top, as long as a level fits whole. So only the levels' sizes and the
    words taken come to the driver, whatever the number of words and tasks.
    """
    counted = None
    for table in texts:
        own = table.select("text").mapInArrow(_words, "word binary, n long")
        counted = own if counted is None else counted.unionByName(own)
    level = F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int").alias("level")
    counted = stage(counted.groupBy("word").agg(F.sum("n").alias("n")).select("word", level), "words")
    sizes = counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    lowest, room = None, words
    for r in sizes:
        room -= r["n"]
        if room < 0:
            break
        lowest = r["level"]
    if lowest is None:
        return Dictionary([])
    return Dictionary(sorted(bytes(r["word"]) for r in counted.filter(F.col("level") >= lowest).select("word").collect()))


def bucket_counts(texts: DataFrame, shared) -> np.ndarray:
    """How many features of the column text fall into each bucket; ``shared`` is a broadcast dictionary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for _, data, offsets in slices(batches):
            for _, _, bucket in shared.value.features(data, offsets):
                counts += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # one row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, with one count added to each."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _score(shared, gain: np.ndarray) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            n_words, n, total = (np.zeros(rows.num_rows, np.int64) for _ in range(3))
            for word_row, row, bucket in shared.value.features(data, offsets):
                n_words += np.bincount(word_row, minlength=rows.num_rows)
                n += np.bincount(row, minlength=rows.num_rows)
                total += np.bincount(row, weights=gain[bucket], minlength=rows.num_rows).astype(np.int64)
            yield pa.record_batch([*(rows.column(c) for c in ("doc_id", "k1", "k2")), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "k1", "k2", "n_words", "n_features", "weight"])

    return score


def _noise() -> Column:
    head = F.substring(F.sha2(F.concat(F.lit(NOISE), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def importance(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, k1, k2 (the text's key), n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).

    Of the documents of at least ``least`` words ``share`` percent are drawn; the rank of the others is null.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionary(docs, target))
    gain = gains(bucket_counts(docs, shared), bucket_counts(target, shared))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text").mapInArrow(
        _score(shared, gain), "doc_id long, k1 long, k2 long, n_words long, n_features long, weight long")
    order = {"later": (F.col("n_words") < least).cast("int"), "lower": -F.col("score"), "tie": F.monotonically_increasing_id()}
    scored = stage(scored.withColumn("score", F.col("weight") + _noise()).withColumns(order), "scored")
    drawn = scored.filter("later = 0").count() * share // 100
    out = ranked(scored, ["later", "lower", "doc_id", "tie"])
    rank = F.when((F.col("later") == 0) & (F.col("rank") < drawn), F.col("rank") + 1).alias("rank")
    return out.select("doc_id", "k1", "k2", "n_words", "n_features", "weight", "score", rank)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows alike in doc_id and text all stay if one of them is drawn."""
    drawn = importance(docs, target, share, least).filter("rank IS NOT NULL")
    drawn = stage(drawn.select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), "drawn")
    k1, k2 = text_key()
    same = (k1 == F.col("__k1")) & (k2 == F.col("__k2")) & docs["doc_id"].eqNullSafe(F.col("__id"))
    return docs.join(drawn, same, "left_semi")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a quarter of them drawn towards the benchmark."""
    out = importance(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
