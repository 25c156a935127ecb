"""Removal of repeated passages by suffix automata (operator 5).

A passage of 35 words or more that starts anywhere else too is removed at all
its places. Matching every document against an automaton of every other one
would grow with the square of the corpus, so documents are first parted into
reference shards in such a way that all places of a repeated window of 35
words meet in one shard:

1. Every window has a key: the least hash of the runs of 18 words in it. Equal
   windows have equal keys. Consecutive windows with one key make a span.
   Counting the places of the keys' runs over all documents leaves the keys
   that lie at two places or more; they are broadcast as a bitmap of bounded
   size, which may let more through but loses none.
2. Spans of those keys are written, and put together where they are equal,
   with their number. The spans of a key are a reference shard.
3. A shard's spans make up a suffix automaton over words, with the number of
   places of each state. The spans are streamed through it; where the matched
   length reaches 35 words, the state of the last 35 tells whether they start
   at a second place. Maximal runs of words in such windows are removed.
4. The spans of a key with more than ``SHARD_SPANS`` different ones (the edge
   of a passage that many documents have, each with other words around) are
   cut into single windows, each of them a shard of its own, so that no shard
   and no automaton grows with the corpus.

Words are compared as words: hashes only bring candidates together.

Defined results: null texts have no words; texts of fewer words than the
threshold lose none; rows that repeat are places of their own, so each loses
what the other has; no rows give no rows; in ``remove`` other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatt.llm.common import SPACED, Bitmap, Words, gram_hashes, read_table, slices, split_words, stage_packed, text_key, whole_runs, word_hashes
from tidewatt.session import stage

LENGTH = 35
RUN = 18
#: The bitmap of repeated keys has 64 bits for each of them, but no more than 2 ** KEY_BITS (128 MB).
KEY_BITS = 30
SHARD_SPANS = 64
#: Windows of one span; a longer run of windows with one key (text that repeats itself) is cut.
SPAN_WINDOWS = 64


def _slide(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each n consecutive values."""
    size = 1
    while 2 * size <= n:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:len(values) - (n - size)], values[n - size:]) if n > size else values


def window_keys(words: Words, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the windows that start at each word, whether the window lies in one row, and the hashes of all runs at which a key lies."""
    total = int(words.first[-1])
    if total < length:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    grams = gram_hashes(word_hashes(words), run)
    keys = _slide(grams, length - run + 1, np.minimum)
    inside = whole_runs(words.first, length, total)
    # a run is a key's place if some whole window around it has it as its key
    own = np.where(inside, keys, np.uint64(0))
    edge = np.zeros(length - run, np.uint64)
    most = _slide(np.concatenate([edge, own, edge]), length - run + 1, np.maximum)
    return keys, inside, grams[most == grams]


def _key_counts(length: int, run: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches):
            _, _, places = window_keys(split_words(data, offsets, SPACED, lower=False), length, run)
            keys, n = np.unique(places, return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return count


def _spans(shared, length: int, run: int):
    names = ["doc_id", "k1", "k2", "key", "at", "words"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, limit=1 << 18):
            words = split_words(data, offsets, SPACED, lower=False)
            keys, inside, _ = window_keys(words, length, run)
            if not len(keys):
                continue
            row = words.row()[:len(keys)]
            part = np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])
            begin = np.flatnonzero(part)
            size = np.diff(np.append(begin, len(keys)))
            long = size > SPAN_WINDOWS
            if long.any():
                more = np.concatenate([np.arange(b, b + n, SPAN_WINDOWS) for b, n in zip(begin[long], size[long], strict=True)])
                begin = np.union1d(begin, more)
                size = np.diff(np.append(begin, len(keys)))
            keep = inside[begin] & shared.value.holds(keys[begin])
            begin, size = begin[keep], size[keep]
            # the last windows of a row may stand in one run with starts that have too few words left
            size = np.minimum(size, words.first[row[begin] + 1] - length + 1 - begin)
            texts = []
            for b, n in zip(begin.tolist(), size.tolist(), strict=True):
                last = b + n + length - 1
                raw = words.data[words.start[b]:words.end[last - 1]].tobytes().decode()
                texts.append(" ".join(_spaced(raw)))
            which = pa.array(row[begin])
            yield pa.record_batch([*(rows.column(c).take(which) for c in names[:3]), pa.array(keys[begin].view(np.int64)), pa.array(begin - words.first[row[begin]]), pa.array(texts, pa.string())], names=names)

    return cut


_BREAKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _spaced(text: str) -> list[str]:
    """Words between the six kinds of space that part words (others, such as a no-break space, are part of them)."""
    return [w for w in text.translate(_BREAKS).split(" ") if w]


class Automaton:
    """Suffix automaton of several sequences of words, each standing for a number of places."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, link: int, after: dict[str, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.next) - 1

    def _split(self, at: int, word: str) -> int:
        """The state that ``word`` leads to from ``at``, parted so that its longest sequence is that of ``at`` and the word."""
        old = self.next[at][word]
        if self.length[old] == self.length[at] + 1:
            return old
        new = self._state(self.length[at] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = new
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def add(self, words: list[str], number: int) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, word)
                last = new
            self.places[last] += number

    def count(self) -> None:
        """Hand the numbers of places on to the suffixes; once, after the last ``add``."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[state]] += self.places[state]

    def repeated(self, words: list[str], length: int) -> list[tuple[int, int]]:
        """Maximal runs (start, stop) of words of ``words`` in windows of ``length`` words that have two places or more."""
        state, matched, runs = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched < length:
                continue
            tail = state
            while self.length[self.link[tail]] >= length:
                tail = self.link[tail]
            if self.places[tail] > 1:
                low = i - length + 1
                if runs and runs[-1][1] >= low:
                    runs[-1] = (runs[-1][0], i + 1)
                else:
                    runs.append((low, i + 1))
        return runs


RUNS = "array<struct<low: int, high: int>>"
_RUNS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _match(length: int):
    """Streams each shard (rows of one key, next to each other) through its automaton."""

    def found(spans: list[dict]) -> list[list[tuple[int, int]]]:
        split = [s["words"].split(" ") for s in spans]
        if len(spans) == 1:  # every state of such an automaton has the span's places, and more only if words recur
            if spans[0]["n"] > 1:
                return [[(0, len(split[0]))]]
            if len(set(split[0])) == len(split[0]):
                return [[]]
        made = Automaton()
        for words, span in zip(split, spans, strict=True):
            made.add(words, span["n"])
        made.count()
        return [made.repeated(words, length) for words in split]

    def shard(key: int, spans: list[dict]) -> pa.RecordBatch:
        runs = [[{"low": low, "high": high} for low, high in own] for own in found(spans)]
        return pa.record_batch([pa.array([key] * len(spans), pa.int64()), *(pa.array([s[c] for s in spans], pa.int64()) for c in ("c1", "c2")), pa.array(runs, _RUNS)], names=["key", "c1", "c2", "runs"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []
        for batch in batches:
            for span in batch.to_pylist():
                if held and span["key"] != key:
                    done.append(shard(key, held))
                    held = []
                    if len(done) >= 256:
                        yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                        done = []
                key = span["key"]
                held.append(span)
        if held:
            done.append(shard(key, held))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return match


def repeated_runs(docs: DataFrame, length: int = LENGTH, run: int = RUN, bits: int = KEY_BITS, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """doc_id, k1, k2 (the text's key) and runs (word numbers from, to) of all rows that lose words."""
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_key_counts(length, run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = stage(counted.filter("n > 1").select("key"), "keys")
    bits = min(bits, max(20, (64 * keys.count()).bit_length()))
    shared = spark.sparkContext.broadcast(Bitmap(keys, bits))
    spans = docs.select("doc_id", *text_key(), "text").mapInArrow(_spans(shared, length, run), "doc_id long, k1 long, k2 long, key long, at long, words string")
    spans = stage_packed(spans.withColumns({"c1": F.xxhash64("words"), "c2": F.xxhash64(F.lit(1), "words")}), "spans")
    distinct = stage_packed(spans.groupBy("key", "c1", "c2", "words").agg(F.count(F.lit(1)).alias("n")), "distinct-spans")
    large = stage(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "shards")
    small = distinct.join(large.filter(F.col("m") <= shard_spans).select("key"), "key", "left_semi").select("key", "c1", "c2", "words", "n")
    found = small.repartition("key").sortWithinPartitions("key").mapInArrow(_match(length), f"key long, c1 long, c2 long, runs {RUNS}")
    cut = distinct.join(large.filter(F.col("m") > shard_spans).select("key"), "key", "left_semi")
    list_ = F.split("words", " ")
    starts = F.sequence(F.lit(0), F.size(list_) - length)
    window = F.transform(starts, lambda i: F.struct(i.alias("low"), F.array_join(F.slice(list_, i + 1, length), " ").alias("window")))
    cut = cut.select("key", "c1", "c2", "n", F.explode(window).alias("w")).select("key", "c1", "c2", "n", "w.low", "w.window")
    cut = stage_packed(cut.withColumns({"w1": F.xxhash64("window"), "w2": F.xxhash64(F.lit(1), "window")}), "windows")
    often = cut.groupBy("key", "window", "w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("key", "w1", "w2")
    cut = cut.join(often, ["key", "w1", "w2"], "left_semi").groupBy("key", "c1", "c2").agg(
        F.collect_set(F.struct("low", (F.col("low") + length).alias("high"))).alias("runs"))
    found = stage(found.filter("size(runs) > 0").unionByName(cut), "runs")
    moved = F.transform("runs", lambda r: F.struct((r["low"] + F.col("at")).alias("low"), (r["high"] + F.col("at")).alias("high")))
    return spans.select("doc_id", "k1", "k2", "key", "c1", "c2", "at").join(found, ["key", "c1", "c2"]).select("doc_id", "k1", "k2", F.explode(moved).alias("r")).distinct().groupBy(
        "doc_id", "k1", "k2").agg(F.collect_list("r").alias("runs"))


def _kept():
    """Splits texts and takes the runs out; the columns text_kept, n_words and n_removed."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            words = split_words(data, offsets, SPACED, lower=False)
            texts, n_removed = [], []
            runs = rows.column("__runs").to_pylist()
            for r, (first, last) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                text = words.data[words.start[first]:words.end[last - 1]].tobytes().decode() if last > first else ""
                own = _spaced(text)
                gone = 0
                if runs[r]:
                    keep_ = np.ones(len(own), bool)
                    for x in runs[r]:
                        keep_[x["low"]:x["high"]] = False
                    gone = len(own) - int(keep_.sum())
                    own = [own[i] for i in np.flatnonzero(keep_)]
                texts.append(" ".join(own))
                n_removed.append(gone)
            out = [c for i, c in enumerate(rows.columns) if rows.schema.names[i] not in ("__runs", "text")]
            names = [c for c in rows.schema.names if c not in ("__runs", "text")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.string()), pa.array(np.diff(words.first)), pa.array(n_removed, pa.int64())], names=[*names, "__kept", "__words", "__removed"])

    return keep


def _with_kept(docs: DataFrame, length: int) -> DataFrame:
    """The columns of ``docs`` but text, and __kept, __words and __removed."""
    runs = repeated_runs(docs, length).select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("runs").alias("__runs"))
    k1, k2 = text_key()
    joined = docs.join(runs, (k1 == F.col("__k1")) & (k2 == F.col("__k2")) & docs["doc_id"].eqNullSafe(F.col("__id")), "left").drop("__id", "__k1", "__k2")
    schema = StructType([f for f in docs.schema.fields if f.name != "text"]).add("__kept", "string").add("__words", "long").add("__removed", "long")
    return joined.mapInArrow(_kept(), schema)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without their repeated passages; the words left are joined by single spaces."""
    names = docs.columns
    return _with_kept(docs, length).withColumnRenamed("__kept", "text").select(*[F.col(f"`{c}`") for c in names])


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, how many are removed, and a digest of the rest."""
    docs = _with_kept(read_table(spark, sf_dir, "documents").select("doc_id", "text"), LENGTH)
    return docs.select("doc_id", F.col("__words").alias("n_words"), F.col("__removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))
