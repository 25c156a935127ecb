"""Removal of repeated byte strings by sorted suffixes (operator 13).

A string of 400 bytes that starts anywhere else too is removed at all its
places. No task can hold the suffixes of a corpus, and sending 400 bytes for
each would multiply it, so the suffixes that are sorted are those at anchors:

1. The anchor of a window of 400 bytes is the first of its places with the least
   hash of 128 bytes, and that hash is the window's key. Equal windows have
   equal keys and the same way from their start to the anchor. Consecutive windows with one
   anchor make a span. Keys of two anchors or more, counted over all
   documents, are broadcast as a bitmap of bounded size, which may let more
   through but loses none.
2. Spans of those keys are written and counted by 128 bits that name their
   text. The different spans of a key are a shard; only they are sent to tasks.
3. Within a shard the texts from the anchor on are suffixes, and those before it,
   read backwards, are suffixes of the reversed text. Both are put in order,
   with the common lengths of neighbours, by deep-shallow sorting: multikey
   quicksort by words of eight bytes down to a shallow depth, then a blind trie
   for each group that is still together.
4. A window that starts w bytes before its anchor equals another one if the two lie
   in one run of suffixes with 400 - w common bytes or more, and in one run of
   reversed ones with w or more. Counting pairs of runs for each w gives all
   windows that start at two places or more, without comparing pairs.
5. A shard of more than ``SHARD_SPANS`` different spans (the edge of a passage that
   many documents have) is parted by w, again and again, into shards of the windows of
   half as many w; what they have in common is then longer and their spans
   differ less, until a shard has one window. All go through steps 3 and 4.

Defined results: a null text is empty; texts of fewer bytes than the threshold
lose none; rows that repeat are places of their own, so each loses what the
other has; no rows give no rows; ``remove`` keeps other columns, and of a
character that is cut it keeps all bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatt.llm import common
from tidewatt.llm.common import Bitmap, gram_hashes, read_table, slices, stage_packed, text_key
from tidewatt.session import stage

LENGTH = 400
RUN = 128
#: The bitmap of repeated keys has 64 bits for each of them, but no more than 2 ** KEY_BITS (128 MB).
KEY_BITS = 30
SHARD_SPANS = 4096
#: Keys of larger shards that are broadcast, as a table of eight bytes each; more of them are joined by shuffling.
BROADCAST_KEYS = 1 << 17
#: Spans that a task compares at once (whole shards).
BATCH_SPANS = 8192
#: Suffixes are parted by quicksort to this depth.
SHALLOW = 32
#: Bytes of text that are worked on at once; places within them fit into PLACE_BITS.
PART_BYTES = 1 << 18
PLACE_BITS = 22


# --- anchors ----------------------------------------------------------------

def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (n - size)], values[n - size:]) if n > size else values


def anchored(data: np.ndarray, offsets: np.ndarray, length: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor and key of each span of windows that lie in one row; places in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(common._BYTE_VALUE[data], run)
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    packed = (grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(packed, length - run + 1) & low_bits).astype(np.int64)
    edges = np.zeros(len(data) + 1, np.int32)  # a window may not start in the last bytes of a row
    np.add.at(edges, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
    np.add.at(edges, offsets[1:], -1)
    inside = np.cumsum(edges)[:len(anchor)] == 0
    new = np.append(True, anchor[1:] != anchor[:-1])
    new[1:] |= inside[1:] != inside[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(anchor)) - 1
    begin, last = begin[inside[begin]], last[inside[begin]]
    return begin, last, anchor[begin], grams[anchor[begin]]


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Rows with their bytes and offsets; a very long row comes in pieces that overlap, with the place where each begins."""
    for rows, data, offsets in slices(batches, limit=PART_BYTES):
        low, stop = int(offsets[0]), int(offsets[-1])
        if stop - low <= PART_BYTES + length:
            yield rows, data[low:stop], offsets - low, 0
            continue
        for at in range(low, stop, PART_BYTES):
            piece = data[at:min(at + PART_BYTES + length - 1, stop)]
            yield rows, piece, np.array([0, len(piece)], np.int64), at - low


def _key_counts(length: int, run: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets, _ in _parts(batches, length):
            keys, n = np.unique(anchored(data, offsets, length, run)[3], return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return count


def _spans(shared, length: int, run: int) -> Callable:
    """``place`` is the anchor's in the row, ``ahead`` the bytes of the span before it."""
    names = ["doc_id", "k1", "k2", "key", "place", "ahead", "span"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets, base in _parts(batches, length):
            begin, last, anchor, keys = anchored(data, offsets, length, run)
            held = shared.value.holds(keys)
            begin, last, anchor, keys = begin[held], last[held], anchor[held], keys[held]
            row = np.searchsorted(offsets, begin, side="right") - 1
            raw = data.tobytes()
            texts = [raw[b:e] for b, e in zip(begin.tolist(), (last + length).tolist(), strict=True)]
            which = pa.array(row)
            yield pa.record_batch([
                *(rows.column(c).take(which) for c in names[:3]), pa.array(keys.view(np.int64)), pa.array(anchor - offsets[row] + base),
                pa.array((anchor - begin).astype(np.int32)), pa.array(texts, pa.binary())], names=names)

    return cut


# --- deep-shallow sorting ---------------------------------------------------

def common_length(a: bytes, b: bytes) -> int:
    """How many bytes ``a`` and ``b`` have in common at their beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Orders strings by the bytes at which they part; the rest of a string is read once, when it comes in.

    A node is [depth, children by byte (-1 for the end of a string), one string below]; a leaf the list of equal strings.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | dict | None = None

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = {"same": [k]}
            return
        node = self.root
        while isinstance(node, list):  # blindly: only bytes at which strings part are looked at
            below = node[1].get(self._at(s, node[0]))
            if below is None:
                break
            node = below
        other = node[2] if isinstance(node, list) else node["same"][0]
        t = self.strings[other]
        depth = common_length(s, t)
        if depth == len(s) == len(t):
            node["same"].append(k)
            return
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][self._at(s, node[0])]
        leaf = {"same": [k]}
        if isinstance(node, list) and node[0] == depth:
            node[1][self._at(s, depth)] = leaf
            return
        made = [depth, {self._at(t, depth): node, self._at(s, depth): leaf}, k]
        if above is None:
            self.root = made
        else:
            above[1][self._at(s, above[0])] = made

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings in order, and what each has in common with the one before it (0 for the first)."""
        order, lengths, stack = [], [], [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, list):
                below = sorted(node[1].items(), reverse=True)
                stack += [(child, node[0]) for _, child in below[:-1]]
                stack.append((below[-1][1], before))
            else:
                same = node["same"]
                order += same
                lengths += [before, *[len(self.strings[same[0]])] * (len(same) - 1)]
        return order, lengths


def sorted_strings(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings in order and what each has in common with the one before it."""
    words = np.frombuffer(b"".join([s[:shallow].ljust(shallow, b"\0") for s in strings]), ">u8").reshape(len(strings), -1).astype(np.uint64)
    order, lengths = [], []
    todo = [(np.arange(len(strings)), 0)]
    while todo:  # multikey quicksort: parted by one word, the equal ones go on with the next
        some, depth = todo.pop()
        if len(some) > 1 and depth < words.shape[1]:
            own = words[some, depth]
            pivot = own[len(own) // 2]
            for part, deeper in ((own > pivot, 0), (own == pivot, 1), (own < pivot, 0)):
                if part.any():
                    todo.append((some[part], depth + deeper))
            continue
        if len(some) > 1:
            trie = BlindTrie(strings)
            for k in some.tolist():
                trie.add(k)
            group, own_lengths = trie.ordered()
        else:
            group, own_lengths = [int(some[0])], [0]
        if order:
            own_lengths[0] = common_length(strings[order[-1]], strings[group[0]])
        order += group
        lengths += own_lengths
    return np.array(order, np.int64), np.array(lengths, np.int64)


# --- windows ----------------------------------------------------------------

def repeated(spans: list[bytes], ahead: np.ndarray, length: int, widest: int) -> np.ndarray:
    """Marks (span, w) of the windows, w bytes before the anchor, that occur in two of the spans, which differ."""
    n = len(spans)
    after, after_common = sorted_strings([s[a:] for s, a in zip(spans, ahead.tolist(), strict=True)])
    before, before_common = sorted_strings([s[:a][::-1] for s, a in zip(spans, ahead.tolist(), strict=True)])
    nearest = ahead - (np.fromiter(map(len, spans), np.int64, n) - length)
    marks = np.zeros((n, widest), bool)
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for w in range(int(nearest.min()), int(ahead.max()) + 1):
        valid = np.flatnonzero((nearest <= w) & (ahead >= w))
        if not len(valid):
            continue
        one[after] = np.cumsum(after_common < length - w)
        two[before] = np.cumsum(before_common < w)
        pair = one[valid] * (n + 1) + two[valid]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.zeros(len(valid), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marks[valid, w] = twice
    return marks


RUNS = "array<struct<low: int, high: int>>"
_RUN = pa.struct([("low", pa.int32()), ("high", pa.int32())])


def _runs(marks: np.ndarray, length: int) -> pa.Array:
    """For each span the runs of bytes, counted from the anchor, that its marked windows cover."""
    n, widest = marks.shape
    edge = np.zeros((n, widest + 2), np.int8)
    edge[:, 1:-1] = marks
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1] - 1
    values = pa.StructArray.from_arrays([pa.array((-last).astype(np.int32)), pa.array((length - first).astype(np.int32))], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _match(length: int, widest: int) -> Callable:
    """Compares the spans of each shard (rows of one key, next to each other), several shards at once."""

    def compare(held: pa.Table) -> Iterator[pa.RecordBatch]:
        # the bitmap may let an equal span through
        names = zip(*(held.column(c).to_pylist() for c in ("key", "c1", "c2")), strict=True)
        first = {name: k for k, name in reversed(list(enumerate(names)))}
        held = held.take(pa.array(sorted(first.values())))
        marks = repeated(held.column("span").to_pylist(), held.column("ahead").to_numpy().astype(np.int64), length, widest)
        out = [held.column(c).combine_chunks() for c in ("key", "c1", "c2")]
        yield from pa.table([*out, _runs(marks, length)], names=["key", "c1", "c2", "runs"]).to_batches()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = held.column("key").to_numpy()
            if len(key) >= BATCH_SPANS and key[0] != key[-1]:
                whole = int(np.flatnonzero(key != key[-1])[-1]) + 1  # the last shard may go on
                yield from compare(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from compare(held)

    return match


def _staged(spans: DataFrame, label: str) -> DataFrame:
    """Spans, written, with 128 bits that name their text (c1 and c2) and a number of their own (id)."""
    named = spans.withColumns({"c1": F.xxhash64("ahead", "span"), "c2": F.xxhash64(F.lit(1), "ahead", "span"), "id": F.monotonically_increasing_id()})
    return stage_packed(named, label)


def _held(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among ``keys``, rows whose key is not), told by a broadcast bitmap of bounded size."""
    n = keys.count()
    if not n:
        return rows.limit(0), rows
    shared = rows.sparkSession.sparkContext.broadcast(Bitmap(keys, min(KEY_BITS, max(16, (64 * n).bit_length()))))

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.holds(batch.to_numpy().view(np.uint64)))

    marked = rows.withColumn("__held", holds(key))
    return marked.filter("__held").drop("__held"), marked.filter("NOT __held").drop("__held")


def _compared(spans: DataFrame, length: int, run: int, shard_spans: int, low: int, high: int) -> DataFrame:
    """key, c1, c2 and runs of staged ``spans``, each standing for n places, of windows low <= w < high.

    Equal spans are counted by their names. Texts are sent once, and only one of
    each name, and only where a key has several.
    """
    names = spans.groupBy("key", "c1", "c2").agg(
        F.sum("n").alias("n"), F.first("ahead").alias("ahead"), F.first(F.octet_length("span")).alias("size"), F.min("id").alias("id"))
    names = stage(names, "span-names")
    sizes = stage(names.groupBy("key").agg(F.count(F.lit(1)).alias("spans")).filter("spans > 1"), "shards")
    # all windows of a span that lies at several places do
    whole = F.array(F.struct((-F.col("ahead")).alias("low"), (F.col("size") - F.col("ahead")).alias("high")))
    found = names.filter("n > 1").select("key", "c1", "c2", whole.alias("runs"))
    small, large = sizes.filter(F.col("spans") <= shard_spans).select("key"), stage(sizes.filter(F.col("spans") > shard_spans).select("key"), "large")
    n_large = large.count()
    if n_large <= BROADCAST_KEYS:
        large = F.broadcast(large)
    chosen, _ = _held(spans, F.col("id"), names.join(small, "key", "left_semi").select(F.col("id").alias("key")))
    if n_large:  # the bitmap may have let some of their spans through
        chosen = chosen.join(large, "key", "left_anti")
    chosen = chosen.select("key", "c1", "c2", "ahead", "span").repartition("key").sortWithinPartitions("key")
    found = found.unionByName(chosen.mapInArrow(_match(length, length - run + 1), f"key long, c1 long, c2 long, runs {RUNS}").filter("size(runs) > 0"))
    if not n_large or high - low == 1:
        return stage(found, "runs")
    # one of each name stands for all; its key's windows are parted by w
    ids = stage(names.join(large, "key", "left_semi").select("id", "n"), "parted-ids")
    some, _ = _held(spans, F.col("id"), ids.select(F.col("id").alias("key")))
    some = some.select("id", "key", "c1", "c2", "ahead", "span").join(ids, "id")
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle, high)):
        # w of the span's windows in this half, and the bytes that all windows of the half have in common
        half = some.withColumns({
            "first": F.greatest(F.col("ahead") - (F.octet_length("span") - length), F.lit(a)), "last": F.least("ahead", F.lit(b - 1))})
        half = half.filter("first <= last").select(
            F.col("key").alias("p_key"), F.col("c1").alias("p1"), F.col("c2").alias("p2"), "n",
            F.xxhash64("key", F.lit(a), F.expr(f"substring(span, ahead - {a} + 1, {length - (b - 1 - a)})")).alias("key"),
            F.expr(f"substring(span, ahead - last + 1, {length} + last - first)").alias("span"), F.col("last").alias("ahead"))
        half = _staged(half, "parted")
        deeper = _compared(half, length, run, shard_spans, a, b)
        back = half.select("p_key", "p1", "p2", "key", "c1", "c2").join(deeper, ["key", "c1", "c2"])
        found = found.unionByName(back.select(F.col("p_key").alias("key"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), "runs"))
    return stage(found, "runs")


def repeated_runs(docs: DataFrame, length: int = LENGTH, run: int = RUN, bits: int = KEY_BITS, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """doc_id, k1, k2 (the text's key) and runs (byte numbers from, to; they may overlap) of all rows that lose bytes."""
    spark = docs.sparkSession
    counted = docs.select("text").mapInArrow(_key_counts(length, run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = stage(counted.filter("n > 1").select("key"), "keys")
    bits = min(bits, max(20, (64 * keys.count()).bit_length()))
    shared = spark.sparkContext.broadcast(Bitmap(keys, bits))
    spans = docs.select("doc_id", *text_key(), "text").mapInArrow(_spans(shared, length, run), "doc_id long, k1 long, k2 long, key long, place long, ahead int, span binary")
    spans = _staged(spans.withColumn("n", F.lit(1).cast("long")), "spans")
    found = _compared(spans, length, run, shard_spans, 0, length - run + 1)
    moved = F.transform("runs", lambda r: F.struct((r["low"] + F.col("place")).alias("low"), (r["high"] + F.col("place")).alias("high")))
    places = spans.select("doc_id", "k1", "k2", "key", "c1", "c2", "place").join(found, ["key", "c1", "c2"])
    return places.select("doc_id", "k1", "k2", F.explode(moved).alias("r")).distinct().groupBy("doc_id", "k1", "k2").agg(F.collect_list("r").alias("runs"))


# --- removal ----------------------------------------------------------------

def _joined(runs: list[dict] | None) -> list[list[int]]:
    """Runs put together where they overlap or touch."""
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in runs or []):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _without(text: bytes, runs: list[list[int]]) -> bytes:
    cuts = [0, *(x for r in runs for x in r), len(text)]
    return b"".join([text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)])


def _whole_characters(text: bytes, runs: list[list[int]]) -> list[list[int]]:
    """Runs without the bytes of characters that they cut."""
    out = []
    for low, high in runs:
        while low < high and text[low] & 0xC0 == 0x80:
            low += 1
        while high < len(text) and high > low and text[high] & 0xC0 == 0x80:
            high -= 1
        out.append([low, high])
    return out


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` and __runs, which is null where nothing is removed; texts that lose nothing are not shuffled."""
    runs = stage(repeated_runs(docs, length), "document-runs")
    k1, k2 = text_key()
    some, others = _held(docs, k1, runs.select(F.col("k1").alias("key")).distinct())
    runs = runs.select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("runs").alias("__runs"))
    joined = some.join(runs, (k1 == F.col("__k1")) & (k2 == F.col("__k2")) & some["doc_id"].eqNullSafe(F.col("__id")), "left").drop("__id", "__k1", "__k2")
    return joined.unionByName(others.withColumn("__runs", F.lit(None).cast(runs.schema["__runs"].dataType)))


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the strings of ``length`` bytes that start at two places or more; null texts stay null."""
    names = docs.columns
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            texts = []
            for k, (low, high, runs) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows.column("__runs").to_pylist(), strict=True)):
                raw = data[low:high].tobytes()
                texts.append(_without(raw, _whole_characters(raw, _joined(runs))).decode() if rows.column(at)[k].is_valid else None)
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(rows.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_runs(docs, length).mapInArrow(cut, StructType(list(docs.schema.fields)))


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        out = []
        for low, high, runs in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows.column("__runs").to_pylist(), strict=True):
            whole = _joined(runs)
            kept = _without(data[low:high].tobytes(), whole)
            out.append((high - low, high - low - len(kept), len(whole), hashlib.sha256(kept).hexdigest()))
        yield pa.record_batch([rows.column("doc_id"), *(pa.array(c) for c in zip(*out, strict=True))], names=[f.split()[0] for f in _DIGEST.split(", ")])


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents, how many are removed, and a digest of the rest."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_runs(docs, LENGTH).mapInArrow(_digest, _DIGEST)
