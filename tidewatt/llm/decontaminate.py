"""Benchmark decontamination by a prefix-filtered set join (operator 10).

A window is 13 consecutive words of an item (all of them, if it has fewer). To
contain a window a document has to contain every shingle of three words of it,
so one of them is enough to find the document by: the rarest. The steps:

1. Count, over all documents, the shingles that occur in the benchmark. A
   window with a shingle that no document has can't occur and is dropped.
2. Take each window's rarest shingle as its prefix, with its place in it.
3. Join the documents' occurrences of prefixes with the windows by shingle.
   The window has to lie inside the document (bounds by place and length), and
   its words have to be equal, one by one, to the document's around it.
4. Put the verified windows of a document together.

Documents' shingles are looked up in a bitmap of fixed size before anything is
shuffled; a larger benchmark only makes it let more through. Only occurrences
of prefixes, with a few words around, are shuffled, never texts.

Defined results: null and empty texts have no words and are clean; an item
without words has no windows; hits of an item with a null id count, but the id
is not listed; ids given twice count once; rows that repeat get the same
answer each; an empty benchmark hits nothing; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.common import ALNUM, Words, gram_hashes, read_table, slices, split_words, text_key, whole_runs, word_hashes
from tidewatt.session import stage

WINDOW = 13
SHINGLE = 3
#: Bits of the bitmap that documents' shingles are looked up in.
BITMAP = 1 << 20


def _text(words: Words, low: int, high: int) -> str:
    return " ".join(words.data[s:e].tobytes().decode() for s, e in zip(words.start[low:high], words.end[low:high], strict=True))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words (joined by spaces), n_words and shingles (hash and place) of each window of ``items`` (item_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, limit=1 << 16):
            words = split_words(data, offsets, ALNUM, lower=True)
            h = word_hashes(words)
            out = {"item_id": [], "words": [], "n_words": [], "shingles": []}
            for item, low, high in zip(rows.column("item_id").to_pylist(), words.first[:-1], words.first[1:], strict=True):
                size = min(window, high - low)
                grams = gram_hashes(h[low:high], min(SHINGLE, size)).view(np.int64) if size else None
                for at in range(high - low - size + 1 if size else 0):
                    out["item_id"].append(item)
                    out["words"].append(_text(words, low + at, low + at + size))
                    out["n_words"].append(size)
                    out["shingles"].append(grams[at:at + max(size - SHINGLE, 0) + 1].tolist())
            yield pa.record_batch([pa.array(out["item_id"], pa.int64()), pa.array(out["words"], pa.string()), pa.array(out["n_words"], pa.int32()), pa.array(out["shingles"], pa.list_(pa.int64()))], names=list(out))

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, words string, n_words int, shingles array<long>")


class Bitmap:
    """The shingles to look for, by size, as bits of their hashes; broadcast, of a fixed size."""

    def __init__(self, shingles: DataFrame) -> None:
        """``shingles`` has size and shingle."""
        bits = shingles.select("size", F.pmod("shingle", F.lit(BITMAP)).alias("bit")).distinct().collect()  # at most BITMAP rows a size
        self.bits = {}
        for r in bits:
            self.bits.setdefault(r["size"], np.zeros(BITMAP, bool))[r["bit"]] = True

    def found(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the words' shingles that have their bit set."""
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for size, bits in self.bits.items():
            grams = gram_hashes(h, size)
            at = np.flatnonzero(bits[grams & np.uint64(BITMAP - 1)] & whole_runs(first, size, len(h)))
            places.append(at)
            hashes.append(grams[at])
        return np.concatenate(places), np.concatenate(hashes)


def _occurrences(bitmap: Bitmap) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches):
            words = split_words(data, offsets, ALNUM, lower=True)
            grams, n = np.unique(bitmap.found(word_hashes(words), words.first)[1], return_counts=True)
            yield pa.record_batch([pa.array(grams.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return count


def prefixes(cut: DataFrame, docs: DataFrame) -> DataFrame:
    """The rarest shingle of each window that can occur: words, n_words, shingle, place and size."""
    each = cut.select("words", "n_words", F.posexplode("shingles").alias("place", "shingle")).distinct()
    each = stage(each.withColumn("size", F.least("n_words", F.lit(SHINGLE))), "shingles")
    counted = docs.select("text").mapInArrow(_occurrences(Bitmap(each)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rare = each.join(counted, "shingle", "left").groupBy("words", "n_words", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("least"))
    return rare.filter("least.n > 0").select("words", "n_words", "size", F.col("least.shingle").alias("shingle"), F.col("least.place").alias("place"))


CANDIDATES = "array<struct<shingle: long, at: int, low: int, around: string>>"


def _candidates(bitmap: Bitmap, window: int) -> Callable:
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("around", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            words = split_words(data, offsets, ALNUM, lower=True)
            places, hashes = bitmap.found(word_hashes(words), words.first)
            found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            row = np.searchsorted(words.first, places, side="right") - 1
            for r, at, gram in zip(row.tolist(), places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                first, last = int(words.first[r]), int(words.first[r + 1])
                low = max(first, at - window + 1)
                found[r].append({"shingle": gram, "at": at - first, "low": low - first, "around": _text(words, low, min(last, at + window))})
            yield pa.record_batch([*(rows.column(c) for c in ("doc_id", "k1", "k2")), pa.array(np.diff(words.first)), pa.array(found, kind)], names=["doc_id", "k1", "k2", "n_words", "found"])

    return find


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = 20) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) its words, hit words, hitting items, spans hit, and whether it is contaminated.

    Contaminated: at least one word in ``least`` is hit. k1 and k2 name the text.
    """
    cut = stage(windows(items, window), "windows")
    prefix = stage(prefixes(cut, docs), "prefixes")
    found = docs.select("doc_id", *text_key(), "text").mapInArrow(_candidates(Bitmap(prefix), window), f"doc_id long, k1 long, k2 long, n_words long, found {CANDIDATES}")
    found = stage(found, "candidates")
    ids = cut.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    prefix = prefix.join(ids, "words")
    start = F.col("c.at") - F.col("place")
    inside = (start >= 0) & (start >= F.col("c.low")) & (start + F.col("size_words") <= F.col("doc_words"))
    same = F.array_join(F.slice(F.split("c.around", " "), start - F.col("c.low") + 1, F.col("size_words")), " ") == F.col("words")
    hits = (
        found.filter("size(found) > 0").select("doc_id", "k1", "k2", F.col("n_words").alias("doc_words"), F.explode("found").alias("c")).withColumn("shingle", F.col("c.shingle"))
        .join(prefix.withColumnRenamed("n_words", "size_words"), "shingle").filter(inside).filter(same)
        .groupBy("doc_id", "k1", "k2")
        .agg(F.array_sort(F.collect_set(F.struct(start.alias("start"), (start + F.col("size_words")).alias("stop")))).alias("spans"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(a["upto"], s["start"].cast("long")))).alias("n"),
            F.greatest(a["upto"], s["stop"].cast("long")).alias("upto")),
        lambda a: a["n"])
    hits = hits.select(F.col("doc_id").alias("h_id"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), covered.alias("n_hit"), "item_ids", "spans")
    same_row = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("h_id"))
    out = found.select("doc_id", "k1", "k2", "n_words").join(hits, same_row, "left").drop("h_id", "h1", "h2")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = stage(contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("b_id"), F.col("k1").alias("b1"), F.col("k2").alias("b2")), "bad")
    k1, k2 = text_key()
    return docs.join(bad, (k1 == F.col("b1")) & (k2 == F.col("b2")) & docs["doc_id"].eqNullSafe(F.col("b_id")), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items."""
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")
