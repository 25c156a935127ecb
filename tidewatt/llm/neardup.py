"""Near-duplicates by an inverted join over MinHash coordinates (operator 4).

Documents with one set of shingles are one class from the start; the work
below is on classes, so copies never meet as pairs. A class has a signature of
64 coordinates and is posted under (coordinate, value). Two classes that agree
on at least 40 of them agree on one of any 25, so only the lists of 25
coordinates, the prefix, are merged; the other lists are skipped and looked
up in the signature. In a merged list two classes are compared

* only if no earlier coordinate of the prefix has brought them together, and
* are retained if at least 40 coordinates collide (those of the skipped lists
  are compared by their last byte).

A list emits no more retained pairs than connect its classes, so rows grow
with the lists and not with their squares. The components of retained pairs
are clusters. The full sets of a cluster are sent to its tasks once, together
with a longer signature of 320 bytes; pairs that collide on at least
``MATCHES`` of those are confirmed on the sets, unless confirmed links connect
the two already, which leaves the components as they are.

With a similarity of 0.85, fewer than 40 of 64 collisions have a chance of
about 2 in a million, fewer than 240 of 320 of less than 1 in a million.

Long lists and large clusters are cut into chunks that meet in pairs, in tasks
of their own. No pair within one class is ever made.

Defined results: null texts and texts without words have an empty set, are
linked with nothing and are their own component; texts of fewer than five
words are one shingle; rows that repeat are one class; null doc_ids count as
above all others; no rows give no rows; ``unique`` keeps all columns and
decides by row: of a component all rows that carry its id or, without repeats,
exactly one of them. A doc_id on several texts is judged with each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.common import SPACED, Bitmap, gram_hashes, mixed, read_table, slices, split_words, text_key, word_hashes
from tidewatt.session import stage

SHINGLE = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 85
COORDINATES = 64
AGREE = 40
PREFIX = COORDINATES - AGREE + 1
EXTRA = 256
MATCHES = 240
CHUNK = 4096
#: A task confirms links between two chunks of a cluster, each of about so many classes and bytes of sets at most.
SET_CHUNK = 4096
SET_BYTES = 1 << 24
BITMAP_BITS = 24
#: The bitmap of the texts that go has 64 bits for each of them, but no more than 2 ** GONE_BITS (32 MB).
GONE_BITS = 28
#: Text bytes that are worked on at once.
PART_BYTES = 1 << 18

_rng = np.random.default_rng(77)
_FACTOR = _rng.integers(1, 2**63, COORDINATES + EXTRA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _rng.integers(1, 2**63, COORDINATES + EXTRA, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted hashes of each row's distinct shingles."""
    words = split_words(data, offsets, SPACED, lower=True)
    h = word_hashes(words)
    grams = gram_hashes(h, SHINGLE)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield np.unique(grams[low:high - SHINGLE + 1] if high - low >= SHINGLE else gram_hashes(h[low:high], high - low) if high > low else h[:0])


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    one = mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + place).sum(dtype=np.uint64)
    two = np.bitwise_xor.reduce(mixed(shingles ^ mixed(place)))
    return int(one.view(np.int64)), int(np.uint64(two).view(np.int64))


def signature(shingles: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """Least value of each of the first ``size`` coordinates' hashes over the set."""
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 256):
        some = shingles[at:at + 256, None] * _FACTOR[:size] + _TERM[:size]
        low = np.minimum(low, (some >> np.uint64(32)).astype(np.uint32).min(0))
    return low


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, limit=PART_BYTES):
        n, one, two, prefix, rest = [], [], [], [], []
        for shingles in shingle_sets(data, offsets):
            d = digest(shingles)
            n.append(len(shingles))
            one.append(d[0])
            two.append(d[1])
            sign = signature(shingles)
            prefix.append(sign[:PREFIX].tobytes())
            rest.append(sign[PREFIX:].astype(np.uint8).tobytes())
        ids = [c for c in rows.schema.names if c != "text"]
        yield pa.record_batch([*map(rows.column, ids), *(pa.array(x, pa.int64()) for x in (n, one, two)), pa.array(prefix, pa.binary()), pa.array(rest, pa.binary())], names=[*ids, "n", "d1", "d2", "prefix", "rest"])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each coordinate of the prefix: list (coordinate and value) and class."""
    place = np.arange(PREFIX, dtype=np.int64) << 32
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint32).reshape(-1, PREFIX)
        yield pa.record_batch([pa.array((values + place).reshape(-1)), pa.array(np.repeat(batch.column("class").to_numpy(), PREFIX))], names=["list", "class"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of a sorted stream; only one group is held."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in names]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        begin = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for low, high in zip(begin[:-1], begin[1:], strict=True):
            own = tuple(int(c[low]) for c in columns)
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class _Union:
    """Which classes are connected so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were connected."""
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _pairs_table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, pa.int64()) for v in zip(*pairs, strict=True)], names=["a", "b"])


def _sides(chunk: np.ndarray, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each place of chunk i and the places of chunk j that it is compared with; each pair once."""
    right = np.flatnonzero(chunk == j)
    for k, a in enumerate(np.flatnonzero(chunk == i).tolist()):
        yield a, right[k + 1:] if i == j else right


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of one list (or of two chunks of it) that are retained, as many as connect what all of them do."""
    for group in _groups(batches, ["list", "i", "j"]):
        if group.num_rows < 2:
            continue
        own, i, j = group.column("class").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        prefix, rest = _matrix(group.column("prefix"), np.uint32, PREFIX), _matrix(group.column("rest"), np.uint8, COORDINATES - PREFIX)
        coordinate, union, links = int(group.column("list")[0].as_py()) >> 32, _Union(), []
        for a, others in _sides(group.column("chunk").to_numpy(), i, j):
            if coordinate:
                others = others[~(prefix[others, :coordinate] == prefix[a, :coordinate]).any(1)]
            if not len(others):
                continue
            same = (prefix[others] == prefix[a]).sum(1) + (rest[others] == rest[a]).sum(1)
            links += [(int(own[a]), int(own[b])) for b in others[same >= AGREE] if union.join(own[a], own[b])]
        if links:
            yield _pairs_table(links)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links within one cluster (or between two chunks of it), as many as connect what all of them do."""
    for group in _groups(batches, ["cluster", "i", "j"]):
        own, i, j = group.column("class").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
        size = np.array([len(x) for x in sets])
        signs = _matrix(group.column("signs"), np.uint8, COORDINATES + EXTRA)
        union, links = _Union(), []
        for a, others in _sides(group.column("chunk").to_numpy(), i, j):
            low, high = np.minimum(size[others], size[a]), np.maximum(size[others], size[a])
            others = others[low * 100 >= high * PERCENT]
            if not len(others):
                continue
            alike = (signs[others] == signs[a]).sum(1)
            for b, n in sorted(zip(others.tolist(), alike.tolist(), strict=True), key=lambda x: -x[1]):
                if n < MATCHES:
                    break
                if union.find(own[a]) == union.find(own[b]):
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= PERCENT * (size[a] + size[b] - both) and union.join(own[a], own[b]):
                    links.append((int(own[a]), int(own[b])))
        if links:
            yield _pairs_table(links)


def components(links: DataFrame) -> DataFrame:
    """id and label of everything that ``links`` (a, b) touches; a component has one label.

    In each round every node goes over to its least neighbour, chains are
    shortened, and the links are put between the labels that are left, until
    there are none. Nodes with links at least halve with each round.
    """
    links = stage(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select("b", "a")).distinct(), "links")
    names = stage(links.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct(), "labels")
    while not links.isEmpty():
        up = stage(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("from"), F.least("a", "b").alias("to")), "up")
        for _ in range(2):
            next_ = up.select(F.col("from").alias("to"), F.col("to").alias("next"))
            up = up.join(next_, "to").select("from", F.col("next").alias("to"))
        up = stage(up, "up")
        names = stage(names.join(up, names["label"] == up["from"], "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        a, b = up.select(F.col("from").alias("a"), F.col("to").alias("x")), up.select(F.col("from").alias("b"), F.col("to").alias("y"))
        links = stage(links.join(a, "a").join(b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return names


def _chunked(rows: DataFrame, group: str, own: str) -> DataFrame:
    """Classes of groups of more than SET_CHUNK classes or SET_BYTES of sets in chunks: every pair of chunks (i, j) gets the rows of both."""
    chunks = F.greatest(F.count(F.lit(1)) / SET_CHUNK, F.sum(8 * F.col("n") + COORDINATES + EXTRA) / SET_BYTES)
    counts = rows.groupBy(group).agg(F.ceil(chunks).cast("int").alias("chunks"))
    return rows.join(counts, group).withColumn("chunk", F.pmod(F.xxhash64(own), F.col("chunks")).cast("int"))


def _pairs(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other", "chunks")


def near_duplicates(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (the set's digest) and component_id of every row of ``docs`` (doc_id, text).

    With ``keyed`` also k1 and k2, which name the text, and component, which
    names the component where its id does not: null for empty sets.
    """
    spark = docs.sparkSession
    key = ["k1", "k2"] if keyed else []
    signed = docs.select("doc_id", *(text_key() if keyed else []), "text").mapInArrow(_sign, f"doc_id long, {''.join(f'{k} long, ' for k in key)}n long, d1 long, d2 long, prefix binary, rest binary")
    signed = stage(signed, "signed")
    rows = signed.select("doc_id", *key, "n", "d1", "d2")
    # a signature depends on the set alone, so any row's stands for its class
    classes = signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("lead"), F.max("n").alias("n"), F.first("prefix").alias("prefix"), F.first("rest").alias("rest"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    lead = classes.select("class", "prefix", "rest")
    posts = stage(lead.select("class", "prefix").mapInArrow(_post, "list long, class long"), "posts")
    lists = posts.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("list", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    posts = posts.join(lists, "list").groupBy("class").agg(F.collect_list(F.struct("list", "chunks")).alias("lists"))
    posts = lead.join(posts, "class").select("class", "prefix", "rest", F.explode("lists").alias("l")).select("class", "prefix", "rest", "l.*")
    posts = _pairs(posts.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")))
    pairs = posts.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(_merge, "a long, b long")
    pairs = stage(pairs, "pairs")

    clusters = components(pairs).select(F.col("id").alias("class"), F.col("label").alias("cluster")).join(classes.select("class", "d1", "d2", "lead", "n"), "class")
    clusters = stage(_chunked(clusters, "cluster", "class"), "clusters")
    shared = spark.sparkContext.broadcast(Bitmap(clusters.select(F.xxhash64("lead").alias("key")), BITMAP_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in slices(batches, limit=PART_BYTES):
            held = shared.value.holds(part.column("key").to_numpy().view(np.uint64))
            for _, text, at in slices([part.filter(pa.array(held)).select(["text"])]):
                shingles = list(shingle_sets(text, at))
                named = [digest(x) for x in shingles]
                signs = [signature(x, COORDINATES + EXTRA).astype(np.uint8).tobytes() for x in shingles]
                yield pa.record_batch([*(pa.array([d[k] for d in named], pa.int64()) for k in (0, 1)), pa.array([x.tobytes() for x in shingles], pa.binary()), pa.array(signs, pa.binary())], names=["d1", "d2", "shingles", "signs"])

    full = docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(sets, "d1 long, d2 long, shingles binary, signs binary")
    # several rows of a class come through where they share its lead's id, or all have none
    full = full.groupBy("d1", "d2").agg(F.first("shingles").alias("shingles"), F.first("signs").alias("signs"))
    full = clusters.join(full, ["d1", "d2"]).select("cluster", "chunk", "chunks", "class", "shingles", "signs")
    links = _pairs(full).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_confirm, "a long, b long")
    links = stage(links, "confirmed")

    linked = stage(components(links).join(classes.select(F.col("class").alias("id"), "lead"), "id"), "linked")
    least = linked.groupBy("label").agg(F.min("lead").alias("least"))
    merged = linked.join(least, "label").select(F.col("id").alias("class"), "label", "least")
    named = classes.join(merged, "class", "left").select("d1", "d2", F.coalesce("least", "lead").alias("least"), F.coalesce("label", "class").alias("component"))
    out = rows.join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2", own, *([*key, "component"] if keyed else []))


def _of(keys: DataFrame) -> Column:
    """Joins rows with doc_id and text to ``keys`` (doc_id, k1, k2, renamed), null ids too."""
    k1, k2 = text_key()
    return (k1 == keys["__k1"]) & (k2 == keys["__k2"]) & F.col("doc_id").eqNullSafe(keys["__id"])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not in ``gone`` (__id, __k1, __k2).

    A bitmap of the texts' keys, of bounded size, lets most rows through at
    once, so that only texts that may have to go are shuffled.
    """
    n = gone.count()
    if not n:
        return docs
    bitmap = Bitmap(gone.select(F.col("__k1").alias("key")).distinct(), min(GONE_BITS, max(16, (64 * n).bit_length())))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for key in keys:
            yield pd.Series(shared.value.holds(key.to_numpy().view(np.uint64)))

    marked = docs.withColumn("__held", held(text_key()[0]))
    kept = marked.filter("NOT __held").drop("__held")
    return kept.unionByName(marked.filter("__held").drop("__held").join(gone, _of(gone), "left_anti"))


def unique(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's, with all their columns.

    Without ``repeats`` exactly one of them for each component: of several
    texts under its id the one of least key, of rows alike in both the least.
    Texts without words are no component's and all stay.
    """
    named = near_duplicates(docs, keyed=True).filter("component IS NOT NULL")
    key = [F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")]
    keys = stage(named.groupBy("doc_id", "k1", "k2", "component", "component_id").agg(F.count(F.lit(1)).alias("n")), "keys")
    lead = keys.filter("doc_id <=> component_id")
    if repeats:
        gone = stage(keys.filter("NOT doc_id <=> component_id").select(*key), "gone")
        return _without(docs, gone)
    first = F.min(F.struct("k1", "k2", "doc_id", "n")).alias("l")
    chosen = stage(lead.groupBy("component").agg(first).select("l.*"), "chosen")
    several = stage(chosen.filter("n > 1").select(*key), "several")
    one = chosen.filter("n = 1").select(*key)
    same = (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    gone = stage(keys.join(one, same, "left_anti").select(*key), "gone")
    out = _without(docs, gone)
    if several.isEmpty():
        return out
    row = F.struct(*docs.columns)
    # partial minima are made before the shuffle, so a key of any number of rows is one row a task
    least = docs.join(several, _of(several)).groupBy("__id", "__k1", "__k2").agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return out.unionByName(least.select("__row.*"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of all documents."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
