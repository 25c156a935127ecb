"""Token-ID output as Arrow files of equal-length sequences (operator 1).

A shard is a range of documents in order of doc_id. Its token ids, each
document closed by the end id, are one stream that is cut into sequences of
equal length: an Arrow IPC file of record batches with the columns ``ids`` (a
fixed-size list of unsigned 16-bit numbers, 32-bit for a vocabulary above
65,536) and ``mask`` (a fixed-size list of booleans, false on padding after
the shard's last token). All batches but the last hold the same number of
sequences, nothing is compressed, so sequence k of a file is row k mod b of
batch k div b and can be read from a memory map without copying. A second
Arrow file lists doc_id, start in the shard's stream and number of tokens of
each document.

Every attempt of a task writes files of a name of its own; the manifest, a
table written through Spark's commit, names the files that count. A lost
executor leaves at most files that no manifest names.

Encoding: a text is parted before each single space between two characters
that are not white space. Every piece of the byte-level pre-tokenizer ends
there, so the ids of the parts, joined, are the ids of the whole text. Parts
and their pieces recur, so those that come first are kept encoded in tables of
a bounded size, which start anew when texts no longer find theirs: pieces of
plain letters and signs by the library's model, any other part by the whole
tokenizer. A word before signs is the same piece as that word alone, and is
looked up as such.

A literal added token such as ``<|endoftext|>`` in a text gets its own id, as by
the library's plain call: such a text goes to the tokenizer whole.

Defined results: a null text is empty and has just the end id; null doc_ids
come first; rows that repeat a doc_id are ordered by their text's hash and
text, and rows alike in everything get places one after the other; no rows
give no files; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import KEPT_TABLES, chunked, give_back, partitions, read_table, utf8
from tidewatt.session import scratch_path, stage

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
LENGTH = 2048
SEQUENCES = 256
#: Parts and pieces that a worker keeps encoded in all tables, and the longest one that it keeps.
KEPT_PARTS = 350_000
KEPT_LENGTH = 32
#: Words with signs, which are soon put together, are kept until this share of the room is left.
JOINED = 0.5
#: The tables start anew when this many times as many have not been found in the full ones.
STALE = 4

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters and signs of which the pre-tokenizer's pieces are sure without its tables of Unicode.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf" ?(?:[{_LETTERS}]+|[{_SIGNS}]+)(?:[{_LETTERS}]+|[{_SIGNS}]+|\n(?!\n))*")
_WORD = re.compile(rf"[{_LETTERS}]+")
_ENDS = "".join(c for c in map(chr, range(33, 127)) if re.fullmatch(f"[{_SIGNS}]", c))
_PIECES = re.compile(rf" ?[{_LETTERS}]+| ?[{_SIGNS}]+|\n")
_coders: dict[str, Coder] = {}
KEPT_TABLES.append(_coders)


def vocabulary_file(name: str) -> str:
    """``name`` itself if it is a path, or else the public tokenizer file of that name on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _OddSpace(Exception):
    """A part begins or ends with white space, so the text can't be parted at every space."""


class _Known(dict):
    """Codes of parts; a part that is not held is encoded. ``lead`` stands before each."""

    def __init__(self, coder: Coder, lead: str) -> None:
        super().__init__()
        self.coder, self.lead = coder, lead

    def __missing__(self, part: str) -> bytes:
        word = part.rstrip(_ENDS)
        if _WORD.fullmatch(word):
            if len(word) < len(part):
                code = self[word] + self.coder.piece(part[len(word):])
                if self.coder.room > JOINED * KEPT_PARTS:
                    self.coder.keep(self, part, code)
                return code
            code = self.coder.model_ids(self.lead + word)
        elif not part or part[0].isspace() or part[-1].isspace():
            raise _OddSpace
        else:
            code = self.coder.part(self.lead + part)
        self.coder.keep(self, part, code)
        return code


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the others 256 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in shown else next(rest) for b in range(256)}


class Coder:
    """Encodes texts with one vocabulary; ids are the bytes of numbers of a fixed width."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary_file(vocabulary))
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model = self.whole.model
        self.kind = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.parted = self.whole.normalizer is None and "ByteLevel(add_prefix_space=False" in repr(self.whole.pre_tokenizer) and "use_regex=True" in repr(self.whole.pre_tokenizer)
        self.letters = _byte_letters()
        self.space = chr(self.letters[32])
        self.pieces: dict[str, bytes] = {}
        self.first, self.later = _Known(self, ""), _Known(self, " ")
        self.room = KEPT_PARTS

    def by_library(self, text: str) -> bytes:
        return array(self.kind, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def keep(self, table: dict[str, bytes], part: str, code: bytes) -> None:
        if self.room > 0 and len(part) <= KEPT_LENGTH:
            table[part] = code
        self.room -= 1

    def model_ids(self, piece: str) -> bytes:
        """Ids of a piece of plain letters, signs or a line's end, by the library's model."""
        if piece.isascii() and piece != "\n":
            shown = self.space + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def piece(self, piece: str) -> bytes:
        code = self.pieces.get(piece)
        if code is None:
            code = self.model_ids(piece)
            self.keep(self.pieces, piece, code)
        return code

    def part(self, part: str) -> bytes:
        """Ids of a part: of each of its pieces by the library's model, where the pieces are plain."""
        if not _PLAIN.fullmatch(part):
            return self.by_library(part)
        return b"".join([self.piece(p) for p in _PIECES.findall(part)])

    def text(self, text: str) -> bytes:
        if not self.parted or not text or self.added and self.added.search(text):
            return self.by_library(text)
        parts = text.split(" ")
        try:
            return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        except _OddSpace:
            first, *later = _CUT.split(text)
            return b"".join([self.part(first), *(self.part(" " + p) for p in later)])

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [self.text(t) for t in texts]
        if self.room < -STALE * KEPT_PARTS:
            for table in (self.first, self.later, self.pieces):
                table.clear()
            self.room = KEPT_PARTS
        return out


def coder(vocabulary: str) -> Coder:
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


MANIFEST = "part int, path string, index_path string, n_documents long, n_tokens long, n_sequences long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open_out(path: str) -> Any:
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    return store.open_output_stream(place)


def _open_in(path: str) -> Any:
    store, place = fs.FileSystem.from_uri(path)
    return pa.memory_map(place) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place)


class _Shard:
    """The two open files of a shard; holds at most one batch of sequences."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, length: int, sequences: int) -> None:
        name = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}"
        self.part, self.path, self.index_path = part, f"{name}.arrow", f"{name}.index.arrow"
        self.length, self.room, self.dtype = length, length * sequences, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.files = [_open_out(self.path), _open_out(self.index_path)]
        self.ids = pa.ipc.new_file(self.files[0], self.schema)
        self.index = pa.ipc.new_file(self.files[1], INDEX)
        self.held, self.tokens, self.documents, self.written = bytearray(), 0, 0, 0

    def add(self, doc_ids: pa.Array, codes: list[bytes], end: bytes) -> None:
        width = self.dtype.itemsize
        n = np.fromiter((len(c) // width + 1 for c in codes), np.int64, len(codes))
        start = self.tokens + np.cumsum(n) - n
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(start), pa.array(n)], schema=INDEX))
        self.documents += len(codes)
        self.tokens += int(n.sum())
        for code in codes:
            self.held += code
            self.held += end
            while len(self.held) >= self.room * width:
                self._batch(bytes(self.held[:self.room * width]), self.room)
                del self.held[:self.room * width]

    def _batch(self, ids: bytes, real: int) -> None:
        n = len(ids) // self.dtype.itemsize
        mask = pa.array(np.arange(n) < real)
        values = pa.array(np.frombuffer(ids, self.dtype))
        self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(x, self.length) for x in (values, mask)], schema=self.schema))
        self.written += n // self.length

    def close(self) -> list:
        real = len(self.held) // self.dtype.itemsize
        if real:
            pad = -real % self.length
            self._batch(bytes(self.held) + bytes(pad * self.dtype.itemsize), real)
        for x in (self.ids, self.index, *self.files):
            x.close()
        return [self.part, self.path, self.index_path, self.documents, self.tokens, self.written]


def _writer(folder: str, vocabulary: str, end_id: int, length: int, sequences: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = coder(vocabulary)
            shard = shard or _Shard(folder, TaskContext.get().partitionId(), code.dtype, length, sequences)
            end = np.array([end_id], code.dtype).tobytes()
            _, offsets = utf8(batch.column("text"))
            for low, high in chunked(offsets):
                texts = [t or "" for t in batch.column("text")[low:high].to_pylist()]
                shard.add(batch.column("doc_id")[low:high].cast(pa.int64()), code.encode(texts), end)
            del batch, offsets, texts, _
            give_back()
        if shard:
            yield pa.RecordBatch.from_pylist([dict(zip([c.split(" ")[0] for c in MANIFEST.split(", ")], shard.close(), strict=True))], schema=pa.schema([
                ("part", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("n_documents", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    return write


def write_sequences(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, length: int = LENGTH, sequences: int = SEQUENCES) -> DataFrame:
    """Write ``docs`` (doc_id, text) as Arrow files below ``folder``; the manifest, a row for each shard.

    ``first_token`` and ``first_sequence`` count what lies in the shards before.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(partitions(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = rows.mapInArrow(_writer(folder, vocabulary, end_id, length, sequences), MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    made = docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumns({"first_token": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "first_sequence": F.coalesce(F.sum("n_sequences").over(before), F.lit(0))})


def read_sequence(path: str, k: int, sequences: int = SEQUENCES) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``k`` of a file; the ids are a view of the mapped file."""
    batch = pa.ipc.open_file(_open_in(path)).get_batch(k // sequences)
    ids, mask = (batch.column(i)[k % sequences].values for i in (0, 1))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def documents_in(path: str, index_path: str) -> Iterator[tuple[pa.RecordBatch, list[list[np.ndarray]]]]:
    """Batches of a shard's index, and for each of their documents its ids as views of the file's batches."""
    ids = pa.ipc.open_file(_open_in(path))
    index = pa.ipc.open_file(_open_in(index_path))
    flat = [None, -1]

    def batch(i: int) -> np.ndarray:
        if flat[1] != i:
            flat[:] = [ids.get_batch(i).column(0).flatten().to_numpy(), i]
        return flat[0]

    size = len(batch(0)) if ids.num_record_batches else 0
    for i in range(index.num_record_batches):
        rows, views = index.get_batch(i), []
        for start, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
            cut = []
            while n:
                part = batch(start // size)[start % size:start % size + n]
                cut.append(part)
                start, n = start + len(part), n - len(part)
            views.append(cut)
        yield rows, views


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (ids as little-endian 32-bit numbers) of each document in the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in batches:
            for shard in shards.to_pylist():
                for rows, views in documents_in(shard["path"], shard["index_path"]):
                    sums = []
                    for cut in views:
                        crc = 0
                        for part in cut:
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    start = pa.array(rows.column(1).to_numpy() + shard["first_token"])
                    yield pa.record_batch([rows.column(0), start, rows.column(2), pa.array(sums, pa.int64())], schema=schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "index_path", "first_token").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return token_digests(spark, read_table(spark, sf_dir, "documents"))


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return read_digests(stage(write_sequences(docs, scratch_path(spark, "tokens")), "manifest"))
