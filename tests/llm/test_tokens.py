from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import DATA
from tidewatt.llm import tokens


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def whole(model, text):
    return np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def digests(model, docs):
    start, out = 0, []
    for doc_id, text in docs:
        ids = whole(model, text)
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_sample(spark, sample, model):
    got = sorted(map(tuple, tokens.op1_token_files(spark, DATA).collect()))
    assert got == digests(model, sorted(zip(sample.doc_id, sample.text, strict=True)))


def test_edges(spark, edges, edge_dir, model):
    got = [tuple(r) for r in tokens.op1_token_files(spark, edge_dir).orderBy("start").collect()]
    docs = sorted(((r.doc_id, r.text) for r in edges.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert got == digests(model, docs)


def test_empty(spark, empty_dir):
    assert tokens.op1_token_files(spark, empty_dir).count() == 0


def test_odd_spaces(model):
    code = tokens.Coder(tokens.VOCABULARY)
    texts = ["", " ", "  a  b ", "a\n b", "a \nb", "it's we'll  x\t y", "  a  b  c", "x \x1c y\x1f z", "1 2  3 ...　 \u0085 é ü", "<|endoftext|> a <|endoftext|>b", " lead", "trail "]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list(" \n\t  ab1.'é\x1d"), 40)) for _ in range(400)]
    assert [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_by_the_plain_call(spark, model, tmp_path):
    texts = ["a <|endoftext|> b", "c <|endoftext|", "<|endoftext|><|endoftext|>", "  d  <|endoftext|>e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = digests(model, list(enumerate(texts)))
    assert sorted(map(tuple, dict(corpus_pipeline.STAGES)["tokens"](spark, docs, "").collect())) == want and 50256 in whole(model, texts[0])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, tokens.op1_token_files(spark, str(tmp_path)).collect())) == want


def test_random_access(spark, sample, model, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").coalesce(1)
    files = tokens.write_sequences(docs, f"file://{tmp_path}/out", length=64, sequences=10).orderBy("part").collect()
    stream = np.concatenate([whole(model, t) for _, t in sorted(zip(sample.doc_id, sample.text, strict=True))])
    for f in files:
        own = stream[f.first_token:f.first_token + f.n_tokens]
        assert f.n_sequences == -(-len(own) // 64)
        for k in {0, 9, 10, f.n_sequences - 1} & set(range(f.n_sequences)):
            ids, mask = tokens.read_sequence(f.path, k, 10)
            assert len(ids) == 64 and not ids.flags.owndata
            assert ids[mask].tolist() == own[64 * k:64 * (k + 1)].tolist() and mask.sum() == min(64, len(own) - 64 * k)
    assert sum(f.n_tokens for f in files) == len(stream)


def test_full_tables_keep_what_they_hold(model, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PARTS", 12)
    code = tokens.Coder(tokens.VOCABULARY)
    plain = lambda texts: [model.encode(t, add_special_tokens=False).ids for t in texts]
    ids = lambda texts: [np.frombuffer(x, code.dtype).tolist() for x in code.encode(texts)]
    first = ["one two, two three.", "one été\nsix"]
    assert ids(first) == plain(first)
    held = dict(code.later)
    for k in range(3):  # more words than the tables hold, and not yet so many that they start anew
        texts = [" ".join(f"{a}{b}{'xyz'[k]}!" for a in "abc" for b in "def"), "two, three. ###"]
        assert ids(texts) == plain(texts)
        assert held.items() <= code.later.items() and sum(map(len, (code.first, code.later, code.pieces))) <= 12
    for k in range(9):
        texts = [" ".join(f"{a}{'ghijklmno'[k]}{b}?" for a in "abc" for b in "def")]
        assert ids(texts) == plain(texts)
    assert not held.items() <= code.later.items()
