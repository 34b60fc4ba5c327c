"""Ids by tree concatenation and decoded texts against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linemill.llm import bpe, queries

JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    *"ab .,'\n\t\r!<|>-_9éß漢あảக", "  ", " ", " ", "’", " ", "　", "\u0085", "\x1c", "\U0001f642", "<|endoftext|>", "<|endof", "text|>", "'s", "'ll", "'re",
    " the", "Word", "é", "aaaa", " " * 7, "\n\n\n", "----", "0123",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def library_ids(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("leaf", [1, 5, 40])
def test_hostile_texts(library, leaf):
    """Cuts fall into words, numbers, characters' neighbours, contractions, blanks and added tokens."""
    draw = np.random.default_rng(leaf)
    texts = ["".join(draw.choice(PARTS, draw.integers(0, 120))) for _ in range(400)]
    texts += ["".join(draw.choice(list(some), 300)) for some in ("ab", "aA", " \n", "a' s", "'re l", "-'s!", "漢あa", "the ", "<|endoftx>") for _ in range(15)]
    assert [x.tolist() for x in bpe.TreeCodec(JSON, leaf).encode([t.encode() for t in texts])] == library_ids(library, texts)


def test_long_unsplit_texts(library):
    """Runs without any boundary, of one letter too, where the sides of a join agree late or never."""
    draw = np.random.default_rng(9)
    letters = "".join(draw.choice(list("etaoinshrdlu"), 60_000))
    texts = ["a" * 30_001, " " * 20_003, "\n" * 9_999, letters, letters[:31_000] + "<|endoftext|>" + letters[31_000:], "é" * 9_001, "ab" * 12_345, "1234567890" * 3_000, "!?" * 5_001]
    assert [x.tolist() for x in bpe.TreeCodec(JSON).encode([t.encode() for t in texts])] == library_ids(library, texts)


def test_windows_are_small(library, monkeypatch):
    """Joins encode little again: of a long prose text a small part."""
    codec = bpe.TreeCodec(JSON)
    text = ("The quick brown fox, it's said, jumps over 12 lazy dogs.\n" * 4_000).encode()
    seen = []
    join = codec.text_bytes
    monkeypatch.setattr(codec, "text_bytes", lambda ids: seen.append(len(ids)) or join(ids))
    ids = codec.encode([text])[0]
    assert ids.tolist() == library.encode(text.decode(), add_special_tokens=False).ids and sum(seen) < 0.1 * len(ids)


def test_decoding_of_any_ids(library):
    draw = np.random.default_rng(6)
    codec = bpe.TreeCodec(JSON)
    for _ in range(500):
        ids = draw.integers(0, 50_257, draw.integers(0, 40)).tolist()
        assert codec.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode(np.array([5, 70_000, 6], "<u4")) == codec.decode(np.array([5, 6], "<u4"))


def test_spread_texts_and_odd_rows(spark, library):
    """Long texts in blocks on all tasks, repeated and null ones, and columns of clashing names."""
    long = "word it's 12\n" * 800 + "x" * 5_000
    texts = [long, long, long + "!", None, "", "short", "漢" * 3_000]
    rows = [(i % 3 if i else None, i, t, "old", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, text string, ids string, __row int")
    found = bpe.encode(docs, JSON, spread_bytes=4_000, block_bytes=1_000, leaf_bytes=300)
    assert found.columns == ["doc_id", "n", "__row", "ids"]
    held = {r["n"]: (r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["__row"]) for r in found.collect()}
    assert held == {i: (r[0], ids, 7) for i, (r, ids) in enumerate(zip(rows, library_ids(library, [t or "" for t in texts])))}
    told = bpe.decode(found, JSON, text="n")
    assert sorted(r["n"] for r in told.collect()) == sorted(t or "" for t in texts)
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(nulls, JSON).first()["decoded"] is None
    assert bpe.encode(docs.limit(0), JSON).count() == 0


def test_query(spark, sf_dir, library):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    for r, ids in zip(docs, library_ids(library, [r["text"] for r in docs])):
        assert found.pop(r["doc_id"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert not found


def test_other_vocabularies_are_refused(spark):
    docs = spark.createDataFrame([("a",)], "text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"):
        with pytest.raises(ValueError):
            bpe.encode(docs, public_tokenizers.path(name))
