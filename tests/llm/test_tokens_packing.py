"""Token counts and packing against the tokenizer libraries."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linemill.llm.packing import Packer, pack
from linemill.llm.tokens import CALL_BYTES, RUN_BYTES, SafePieces, WholeTexts, codec, runs, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \n b", "a\n\nb", "\na", "a\n", "a\r\nb", "it's they'll 's", "a b c  d", "tab\tx y", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>\nz", "é ñ 漢字 🙂 ok",
    "1 22 333,4 5.", "!!! *** ###", "a b c", "a\x1cb c \x1c d", "The  end. \n\n  Again\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def split_ids(encoder, texts, most=RUN_BYTES):
    out = []
    for part in runs(pa.array(texts, pa.string()), most):
        ids, sizes = encoder.ids(part)
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


@pytest.mark.parametrize("most", [1, 40, RUN_BYTES])
def test_odd_texts(library, most):
    long = ("word one, two\n" * 30_000) + "  " + "x" * 1000
    assert len(long) > CALL_BYTES
    texts = [*ODD, *ODD, long, long.replace("  ", " ")]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [n for part in runs(pa.array(texts), most) for n in codec(JSON, True).counts(part)] == [len(x) for x in expected]
    assert split_ids(codec(JSON, False), texts, most) == expected


def test_random_hostile_texts(library):
    """Marks, blanks of all kinds, letters of several scripts and added tokens in any order, as the library gives them."""
    draw = np.random.default_rng(7)
    parts = [*"ab .,'\n\t\r!<|>-_9\u00e9\u00df\u6f22\u3042\u1ea3\u0b95", "  ", "\u00a0", "\u2003", "\u2019", "\u201c", "\u2028", "\u3000", "\u1680", "\u0085", "\x1c", "\x00", "\U0001f642", "<|endoftext|>", "'s", "'ll", " the", "Word", "e\u0301"]
    texts = ["".join(draw.choice(parts, draw.integers(0, 30))) for _ in range(6_000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert split_ids(SafePieces(JSON, False), texts) == expected
    assert SafePieces(JSON, True).counts(pa.array(texts)).tolist() == [len(x) for x in expected]


def test_real_texts(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, JSON).collect()}
    assert found == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    path = public_tokenizers.path(name)
    assert not SafePieces.fits(path)
    one = WholeTexts(path)
    texts = pa.array(["Hello world", "", None])
    ids, sizes = one.ids(texts)
    assert one.counts(texts).tolist() == sizes.tolist() == [len(ids), 0, 0]


def test_null_text_and_clashing_column(spark):
    frame = spark.createDataFrame([(1, None, 9), (1, "a b", 9)], "doc_id long, text string, n_tokens long")
    assert sorted(tuple(r) for r in token_counts(frame, JSON).collect()) == [(1, 0), (1, 2)]
    assert token_counts(frame.limit(0), JSON).count() == 0


def check_windows(pieces, ids):
    """pieces: dicts; ids: key to its ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for key, own in ids.items():
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(own))
            assert p["ids_crc32"] == zlib.crc32(np.array(own[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(own)
    padding = 0
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= members[0]["window"]
        padding += members[0]["window"] - at
    return padding


def test_packing(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces = [r.asDict() for r in pack(docs.repartition(3), JSON).collect()]
    assert check_windows(pieces, ids) < 3 * 3 * 2048
    steps = defaultdict(int)
    for p in pieces:
        steps[p["step_group"]] += p["length"]
    assert max(steps.values()) <= 64 * 2048


def test_packing_null_empty_and_repeated(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string").coalesce(1)
    rows = pack(frame, JSON).collect()
    assert sorted((r["doc_id"], r["length"], r["doc_tokens"]) for r in rows) == [(1, 1, 1), (2, 1, 1), (2, 1, 1)]
    assert pack(frame.limit(0), JSON).count() == 0


def test_packer_of_many_sizes():
    draw = np.random.default_rng(1)
    docs = {i: np.arange(n, dtype="<u4") for i, n in enumerate(draw.integers(1, 5000, 3000))}
    packer, rows = Packer(0), []
    for key, ids in docs.items():
        rows += packer.add(key, ids.tobytes())
    rows += packer.flush()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group")
    assert check_windows([dict(zip(names, r)) for r in rows], {k: v.tolist() for k, v in docs.items()}) < 3 * 2048
    with pytest.raises(ValueError):
        Packer(0, tiers=(500, 1000))


def test_waiting_fragments_hold_their_own_ids_only():
    """Documents of 100,001 tokens leave tails of a few ids each; what waits does not keep the documents."""
    packer = Packer(0)
    ids = np.arange(100_001, dtype="<u4").tobytes()
    found = [row for i in range(200) for row in packer.add(i, ids)]
    waiting = [f for pool in packer._pools.values() for held in pool._by.values() for f in held]
    assert sum(len(f.ids) for f in waiting) == 4 * sum(map(len, waiting)) <= 2 * 4 * 200 * (100_001 % 2048)
    found += list(packer.flush())
    pieces = defaultdict(list)
    for key, start, n, crc, total, *_ in found:
        assert crc == zlib.crc32(ids[4 * start : 4 * (start + n)]) and total == 100_001
        pieces[key].append((start, n))
    assert all(sum(n for _, n in own) == 100_001 and sorted(own)[0][0] == 0 for own in pieces.values()) and len(pieces) == 200


def test_pack_with_a_very_long_text_and_clashing_columns(spark, library):
    texts = ["word " * 200_000, None, "", "x" * 50_000]
    docs = spark.createDataFrame([(i, t, 1.5, "old") for i, t in enumerate(texts)], "doc_id long, text string, length double, window string")
    found = pack(docs, JSON).collect()
    lengths = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["doc_tokens"] for r in found} == lengths
    assert all(sum(r["length"] for r in found if r["doc_id"] == i) == n for i, n in lengths.items())
    assert pack(docs.limit(0), JSON).count() == 0
