"""Byte-level BPE ids of whole texts by tree concatenation, and their decoding.

A long text is halved, at characters but wherever else the middle falls, until
its leaves are short. Leaves are encoded in parallel, as if each were a text.
Then neighbours are joined, level by level: a window of tokens around the join
is encoded again, and grows until its first tokens are those of the left side
and its last ones those of the right side. What lies outside the window then
stands as it is, for two reasons. The pattern that splits words looks no
further than a window reaches beyond the join, and it ends a run of letters,
digits, marks or blanks at the same place wherever in the run it starts. In a
word, a sequence of tokens is the encoding if each two neighbours are the
encoding of their own bytes, since the first merge across a border would happen
between these two alone; so tokens that agree at a window's edge carry what
holds inside each part over the edge. Where both sides never agree, as in a long
run of one letter, the window grows to the whole text.

Texts of more than SPREAD_BYTES are cut into blocks that are dealt to all tasks,
and their ids meet again, block after block, in one row for each text.

Defined results: a null or empty text has no ids; null ids decode to null, ids
outside the vocabulary to nothing, and bytes that are no UTF-8 to U+FFFD, as the
library has it. Repeated rows and ties are encoded alike; empty tables give no
rows; other columns pass through, and one named like the result is replaced.
Vocabularies of another kind raise ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._common import fresh_dir
from linemill.llm._memo import claim, release
from linemill.llm.tokens import _BYTE_LEVEL, SafePieces, _json_encoder, runs

#: Longest leaf in bytes, before a text is halved.
LEAF_BYTES = 4_096
#: Tokens on either side of a join in its first window, and those that must agree at each edge.
WINDOW, AGREE = 24, 4
#: Texts of more bytes are spread over tasks, in blocks of at most so many.
SPREAD_BYTES, BLOCK_BYTES = 65_536, 32_768


def check_vocabulary(path: str) -> None:
    """Raises ValueError unless the file is a byte-level BPE whose merges alone decide, without normalisation."""
    model = json.loads(_json_encoder(path).to_str())["model"] if path.endswith(".json") else {}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or not SafePieces.fits(path):
        raise ValueError(f"{path} is no byte-level BPE vocabulary")


class TreeCodec:
    """Encodes and decodes in one worker."""

    def __init__(self, path: str, leaf: int = LEAF_BYTES):
        self._leaf = leaf
        self._pieces = SafePieces(path, False)
        self._encoder = _json_encoder(path)
        of_char = {c: b for b, c in _BYTE_LEVEL.items()}
        names = {i: t for t, i in self._encoder.get_vocab(with_added_tokens=True).items()}
        size = max(names) + 1
        self.bytes_of = [b""] * size
        for i, name in names.items():
            self.bytes_of[i] = bytes(of_char[c] for c in name) if all(c in of_char for c in name) else name.encode()
        self._size = np.array([len(b) for b in self.bytes_of], np.int64)
        self._starts = np.array([bool(b) and b[0] & 0xC0 != 0x80 for b in self.bytes_of])
        added = self._encoder.get_added_tokens_decoder().values()
        #: Bytes that an added token or the pattern's look-ahead can reach across a join.
        self._margin = max([8, *(len(t.content.encode()) for t in added)])

    def cuts(self, data: bytes, most: int) -> list[bytes]:
        """The text in halves of halves, none of more than about so many bytes, cut between characters."""
        depth = max(0, (max(1, -(-len(data) // most)) - 1).bit_length())
        at = [0]
        for i in range(1, 1 << depth):
            place = max(at[-1], len(data) * i >> depth)
            while place < len(data) and data[place] & 0xC0 == 0x80:
                place += 1
            at.append(place)
        return [data[a:b] for a, b in zip(at, [*at[1:], len(data)]) if b > a] or [b""]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        leaves = [self.cuts(t, self._leaf) for t in texts]
        flat = pa.array(list(chain.from_iterable(leaves)), pa.large_binary())
        parts: list[np.ndarray] = []
        for run in runs(flat):
            ids, sizes = self._pieces.ids(run)
            parts += np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []
        at, nodes = 0, []
        for own in leaves:
            nodes.append(parts[at : at + len(own)])
            at += len(own)
        return self.concatenated(nodes)

    def concatenated(self, nodes: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The ids of texts whose parts' ids are given in order."""
        while any(len(own) > 1 for own in nodes):
            pairs = [(own[i], own[i + 1]) for own in nodes for i in range(0, len(own) - 1, 2)]
            joined = iter(self.join(pairs))
            nodes = [[next(joined) for _ in range(len(own) // 2)] + own[len(own) & ~1 :] for own in nodes]
        return [own[0] if own else np.zeros(0, "<u4") for own in nodes]

    def _left(self, ids: np.ndarray, want: int) -> int:
        """First token of the window in the left side: a character's start, far enough from the join."""
        at = len(ids) - want
        while at > 0 and (not self._starts[ids[at]] or self._size[ids[at + AGREE :]].sum() < self._margin):
            at -= 1
        return max(at, 0)

    def _right(self, ids: np.ndarray, want: int) -> int:
        """First token after the window in the right side."""
        at = want
        while at < len(ids) and (not self._starts[ids[at]] or self._size[ids[: at - AGREE]].sum() < self._margin):
            at += 1
        return min(at, len(ids))

    def join(self, pairs: list[tuple[np.ndarray, np.ndarray]], want: int = WINDOW) -> list[np.ndarray]:
        """The ids of each pair's concatenated texts."""
        out: list[np.ndarray] = [np.concatenate(p) if not (len(p[0]) and len(p[1])) else None for p in pairs]
        open_ = [i for i, done in enumerate(out) if done is None]
        while open_:
            edges = [(self._left(pairs[i][0], want), self._right(pairs[i][1], want)) for i in open_]
            windows = [self.text_bytes(np.concatenate([pairs[i][0][a:], pairs[i][1][:b]])).decode() for i, (a, b) in zip(open_, edges)]
            still = []
            for i, (a, b), one in zip(open_, edges, self._encoder.encode_batch_fast(windows, add_special_tokens=False)):
                left, right = pairs[i]
                new = np.array(one.ids, "<u4")
                fits_left = a == 0 or np.array_equal(new[:AGREE], left[a : a + AGREE])
                fits_right = b == len(right) or np.array_equal(new[-AGREE:], right[b - AGREE : b])
                if fits_left and fits_right:
                    out[i] = np.concatenate([left[:a], new, right[b:]])
                else:
                    still.append(i)
            open_, want = still, 2 * want
        return out

    def text_bytes(self, ids: np.ndarray) -> bytes:
        known = self.bytes_of
        return b"".join([known[i] for i in ids.tolist() if i < len(known)])

    def decode(self, ids: np.ndarray) -> str:
        return self.text_bytes(ids).decode("utf-8", "replace")


_codecs: dict[tuple[str, int], TreeCodec] = {}


def tree_codec(path: str, leaf: int = LEAF_BYTES) -> TreeCodec:
    """The worker's codec of a vocabulary file, made once per worker process."""
    claim("bpe", _codecs.clear)
    if (path, leaf) not in _codecs:
        _codecs[path, leaf] = TreeCodec(path, leaf)
    return _codecs[path, leaf]


def _encoded(rows: DataFrame, vocabulary: str, text: str, ids: str, leaf: int) -> DataFrame:
    """The other columns of rows, and ids of the texts; a task's texts are encoded run by run."""
    kept = [c for c in rows.columns if c not in (text, ids)]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(ids, T.BinaryType())])

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(vocabulary, leaf)
        for batch in batches:
            at = 0
            for part in runs(batch.column(batch.num_columns - 1)):
                found = codec.encode([(t or "").encode() if not isinstance(t, bytes) else t for t in part.to_pylist()])
                columns = [c.slice(at, len(part)) for c in batch.columns[:-1]]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in found], pa.binary())], names=[*kept, ids])
        release()

    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(encode_batches, schema)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", spread_bytes: int = SPREAD_BYTES, block_bytes: int = BLOCK_BYTES, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """The columns of docs other than its text, with the ids of each whole text as little-endian 32-bit integers."""
    check_vocabulary(vocabulary)
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in (text, ids)]
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0))
    docs = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))
    short = _encoded(docs.where(size <= spread_bytes), vocabulary, text, ids, leaf_bytes)
    # The number of a long text's row must not change between its blocks and its other columns.
    folder = f"{fresh_dir(spark, 'bpe')}/long"
    own = [f"__kept{i}" for i in range(len(kept))]
    long = docs.where(size > spread_bytes).select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own)], F.col(f"`{text}`").alias("__text"))
    long.write.parquet(folder)
    long = spark.read.schema(long.schema).parquet(folder)

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(vocabulary, leaf_bytes)
        for batch in batches:
            for row, whole in zip(batch.column(0), batch.column(1)):
                parts = codec.cuts(whole.as_py().encode(), block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["__row", "__block", "__part"])

    def join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(vocabulary, leaf_bytes)
        for batch in batches:
            for row, parts in zip(batch.column(0), batch.column(1)):
                held = [np.frombuffer(p["ids"], "<u4") for p in parts.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()]), pa.array([codec.concatenated([held])[0].tobytes()], pa.binary())], names=["__row", "__ids"])
        release()

    blocks = long.select("__row", "__text").mapInArrow(cut_batches, "__row long, __block long, __part binary").repartition("__row", "__block")
    parts = _encoded(blocks, vocabulary, "__part", "ids", leaf_bytes).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__block", "ids"))).alias("__parts"))
    whole = parts.mapInArrow(join_batches, "__row long, __ids binary")
    met = long.drop("__text").join(whole, "__row").select(*[F.col(o).alias(c) for c, o in zip(kept, own)], F.col("__ids").alias(ids))
    return short.unionByName(met)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The columns of rows, with the text that each row's ids stand for; special tokens are written out."""
    check_vocabulary(vocabulary)
    kept = [c for c in rows.columns if c != text]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(text, T.StringType())])

    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tree_codec(vocabulary)
        for batch in batches:
            at = 0
            for part in runs(batch.column(batch.num_columns - 1)):
                told = [None if x is None else codec.decode(np.frombuffer(x, "<u4")) for x in part.to_pylist()]
                columns = [c.slice(at, len(part)) for c in batch.columns[:-1]]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(told, pa.string())], names=[*kept, text])
        release()

    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("__from")).mapInArrow(decode_batches, schema)
