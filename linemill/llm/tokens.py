"""Token counts and ids of whole texts, without special begin or end tokens.

Texts arrive as Arrow batches. Each is cut at safe boundaries, places that no
token of the vocabulary can cross, so that long texts become many short pieces.
Of a run of texts, balanced by bytes, the distinct pieces are found in Arrow,
those not met before are encoded in calls of balanced bytes, and the texts'
lengths (or ids) are summed (or gathered) from the pieces' with numpy. Only
lengths, or packed windows, leave the task.

Defined results: a null text counts as empty and has no tokens; repeated rows
and ties are counted alike; other columns pass through untouched; a very long
text is a run of its own, cut like any other, and one without any boundary is
encoded as one piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._memo import claim, release

#: Bytes that one call of the encoder gets at most, unless a single text or piece is longer.
CALL_BYTES = 262_144
#: Bytes of texts that are cut and counted together.
RUN_BYTES = 2 << 20
#: Pieces that a worker remembers, and the longest of them in bytes.
MEMO_PIECES, MEMO_BYTES = 120_000, 64


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[pa.Array]:
    """Slices of texts whose bytes add up to at most so many, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _balanced(pieces: list[bytes], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Runs of decoded pieces whose bytes add up to about the same."""
    part, held = [], 0
    for piece in pieces:
        if part and held + len(piece) > most:
            yield part
            part, held = [], 0
        part.append(piece.decode())
        held += len(piece)
    if part:
        yield part


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and the length of each."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes


def _json_encoder(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = Tokenizer.from_file(path)
    encoder.no_truncation()
    encoder.no_padding()
    return encoder


class WholeTexts:
    """Encodes each text in one piece: for vocabularies without known boundaries."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            encoder = _json_encoder(path)
            self._encode = lambda texts: [e.ids for e in encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and the number of each text's."""
        return _flat([ids for part in runs(texts, CALL_BYTES) for ids in self._encode([t or "" for t in part.to_pylist()])])

    def counts(self, texts: pa.Array) -> np.ndarray:
        return self.ids(texts)[1]


def _byte_level() -> dict[int, str]:
    """The vocabulary's character for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()
#: Letters below this are letters in every version of Unicode.
_LETTERS_BELOW = "\u0220"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_MARK = np.zeros(256, bool)
_ASCII_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Bytes that start or are a character which is no white space, whatever follows; the rest is looked at or left uncut.
_SURE = np.zeros(256, bool)
_SURE[[*range(0x21, 0x7F), *range(0xC3, 0xE0), 0xE0, *range(0xE4, 0xF5)]] = True


def _no_blank(data: np.ndarray) -> np.ndarray:
    """Of each byte, whether its character is surely no white space. data holds two bytes more than are asked for."""
    sure = _SURE[data]
    if int(data.max(initial=0)) >= 0x80:
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            at = np.flatnonzero(data[:-2] == lead)
            two, three = data[at + 1], data[at + 2]
            if lead == 0xC2:
                sure[at] = two > 0xA0
            elif lead == 0xE1:
                sure[at] = two > 0xA0
            elif lead == 0xE2:
                sure[at] = (two > 0x81) | ((two == 0x80) & (three >= 0x90) & (three < 0xA8))
            else:
                sure[at] = (two != 0x80) | (three != 0x80)
        later = np.flatnonzero((data & 0xC0) == 0x80)
        later = later[later > 0]
        for _ in range(3):
            sure[later] = sure[later - 1]
    return sure


class SafePieces:
    """Byte-level pairs whose words take at most one leading space.

    Texts are cut before a space and before and after a line feed that stand
    alone between characters which are no white space, and before an ASCII mark
    after an ASCII letter: there the vocabulary's pattern always ends a
    pre-token. Other white space stays inside a piece, and so does the content
    of an added token, so the result never depends on the cuts.
    """

    def __init__(self, path: str, count_only: bool):
        self._encoder = _json_encoder(path)
        self._model = self._encoder.model
        self._count_only = count_only
        self._whole = [re.compile(re.escape(t.content.encode())) for t in self._encoder.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self._place: dict[bytes, int] = {}
        self._sizes, self._flat = np.zeros(0, np.int64), np.zeros(0, "<u4")

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the vocabulary file is of the kind that this class handles."""
        if not path.endswith(".json"):
            return False
        encoder = _json_encoder(path)
        shape = json.loads(encoder.to_str())
        pre = shape.get("pre_tokenizer") or {}
        added = shape.get("added_tokens") or []
        plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x["content"].isalpha() or set(x["content"]) & set(" \n")) for x in added)
        return shape.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First bytes of the pieces. starts are those of the texts that are not empty; the last entry is the end."""
        sure, letter = _no_blank(np.concatenate([data, np.zeros(2, np.uint8)])), _ASCII_LETTER[data]
        before = np.concatenate([[False], sure[: len(data) - 1]])
        before[starts[:-1]] = False
        after = sure[1 : len(data) + 1]
        after[starts[1:] - 1] = False
        alone = before & after
        feed = alone & (data == 10)
        cut = feed | (alone & (data == 32))
        cut[1:] |= feed[:-1] | (letter[:-1] & _ASCII_MARK[data[1:]])
        raw = None
        for pattern in self._whole:
            if data.size >= 3:
                raw = data.tobytes() if raw is None else raw
                for found in pattern.finditer(raw):
                    cut[found.start() + 1 : found.end()] = False
        cut[starts[:-1]] = True
        return np.flatnonzero(cut)

    def _encoded(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. One word of letters with its space is one pre-token, which the vocabulary's model takes directly."""
        out: list[list[int] | None] = [None] * len(pieces)
        rest, model = [], self._model.tokenize
        for i, piece in enumerate(pieces):
            if len(piece) <= MEMO_BYTES:
                word = piece[1:] if piece[:1] == b" " else piece
                if word.isalpha():  # of bytes: ASCII letters only
                    out[i] = [t.id for t in model(piece.decode().replace(" ", _BYTE_LEVEL[32]))]
                    continue
                if (text := word.decode()).isalpha() and max(text) < _LETTERS_BELOW:
                    out[i] = [t.id for t in model(piece.decode("latin-1").translate(_BYTE_LEVEL))]
                    continue
            rest.append(i)
        encoded = chain.from_iterable(self._encoder.encode_batch_fast(part, add_special_tokens=False) for part in _balanced([pieces[i] for i in rest]))
        for i, one in zip(rest, encoded):
            out[i] = one.ids
        return out

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a run: each piece's code, pieces of each text; sizes, starts and ids of the codes."""
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            none = np.zeros(0, np.int64)
            return none, np.zeros(len(texts), np.int64), none, none, np.zeros(0, "<u4")
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        firsts = self._cuts(data, np.unique(bounds))
        of_text = np.diff(np.searchsorted(firsts, bounds))
        spans = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(np.append(firsts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = spans.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._place) + len(distinct) > MEMO_PIECES:
            self._forget()
        known = list(map(self._place.get, distinct))
        new = [i for i, place in enumerate(known) if place is None]
        flat, sizes = _flat(self._encoded([distinct[i] for i in new]))
        base = len(self._sizes)
        short = [(n, i) for n, i in enumerate(new) if len(distinct[i]) <= MEMO_BYTES]
        for n, i in enumerate(new):
            known[i] = base + n
        all_sizes = np.concatenate([self._sizes, sizes])
        all_flat = self._flat if self._count_only else np.concatenate([self._flat, flat])
        if len(short) == len(new):
            self._place.update((distinct[i], base + n) for n, i in short)
            self._sizes, self._flat = all_sizes, all_flat
        else:
            keep = np.zeros(len(new), bool)
            keep[[n for n, _ in short]] = True
            self._place.update((distinct[i], base + at) for at, (_, i) in enumerate(short))
            self._sizes = np.concatenate([self._sizes, sizes[keep]])
            if not self._count_only:
                self._flat = np.concatenate([self._flat, flat[np.repeat(keep, sizes)]])
        codes = np.asarray(known, np.int64)[coded.indices.to_numpy()]
        return codes, of_text, all_sizes, np.cumsum(all_sizes) - all_sizes, all_flat

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a run in turn, and the number of each text's."""
        codes, of_text, sizes, starts, flat = self._pieces(texts)
        each = sizes[codes]
        ends = np.cumsum(each)
        gather = np.repeat(starts[codes] - (ends - each), each) + np.arange(int(each.sum()))
        return flat[gather], _sums(each, of_text)

    def counts(self, texts: pa.Array) -> np.ndarray:
        codes, of_text, sizes, _, _ = self._pieces(texts)
        return _sums(sizes[codes], of_text)


def _sums(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of so many values."""
    reached = np.concatenate([[0], np.cumsum(values)])
    return np.diff(reached[np.concatenate([[0], np.cumsum(groups)])])


_codecs: dict[tuple[str, bool], object] = {}


def codec(path: str, count_only: bool):
    """The worker's encoder of a vocabulary file, loaded once per worker process."""
    claim("tokens", _codecs.clear)
    if (path, count_only) not in _codecs:
        _codecs[path, count_only] = SafePieces(path, count_only) if SafePieces.fits(path) else WholeTexts(path)
    return _codecs[path, count_only]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """The columns of docs other than its text, with the token count of each whole text.

    A null text counts as empty. A column named like the count is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, count)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(count, T.LongType())])

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(vocabulary, True)
        for batch in batches:
            counted = [encoder.counts(part) for part in runs(batch.column(batch.num_columns - 1))]
            found = pa.array(np.concatenate(counted) if counted else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*kept, count])
        release()

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(count_batches, schema)
