"""Document quality by votes of the nearest labelled documents in a latent-semantic space.

Every whole text becomes a sparse vector of terms: its words in hashed bins,
the shapes of its words, and how much of it repeats. Inverse document
frequencies and a truncated singular value decomposition are fitted on a
bounded sample of labelled rows; the sample's latent vectors are broadcast
(their number has a fixed bound) and each document is compared with all of
them, in blocks, by exact cosine. The share of good labels among the nearest,
weighted by similarity, is the score.

Defined results: a null, empty or blank text has the single term "empty" and
so the votes of labelled texts like it; a text that shares nothing with the
labelled ones has the share of good labels among all; cosines are rounded to
six digits, so a text has one score wherever it stands and whatever stands
beside it; null labels are left out; without any labelled row the score
is the prior 0.5; null keys are scored and are not held out; texts of any length
are scored whole, the terms of one text at a time; of a key with several texts
one is learned from; equally near neighbours beyond the last vote are told
apart by their place among the fitted vectors; an empty table gives an empty
result. Columns of other names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._common import crc_fold
from linemill.llm._memo import claim, release

#: Most labelled rows that the fit takes (those of the least key hashes).
SAMPLE_ROWS = 6_000
#: Bins of words and of word shapes, and latent dimensions.
WORD_BINS, SHAPE_BINS, LATENT = 1024, 512, 48
#: Neighbours that vote, and the power of their similarity that weighs a vote.
NEIGHBOURS, SHARPNESS = 31, 4.0
#: Documents compared with all neighbours at once.
BLOCK = 512

_TERMS = 1 + 40 + SHAPE_BINS + WORD_BINS
_LOWER, _UPPER, _DIGIT, _OTHER = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+"), re.compile(r"(\W)\1+")
_MEMO = 60_000


class _Words(dict):
    """Of a word: its own hash, its shape's bin and its bin."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        shape = _OTHER.sub(r"\1", _DIGIT.sub("9", _UPPER.sub("A", _LOWER.sub("a", word))))[:12]
        core = word.strip(".,;:!?\"'()").lower()
        found = self[word] = (
            xxhash.xxh64_intdigest(word) >> 1,
            41 + xxhash.xxh32_intdigest(shape) % SHAPE_BINS,
            41 + SHAPE_BINS + xxhash.xxh32_intdigest(core) % WORD_BINS,
        )
        return found


_words = _Words()


def _grade(share: float) -> int:
    """A share in ten steps, finer near nothing."""
    return min(9, int(10 * share**0.5))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights of a whole text."""
    words = (text or "").split()
    if not words:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    claim("terms", _words.clear)
    if len(_words) > _MEMO:
        _words.clear()
    known = np.array(list(map(_words.__getitem__, words)), np.int64)
    n = len(words)
    hashes = known[:, 0]
    same = float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0
    runs = hashes[:-2] * 3 + hashes[1:-1] * 5 + hashes[2:] * 7 if n > 2 else hashes[:0]
    again = 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    fixed = [1 + _grade(same), 11 + _grade(again), 21 + _grade(repeated), 31 + min(9, int(np.log2(n)))]
    shapes = np.bincount(known[:, 1] - 41, minlength=SHAPE_BINS)
    bins = np.bincount(known[:, 2] - 41 - SHAPE_BINS, minlength=WORD_BINS)
    at_shape, at_bin = np.flatnonzero(shapes), np.flatnonzero(bins)
    shape_part = np.sqrt(shapes[at_shape] / n)
    bin_part = np.log1p(bins[at_bin])
    bin_part /= max(1e-9, float(np.linalg.norm(bin_part)))
    where = np.concatenate([fixed, at_shape + 41, at_bin + 41 + SHAPE_BINS]).astype(np.int32)
    weight = np.concatenate([[0.5, 0.6, 0.5, 0.2], shape_part, 0.5 * bin_part]).astype(np.float32)
    return where, weight


def _dense(found: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, kind: type = np.float32) -> np.ndarray:
    out = np.zeros((len(found), _TERMS), kind)
    for row, (where, weight) in enumerate(found):
        out[row, where] = weight
    out *= idf
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _nearest(near: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k greatest values, ties by place, in the order of places."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    above, equal = near > least, near == least
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))[1].reshape(len(near), k)


class Voters(NamedTuple):
    """The fitted space and its labelled vectors; bounded by SAMPLE_ROWS whatever the corpus."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        axes, vectors = np.asarray(self.axes, np.float64), np.asarray(self.vectors, np.float64)
        for at in range(0, len(texts), BLOCK):
            # Sums depend on the height of a block in their last bits; rounded cosines don't.
            latent = _dense([terms(t) for t in texts[at : at + BLOCK]], self.idf, np.float64) @ axes
            norm = np.linalg.norm(latent, axis=1)
            near = np.round((latent / np.maximum(norm, 1e-9)[:, None]) @ vectors.T, 6)
            best = _nearest(near, min(NEIGHBOURS, near.shape[1]))
            weight = np.clip(np.take_along_axis(near, best, axis=1), 1e-6, 1) ** SHARPNESS
            votes = np.round((weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1), 9)
            # What shares no axis with any voter is near none: all vote.
            out[at : at + BLOCK] = np.where(np.round(norm, 6) > 1e-6, votes, self.labels.mean())
        return np.clip(out, 0, 1)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist() for w, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float32())), batch.column(1)], names=["at", "weight", "label"])


def solve(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Voters:
    """Voters of sparse rows and their labels, whatever their order."""
    order = sorted(range(len(found)), key=lambda i: (len(found[i][0]), found[i][0].tobytes(), found[i][1].tobytes(), labels[i]))
    found, labels = [found[i] for i in order], labels[order]
    seen = np.bincount(np.concatenate([w for w, _ in found]), minlength=_TERMS)
    idf = np.sqrt(np.log((1 + len(found)) / (1 + seen)) + 1).astype(np.float32)
    matrix = _dense(found, idf)
    values, vectors = np.linalg.eigh(matrix.T @ matrix)
    axes = vectors[:, np.argsort(-values)[: min(LATENT, len(found))]].astype(np.float32)
    return Voters(idf, axes, _unit(matrix @ axes), labels)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, labels = [], []
    for batch in batches:
        at, weight, label = (batch.column(i).to_pylist() for i in range(3))
        found += [(np.asarray(a, np.int32), np.asarray(w, np.float32)) for a, w in zip(at, weight)]
        labels += label
    if found:
        voters = solve(found, np.asarray(labels, np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in voters], names=list(Voters._fields))


def fit(labelled: DataFrame) -> Voters:
    """Voters of a bounded frame of text and label. One task solves it; only the fitted arrays reach the driver."""
    sparse = labelled.mapInArrow(_sparse, "at array<int>, weight array<float>, label int").repartition(1)
    rows = sparse.mapInArrow(_solved, ", ".join(f"{name} binary" for name in Voters._fields)).collect()
    if not rows:
        return Voters(np.ones(_TERMS, np.float32), np.zeros((_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    idf, axes, vectors = (np.frombuffer(rows[0][name], np.float32) for name in ("idf", "axes", "vectors"))
    labels = np.frombuffer(rows[0]["labels"], np.float64)
    return Voters(idf, axes.reshape(_TERMS, -1), vectors.reshape(len(labels), -1), labels)


def quality_scores(docs: DataFrame, voters: Voters, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column score from 0 to 1 (one of that name is replaced); its other columns pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(voters))

    @F.arrow_udf(T.DoubleType())
    def vote(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        idf, axes, vectors, labels = sent.value
        own = Voters(idf, axes.astype(np.float64), vectors.astype(np.float64), labels)
        for part in parts:
            # Few texts at a time are held as Python strings.
            found = [own.scores(part.slice(at, BLOCK).to_pylist()) for at in range(0, len(part), BLOCK)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))
        release()

    return docs.withColumn(score, vote(F.col(f"`{text}`")))


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    return crc_fold(key, folds) == fold


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> Voters:
    """Voters of labelled documents outside the held-out fold (the keys' crc32 modulo folds is 0).

    At most sample_rows distinct pairs of key and label are drawn, by the key's
    hash; only these rows are broadcast to find their texts. Of a key's texts
    the one of the least hash is taken, so no more rows are gathered.
    """
    marked = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(F.col("__key").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__key"), folds))
    drawn = marked.distinct().orderBy(F.xxhash64(F.lit("voters"), "__key"), "__key", "__label").limit(sample_rows)
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    found = texts.join(F.broadcast(drawn), "__key").groupBy("__key", "__label")
    return fit(found.agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("__least")).select("__least.__text", "__label"))
