"""Language identification with error-correcting output codes.

Each language gets a codeword; for each bit of it a binary classifier over
hashed character n-grams (one to three bytes) predicts the bit of a text's
language. Decoding is loss-weighted: the codeword with the least total loss
over the bits' margins wins, and a bit counts by how well it held on its own
training rows. Texts whose two best codewords lie close together are flagged.

The classifiers are fitted on a bounded, hash-drawn sample of labelled rows;
every whole text is predicted.

Defined results: a null text or one without a letter is `und` with score 0;
without labelled rows every text is; one learned language is always predicted,
with score 1. Null languages are not learned from. Of languages of equal share
the first by name is predicted. Rows are predicted each on its own, repeated
ones alike, and texts of any length whole, a block of bytes at a time; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linemill.llm._common import crc_fold
from linemill.llm.shingles import mix

#: Most labelled rows that the fit takes, bins of n-grams, and steps of the fit.
SAMPLE_ROWS, BINS, STEPS = 6_000, 4096, 250
#: Most values of the language column; more are no languages, and raise an error. Each has a row in the sample at least.
MOST_LANGUAGES = 8_000
#: Characters of a text's block of n-grams at a time.
BLOCK_BYTES = 1 << 20
#: Below this gap between the best two languages' shares a prediction is ambiguous.
AMBIGUOUS = 0.1
NO_LANGUAGE = "und"


def codewords(languages: int) -> np.ndarray:
    """A +1/-1 row for each language.

    Up to five languages get the exhaustive code of 2 ** (n - 1) - 1 bits; more
    get dense drawn rows of 10 * log2(n) bits or more, the farthest apart of 64
    fixed draws.
    """
    n = languages
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        columns = range(1, 2 ** (n - 1))
        return np.array([[1 if row == 0 else (-1 if c >> (row - 1) & 1 else 1) for c in columns] for row in range(n)], np.int8)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    best, apart = None, -1
    for seed in range(64):
        drawn = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        distance = (bits - drawn.astype(np.int32) @ drawn.T) // 2 + bits * np.eye(n, dtype=np.int32)
        if distance.min() > apart and (np.abs(drawn.sum(axis=0)) < n).all():
            best, apart = drawn, distance.min()
    return best


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of n-gram counts over a whole text, its case and digits folded."""
    raw = np.frombuffer(b"  " + text.lower().encode() + b"  ", np.uint8)
    counts = np.zeros(BINS, np.float64)
    for at in range(0, max(1, len(raw) - 2), BLOCK_BYTES):
        x = raw[at : at + BLOCK_BYTES + 2].astype(np.uint64)
        three = x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16)
        for grams, tag in ((three, 3), (three & np.uint64(0xFFFF), 2), (three & np.uint64(0xFF), 1)):
            counts += np.bincount((mix(grams | np.uint64(tag << 32)) >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS)
    found = np.sqrt(counts).astype(np.float32)
    return found / max(1e-9, float(np.linalg.norm(found)))


class Coder(NamedTuple):
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def shares(self, vectors: np.ndarray) -> np.ndarray:
        """For each row the languages' shares, from the losses of their codewords."""
        margin = vectors @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust
        power = -loss.sum(axis=2)
        power = np.exp(power - power.max(axis=1, keepdims=True))
        return power / power.sum(axis=1, keepdims=True)


def _fit_bits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions, one for each column of +1/-1 in y, by accelerated gradient steps."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    rate, keep = 40.0, 0.9
    for _ in range(STEPS):
        pull = (-y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))).astype(np.float32) / len(x)
        vw = keep * vw - rate * (x.T @ pull + 1e-6 * w)
        vb = keep * vb - rate * 0.05 * pull.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t).astype(np.float16).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["vector", "language"])


def solve(vectors: list[bytes], languages: list[str], names: list[str]) -> Coder:
    """A coder of sample vectors and their languages, whatever their order."""
    order = sorted(range(len(vectors)), key=lambda i: (languages[i], vectors[i]))
    x = np.stack([np.frombuffer(vectors[i], np.float16) for i in order]).astype(np.float32)
    code, place = codewords(len(names)), {n: i for i, n in enumerate(names)}
    y = code[[place[languages[i]] for i in order]].astype(np.float32)
    w, b = _fit_bits(x, y)
    right = np.clip(((x @ w + b) * y > 0).mean(axis=0), 0.51, 0.999)
    trust = np.log(right / (1 - right))
    return Coder(names, code, w, b, trust / trust.mean())


def _fitted(sample: DataFrame, names: list[str]) -> Coder:
    """The coder of a bounded frame of text and language. One task solves it; only the weights reach the driver."""

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, languages = [], []
        for batch in batches:
            vectors += batch.column(0).to_pylist()
            languages += batch.column(1).to_pylist()
        if vectors:
            coder = solve(vectors, languages, names)
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(v, np.float32).tobytes()], pa.binary()) for v in (coder.weights, coder.bias, coder.trust)], names=["weights", "bias", "trust"])

    rows = sample.mapInArrow(_vectors, "vector binary, language string").repartition(1).mapInArrow(solved, "weights binary, bias binary, trust binary").collect()
    weights, bias, trust = (np.frombuffer(rows[0][name], np.float32) for name in ("weights", "bias", "trust"))
    return Coder(names, codewords(len(names)), weights.reshape(BINS, -1), bias, trust)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", folds: int = 3, fold: int = 1, sample_rows: int = SAMPLE_ROWS) -> Coder:
    """A coder of all languages that rows outside the held-out fold name.

    The sample is drawn by key hash from the keys of each language, with the
    text of the least hash of each key; its bound (sample_rows, or one row of
    each language if these are more) is shared by the languages, so rare
    languages keep all their keys. No more rows are gathered. Raises ValueError
    for more than MOST_LANGUAGES values of the language column.
    """
    learn = docs.where(F.col(f"`{language}`").isNotNull() & F.col(f"`{text}`").isNotNull() & F.col(f"`{key}`").isNotNull() & (crc_fold(F.col(f"`{key}`"), folds) != fold))
    found = learn.groupBy(F.col(f"`{language}`").alias("language")).agg(F.approx_count_distinct(F.col(f"`{key}`"), 0.02).alias("count")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"column {language!r} has more than {MOST_LANGUAGES} values")
    names = sorted(r["language"] for r in found)
    if len(names) < 2:
        return Coder(names, codewords(len(names)), np.zeros((BINS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    each = max(1, sample_rows // len(names))
    # The draw's threshold passes about 1.2 times the bound, and the bound then holds exactly.
    reach = F.create_map(*[x for r in found for x in (F.lit(r["language"]), F.lit(min(1.0, (1.2 * each + 60) / r["count"])))])
    draw = F.pmod(F.xxhash64(F.lit("coder"), F.col(f"`{key}`")), F.lit(1 << 30)) / float(1 << 30)
    near = learn.select(F.col(f"`{text}`").alias("text"), F.col(f"`{language}`").alias("language"), F.col(f"`{key}`").alias("key"), draw.alias("draw")).where(F.col("draw") < F.element_at(reach, F.col("language")))
    one = near.groupBy("language", "draw", "key").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
    place = F.row_number().over(Window.partitionBy("language").orderBy("draw", "key"))
    bounded = one.withColumn("place", place).where(F.col("place") <= each)
    return _fitted(bounded.select("least.text", "language"), names)


def predict(docs: DataFrame, coder: Coder, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (share of the predicted language) and ambiguous; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(coder))

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Coder(*sent.value)
        for part in parts:
            lettered = [i for i, t in enumerate(part) if own.languages and t is not None and any(map(str.isalpha, t))]
            name, score, unsure = [NO_LANGUAGE] * len(part), np.zeros(len(part)), np.zeros(len(part), bool)
            texts = part.tolist()
            for at in range(0, len(lettered), 512):
                some = lettered[at : at + 512]
                shares = own.shares(np.stack([features(texts[i]) for i in some]))
                order = np.argsort(-shares, axis=1, kind="stable")
                best = np.take_along_axis(shares, order, axis=1)
                score[some] = best[:, 0]
                unsure[some] = best[:, 0] - best[:, 1] < AMBIGUOUS if best.shape[1] > 1 else False
                for i, k in zip(some, order[:, 0]):
                    name[i] = own.languages[k]
            yield pd.DataFrame({"lang_pred": name, "score": score, "ambiguous": unsure})

    return docs.withColumn("__guess", guess(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")], "__guess.lang_pred", "__guess.score", "__guess.ambiguous")
