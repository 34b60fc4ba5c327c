"""Classifiers and neighbours: held-out accuracy, recall, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linemill.llm import ann, language_id, quality_classifier
from linemill.llm.queries import op3_nearest_neighbours, op4_quality_classifier, op8_language_id

SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op4_quality_classifier(spark, SF).collect()]
    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 1]) > 0.97


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"some plain words here {i}" if i % 2 else "### *** $$$", 5.0) for i in range(40)] + [(None, None, 1.0), (50, "", 1.0), (50, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality_classifier.quality_scores(docs, quality_classifier.train(docs, labels)).collect()
    by = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 43 and by[1] > 0.7 and by[2] < 0.3
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.quality_scores(docs, none).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), none).count() == 0


def test_language_of_held_out_rows(spark):
    told = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in op8_language_id(spark, SF).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == told[r["doc_id"]] for r in held]) > 0.98


def test_language_of_odd_rows(spark):
    rows = [(i, ["the cat and dog", "le chat et chien"][i % 2], ["en", "fr"][i % 2], 1.0) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None, "en", 1.0), (61, "12 ²!", None, 1.0), (None, "the dog", None, 1.0)], "doc_id long, text string, lang string, score double")
    coder = language_id.train(docs)
    found = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, coder).collect()}
    assert {(0, "en"), (1, "fr"), (60, "und"), (61, "und"), (None, "en")} <= found
    nothing = language_id.train(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    one = language_id.train(docs.where("lang = 'en'"))
    assert [tuple(r)[-3:] for r in language_id.predict(docs.where("doc_id = 1"), one).collect()] == [("en", 1.0, False)]


@pytest.mark.parametrize("n", [2, 4, 5, 12])
def test_codewords_are_far_apart(n):
    code = language_id.codewords(n).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert (apart + np.eye(n, dtype=int) * 99).min() >= (1 if n == 2 else code.shape[1] // 4)


def brute_force(vectors, keys, k):
    out = {}
    for q in keys:
        x = np.array(vectors[q])
        far = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), key) for key, v in vectors.items() if key != q)
        out[q] = far[:k]
    return out


def test_recall_on_all_queries(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float32).astype(float) for r in rows}
    queries = [k for k in vectors if k % 100 == 0]
    told, found = brute_force(vectors, queries, 10), {}
    for r in op3_nearest_neighbours(spark, SF).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in queries:
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        exact = {key: far for far, key in brute_force(vectors, [q], len(vectors))[q]}
        assert all(abs(exact[m[1]] - m[2]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & {key for _, key in told[q]})
    assert hits >= 9 * len(queries)


def test_odd_vectors(spark):
    same = [(i, [1.0, 1.0]) for i in range(200)]
    rows = [*same, (300, None), (301, [0.0, 0.0]), (302, [1.0, None]), (303, [float("nan"), 1.0]), (304, [1.0]), (None, [1.0, 1.0]), (400, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(frame, F.col("vec_id") % 100 == 0, k=3).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {0: [(1, 0.0), (2, 0.0), (3, 0.0)], 100: [(0, 0.0), (1, 0.0), (2, 0.0)], 400: [(0, 1.0), (1, 1.0), (2, 1.0)]}
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]


def test_outliers_among_copies_find_all_neighbours(spark):
    draw = np.random.default_rng(5)
    groups = np.repeat(draw.normal(size=(50, 8)), 40, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(groups)]
    outliers = [(10_000 + i, v.tolist()) for i, v in enumerate(20 * draw.normal(size=(20, 8)))]
    # A key of its own leaf: none of its rows is a candidate.
    repeated = [(20_000, [300.0] * 8)] * 15
    frame = spark.createDataFrame(rows + outliers + repeated, "vec_id long, embedding array<float>")
    found = ann.nearest(frame, F.col("vec_id") >= 10_000, leaf_rows=40).groupBy("query_id").count().collect()
    counts = {r["query_id"]: r["count"] for r in found}
    assert counts == {key: 10 for key in [*range(10_000, 10_020), 20_000]}


def test_voters_of_a_repeated_key_are_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(1, 1)] * 50, "doc_id long, quality int")
    found = quality_classifier.train(docs, labels, sample_rows=1000)
    told = labels.where(~quality_classifier.held_out(F.col("doc_id"))).select("doc_id").distinct().count()
    assert not labels.where(quality_classifier.held_out(F.col("doc_id")) & (F.col("doc_id") == 1)).count()
    assert len(found.labels) == told


def test_coder_takes_one_text_of_a_repeated_key(spark, monkeypatch):
    sizes = []
    fitted = language_id._fitted
    monkeypatch.setattr(language_id, "_fitted", lambda sample, names: (sizes.append(sample.count()), fitted(sample, names))[1])
    rows = [(1, f"the cat {i}", "en") for i in range(400)] + [(i, ["le chien", "the dog"][i % 2], ["fr", "en"][i % 2]) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = {r["doc_id"] for r in docs.where(language_id.crc_fold(F.col("doc_id"), 3) != 1).collect()}
    language_id.train(docs)
    assert 1 in learnt and sizes == [len(learnt)]


def test_votes_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    voters = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    some = [*docs.orderBy("doc_id").limit(60).collect(), (None, None), (-1, "w " * 300_000), (-2, "one two"), (-3, "one two")]
    frame = spark.createDataFrame([tuple(r) for r in some], "doc_id long, text string")
    scores = [r["score"] for r in quality_classifier.quality_scores(frame.coalesce(1), voters).collect()]
    for (_, text), score in zip(some, scores):
        sparse = dict(zip(*(x.tolist() for x in quality_classifier.terms(text))))
        weighted = {t: w * float(voters.idf[t]) for t, w in sparse.items()}
        norm = sum(w * w for w in weighted.values()) ** 0.5
        latent = [sum(w / norm * float(voters.axes[t, d]) for t, w in weighted.items()) for d in range(voters.axes.shape[1])]
        size = sum(x * x for x in latent) ** 0.5
        if size < 1e-6:
            assert abs(score - float(voters.labels.mean())) < 1e-9
            continue
        near = sorted(((round(sum(a / size * float(b) for a, b in zip(latent, v)), 6), -place, float(y)) for place, (v, y) in enumerate(zip(voters.vectors, voters.labels))), reverse=True)
        votes = [(max(1e-6, min(1, s)) ** quality_classifier.SHARPNESS, y) for s, _, y in near[: quality_classifier.NEIGHBOURS]]
        assert abs(score - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 2e-9
    assert scores[-1] == scores[-2]


def test_one_score_for_one_text(spark):
    """A text alone, first, last and amid blocks of any height has the same score, exactly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    voters = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    whole = voters.scores(texts)
    assert [voters.scores([t])[0] for t in texts] == whole.tolist()
    for n in (2, 3, 7, 61):
        assert np.concatenate([voters.scores(texts[at : at + n]) for at in range(0, len(texts), n)]).tolist() == whole.tolist()
    assert voters.scores(texts[::-1])[::-1].tolist() == whole.tolist()
    again = quality_classifier.quality_scores(docs.repartition(7), voters).orderBy("doc_id").collect()
    assert [r["score"] for r in again] == whole.tolist()


def test_decoding_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    coder = language_id.train(docs)
    some = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()] + ["le chat " * 200_000, "le chat " * 200_000]
    found = language_id.predict(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").coalesce(1), coder).collect()
    for text, row in zip(some[:40], found):
        raw = b"  " + text.lower().encode() + b"  "
        counts = np.zeros(language_id.BINS)
        for n in (1, 2, 3):
            for i in range(len(raw) - 2):
                gram = sum(b << 8 * k for k, b in enumerate(raw[i : i + n]))
                counts[int(language_id.mix(np.array([gram | n << 32], np.uint64))[0] >> np.uint64(40)) % language_id.BINS] += 1
        vector = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
        margins = [float(vector @ coder.weights[:, b] + coder.bias[b]) for b in range(coder.code.shape[1])]
        losses = [sum(np.log1p(np.exp(-m * c)) * t for m, c, t in zip(margins, word, coder.trust)) for word in coder.code.tolist()]
        shares = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        assert row["lang_pred"] == coder.languages[int(shares.argmax())] and abs(row["score"] - shares.max()) < 1e-3
    assert found[-1]["lang_pred"] == found[-2]["lang_pred"] and found[-1]["score"] == found[-2]["score"]


def test_vectors_far_from_the_origin_and_a_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 100)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 40)
    draw = np.random.default_rng(8)
    for vectors in (100_000 + 0.001 * draw.normal(size=(1500, 6)), np.concatenate([np.ones((700, 6)), draw.normal(size=(800, 6))])):
        frame = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, leaf int, part string").repartition(4)
        told = {q: brute_force(dict(enumerate(vectors)), [q], 10)[q] for q in range(0, 1500, 100)}
        found = {}
        for r in ann.nearest(frame, F.col("vec_id") % 100 == 0, recall=1.0).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hits = sum(len({m[1] for m in found[q]} & {key for _, key in told[q]}) for q in told)
        assert hits >= 0.97 * 10 * len(told)
        off = [sorted(found[q])[0][2] - told[q][0][0] for q in told]
        assert min(off) > -1e-9 and sum(x < 1e-9 for x in off) >= 0.9 * len(told)


def test_many_languages_are_all_learned_and_too_many_refused(spark, monkeypatch):
    words = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"]
    rows = [(i, f"{words[i % 8]} " * 5 + f"{i}", f"l{i % 8}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.train(docs, sample_rows=4).languages == [f"l{i}" for i in range(8)]
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 7)
    with pytest.raises(ValueError):
        language_id.train(docs)
