"""Hard negatives against brute force over all pairs, and the bounds of the tree."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linemill.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, low=80, high=100, k=5):
    """All results by plain loops over whole numbers."""
    held = [(i, label, [int(np.floor(256.0 * x)) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for anchor, label, v in sorted({(i, label, tuple(v)) for i, label, v in held if i % 100 == 0}):
        scored = [(sum(a * b for a, b in zip(v, w)), i, other) for i, other, w in held if i != anchor and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p][:k]
            out += [(anchor, positive, n + 1, i, p, s) for n, (s, i, _) in enumerate(fits)]
    return Counter(out)


def mined(spark, rows, **kw):
    found = hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0, **kw)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("group", [8192, 3])
def test_given_table(spark, sf_dir, group):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = mined(spark, rows, group_anchors=group)
    assert found == brute(rows) and found


def test_clusters_ties_and_copies(spark):
    """Near rows, so that bounds decide; whole groups of equal vectors; a common one."""
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 3, (6, 5))
    rows = []
    for i in range(900):
        x = centres[i % 6] + draw.normal(0, 0.01 if i % 2 else 0, 5)
        rows.append((i, [float(v) for v in (centres[0] if i % 3 == 0 else x)], int(draw.integers(0, 4))))
    assert mined(spark, rows, group_anchors=4) == brute(rows) == mined(spark, rows)


def test_odd_rows(spark):
    """Nulls, repeated rows, keys with several vectors, other lengths, empty vectors, huge components, one label only."""
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [3.0, 0.0], 2), (1, [1.0, 1.9], 1), (1, [1.0, 1.9], 1), (2, [0.9, 1.8], 2), (3, [1.0, None], 1), (4, None, 1), (5, [1.0, float("nan")], 2),
        (6, [float("inf"), 1.0], 2), (None, [1.0, 2.0], 1), (7, [1.0, 2.0], None), (8, [1.0], 2), (9, [], 1), (100, [], 1), (101, [], 2), (200, [1.0], 1), (201, [1.0], 1), (202, [0.95], 3),
        (300, [1e8, 1.0], 5), (301, [1e6, 3.0], 5), (302, [1e6, 2.0], 6), (303, [9.99e5, 2.0], 6), (400, [-1.0, 0.0], 7), (401, [1.0, 0.5], 7), (402, [0.9, 0.0], 8),
    ]
    found = mined(spark, rows)
    assert found == Counter(brute(rows)) and any(k[0] == 300 for k in found) and (200, 201, 1, 8, 65536, 65536) in found
    assert mined(spark, []) == Counter() and mined(spark, [(1, [1.0], 1)]) == Counter()
    named = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [1.0], 1, "y"), (2, [0.9], 2, "z")], SCHEMA + ", score string").withColumn("key", F.lit(1)).withColumn("anchor", F.lit(True))
    assert hn.mine(named, F.col("vec_id") % 100 == 0).count() == 1


def test_bounds_save_scores():
    """In tight clusters far fewer scores are computed than there are pairs, and nothing is lost."""
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 2000, (20, 8)).round()
    anchors = (centres[np.arange(200) % 20] + draw.integers(-2, 3, (200, 8))).astype(float)
    labels = ["a" if i % 2 else "b" for i in range(200)]
    tree = hn.spanning_tree(np.arange(200), np.arange(200) * 100, labels, anchors)
    x = (centres[np.arange(4000) % 20] + draw.integers(-3, 4, (4000, 8))).astype(float)
    keys, own = np.arange(4000) * 100 + 1, np.array(["a" if i % 3 else "b" for i in range(4000)], object)
    wanted = hn.Positives(tree, 5)
    hn._seed(tree, wanted)
    scored = hn.walk(tree, keys[:2000], own[:2000], x[:2000], wanted) + hn.walk(tree, keys[2000:], own[2000:], x[2000:], wanted)
    assert scored < 0.3 * 200 * 4000
    for a in range(200):
        score = x @ tree.vectors[a]
        same = np.flatnonzero(own == tree.label[a])
        best = same[np.lexsort((keys[same], -score[same]))][:5]
        assert wanted.held[a][1].tolist() == keys[best].tolist() and wanted.held[a][0].tolist() == score[best].tolist()


def test_walk_holds_few_ranges():
    """A tree is a permutation of its anchors, each after its parent."""
    vectors = np.random.default_rng(1).normal(0, 9, (300, 3)).round()
    tree = hn.spanning_tree(np.arange(300), np.arange(300), ["x"] * 300, vectors)
    assert sorted(tree.number.tolist()) == list(range(300)) and all(p < i for i, p in enumerate(tree.parent)) and (tree.parent < 0).sum() == 1
    open_, most = set(), 0
    for i, p in enumerate(tree.parent):
        if p >= 0:
            assert p in open_
            if tree.last[i]:
                open_.discard(p)
        if not tree.leaf[i]:
            open_.add(i)
        most = max(most, len(open_))
    assert not open_ and most <= 10
