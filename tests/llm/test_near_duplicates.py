"""MinHash near-duplicates against brute force, and the cases that data can hold."""

import pathlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linemill.llm import minhash, shingles
from linemill.llm._common import cut_lineage, with_groups
from linemill.llm.components import components


def word_set(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[i:] for i in range(size)]))


def brute_force(rows, size):
    """component of each key, by comparing all pairs."""
    sets = {k: word_set(t, size) for k, t in rows}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in keys}, {k: len(s) for k, s in sets.items()}


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(30, 120))]
        texts.append(" ".join(base))
        for _ in range(draw.randrange(4)):
            changed = list(base)
            for _ in range(draw.randrange(1, 7)):
                changed[draw.randrange(len(changed))] = draw.choice(vocabulary)
            texts.append(" \t".join(changed).upper())
    base = [draw.choice(vocabulary) for _ in range(80)]
    for i in range(60):  # one large group of near copies, some of them too far from all others
        changed = list(base)
        for _ in range(draw.randrange(0, 9)):
            changed[draw.randrange(80)] = f"x{draw.randrange(1000)}"
        texts.append(" ".join(changed))
    texts += [texts[0]] * 30 + ["", None, "  ", "one", "ONE", "one two", "é É", "é É"]
    return list(enumerate(texts, start=5))


@pytest.mark.parametrize("size", [2, 5])
def test_same_as_brute_force(spark, size):
    rows = corpus()
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, id string").repartition(5)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(frame, words=size).collect()}
    component, sizes = brute_force(rows, size)
    assert {k: r["component_id"] for k, r in found.items()} == component
    assert {k: r["n_shingles"] for k, r in found.items()} == sizes
    assert all(r["kept"] == (k == r["component_id"]) for k, r in found.items())


def test_odd_keys(spark):
    text = "a b c d e f g"
    rows = [(None, text), (3, text), (3, text), (7, text), (7, "other words of this one"), (9, "other words of this one"), (None, None)]
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()), key=str)
    assert found == sorted([(None, None, True)] * 2 + [(3, 3, True)] * 2 + [(7, 3, False)] * 2 + [(9, 3, False)], key=str)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_and_short_keys():
    long = " ".join(f"w{i % 30011}" for i in range(120_000)).encode()
    found = shingles.shingle_set(long, 2)
    assert len(found) == 30011 and (np.diff(found.astype(object)) > 0).all()
    factors = minhash._multipliers(12)
    whole, other = minhash.short_keys(found, 3, factors), minhash.short_keys(found[::-1].copy(), 3, factors)
    assert (whole == other).all() and len(set(whole.tolist())) == 4


def test_blocks_find_the_pairs():
    draw = np.random.default_rng(0)
    base = draw.integers(0, 2**60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i:], draw.integers(0, 2**60, i, dtype=np.uint64)])) for i in range(0, 40, 4)]
    ids = np.arange(len(sets))
    block = (ids, ids, sets)
    expected = {(a, b) for a in ids for b in ids if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert set(minhash._linked_in_blocks(block, block, 80)) == expected


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(1000, 1001)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, n)}, 1001: 1000}


def test_large_groups_meet_their_rows_like_small_ones(spark):
    rows = [(i % 3 if i < 30 else i, i) for i in range(40)] + [(None, 99)]
    groups = [(0, 10, 7), (1, 10, 8), (30, 1, 9)]
    frame, small = spark.createDataFrame(rows, "x long, y long"), spark.createDataFrame(groups, "x long, n long, z long")
    found = with_groups(frame, small, "x", "n", 21, many=5)
    expected = [(x, y, n, z) for x, y in rows for g, n, z in groups if x == g]
    assert sorted(tuple(r) for r in found.select("x", "y", "n", "z").collect()) == sorted(expected)
    assert with_groups(frame, small.where("false"), "x", "n", 0).count() == 0


def test_small_blocks_find_the_same(spark, monkeypatch):
    """Blocks bound by bytes, down to about one set each, lose no link."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1_500)
    rows = corpus(7)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, words=2).collect()}
    assert found == brute_force(rows, 2)[0]


def test_a_key_of_many_texts_and_a_text_of_many_keys(spark):
    """Such keys and texts meet their rows by a broadcast; all their classes are one component."""
    rows = [(5, f"only words of text {i} a{i} b{i} c{i}") for i in range(1_100)] + [(i, "shared text of all of these") for i in range(5, 1_105)]
    rows += [(2_000, "only words of text 7 a7 b7 c7"), (2_001, "something else that nobody has")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).select("doc_id", "component_id").distinct().collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {**{i: 5 for i in range(5, 1_105)}, 2_000: 5, 2_001: 2_001}


def test_cut_lineage_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    counts = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = cut_lineage(counts)
    assert spark.conf.get(name, None) == before
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in counts.collect())
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    counted = lambda: sum(len(list(pathlib.Path(d).glob("*/shuffle_*"))) for d in folders)
    held = counted()
    cut_lineage(counts.where("count > 1"))
    until = time.time() + 10
    while counted() > held and time.time() < until:
        time.sleep(0.1)
    assert counted() <= held
