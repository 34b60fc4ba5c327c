"""The manifest against a plain tree, its growth, and both new SQL twins."""

import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from linemill.llm import merkle, queries, twins

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """Root, and each node's siblings on its way up, by lists."""
    ways, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[a : a + 16], below[a : a + 16]) for a in range(0, len(nodes), 16)]
        for run, held in runs:
            for k, own in enumerate(held):
                for i in own:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        nodes, below = [h(*run) for run, _ in runs], [sum(held, []) for _, held in runs]
    return nodes[0], ways


def plain(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: plain_tree([leaf(r) for r in groups[s]]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    out = Counter()
    for s, up in zip(order, above):
        for r, way in zip(groups[s], trees[s][1]):
            now = leaf(tampered(r))
            for a, b in way + up:
                now = h(a, now, b)
            out[r[0], leaf(r), trees[s][0], root, h(*(a + b for a, b in way + up)), now, now == root] += 1
    return out


def lowered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 5 or row[4] is None:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


def digested(docs):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = merkle.leaf_digest(*fields, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return docs.withColumns({"leaf": merkle.leaf_digest(*fields, F.col("text")), "claim": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, low)})


def rows_of(found):
    return Counter(tuple(r) for r in found.select(*COLUMNS).collect())


def test_sizes_ties_nulls_and_a_hot_source(spark):
    """Sources of 1, 16, 17, 255 to 257 and 4,500 rows, many small ones and none; equal keys, repeated rows, null fields."""
    rows = [(i, f"n{n}", "en", i, f"Text {i}") for n in (1, 16, 17, 255, 256, 257) for i in range(n)]
    rows += [(i % 7 if i % 3 else None, f"s{i % 301}" if i % 4 else None, None, i % 5, "Ab é" if i % 5 else None) for i in range(1_500)]
    rows += [(i, "hot", None, None, "X" * (i % 3)) for i in range(4_500)] + [(4, "é", "", 1, "")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = rows_of(merkle.manifest(digested(docs), claim="claim"))
    assert found == plain(rows, lowered)
    assert any(not r[-1] for r in found) and all(r[-1] == (r[5] == r[3]) for r in found)


def test_growth_equals_a_new_manifest(spark):
    rows = [(i, f"s{i % 4}" if i % 4 else None, "en", i, f"Text {i}") for i in range(3_000)] + [(i, "late", None, i, None) for i in range(2_500, 3_000)]
    docs = digested(spark.createDataFrame(rows, SCHEMA))
    kept = merkle.Manifest(spark)
    for low, high in ((0, 10), (10, 1_030), (1_030, 1_031), (1_031, 3_000)):
        kept.append(docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)), claim="claim")
    assert rows_of(kept.proofs()) == plain(rows, lowered)
    with pytest.raises(ValueError):
        kept.append(docs.where("doc_id = 77"), claim="claim")


def test_empty_and_clashing_columns(spark):
    docs = digested(spark.createDataFrame([], SCHEMA))
    assert rows_of(merkle.manifest(docs)) == Counter()
    one = digested(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).withColumns({"root": F.lit("old"), "pos": F.lit(9), "id": F.lit("mine"), "witness": F.lit(1.5)})
    found = merkle.manifest(one)
    assert [found.first()[c] for c in ("pos", "id", "witness", "verified")] == [9, "mine", 1.5, True] and found.columns.count("root") == 1
    assert found.first()["root"] == found.first()["leaf"] == leaf((1, None, None, None, None)) and found.first()["proof_sha256"] == h()


def test_witnesses_grow_as_siblings_come():
    tree = merkle.Appender()
    for i in range(20):
        tree.append(f"{i}".encode())
        assert len(tree.witness[0]) == (1 if i >= 15 else 0)
    assert len(tree.witness[19]) == 0
    root = tree.close()
    for i, way in enumerate(tree.witness):
        now = f"{i}".encode()
        for a, b in way:
            now = merkle.digest([a, now, b])
        assert now == root


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_merkle_manifest"])
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    told = con.execute({"op11_hard_negatives": twins.HARD_NEGATIVES, "op13_merkle_manifest": twins.MERKLE}[name])
    names = [d[0] for d in told.description]
    found = queries.queries()[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(names)
    assert Counter(tuple(r) for r in found.select(*names).collect()) == Counter(told.fetchall())
