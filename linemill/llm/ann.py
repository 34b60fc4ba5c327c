"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is put into a leaf. A query
goes down the tree best-bin-first: a priority queue holds the branches seen so
far by the distance of their centres, and the nearest is opened next. How many
rows' worth of leaves a query visits is calibrated: for a bounded set of rows
as probes, their true neighbours among all rows are found in blocks, and visits
are widened until the wanted recall is reached on them. However small that is,
a query goes on until its leaves hold as many rows of other keys as it wants.
Distances of visited rows are exact, in double precision.

Leaves are cut into chunks of bounded size, and a large leaf's chunks are dealt
to several parts that each meet its queries, so a leaf that holds a third of all
rows (equal vectors) is many tasks' work; queries meet a chunk in blocks.

Defined results: null vectors, vectors of another length than the index, zero
vectors and those with null or non-finite components take no part, neither as
queries nor as candidates. Equal distances go to the smaller key. Fewer
candidates than neighbours give fewer rows. Rows of an equal key are all
candidates, but never of a query of that key; null keys take no part. Columns
of other names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linemill.llm._common import broadcast_up_to, cut_lineage

#: Rows of the sample that the tree is fitted on, rows that a leaf should hold, and children of a node.
SAMPLE_ROWS, LEAF_ROWS, BRANCHES = 20_000, 256, 8
#: Most leaves: bounds the broadcast tree.
MOST_LEAVES = 16_384
#: Probes of the calibration, the recall it widens to, and rows of a chunk.
PROBES, RECALL, CHUNK_ROWS = 128, 0.95, 4_096
#: Rows of a leaf that meet its queries in one part; a larger leaf's chunks are dealt to several, each with all queries.
PART_ROWS = 32_768
#: Queries that meet a chunk at once.
QUERY_BLOCK = 128
#: Partial results that a task holds and thins to the nearest of each query.
HELD_ROWS = 400_000


class Tree(NamedTuple):
    """Nodes of a k-means tree. Children of node i are first[i] .. first[i] + count[i]; a leaf has none.

    The root's centre is the sample's mean; the other centres are told from it,
    so that vectors far from the origin are compared as well as those around it.
    """

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def leaves(self) -> int:
        return int((self.count == 0).sum())

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into, nearest centre by nearest centre."""
        vectors = vectors - self.centres[0]
        at = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(self.count[at] > 0)
            if not len(inner):
                return at
            for node in np.unique(at[inner]):
                mine = inner[at[inner] == node]
                children = self.centres[self.first[node] : self.first[node] + self.count[node]]
                at[mine] = self.first[node] + _squared(vectors[mine], children).argmin(axis=1)

    def best_bins(self, vector: np.ndarray, rows: np.ndarray, budget: float, least: float = 0.0) -> list[int]:
        """Leaves in the order of a best-bin-first walk, until they hold so many rows, and at least `least`."""
        vector = vector - self.centres[0]
        queue: list[tuple[float, int]] = [(0.0, 0)]
        found: list[int] = []
        held = 0.0
        while queue and held < max(budget, least):
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                if rows[node]:
                    found.append(node)
                    held += rows[node]
                continue
            first, count = self.first[node], self.count[node]
            for at, far in enumerate(_squared(vector[None], self.centres[first : first + count])[0].tolist()):
                heapq.heappush(queue, (far, int(first + at)))
        return found


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T), 0.0)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    place = None
    for _ in range(rounds):
        new = _squared(x, centres).argmin(axis=1)
        if place is not None and (new == place).all():
            break
        place = new
        for c in range(k):
            if (mine := place == c).any():
                centres[c] = x[mine].mean(axis=0)
    return centres, place


def grow(sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 3) -> Tree:
    """A tree of about so many leaves; the fullest node is split next."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1] if sample.ndim == 2 and len(sample) else 1
    mean = sample.mean(axis=0) if dims > 1 or len(sample) else np.zeros(dims)
    sample = sample - mean if len(sample) else sample
    centres, first, count = [mean], [0], [0]
    parts: list[tuple[int, int, np.ndarray]] = [(-len(sample), 0, np.arange(len(sample)))] if len(sample) else []
    have = 1
    while parts and have < leaves:
        size, node, rows = heapq.heappop(parts)
        distinct = np.unique(sample[rows[: 4 * branches]], axis=0)
        if -size < 2 * branches or (len(distinct) < 2 and (sample[rows] == sample[rows[0]]).all()):
            continue
        k = min(branches, len(rows))
        found, place = _k_means(sample[rows], k, rng)
        used = [c for c in range(k) if (place == c).any()]
        if len(used) < 2:
            continue
        first[node], count[node] = len(centres), len(used)
        for c in used:
            heapq.heappush(parts, (-int((place == c).sum()), len(centres), rows[place == c]))
            centres.append(found[c])
            first.append(0)
            count.append(0)
        have += len(used) - 1
    return Tree(np.array(centres), np.array(first), np.array(count))


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of rows with a key and a finite vector that is not zero, as doubles."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("key").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _nearest(queries: np.ndarray, query_keys: np.ndarray, rows: np.ndarray, row_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k nearest rows of another key: query index, row index, distance."""
    mean = rows.mean(axis=0) if len(rows) else 0.0
    x, y = queries - mean, rows - mean
    rough = _squared(x, y)
    # What rounding can add to or take from a rough squared distance.
    slack = 1e-13 * rows.shape[1] ** 0.5 * ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None])
    rough[query_keys[:, None] == row_keys[None]] = np.inf
    at_q, at_r = [], []
    for i in range(len(queries)):
        line = rough[i]
        if len(line) > k:
            # Rounding of the rough distance must not decide, nor may ties be lost.
            edge = np.partition(line + slack[i], k - 1)[k - 1]
            near = np.flatnonzero((line - slack[i] <= edge) & (line < np.inf))
        else:
            near = np.flatnonzero(line < np.inf)
        exact = np.sqrt(((rows[near] - queries[i]) ** 2).sum(axis=1))
        order = np.lexsort((row_keys[near], exact))[:k]
        at_q.append(np.full(len(order), i))
        at_r.append(near[order])
    q, r = np.concatenate(at_q), np.concatenate(at_r)
    return q, r, np.sqrt(((rows[r] - queries[q]) ** 2).sum(axis=1))


def _best_of(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of partial results (query, row, distance) the k nearest of each query."""
    q, v, far = (np.concatenate(parts) for parts in zip(*held))
    order = np.lexsort((v, far, q))
    q, v, far = q[order], v[order], far[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[place < k], v[place < k], far[place < k]


def _found_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with their rank; tasks keep k of each query before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _parts(rows: np.ndarray) -> np.ndarray:
    """Into how many parts each leaf's chunks are dealt."""
    return np.maximum(1, -(-rows // PART_ROWS))


def _chunks(placed: DataFrame, dims: int, chunk_rows: int, sizes) -> DataFrame:
    """(leaf, part, keys, vectors) of at most chunk_rows rows of a leaf; rows of a task stay in their task."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, parts = TaskContext.get().partitionId(), _parts(sizes.value)
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            keys, x = batch.column(1).to_numpy(), _matrix(batch.column(2), dims)
            order = np.argsort(leaf, kind="stable")
            edges = np.flatnonzero(np.diff(leaf[order])) + 1
            out = [part[at : at + chunk_rows] for part in np.split(order, edges) for at in range(0, len(part), chunk_rows)]
            leaves = [int(leaf[p[0]]) for p in out]
            salts = [(turn + i) % int(parts[one]) for i, one in enumerate(leaves)]
            turn += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(salts, pa.int64()), pa.array([keys[p].tobytes() for p in out], pa.binary()), pa.array([x[p].tobytes() for p in out], pa.binary())], names=["leaf", "part", "keys", "vectors"])

    return placed.select("leaf", "key", "vector").mapInArrow(gather, "leaf long, part long, keys binary, vectors binary")


def nearest(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found rows of every row that is_query marks.

    is_query is a condition on df's columns. The length of vectors is that of
    the most rows.
    """
    marked = df.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    usable = cut_lineage(_usable(marked, key, vector).select("key", "vector"))
    lengths = usable.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims, total = lengths["dims"], lengths["count"]
    usable = usable.where(F.size("vector") == dims)
    queries = _usable(marked.where("__query"), key, vector).where(F.size("vector") == dims)

    draw = F.pmod(F.xxhash64(F.lit("tree"), "key"), F.lit(1 << 30))
    share = min(1.0, 1.2 * sample_rows / total)
    sample = np.array([r["vector"] for r in usable.where(draw < int(share * (1 << 30))).orderBy(draw, "key").select("vector").limit(sample_rows).toLocalIterator()], np.float64).reshape(-1, dims)
    tree = grow(sample, min(MOST_LEAVES, max(1, total // leaf_rows)))
    sent = spark.sparkContext.broadcast(tuple(tree))

    @F.pandas_udf("long")
    def leaf_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Tree(*sent.value)
        for part in parts:
            yield pd.Series(own.assign(np.stack(part.to_numpy())) if len(part) else np.zeros(0, np.int64))

    placed = cut_lineage(usable.select("key", "vector", leaf_of("vector").alias("leaf")))
    rows = np.zeros(len(tree.count), np.int64)
    for r in placed.groupBy("leaf").count().toLocalIterator():  # at most MOST_LEAVES rows
        rows[r["leaf"]] = r["count"]

    # A query's own key is no candidate, so its rows count on top of the k that its leaves must hold.
    several = cut_lineage(placed.groupBy("key").agg(F.count("*").alias("own")).where("own > 1"))
    queries = queries.join(broadcast_up_to(several, 200_000), "key", "left").select("key", "vector", F.coalesce("own", F.lit(1)).cast("long").alias("own"))
    budget = _calibrated(placed, tree, rows, k, dims, recall)
    sizes = spark.sparkContext.broadcast(rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = Tree(*sent.value), sizes.value
        parts = _parts(held)
        for batch in batches:
            keys, x, own_rows = batch.column(0).to_numpy(), _matrix(batch.column(1), dims), batch.column(2).to_numpy()
            for at in range(0, len(keys), QUERY_BLOCK):
                part = slice(at, at + QUERY_BLOCK)
                visits: dict[int, list[int]] = {}
                for i, one in enumerate(x[part]):
                    for leaf in own.best_bins(one, held, budget, k + own_rows[at + i]):
                        visits.setdefault(leaf, []).append(at + i)
                out = [(leaf, salt, q) for leaf, q in visits.items() for salt in range(int(parts[leaf]))]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([keys[q].tobytes() for _, _, q in out], pa.binary()), pa.array([x[q].tobytes() for _, _, q in out], pa.binary())], names=["leaf", "part", "query_keys", "queries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row_keys, vectors, query_keys, queries_ in zip(*(batch.column(i) for i in range(4))):
                rk, qk = np.frombuffer(row_keys.as_buffer(), np.int64), np.frombuffer(query_keys.as_buffer(), np.int64)
                x, y = np.frombuffer(vectors.as_buffer()).reshape(-1, dims), np.frombuffer(queries_.as_buffer()).reshape(-1, dims)
                q, r, score = _nearest(y, qk, x, rk, k)
                held.append((qk[q], rk[r], score))
                size += len(q)
                if size > HELD_ROWS:
                    held = [_best_of(held, k)]
                    size = len(held[0][0])
                    if size > HELD_ROWS // 2:
                        yield _found_batch(held[0])
                        held, size = [], 0
        if size:
            yield _found_batch(_best_of(held, k))

    routed = queries.mapInArrow(route, "leaf long, part long, query_keys binary, queries binary")
    met = _chunks(placed, dims, CHUNK_ROWS, sizes).join(routed, ["leaf", "part"]).select("keys", "vectors", "query_keys", "queries")
    return _top(met.mapInArrow(meet, "query_id long, vec_id long, score double"), k).select("query_id", "rank", "vec_id", "score")


def _calibrated(placed: DataFrame, tree: Tree, rows: np.ndarray, k: int, dims: int, recall: float, probes: int = PROBES) -> float:
    """Rows' worth of leaves that reach the recall on probes, whose neighbours among all rows are exact."""
    draw = F.xxhash64(F.lit("probe"), "key")
    drawn = placed.orderBy(draw, "key").select("key", "vector").limit(probes).collect()
    keys, x = np.array([r["key"] for r in drawn], np.int64), np.array([r["vector"] for r in drawn], np.float64).reshape(-1, dims)
    sent = placed.sparkSession.sparkContext.broadcast((keys, x))

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe_keys, probe = sent.value
        for batch in batches:
            rk, row, leaf = batch.column(0).to_numpy(), _matrix(batch.column(1), dims), batch.column(2).to_numpy()
            for at in range(0, len(rk), CHUNK_ROWS):
                part = slice(at, at + CHUNK_ROWS)
                q, r, score = _nearest(probe, probe_keys, row[part], rk[part], k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(rk[part][r]), pa.array(leaf[part][r]), pa.array(score)], names=["query_id", "vec_id", "leaf", "score"])

    near = placed.select("key", "vector", "leaf").mapInArrow(against, "query_id long, vec_id long, leaf long, score double")
    leaves: dict[int, list[int]] = {}
    for r in _top(near, k).select("query_id", "leaf").collect():  # probes * k rows
        leaves.setdefault(r["query_id"], []).append(r["leaf"])
    need: list[float] = []  # rows visited when each true neighbour's leaf is reached
    for probe, found in leaves.items():
        order = tree.best_bins(x[probe], rows, float("inf"))
        before = dict(zip(order, np.concatenate([[0], np.cumsum(rows[order])[:-1]])))
        need += [float(before[leaf]) for leaf in found]
    if not need:
        return float(rows.sum())
    need.sort()
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] + 1.0
