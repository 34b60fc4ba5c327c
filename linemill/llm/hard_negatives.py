"""Hard negatives of anchor rows, found exactly with bounds along a spanning tree of the anchors.

A score is the inner product of integer vectors. Anchors are taken in groups of
bounded size; a group's anchors are joined by a minimum spanning tree. Each
task walks the tree over chunks of its own candidates: with s the score at the
parent and d the length of the edge, the score at the child lies within
s - d * |candidate| and s + d * |candidate|. Only candidates whose range meets
what the child still looks for are scored again; the others keep their range,
which the next edge widens. One walk finds each anchor's positives, the best
rows of its own label; a second one the best rows of other labels in the window
below each positive. Candidates are never shuffled: a group of anchors is
broadcast (at most GROUP_ANCHORS rows and GROUP_BYTES), and a task gives back what it holds for
each anchor at its end.

Defined results: rows without a key, label or vector, or with a component that
is null or not finite, take no part. Only rows of vectors of equal length meet.
Rows of the anchor's own key are no candidates. Repeated rows of other keys
count each; an anchor that repeats with label and vector gives its results
once. Ties go to the smaller key. Windows of a negative positive score are
empty. An empty table gives no rows; other columns of the frame, whatever their
names, are left out. Scores beyond 64 bits raise OverflowError.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linemill.llm._common import fresh_dir
from linemill.operators.order import number_lines

#: Anchors that are broadcast together, at most, and the bytes of their vectors.
GROUP_ANCHORS, GROUP_BYTES = 8_192, 32 << 20
#: Candidates that walk the tree together.
CHUNK_ROWS = 4_096
#: Candidates of a task, where there are enough for every core.
TASK_ROWS = 200_000
#: Products of integers below this are exact in double precision.
EXACT = float(1 << 53)


@dataclass
class Tree:
    """Anchors of one vector length in the order of the walk, each after its parent.

    vectors are whole numbers as doubles. A node's heaviest child comes last, so
    a walk holds the ranges of few nodes at a time. most is the largest magnitude.
    """

    number: np.ndarray
    key: np.ndarray
    label: list[str]
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    last: np.ndarray  # whether the node is its parent's last child
    leaf: np.ndarray
    most: float = field(init=False)

    def __post_init__(self):
        self.most = float(np.abs(self.vectors).max(initial=0))


def products(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers, exactly: in double precision if sums stay below 2**53, else with big integers."""
    if most * float(np.abs(x).max(initial=0)) * x.shape[1] < EXACT:
        return x @ y
    return np.vectorize(int, otypes=[object])(x) @ np.vectorize(int, otypes=[object])(y) if x.size and y.size else np.zeros(len(x), object)


def spanning_tree(number: np.ndarray, key: np.ndarray, label: list[str], vectors: np.ndarray) -> Tree:
    """Prim's tree from the anchor of least norm, listed so that every heaviest child comes last."""
    n = len(key)
    squares = (vectors**2).sum(axis=1)
    parent, gap, open_ = np.full(n, -1), np.full(n, inf), np.ones(n, bool)
    joined, now = [], int(np.argmin(squares))
    for _ in range(n):
        joined.append(now)
        open_[now] = False
        near = squares + squares[now] - 2 * (vectors @ vectors[now])
        closer = open_ & (near < gap)
        gap[closer], parent[closer] = near[closer], now
        now = int(np.argmin(np.where(open_, gap, inf)))
    weight = np.ones(n, np.int64)
    for node in reversed(joined):
        if parent[node] >= 0:
            weight[parent[node]] += weight[node]
    children: list[list[int]] = [[] for _ in range(n)]
    for node in joined[1:]:
        children[parent[node]].append(node)
    order, stack = [], [joined[0]]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += sorted(children[node], key=lambda c: -weight[c])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at = np.array(order)
    up = np.where(parent[at] >= 0, place[parent[at]], -1)
    last = np.zeros(n, bool)
    last[list({int(p): i for i, p in enumerate(up)}.values())] = True
    # Slightly long edges, so that rounding can't make a bound too tight.
    edge = np.array([np.sqrt(((vectors[i] - vectors[parent[i]]) ** 2).sum()) if parent[i] >= 0 else 0.0 for i in order]) * (1 + 1e-9)
    return Tree(number[at], key[at], [label[i] for i in order], vectors[at], up, edge, last, np.array([not children[i] for i in order]))


def _under(score: int) -> float:
    """A double that is not above the score."""
    return float(score) - (abs(float(score)) * 2.0**-50 if abs(score) >= EXACT else 0.0)


def _nothing() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


class Positives:
    """For each anchor the best rows of its label."""

    same = True

    def __init__(self, tree: Tree, k: int):
        self._k = k
        self.held = [_nothing() for _ in tree.key]
        self.low, self.high = np.full(len(tree.key), -inf), np.full(len(tree.key), inf)

    def meet(self, a: int, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.concatenate([self.held[a][0], score]), np.concatenate([self.held[a][1], key])
        best = np.lexsort((key, -score))[: self._k]
        self.held[a] = score[best], key[best]
        if len(best) == self._k:
            self.low[a] = max(self.low[a], _under(int(score[best[-1]])))


class Negatives:
    """For each anchor the best rows of other labels in the window below each of its positives."""

    same = False

    def __init__(self, tree: Tree, k: int, windows: dict[int, list[tuple[int, int]]]):
        self._k = k
        self._windows = [[w for w in windows.get(int(n), []) if w[0] <= w[1]] for n in tree.number]
        self._low = [[_under(w[0]) for w in own] for own in self._windows]
        self.held = [_nothing() for _ in tree.key]
        self.low = np.array([min(low, default=inf) for low in self._low])
        self.high = np.array([max((-_under(-w[1]) for w in own), default=-inf) for own in self._windows])

    def meet(self, a: int, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.concatenate([self.held[a][0], score]), np.concatenate([self.held[a][1], key])
        order = np.lexsort((key, -score))
        score, key = score[order], key[order]
        keep = np.zeros(len(score), bool)
        for i, (low, high) in enumerate(self._windows[a]):
            inside = np.flatnonzero((score >= low) & (score <= high))[: self._k]
            keep[inside] = True
            if len(inside) == self._k:
                self._low[a][i] = max(self._low[a][i], _under(int(score[inside[-1]])))
        self.held[a] = score[keep], key[keep]
        self.low[a] = min(self._low[a])


def walk(tree: Tree, key: np.ndarray, label: np.ndarray, x: np.ndarray, wanted: Positives | Negatives) -> int:
    """Take a chunk of candidates through the tree; returns how many scores were computed."""
    norm = np.sqrt((x**2).sum(axis=1)) * (1 + 1e-9)
    codes, label = np.unique(label, return_inverse=True)
    code = {one: i for i, one in enumerate(codes.tolist())}
    ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for a in range(len(tree.key)):
        up = tree.parent[a]
        if up < 0:
            low = high = None
            at = np.arange(len(key))
        else:
            low, high = ranges.pop(up) if tree.last[a] else ranges[up]
            reach = tree.edge[a] * norm
            low, high = low - reach, high + reach
            meets = (high >= wanted.low[a]) & (low <= wanted.high[a])
            own = label == code.get(tree.label[a], -1)
            at = np.flatnonzero(meets & (own if wanted.same else ~own))
            if 3 * len(at) > len(key):
                at = np.arange(len(key))
        found = products(x if len(at) == len(key) else x[at], tree.vectors[a], tree.most)
        scored += len(at)
        if not tree.leaf[a]:
            exact = found.astype(np.float64)
            # Beyond 2**53 a double is only near the score.
            slack = np.abs(exact) * 2.0**-50 if found.dtype == object else 0.0
            if len(at) == len(key):
                low, high = exact - slack, exact + slack
            else:
                low[at], high[at] = exact - slack, exact + slack
            ranges[a] = low, high
        own = label[at] == code.get(tree.label[a], -1)
        fits = (own if wanted.same else ~own) & (key[at] != tree.key[a]) & (found >= wanted.low[a]) & (found <= wanted.high[a])
        if fits.any():
            wanted.meet(a, found[fits].astype(np.int64), key[at][fits])
    return scored


def _seed(tree: Tree, wanted: Positives | Negatives) -> None:
    """Let the anchors themselves be candidates first, so that thresholds are high from the start; what they hold is forgotten."""
    for at in range(0, len(tree.key), CHUNK_ROWS):
        part = slice(at, at + CHUNK_ROWS)
        walk(tree, tree.key[part], np.array(tree.label[part], object), tree.vectors[part], wanted)
    wanted.held = [_nothing() for _ in tree.key]


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, label, vectors) of the rows of each vector length in a batch of key, label, vector."""
    lists = batch.column(2)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    keys, labels = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield keys[rows], labels[rows], flat[(starts[rows][:, None] + np.arange(dims)).ravel()].reshape(len(rows), dims)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The group's anchors (key, label, vector, number) as one pickled list of trees, one for each vector length."""
    batches = [b for b in batches if b.num_rows]
    rows: dict[int, list[tuple[int, int, str, list[int]]]] = {}
    for batch in batches:
        for key, label, vector, number in zip(*(batch.column(i).to_pylist() for i in range(4))):
            rows.setdefault(len(vector), []).append((number, key, label, vector))
    trees = []
    for dims, held in sorted(rows.items()):
        held.sort()
        trees.append(spanning_tree(np.array([r[0] for r in held]), np.array([r[1] for r in held], np.int64), [r[2] for r in held], np.array([r[3] for r in held], np.float64).reshape(len(held), dims)))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], names=["forest"])


def _usable(df: DataFrame, is_anchor: Column, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """(key, label, vector, anchor): whole-number vectors of the rows that take part."""
    x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(inf)))
    there = F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull()
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return df.where(there & fine).select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("string").alias("label"), whole.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))


def _walked(candidates: DataFrame, sent, kind: str, k: int) -> DataFrame:
    """(number, candidate, score) of what the tasks hold for the anchors; sent holds the forest and the windows."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, windows = sent.value
        wanted = {}
        for tree in pickle.loads(forest):
            held = Positives(tree, k) if kind == "positives" else Negatives(tree, k, windows)
            _seed(tree, held)
            wanted[tree.vectors.shape[1]] = tree, held
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                for key, label, x in _matrices(batch.slice(at, CHUNK_ROWS)):
                    if x.shape[1] in wanted:
                        tree, held = wanted[x.shape[1]]
                        walk(tree, key, label, x, held)
        for tree, held in wanted.values():
            number = np.repeat(tree.number, [len(h[0]) for h in held.held])
            score, candidate = (np.concatenate([h[i] for h in held.held]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(candidate), pa.array(score)], names=["number", "candidate", "score"])

    return candidates.select("key", "label", "vector").mapInArrow(walked, "number long, candidate long, score long")


def _ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "candidate"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def window(positive: int, low: int = 80, high: int = 100) -> tuple[int, int]:
    """The whole scores s of low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all rows that is_anchor marks.

    Components are scaled and rounded down to whole numbers. A positive is one
    of the best rows of the anchor's label; its negatives are the best rows of
    other labels whose score is between low and high percent of its own.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    folder = fresh_dir(spark, "hard-negatives")
    _usable(df, is_anchor, key, label, vector, scale).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    total = rows.count()
    tasks = max(1, spark.sparkContext.defaultParallelism, total // TASK_ROWS)
    candidates = rows.coalesce(tasks)
    anchors = rows.where("anchor").select("key", "label", "vector").distinct()
    one = anchors.orderBy("key", "vector", "label").first()
    if one is None:
        return spark.createDataFrame([], schema)
    # Anchors of like scores at one of them are taken together, so that edges are short.
    along = F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(v)) for v in one["vector"]]).cast("array<double>"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    numbered = number_lines(anchors.withColumn("along", along), F.size("vector"), "along", "key", "label", "vector", name="number")
    longest = numbered.agg(F.max(F.size("vector"))).first()[0]
    together = max(1, min(group_anchors, GROUP_BYTES // (8 * max(1, longest))))
    held = numbered.select("key", "label", "vector", "number", F.floor((F.col("number") - 1) / together).alias("group"))
    held.write.parquet(f"{folder}/anchors")
    held = spark.read.parquet(f"{folder}/anchors")
    groups = held.agg(F.max("group")).first()[0] + 1
    for g in range(groups):
        own = held.where(F.col("group") == g)
        forest = own.select("key", "label", "vector", "number").coalesce(1).mapInArrow(_forest, "forest binary").first()["forest"]
        sent = spark.sparkContext.broadcast((bytes(forest), {}))
        _ranked(_walked(candidates, sent, "positives", positives), positives, "number").write.parquet(f"{folder}/positives-{g}")
        best = spark.read.parquet(f"{folder}/positives-{g}").select("number", F.col("candidate").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))
        windows: dict[int, list[tuple[int, int]]] = {}
        for r in best.select("number", "positive_score").collect():  # at most group_anchors * positives rows
            windows.setdefault(r["number"], []).append(window(r["positive_score"], low, high))
        sent_windows = spark.sparkContext.broadcast((bytes(forest), windows))
        met = _walked(candidates, sent_windows, "negatives", negatives).join(F.broadcast(best), "number")
        lowest, highest = F.lit(low).cast("decimal(3,0)") * F.col("positive_score"), F.lit(high).cast("decimal(3,0)") * F.col("positive_score")
        inside = met.where((F.col("score") * F.lit(100).cast("decimal(3,0)")).between(lowest, highest))
        found = _ranked(inside, negatives, "number", "place").join(F.broadcast(own.select("number", F.col("key").alias("anchor_id"))), "number")
        found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("candidate").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(f"{folder}/found")
        sent.unpersist()
        sent_windows.unpersist()
    return spark.read.schema(schema).parquet(f"{folder}/found")
