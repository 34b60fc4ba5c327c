"""Places, runs and running sums over rows in order, for groups of any size.

Rows are range-partitioned by group and order, so a group of any share of all
rows is spread over as many tasks as its rows need. Each task passes once over
its sorted rows, batch by batch, and leaves one row for its edges: the first
and last group and the rows of each at either end. These rows, one for each
partition, are merged in order on the driver, and a second pass starts from
what came before. No step joins rows or gathers a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one value that are numbered in one piece.
CHUNK = 10_000

Batches = Iterator[pa.RecordBatch]


def ranged(rows: DataFrame, *order: Column | str, numbered: bool = False, added: dict[str, Column] | None = None) -> DataFrame:
    """The rows in sorted range partitions, materialised, with the partition's number in __part.

    Numbered rows also have their place in __at, in the low 33 bits of a long.
    Added columns are computed once the rows lie there: what is before is
    computed twice, for a sample and to be dealt.

    Rows that are equal by the order, however many, are dealt by a hash of all
    their columns. Materialised, since no row may move between two passes.
    Raises ValueError for a stream, whose rows have no fixed order.
    """
    from linemill.plans.storage import materialised

    if rows.isStreaming:
        raise ValueError("an operator that depends on line order needs a batch frame")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    whole = [*order, F.xxhash64(*hashed)] if hashed else [*order]
    dealt = rows.repartitionByRange(parts, *whole).sortWithinPartitions(*whole).withColumns(added or {}).withColumn("__part", F.spark_partition_id())
    return materialised(dealt.withColumn("__at", F.monotonically_increasing_id()) if numbered else dealt)


def _differs(columns: list[pa.Array], before: list[pa.Array] | None) -> np.ndarray:
    """Whether each row differs from the one before it, nulls being equal; before holds the last row of the batch before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for at, column in enumerate(columns):
        shifted = pa.concat_arrays([column.slice(0, 1) if before is None else before[at], column.slice(0, n - 1)])
        same = pc.or_(pc.fill_null(pc.equal(column, shifted), False), pc.and_(pc.is_null(column), pc.is_null(shifted)))
        out |= ~same.to_numpy(zero_copy_only=False)
    if before is None:
        out[0] = True
    return out


def _last(columns: list[pa.Array]) -> list[pa.Array]:
    return [pa.array(c.slice(len(c) - 1, 1).to_pylist(), c.type) for c in columns]


def _sides(first: list, last: list[pa.Array]) -> list[pa.Array]:
    """A partition's first and last value, each as a struct of its columns."""
    told = lambda row: {f"c{i}": v for i, v in enumerate(row)}
    own = pa.struct([pa.field(f"c{i}", c.type) for i, c in enumerate(last)])
    return [pa.array([told(row)], own) for row in (first, [c.to_pylist()[0] for c in last])]


class _Edge:
    """What a partition shows to its neighbours: rows, first and last value, and how many rows of these it has at its ends."""

    def __init__(self, part: int, n: int, head: int, tail: int, first, last):
        self.part, self.n, self.head, self.tail, self.first, self.last = part, n, head, tail, first, last


def _edges(held: DataFrame, columns: list[str]) -> list[_Edge]:
    """The edges of all partitions with rows, in order; one row for each partition."""
    value = T.StructType([T.StructField(f"c{i}", held.schema[c].dataType) for i, c in enumerate(columns)])
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in ("part", "n", "head", "tail")], T.StructField("first", value), T.StructField("last", value)])

    def look(batches: Batches) -> Batches:
        part, n, head, tail, first, before, open_ = 0, 0, 0, 0, None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.columns[1:]
            new = _differs(own, before)
            if before is None:
                part, first = batch.column(0)[0].as_py(), [c.slice(0, 1).to_pylist()[0] for c in own]
                new[0] = False
            changes = np.flatnonzero(new)
            if open_:
                head += int(changes[0]) if len(changes) else batch.num_rows
                open_ = not len(changes)
            tail = batch.num_rows - int(changes[-1]) if len(changes) else tail + batch.num_rows
            n, before = n + batch.num_rows, _last(own)
        if n:
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (part, n, head, tail)], *_sides(first, before)], names=schema.names)

    rows = held.select("__part", *[F.col(f"`{c}`") for c in columns]).mapInArrow(look, schema).collect()
    return [_Edge(r["part"], r["n"], r["head"], r["tail"], tuple(r["first"]), tuple(r["last"])) for r in sorted(rows, key=lambda r: r["part"])]


def _passed(held: DataFrame, added: list[T.StructField], step: Callable[[int], Callable[[Batches], Batches]]) -> DataFrame:
    """A pass over each partition: step(part) takes its batches and gives batches of the columns and the added ones."""
    schema = T.StructType([*[f for f in held.schema if f.name != "__part"], *added])

    def walk(batches: Batches) -> Batches:
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:

            def rest() -> Batches:
                yield first
                yield from (b for b in batches if b.num_rows)

            part = first.column(first.num_columns - 1)[0].as_py()
            yield from step(part)(pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]) for b in rest())

    names = [f"`{f.name}`" for f in held.schema if f.name != "__part"]
    return held.select(*names, "__part").mapInArrow(walk, schema)


def _with(batch: pa.RecordBatch, names: list[str], *more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m) for m in more]], names=names)


def with_position(rows: DataFrame, name: str = "pos", group: str | tuple[str, ...] = "src", order: tuple[Column | str, ...] = ("line_no",)) -> DataFrame:
    """A column with each row's place in its group by the order, from 1, gapless.

    A group is of one or several columns' values; a null group is a group. Rows that are equal by the order, but not
    altogether, get their places in an order that a hash of the row fixes.
    """
    groups = [group] if isinstance(group, str) else [*group]
    held = ranged(rows.drop(name), *[F.col(f"`{g}`") for g in groups], *order)
    before: dict[int, int] = {}
    last, count = None, 0
    for e in _edges(held, groups):
        before[e.part] = count if e.first == last else 0
        count, last = (before[e.part] + e.n) if e.head == e.n else e.tail, e.last
    at = [[c for c in held.columns if c != "__part"].index(g) for g in groups]
    names = [*[c for c in held.columns if c != "__part"], name]

    def step(part: int) -> Callable[[Batches], Batches]:
        def place(batches: Batches) -> Batches:
            seen, previous = before[part], None
            for batch in batches:
                own = [batch.column(i) for i in at]
                new = _differs(own, previous)
                if previous is None:
                    new[0] = False
                index = np.arange(batch.num_rows)
                start = np.maximum.accumulate(np.where(new, index, -1))
                places = np.where(start < 0, seen + index + 1, index - start + 1)
                yield _with(batch, names, places)
                seen, previous = int(places[-1]), _last(own)

        return place

    return _passed(held, [T.StructField(name, T.LongType())], step)


def _since(new: np.ndarray, weights: np.ndarray, before: int) -> int:
    """The weights from the last new value on; with none that is new, those before too."""
    changes = np.flatnonzero(new)
    return int(weights[changes[-1] :].sum()) if len(changes) else before + int(weights.sum())


def with_start(rows: DataFrame, weight: Column, name: str = "start", tied: str = "tied", group: str = "src", order: str = "line_no") -> tuple[DataFrame, bool]:
    """Columns with the weights of all rows before each in its group, summed, and whether other rows are equal to it by the order; and whether any are.

    Rows that are equal by the order all have the sum before the first of them.
    A null group is a group, a null place a place. Weights are whole numbers from 0, null being 0.
    """
    held = ranged(rows.drop(name, tied), F.col(f"`{group}`"), F.col(f"`{order}`"), added={"__weight": F.coalesce(weight, F.lit(0)).cast("long")})
    names = [c for c in held.columns if c != "__part"]
    at, weighs = [names.index(group), names.index(order)], names.index("__weight")
    value = T.StructType([T.StructField(f"c{i}", held.schema[c].dataType) for i, c in enumerate((group, order))])
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in ("part", "total", "own", "same", "ties")], T.StructField("first", value), T.StructField("last", value)])

    def look(batches: Batches) -> Batches:
        part, total, own, same, ties, first, before = 0, 0, 0, 0, 0, None, None  # own and same: of the last group, and of the last place
        for batch in batches:
            if not batch.num_rows:
                continue
            place, weights = batch.columns[1:3], batch.column(3).to_numpy()
            new = _differs(place, before)
            if first is None:
                part, first = batch.column(0)[0].as_py(), [c[0].as_py() for c in place]
            own, same = _since(_differs(place[:1], before and before[:1]), weights, own), _since(new, weights, same)
            total, ties, before = total + int(weights.sum()), ties + int((~new).sum()), _last(place)
        if first is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (part, total, own, same, ties)], *_sides(first, before)], names=schema.names)

    seen = held.select("__part", *[F.col(f"`{c}`") for c in (group, order, "__weight")]).mapInArrow(look, schema).collect()  # one row for each partition
    met: dict[int, tuple[bool, bool]] = {}  # whether a partition begins in the group, and at the place, of the row before
    before: dict[int, tuple[int, int]] = {}
    follows: dict[int, bool] = {}
    summed, start, last, last_part, ties = 0, 0, None, None, 0
    for e in sorted(seen, key=lambda e: e["part"]):
        first, part = tuple(e["first"]), e["part"]
        met[part] = last is not None and first[0] == last[0], first == last
        summed = summed if met[part][0] else 0
        start = start if met[part][1] else summed
        before[part] = summed, start
        if last_part is not None:
            follows[last_part] = met[part][1]
        last, last_part, ties = tuple(e["last"]), part, ties + e["ties"] + met[part][1]
        summed = summed + e["total"] if first[0] == last[0] else e["own"]
        start = start if first == last else summed - e["same"]

    def step(part: int) -> Callable[[Batches], Batches]:
        def place(batches: Batches) -> Batches:
            (reached, open_), waiting, previous = before[part], None, None  # waiting: a batch whose last row's neighbour is still to come
            for batch in batches:
                own, weights = [batch.column(i) for i in at], batch.column(weighs).to_numpy()
                changed, new = _differs(own[:1], previous and previous[:1]), _differs(own, previous)
                if previous is None:
                    changed[0], new[0] = not met[part][0], not met[part][1]
                index, sums = np.arange(batch.num_rows), np.cumsum(weights) - weights
                of_group = np.maximum.accumulate(np.where(changed, index, -1))
                sums = np.where(of_group < 0, reached + sums, sums - sums[of_group])
                of_place = np.maximum.accumulate(np.where(new, index, -1))
                starts = np.where(of_place < 0, open_, sums[of_place])
                if waiting is not None:
                    yield told(*waiting, not new[0])
                waiting = batch, starts, ~new
                reached, open_, previous = int(sums[-1] + weights[-1]), int(starts[-1]), _last(own)
            yield told(*waiting, follows.get(part, False))

        def told(batch: pa.RecordBatch, starts: np.ndarray, same: np.ndarray, following: bool) -> pa.RecordBatch:
            return _with(batch, [*names, name, tied], starts, same | np.append(same[1:], following))

        return place

    return _passed(held, [T.StructField(name, T.LongType()), T.StructField(tied, T.BooleanType())], step).drop("__weight"), ties > 0


def _keyed(lines: DataFrame, key: Column | None) -> tuple[DataFrame, list[_Edge]]:
    held = ranged(lines.withColumn("__key", F.col("line") if key is None else key), "src", "line_no")
    return held, _edges(held, ["src", "__key"])


def runs(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """Runs of adjacent lines of a source with equal key: the columns of each run's first line, and its length n."""
    held, edges = _keyed(lines.drop("n"), key)
    goes_on = {b.part: a.last == b.first for a, b in zip(edges, edges[1:])}
    after: dict[int, int] = {}
    for e, following in zip(reversed(edges), [None, *reversed(edges[1:])]):
        met = following is not None and goes_on[following.part]
        after[e.part] = following.head + (after[following.part] if following.head == following.n else 0) if met else 0
    names = [c for c in held.columns if c != "__part"]
    at = [names.index("src"), names.index("__key")]

    def step(part: int) -> Callable[[Batches], Batches]:
        def count(batches: Batches) -> Batches:
            open_, n, previous = None, 0, None  # the first line of the run that may go on, and its length so far
            for batch in batches:
                own = [batch.column(i) for i in at]
                new = _differs(own, previous)
                if previous is None:
                    new[0] = not goes_on.get(part, False)
                starts, previous = np.flatnonzero(new), _last(own)
                if not len(starts):
                    n += batch.num_rows
                    continue
                if open_ is not None:
                    yield _with(open_, [*names, "n"], [n + int(starts[0])])
                if len(starts) > 1:
                    yield _with(batch.take(pa.array(starts[:-1])), [*names, "n"], np.diff(starts))
                open_, n = batch.take(pa.array(starts[-1:])), batch.num_rows - int(starts[-1])
            if open_ is not None:
                yield _with(open_, [*names, "n"], [n + after[part]])

        return count

    return _passed(held, [T.StructField("n", T.LongType())], step).drop("__key")


def repeated(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """All lines of runs of more than one."""
    held, edges = _keyed(lines, key)
    left = {b.part: a.last == b.first for a, b in zip(edges, edges[1:])}
    right = {a.part: a.last == b.first for a, b in zip(edges, edges[1:])}
    names = [c for c in held.columns if c != "__part"]
    at = [names.index("src"), names.index("__key")]

    def step(part: int) -> Callable[[Batches], Batches]:
        def mark(batches: Batches) -> Batches:
            waiting, same, previous = None, None, None  # a batch whose last line's neighbour is still to come
            for batch in batches:
                own = [batch.column(i) for i in at]
                as_before = ~_differs(own, previous)
                if previous is None:
                    as_before[0] = left.get(part, False)
                if waiting is not None:
                    yield kept(waiting, same, bool(as_before[0]))
                waiting, same, previous = batch, as_before, _last(own)
            yield kept(waiting, same, right.get(part, False))

        def kept(batch: pa.RecordBatch, same: np.ndarray, following: bool) -> pa.RecordBatch:
            return batch.filter(pa.array(same | np.append(same[1:], following)))

        return mark

    return _passed(held, [], step).drop("__key")


def cumulated(rows: DataFrame, weight: str, *order: Column | str, name: str = "before") -> DataFrame:
    """A column with the sum of the weights of all rows before each in the order, which must be total."""
    held = ranged(rows, *order)
    sums = held.groupBy("__part").agg(F.sum(weight).alias("n")).collect()  # one row for each partition
    before, reached = {}, 0
    for r in sorted(sums, key=lambda r: r["__part"]):
        before[r["__part"]] = reached
        reached += r["n"]
    names = [c for c in held.columns if c != "__part"]
    at = names.index(weight)

    def step(part: int) -> Callable[[Batches], Batches]:
        def add(batches: Batches) -> Batches:
            now = before[part]
            for batch in batches:
                own = batch.column(at).to_numpy()
                ends = now + np.cumsum(own)
                yield _with(batch, [*names, name], ends - own)
                now = int(ends[-1])

        return add

    return _passed(held, [T.StructField(name, T.LongType())], step)


def ranks(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """All rows with their place, from 1, in the order, which covers all columns.

    Equal rows are counted first; the distinct ones are ordered, and each is
    spread over as many rows as it stands for in chunks of bounded size, dealt
    to all tasks. So no value, however frequent, is one task's work.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    placed = cumulated(counted, "__n", *order, name="__before")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK).cast("long")))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.withColumn("__from", chunk).repartition(parts)
    one = F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + (CHUNK - 1), F.col("__n") - 1)))
    return dealt.select(*rows.columns, "__before", one.alias("__at")).select(*rows.columns, (F.col("__before") + F.col("__at") + 1).alias(name))
