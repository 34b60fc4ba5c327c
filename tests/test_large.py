"""Places, runs and ranks over range partitions, against plain Python, and how evenly they are spread."""

import random
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from linemill.operators import aggregate, explode, filters, large, order


@pytest.fixture(scope="module")
def mixed(spark):
    """Lines of one source with most of all rows, some small ones and a null one, with long and short runs."""
    draw = random.Random(5)
    rows, number = [], 0
    for src, n in [(1, 700), (2, 40), (3, 1), (None, 60), (4, 9), (5, 400)]:
        while n > 0:
            run = min(n, draw.choice([1, 1, 2, 3, 150, 400]))
            value = draw.choice(["a", "b", "A", None])
            for _ in range(run):
                number += draw.randint(1, 4)
                rows.append((src, number, value))
            n -= run
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "src long, line_no long, line string").repartition(3), rows


def sources(rows):
    own = {}
    for r in sorted(rows, key=lambda r: r[1]):
        own.setdefault(r[0], []).append(r)
    return own


def expected_runs(rows, key=lambda line: line):
    out = []
    for own in sources(rows).values():
        for _, run in groupby(own, lambda r: key(r[2])):
            run = list(run)
            out.append((*run[0], len(run)))
    return out


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_against_plain_python(spark, mixed, parts):
    frame, rows = mixed
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        places = {tuple(r[:3]): r["pos"] for r in large.with_position(frame).collect()}
        assert places == {r: i + 1 for own in sources(rows).values() for i, r in enumerate(own)}
        backwards = {tuple(r[:3]): r["pos"] for r in large.with_position(frame, order=(F.desc("line_no"),)).collect()}
        assert backwards == {r: i + 1 for own in sources(rows).values() for i, r in enumerate(reversed(own))}
        assert Counter(tuple(r) for r in large.runs(frame).collect()) == Counter(expected_runs(rows))
        folded = aggregate.run_key(F.col("line"), ignore_case=True)
        assert Counter(tuple(r) for r in large.runs(frame, folded).collect()) == Counter(expected_runs(rows, lambda x: x and x.lower()))
        many = Counter(r[:3] for own in sources(rows).values() for _, group in groupby(own, lambda r: r[2]) if len(run := list(group)) > 1 for r in run)
        assert Counter(tuple(r) for r in large.repeated(frame).collect()) == many
        assert Counter(tuple(r) for r in order.tail(frame, 3).collect()) == Counter(r for own in sources(rows).values() for r in own[-3:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_small_arrow_batches(spark, mixed):
    """Runs and places go on from batch to batch."""
    frame, rows = mixed
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert Counter(tuple(r) for r in large.runs(frame).collect()) == Counter(expected_runs(rows))
        assert sorted(r["pos"] for r in large.with_position(frame.where("src = 1")).collect()) == list(range(1, 701))
        assert large.repeated(frame).count() == sum(r[3] for r in expected_runs(rows) if r[3] > 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def place_of(number):
    return number is not None, number or 0


@pytest.fixture(scope="module")
def tied(spark):
    """Lines of none to some words; some have the number of others of their source, or none."""
    draw = random.Random(11)
    rows = [(src, number, draw.choice([None, "", " "]) if draw.random() < 0.3 else " ".join(f"w{draw.randint(0, 9)}" for _ in range(draw.randint(1, 9)))) for src, n in [(1, 300), (None, 40), (2, 1), (3, 90)] for number in range(n) for _ in range(draw.choice([1, 1, 1, 2, 5]))]
    rows += [(3, None, f"x{i} y z") for i in range(60)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "src long, line_no long, line string").repartition(3), rows


@pytest.mark.parametrize("parts", [1, 4, 13])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_starts_against_plain_python(spark, tied, mixed, parts, batch):
    frame, rows = tied
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        expected = Counter()
        for src in {r[0] for r in rows}:
            own, start = sorted((r for r in rows if r[0] == src), key=lambda r: place_of(r[1])), 0
            for _, same in groupby(own, lambda r: r[1]):
                same = list(same)
                expected.update((*r, start, len(same) > 1) for r in same)
                start += sum(len(r[2] or "") for r in same)
        found, ties = large.with_start(frame, F.length("line"))
        assert found.columns == ["src", "line_no", "line", "start", "tied"] and Counter(map(tuple, found.collect())) == expected and ties
        plain, none = large.with_start(mixed[0], F.lit(1))
        assert not none and plain.where("tied").count() == 0
        assert {tuple(r[:3]): r["start"] for r in plain.collect()} == {r: i for own in sources(mixed[1]).values() for i, r in enumerate(own)}
        empty, none = large.with_start(frame.limit(0), F.length("line"))
        assert empty.count() == 0 and not none

        words = {r: (r[2] or "").split() for r in rows}
        numbered = explode.words_per_line(frame).collect()
        for src in {r[0] for r in rows}:
            got = {r["line_no"]: r["line"] for r in numbered if r["src"] == src}
            ranked = sorted(((place_of(r[1]), i, w) for r in rows if r[0] == src for i, w in enumerate(words[r])), key=lambda x: x[:2])
            assert sorted(got) == list(range(1, len(ranked) + 1)) and sum(r["src"] == src for r in numbered) == len(ranked)
            for _, equal in groupby(enumerate(ranked, 1), lambda x: x[1][:2]):
                equal = list(equal)
                assert Counter(got[at] for at, _ in equal) == Counter(x[2] for _, x in equal)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_parts_of_lines_are_not_moved(spark, monkeypatch):
    """Lines are ordered, not their words, pieces or matches; lines without a match are not even that."""
    ordered, ranged = [], large.ranged
    monkeypatch.setattr(large, "ranged", lambda rows, *order, **more: ordered.append(rows.count()) or ranged(rows, *order, **more))
    lines = spark.range(1000).select((F.col("id") % 3).alias("src"), F.col("id").alias("line_no"), F.when(F.col("id") % 4 == 0, "").otherwise(F.repeat(F.lit("Ab cd "), 50)).alias("line"))
    assert explode.words_per_line(lines).count() == 75_000 and ordered == [1000]
    assert explode.fold(lines, 10).count() == 750 * 30 + 250 and ordered[1:] == [1000]
    assert explode.only_matching(lines, "A").count() == 37_500 and ordered[2:] == [750]


def sizes(frame):
    return sorted(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())


def test_half_of_all_lines_in_one_source(spark):
    """No task gets more than twice the median, whatever the sources."""
    lines = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("src"), F.col("id").alias("line_no"), (F.col("id") % 5).cast("string").alias("line"))
    for found in (large.with_position(lines), large.runs(lines), order.head(lines, 10**6), filters.drop_line(lines, 10**6)):
        held = sizes(found)
        assert len(held) == 4 and held[-1] <= 2 * held[len(held) // 2]


def test_parts_of_one_source_are_spread(spark):
    lines = spark.range(40_000).select(F.lit(1).alias("src"), F.col("id").alias("line_no"), F.lit("a b c").alias("line"))
    held = sizes(explode.words_per_line(lines))
    assert len(held) == 4 and sum(held) == 120_000 and held[-1] <= 2 * held[0]


def test_equal_lines_are_spread(spark):
    lines = spark.range(100_000).select(F.lit("same").alias("line"))
    for ranked in (order.sort_lines(lines), order.sort_numeric(lines), order.sort_human(lines), order.number_lines(lines, "line")):
        held = sizes(ranked)
        assert len(held) == 4 and held[-1] <= 2 * held[0]
        assert ranked.agg(F.min(ranked.columns[-1]), F.max(ranked.columns[-1]), F.count_distinct(ranked.columns[-1])).first() == (1, 100_000, 100_000)


def test_ranks_of_ties_and_nulls(spark):
    lines = spark.createDataFrame([(x,) for x in ("b", "a", None, "b", "", "a", "b")], "line string")
    assert sorted((r["rank"], r["line"]) for r in order.sort_lines(lines).collect()) == [(1, None), (2, ""), (3, "a"), (4, "a"), (5, "b"), (6, "b"), (7, "b")]
    assert order.sort_lines(lines.limit(0)).count() == 0


def test_extra_columns_and_empty_tables(spark, mixed):
    frame, rows = mixed
    more = frame.withColumns({"pos": F.lit("x"), "n": F.lit(1.5), "tags": F.array(F.lit("t"))})
    placed = large.with_position(more)
    assert placed.columns == ["src", "line_no", "line", "n", "tags", "pos"] and placed.count() == len(rows)
    assert large.runs(more).columns == ["src", "line_no", "line", "pos", "tags", "n"]
    assert large.runs(frame.limit(0)).count() == large.repeated(frame.limit(0)).count() == large.with_position(frame.limit(0)).count() == 0


def test_streams_are_refused(spark):
    stream = spark.readStream.format("rate").load().select(F.lit(1).alias("src"), F.col("value").alias("line_no"), F.lit("a").alias("line"))
    with pytest.raises(ValueError):
        large.with_position(stream)
