"""Templates, type sets, named files, byte cuts, and streams that fail between two sinks."""

import pytest
from pyspark.sql import functions as F

from linemill.functions import fields
from linemill.operators import contracts
from linemill.sources import lines as sources
from linemill.streaming import streams


@pytest.mark.parametrize(
    "out, template, expected",
    [
        ("a-x-b", "a-{{input}}-b", True), ("a-y-b", "a-{{input}}-b", False), ("12 x!", "[0-9]+ {{input}}.", True), ("12 xx", "[0-9]+ {{input}}x", True), ("xxx", "{{input}}[*]", False), ("xxx", "{{input}}x{{input}}", True),
        ("x--l-1", "{{input}}-+{{$1}}[0-9-]*", True), ("x--l-1.", "{{input}}-+{{$1}}[0-9-]*", False), ("aaxaax", "[ax]+{{input}}", True), ("aaxaaxa", "[ax]+{{input}}", False), ("x l r", "{{input}} {{$@}}", True), ("n=q", "n={{n$1}}", True),
        ("x1x2x", "[^ ]*{{input}}[0-9]{{input}}", True), ("x", "{{input}}.*", True), (None, "{{input}}", False), ("xx", "x{{n$@}}", False), ("xq", "x{{n$@}}", True), ("plain", "[a-z]+", True),
    ],
)
def test_templates(spark, out, template, expected):
    values = {"$1": F.lit("l"), "$2": F.lit("r"), "n$1": F.lit("q")}
    row = spark.range(1).select(contracts.template_matches(F.lit(out).cast("string"), F.lit("x"), template, values).alias("ok"))
    assert row.first()["ok"] is expected


def test_unknown_holes():
    with pytest.raises(KeyError):
        contracts.template_matches(F.lit("a"), F.lit("b"), "{{$1}}")


def test_type_sets_and_order(lines):
    some = lines("a", "b", "ab", "1", None, "ab")
    types = {"letters": "[a-z]+", "any": ".*", "one": ".", "never": "x{9}", "lower": "[a-z]*", "nothing": "y{8}"}
    told = {tuple(r["types"]): (r["n"], r["least"]) for r in contracts.type_sets(some, "line", types).collect()}
    assert told == {("any", "letters", "lower", "one"): (2, "a"), ("any", "letters", "lower"): (2, "ab"), ("any", "one"): (1, "1"), (): (1, None)}
    order = {r["type"]: (r["class"], r["covered_by"]) for r in contracts.type_order(some, "line", types).collect()}
    assert order == {"any": ("any", []), "letters": ("letters", ["any"]), "lower": ("letters", ["any"]), "one": ("one", ["any"]), "never": ("never", ["letters", "one"]), "nothing": ("never", ["letters", "one"])}
    assert contracts.type_sets(lines(), "line", types).count() == 0


def test_only_named_files_are_read(spark, tmp_path):
    for name in ("a", "b", "c d"):
        (tmp_path / name).write_text(f"{name}1\n{name}2\n")
    named = spark.createDataFrame([(f"{tmp_path}/a",), (f"'{tmp_path}/c d'",), (f"{tmp_path}/a",), ("two words",), ("",), (None,)], "line string")
    for most in (1, 10):
        found, refused = sources.read_named(spark, named, most)
        assert sorted((r["src"].replace("%20", " ")[-1], r["line_no"], r["line"]) for r in found.collect()) == [("a", 1, "a1"), ("a", 2, "a2"), ("d", 1, "c d1"), ("d", 2, "c d2")]
        assert refused.count() == 3 and refused.columns == ["line", "reason"]
    assert sources.read_named(spark, named.where("line = 'two words'"))[0].count() == 0


def test_cut_bytes(spark):
    rows = ["abcdef", "aéb漢c\U0001f642d", "", "é", None]
    frame = spark.createDataFrame([(x,) for x in rows], "line string")
    for spans, slices in (([(1, 2)], [(0, 2)]), ([1, (3, None)], [(0, 1), (2, None)]), ([(2, 4), (6, 9)], [(1, 4), (5, 9)])):
        expected = [None if x is None else b"".join(x.encode()[a:b] for a, b in slices).decode("utf-8", "ignore") for x in rows]
        assert [r[0] for r in frame.select(fields.cut_bytes(F.col("line"), spans)).collect()] == expected


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(i * 10 + k, "ab1c"[k % 4]) for k in range(8)], "id long, v string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_each_row_once_after_a_failure(spark, source, tmp_path):
    """The second batch fails after its first sink; the restarted query gives it to both again."""
    good, bad, checkpoint = (str(tmp_path / x) for x in ("good", "bad", "checkpoint"))
    failed = []

    def fails_once(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost")
        streams.batch_folder(bad)(batch, number)

    with pytest.raises(Exception):
        streams.stream_quarantine(source, "v", "[a-z]", good, fails_once, checkpoint).awaitTermination()
    assert failed == [1] and spark.read.parquet(good).count() == 12 and spark.read.parquet(bad).count() == 2
    streams.stream_quarantine(source, "v", "[a-z]", good, fails_once, checkpoint).awaitTermination()
    told = lambda path: sorted(r["id"] for r in spark.read.parquet(path).collect())
    every = [(i * 10 + k, k) for i in range(3) for k in range(8)]
    assert told(good) == [i for i, k in every if k % 4 != 2] and told(bad) == [i for i, k in every if k % 4 == 2]


def test_running_table(spark, source, tmp_path):
    """Update mode writes the changed groups of each batch; the last state of each is read, also after compaction."""
    path, checkpoint = str(tmp_path / "rows"), str(tmp_path / "checkpoint")
    streams.keep_running(streams.stream_counts(source, "v"), path, checkpoint).awaitTermination()
    counts = lambda p: {r["v"]: r["n"] for r in streams.latest(spark, p, ["v"]).collect()}
    assert counts(path) == {"a": 6, "b": 6, "1": 6, "c": 6} and spark.read.parquet(path).count() == 12
    streams.compact(spark, path, ["v"], str(tmp_path / "compact"))
    assert counts(str(tmp_path / "compact")) == counts(path) and spark.read.parquet(str(tmp_path / "compact")).count() == 4
