"""Operators, contracts and stages on small frames, with nulls, empty frames and bad arguments."""

import pytest
from pyspark.sql import functions as F

from linemill.operators import aggregate, contracts, explode, filters, infer, order, setops
from linemill.plans import stages
from linemill.sources import lines as sources
from linemill.streaming import streams


def texts(df, column="line"):
    return sorted(r[column] for r in df.collect())


def test_grep_options(lines):
    some = lines("of it", "often", "a.b", "OF")
    assert texts(filters.grep(some, "of", word=True)) == ["of it"]
    assert texts(filters.grep(some, "of", ignore_case=True)) == ["OF", "of it", "often"]
    assert texts(filters.grep(some, ".", fixed=True)) == ["a.b"]
    assert texts(filters.grep(some, "^of$", "n$")) == ["often"]
    assert texts(filters.grep(some, "of", word=True, invert=True)) == ["OF", "a.b", "often"]


def test_literal_anchors_are_pushed_down(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("line"))
    plan = filters.grep(docs, "^The")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan


def test_positions(lines):
    some = lines((1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, "e"))
    assert texts(filters.drop_line(some, 1)) == ["b", "d", "e"]
    assert texts(order.tail(some, 1)) == ["b", "e"]
    assert texts(filters.grep_numbered(some, "[be]")) == ["2:b", "3:e"]


def test_number_lines(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [(r["x"], r["n"]) for r in order.number_lines(rows, "x").orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]
    assert order.number_lines(rows.limit(0), "x").count() == 0


def test_runs(lines):
    some = lines("a", "a", "B", "b", "a", None, None)
    assert [(r["line"], r["n"]) for r in aggregate.runs(some).orderBy("line_no").collect()] == [("a", 2), ("B", 1), ("b", 1), ("a", 1), (None, 2)]
    assert [r["n"] for r in aggregate.runs(some.where("line is not null"), aggregate.run_key(F.col("line"), ignore_case=True)).orderBy("line_no").collect()] == [2, 2, 1]
    assert aggregate.runs(some.limit(0)).count() == 0


def test_run_keys(lines):
    keys = [r[0] for r in lines("aa bb cc").select(aggregate.run_key(F.col("line"), skip_fields=1, skip_chars=1, first=2)).collect()]
    assert keys == ["bb"]


def test_explode(lines):
    assert texts(explode.fold(lines("abcde", ""), 2)) == ["", "ab", "cd", "e"]
    assert texts(explode.words_per_line(lines(" a  b\tc "))) == ["a", "b", "c"]


def test_sets(lines):
    a, b = lines("x", "x", "y"), lines("x", "z")
    assert {tuple(r) for r in setops.comm(a, b).collect()} == {("x", 1, 0, 1), ("y", 1, 0, 0), ("z", 0, 1, 0)}
    assert texts(setops.subtract(a, b)) == ["x", "y"]
    assert texts(setops.paste(a, b, "-")) == ["x-x", "x-z", "y-"]
    assert texts(setops.join_lines(lines("k 1", "m 2"), lines("k 3"))) == ["k 1 3"]


def test_default_if_empty(lines):
    assert texts(filters.default_if_empty(lines("a").limit(0), lines("b"))) == ["b"]
    assert texts(filters.default_if_empty(lines("a"), lines("b"))) == ["a"]


def test_contracts(lines):
    some = lines("hello", "a b", "\x01", "longer one")
    assert contracts.witness(some, "line", "[a-z]+").first()[0] == "a b"
    assert contracts.witness(lines("a\tb"), "line", "x").first()[0] == "a\\tb"
    assert contracts.witness(lines("ab"), "line", "[a-z]+").first()[0] is None
    assert contracts.assert_contains(lines("hello"), "line", ["hello"]).first()["n_missing"] == 0
    with pytest.raises(ValueError):
        contracts.assert_contains(some, "line", ["[0-9]+"])
    good, bad = contracts.quarantine(lines("a", None, "1"), "line", "[a-z]")
    assert good.count() == 1 and bad.count() == 2


def test_signatures_move_no_calls(spark):
    """Each call finds its rule where it lies; one command with most of all calls is not one task's work."""
    rules = spark.createDataFrame([("a", 2, ["-x"], "two", None), ("a", 1, ["-x", "-y"], "one", "1"), ("a", None, [], "never", "never"), ("b", 3, None, "never", "never"), (None, 1, [], "never", "never")], "command string, pos int, required array<string>, input string, output string")
    some = [(1, "a", ["-x"], "two", ".*"), (2, "a", ["-y", "-x", "-z"], "one", "1"), (3, "a", ["-y"], ".*", ".*"), (4, "a", None, ".*", ".*"), (5, "b", [], ".*", ".*"), (6, "c", ["-x"], ".*", ".*"), (7, None, ["-x"], ".*", ".*"), (None, "a", ["-x"], "two", ".*")]
    calls = spark.createDataFrame([r[:3] for r in some], "call long, command string, flags array<string>")
    assert sorted(map(tuple, contracts.lookup_signature(calls, rules).collect()), key=str) == sorted([(r[0], *r[3:]) for r in some], key=str)
    many = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("call"), F.when(F.col("id") == 7, "b").otherwise("a").alias("command"), F.array(F.lit("-x")).alias("flags"))
    found = contracts.lookup_signature(many, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan
    assert [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()] == [5000] * 8


def test_templates():
    assert contracts.fill_template("x{{$1}}{{input}}", {"$1": "a.b", "input": "c"}) == "xa\\.bc"
    with pytest.raises(KeyError):
        contracts.fill_template("{{none}}", {})


def test_pipeline_report(lines):
    steps = [stages.Stage("echo", lambda x: x), stages.Stage("grep", lambda x: filters.grep(x, "foo"), input="[0-9]+")]
    rows = stages.check_pipeline(lines("hello"), steps, [stages.Rule(0, "assert", "output", "[0-9]+")]).collect()
    assert [(r["stage_idx"], r["kind"], r["n_bad"], r["witness"]) for r in rows] == [(0, "assertion_violation", 1, "hello"), (1, "input_mismatch", 1, "hello")]
    assumed = stages.check_pipeline(lines("hello"), steps, [stages.Rule(1, "assume", "input", "[a-z]+")])
    assert [(r["kind"], r["n_bad"]) for r in assumed.collect()] == [("assumption", None)]
    assert stages.status(assumed).first()[0] == 0
    assert stages.ignored_inputs(lines("x").sparkSession, steps, {"grep": False}).count() == 1


def test_registry():
    known = stages.Registry()
    with pytest.raises(KeyError):
        known.get("none").apply(None)


def test_inference(lines):
    assert infer.concretize(lines("a.b", "c"), "line").first()["pattern"] == "a\\.b|c"
    assert infer.concretize(lines("a", "b", "c"), "line", budget=2).first()["pattern"] is None
    assert [r["shape"] for r in infer.infer_shapes(lines("Ab 1-2"), "line").collect()] == ["[A-Z]+[a-z]+[ \\t]+[0-9]+-[0-9]+"]
    assert infer.infer_charclass(lines("ab", "b]"), "line").first()["type"] == "[\\]ab]+"
    assert tuple(infer.infer_affixes(lines("abcz", "abxz"), "line").first()) == ("ab", "z")
    with pytest.raises(ValueError):
        infer.check_name("a b")


def test_files(spark, lines, tmp_path):
    path = tmp_path / "text"
    path.mkdir()
    for name in ("a", "b"):
        (path / name).write_text("".join(f"{name}{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = sources.read_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["src"][-1], r["line_no"], r["line"]) for r in found) == sorted((n, i + 1, f"{n}{i}") for n in "ab" for i in range(3000))
    files = sources.list_files(spark, str(path), "a")
    assert [r["path"][-1] for r in files.collect()] == ["a"]
    assert sources.folder_sizes(sources.list_files(spark, str(path))).first()["n_files"] == 2


def test_saved_contracts(spark, tmp_path):
    own = spark.createDataFrame([("nl", ".*", "x")], "command string, input string, output string")
    stages.save_contracts(own, str(tmp_path / "c"))
    found = {r["command"]: r["output"] for r in stages.load_contracts(stages.builtin_contracts(spark), str(tmp_path / "c")).collect()}
    assert found["nl"] == "x" and found["wc -l"] == "[0-9]+"


def test_streams_refuse_order(spark, sf_dir):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        streams.refuse_ordered(stream)


def test_large_sources(lines):
    from linemill.operators import large

    some = lines((1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, None), (2, None), (None, "x"))
    rows = sorted(((r["src"], r["line_no"], r["line"], r["n"]) for r in large.runs(some).collect()), key=lambda r: r[1])
    assert rows == [(1, 1, "a", 2), (1, 3, "b", 1), (2, 4, "b", 1), (2, 5, None, 2), (None, 7, "x", 1)]
    assert sorted(r["pos"] for r in large.with_position(some).collect()) == [1, 1, 1, 2, 2, 3, 3]
    assert large.runs(some.limit(0)).count() == 0


def test_concretize_counts_all_values(lines):
    many = lines(*[f"v{i % 30}" for i in range(60)])
    assert tuple(infer.concretize(many, "line", budget=10).first()) == (30, None)
    assert tuple(infer.concretize(lines(), "line").first()) == (0, "")


def test_nulls_are_outside_every_type(spark):
    frame = spark.createDataFrame([(0, 1, "a"), (0, 2, None), (0, 3, "1")], "src long, line_no long, line string")
    assert contracts.violations(frame, [("line", "[a-z]")]).select("n_rows", "n_bad", "witness").first() == (3, 2, "1")
    assert contracts.quarantine(frame, "line", "[a-z]")[1].count() == 2
    report = stages.check_pipeline(frame, [stages.Stage("same", lambda x: x, input="[a-z]")])
    assert report.select("n_bad", "witness").first() == (2, "1")


def test_pattern_tables_in_chunks(spark, lines, monkeypatch):
    patterns = spark.createDataFrame([(f"^{c}$",) for c in "abcdefgh"], "pattern string")
    parts = filters.pattern_chunks(patterns, "pattern", 3)
    assert len(parts) == 3 and sorted(r[0] for p in parts for r in p.collect()) == sorted(r[0] for r in patterns.collect())
    monkeypatch.setattr(filters, "pattern_chunks", lambda rows, column: [rows.where(F.pmod(F.xxhash64(column), F.lit(3)) == i) for i in range(3)])
    assert sorted(r["line"] for r in filters.grep_table(lines("a", "b", "x", "a", "h"), patterns).collect()) == ["a", "a", "b", "h"]
