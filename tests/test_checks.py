"""Observed contracts, heuristics and the status of a run."""

import pytest
from pyspark.sql import functions as F

from linemill.operators import filters, order
from linemill.plans import stages

STEPS = [
    stages.Stage("upper", lambda x: x.withColumn("line", F.upper("line")), input="[a-z0-9]+"),
    stages.Stage("grep", lambda x: filters.grep(x, "A"), input="[A-Z]+", output="A.*"),
    stages.Stage("per source", lambda x: x.groupBy("src").agg(F.max("line").alias("line"))),
]
RULES = [stages.Rule(0, "assert", "output", "[A-Z]+"), stages.Rule(1, "contains", "output", "ABC"), stages.Rule(1, "contains", "input", "NONE"), stages.Rule(2, "assume", "input", "x"), stages.Rule(2, "assert", "output", "A[A-Z]*")]


def rows(report):
    return sorted(map(tuple, report.collect()), key=str)


@pytest.fixture
def some(lines):
    return lines((1, "abc"), (1, "a b"), (2, "x"), (2, None), (3, "a1"), (3, "xa"))


@pytest.mark.parametrize("heuristics", [False, True])
def test_observed_report_from_one_scan(some, tmp_path, monkeypatch, heuristics):
    told = rows(stages.check_pipeline(some, STEPS, RULES, heuristics))
    some.write.parquet(str(tmp_path / "in"))
    source = some.sparkSession.read.parquet(str(tmp_path / "in"))
    written = []

    def write(df):
        written.append(df._jdf.queryExecution().toString())
        df.write.parquet(str(tmp_path / "out"))

    monkeypatch.setattr(stages, "check_pipeline", None)  # not needed: all comes from the writing plan
    assert rows(stages.observe_pipeline(source, STEPS, write, RULES, heuristics)) == told
    physical = written[0].split("== Physical Plan ==")[1]
    assert len(written) == 1 and physical.count("FileScan") == 1 and physical.count("CollectMetrics") == len(STEPS) + 1
    assert some.sparkSession.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("step", [lambda x: x.orderBy("line"), lambda x: order.head(x, 1), lambda x: x.limit(1), lambda x: x.union(x)])
def test_plans_that_cannot_be_observed(some, tmp_path, step):
    """Sorts sample their input, limits stop early, places materialise and unions read twice: these are measured apart."""
    steps = [STEPS[0], stages.Stage("step", step, input="[A-Z]+")]
    told = rows(stages.check_pipeline(some, steps))
    assert rows(stages.observe_pipeline(some, steps, lambda df: df.write.parquet(str(tmp_path / "out")))) == told
    assert told[0][5] == 6


def test_skipped_rules_and_statuses(some, spark):
    steps = [stages.Stage("none", lambda x: filters.grep(x, "^no$")), stages.Stage("cat", lambda x: x, input="[a-z]", output="b")]
    report = stages.check_pipeline(some, steps, [stages.Rule(0, "assert", "output", "z"), stages.Rule(1, "assert", "output", "z")], heuristics=True)
    held = {(r["stage_idx"], r["kind"], r["pattern"]): (r["n_bad"], r["message"]) for r in report.collect()}
    assert held[0, "assertion_violation", "z"] == (None, "skipped") and held[1, "assertion_violation", "z"] == (0, "ok")
    assert held[0, "heuristic_violation", "no_empty_output"] == (1, "'none' always produces empty output") and held[1, "heuristic_violation", "no_empty_output"][0] == 0
    assert held[1, "heuristic_violation", "no_useless_composition"][0] == 1
    assert tuple(stages.run_status(spark, lambda: report).first()) == (1, None)
    assert tuple(stages.run_status(spark, lambda: stages.check_pipeline(some, STEPS[:1])).first())[0] == 1
    assert stages.run_status(spark, lambda: stages.check_pipeline(some, [stages.Registry().get("none")])).first()["status"] == 2
    assert stages.run_status(spark, lambda: stages.check_pipeline(some.where("line = 'abc'"), STEPS[:1])).first()["status"] == 0


def test_contains_needs_a_literal(some):
    with pytest.raises(ValueError):
        stages.check_pipeline(some, STEPS, [stages.Rule(0, "contains", "input", "[0-9]+")])
    assert rows(stages.check_pipeline(some, STEPS[:1], [stages.Rule(0, "contains", "input", "a\\.b")]))[0][7] == "a.b"


def test_empty_table(some):
    report = stages.check_pipeline(some.limit(0), STEPS, RULES, heuristics=True)
    assert {r["n_rows"] for r in report.collect()} == {0, None}
