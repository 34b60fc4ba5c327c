"""Stages, their contracts, and the check of a pipeline of stages on data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linemill.functions.patterns import literal_of, matches
from linemill.operators.contracts import least_bad, outside, shown

Rows = Callable[[DataFrame], DataFrame]

REPORT = "stage_idx int, stage string, kind string, side string, pattern string, n_rows long, n_bad long, witness string, message string"


@dataclass(frozen=True)
class Stage:
    """A named step on lines with the types it takes and gives; None is the open type.

    reads_input is false for a step that makes its lines of its own; sorts_text
    is true for one that orders them as text.
    """

    name: str
    apply: Rows
    input: str | None = None
    output: str | None = None
    reads_input: bool = True
    sorts_text: bool = False


@dataclass(frozen=True)
class Rule:
    """An assertion or assumption at a stage's input or output; of contains, the pattern is a line that must be there."""

    stage_idx: int
    kind: str  # assert, contains, assume
    side: str  # input, output
    pattern: str


@dataclass
class Registry:
    """Stages by name; a user's stage hides a built-in one."""

    built_in: dict[str, Stage] = field(default_factory=dict)
    own: dict[str, Stage] = field(default_factory=dict)

    def register(self, stage: Stage, built_in: bool = False) -> None:
        (self.built_in if built_in else self.own)[stage.name] = stage

    def get(self, name: str) -> Stage:
        """The stage of a name; an unknown name raises KeyError when it is applied."""

        def unknown(_: DataFrame) -> DataFrame:
            raise KeyError(name)

        return self.own.get(name) or self.built_in.get(name) or Stage(name, unknown)

    def signatures(self, names: DataFrame) -> DataFrame:
        """For each name of a column name: known, and the types that its stage takes and gives; open ones where it is unknown."""
        rows = [(n, s.input, s.output) for n, s in {**self.built_in, **self.own}.items()]
        known = names.sparkSession.createDataFrame(rows, "name string, input string, output string").withColumn("known", F.lit(True))
        open_ = [F.coalesce(c, F.lit(".*")).alias(c) for c in ("input", "output")]
        return names.join(F.broadcast(known), "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"), *open_)  # as many rows as stages


def compose(*steps: Rows) -> Rows:
    """One step after the other."""
    return lambda df: reduce(lambda d, step: d.transform(step), steps, df)


def check_pipeline(lines: DataFrame, stages: list[Stage], rules: list[Rule] = (), heuristics: bool = False) -> DataFrame:
    """The violation report of a pipeline: a row for each contract of each stage.

    Everything that is asked of the lines between two stages is measured in one
    aggregate; a null line is outside every type, and a line that must be
    there and isn't counts as one violation. Assumed contracts are reported with a null count and not evaluated; a
    stage whose input is assumed is not checked on it. Of several rules of a
    kind and side at one stage, the last holds.

    With heuristics, each stage also has a row for each way in which it is
    likely a mistake (HEURISTICS); a stage that gives nothing, the last one
    excepted, or only empty lines, has its other rules skipped: their count is null.
    """
    plan = _Plan(lines.sparkSession, stages, rules, heuristics)
    parts, now = [], lines
    for b in range(len(stages) + 1):
        parts.append(now.agg(*plan.metrics(b)).withColumn("b", F.lit(b)))
        now = stages[b].apply(now) if b < len(stages) else now
    return plan.report(reduce(DataFrame.unionByName, parts))


def observe_pipeline(lines: DataFrame, stages: list[Stage], write: Callable[[DataFrame], None], rules: list[Rule] = (), heuristics: bool = False) -> DataFrame:
    """Run the pipeline into a sink and give the report of check_pipeline, measured on the rows that flow by.

    write gets the last stage's lines and runs one action. The source is read
    once, by that action, with one observation between every two stages. Where
    observations would not tell of all rows once (a stage that sorts globally or
    stops reading early, materialises its input, or uses it twice), the pipeline
    is written without them and the report measured by check_pipeline. A task
    whose shuffled output was lost and is computed again is observed again.
    """
    plan, observed, now = _Plan(lines.sparkSession, stages, rules, heuristics), [], lines
    for b in range(len(stages) + 1):
        observed.append(Observation())
        now = now.observe(observed[-1], *plan.metrics(b))
        now = stages[b].apply(now) if b < len(stages) else now
    told = now._jdf.queryExecution().optimizedPlan().toString()
    early = [word for word in ("Sort", "GlobalLimit", "RepartitionByExpression") if word in told]
    if told.count("CollectMetrics") != len(observed) or early:
        write(compose(*[s.apply for s in stages])(lines))
        return check_pipeline(lines, stages, rules, heuristics)
    write(now)
    rows = [{**one.get, "b": b} for b, one in enumerate(observed)]
    return plan.report(lines.sparkSession.createDataFrame([tuple(r[n] for n in plan.names) for r in rows], plan.schema))


# What a stage is warned of, with its message.
HEURISTICS = {
    "no_empty_output": ("output", "'%s' always produces empty output"),
    "no_ignored_input": ("input", "'%s' does not read from stdin"),
    "no_useless_composition": ("output", "'%s' does not transform its input"),
    "no_lexicographic_numeric_sort": ("input", "'%s' receives numeric input but sorts it as text"),
}
_NUMERIC = "-?[0-9]+([ \\t]*-?[0-9]+)*"


class _Plan:
    """What is measured between stages, and the report that is made of it."""

    names = ("b", "n_rows", "n_filled", "n_numeric", "hashes", "crcs", "checks")
    schema = "b int, n_rows long, n_filled long, n_numeric long, hashes decimal(38,0), crcs long, checks array<struct<n_bad:long,value:string>>"

    def __init__(self, spark: SparkSession, stages: list[Stage], rules: list[Rule], heuristics: bool):
        self._spark, self._stages, self._heuristics = spark, stages, heuristics
        last = {(r.stage_idx, r.kind, r.side): r for r in rules}
        self._checks: list[tuple] = []  # stage_idx, stage, kind, side, pattern, b, k: the k-th check on the lines before stage b
        self._assumed: list[tuple] = []
        for i, stage in enumerate(stages):
            if stage.input is not None and (i, "assume", "input") not in last:
                self._add(i, "input_mismatch", "input", stage.input)
            for side in ("input", "output"):
                for name, kind in (("assert", "assertion_violation"), ("contains", "contains_violation")):
                    if rule := last.get((i, name, side)):
                        if name == "contains" and literal_of(rule.pattern) is None:
                            raise ValueError(f"{rule.pattern!r} is not a literal")
                        self._add(i, kind, side, rule.pattern)
                if rule := last.get((i, "assume", side)):
                    self._assumed.append((i, stage.name, "assumption", side, rule.pattern, None, None, None, "assumed"))

    def _add(self, i: int, kind: str, side: str, p: str) -> None:
        b = i + (side == "output")
        self._checks.append((i, self._stages[i].name, kind, side, p, b, sum(c[5] == b for c in self._checks)))

    def metrics(self, b: int) -> list[Column]:
        """The aggregates over the lines before stage b."""
        line, checks = F.col("line"), []
        for _, _, kind, _, p, at, _ in self._checks:
            if at == b and kind == "contains_violation":
                missing = F.count_if(line == F.lit(literal_of(p))) == 0
                checks.append(F.struct(F.when(missing, 1).otherwise(0).cast("long").alias("n_bad"), F.when(missing, F.lit(literal_of(p))).alias("value")))
            elif at == b:
                bad = outside(line, p)
                checks.append(F.struct(F.count_if(bad).alias("n_bad"), least_bad(line, bad).getField("value").alias("value")))
        sorts = self._heuristics and b < len(self._stages) and self._stages[b].sorts_text
        zero = F.max(F.lit(0)).cast("long")
        return [
            F.count("*").alias("n_rows"),
            (F.count_if(line != "") if self._heuristics else zero).alias("n_filled"),
            (F.count_if(F.coalesce(matches(line, _NUMERIC), F.lit(False))) if sorts else zero).alias("n_numeric"),
            (F.sum(F.xxhash64("line").cast("decimal(20,0)")) if self._heuristics else zero).cast("decimal(38,0)").alias("hashes"),
            (F.sum(F.coalesce(F.crc32("line"), F.lit(0))) if self._heuristics else zero).cast("long").alias("crcs"),
            F.array(*checks).cast("array<struct<n_bad:long,value:string>>").alias("checks"),
        ]

    def report(self, measured: DataFrame) -> DataFrame:
        """measured has one row for the lines before each stage and after the last."""
        spark = self._spark
        held = measured.groupBy().agg(F.sort_array(F.collect_list(F.struct(*self.names))).alias("at"))  # stages + 1 small structs
        at = lambda b: F.element_at("at", b + 1)
        empty = lambda i: ((at(i + 1)["n_rows"] == 0) & F.lit(i < len(self._stages) - 1)) | ((at(i + 1)["n_rows"] > 0) & (at(i + 1)["n_filled"] == 0))
        rows = []
        for i, name, kind, side, p, b, k in self._checks:
            n_rows, n_bad = at(b)["n_rows"], F.element_at(at(b)["checks"], k + 1)["n_bad"]
            value = F.element_at(at(b)["checks"], k + 1)["value"]
            message = F.when(n_bad > 0, F.format_string("%s of %s: %d of %d lines outside %s", F.lit(side), F.lit(name), n_bad, n_rows, F.lit(p))).otherwise(F.lit("ok"))
            if self._heuristics and kind != "input_mismatch" and (side == "output" or kind == "contains_violation"):
                skip = empty(i)
                n_bad, value, message = F.when(~skip, n_bad), F.when(~skip, value), F.when(skip, F.lit("skipped")).otherwise(message)
            rows.append(_row(i, name, kind, side, F.lit(p), n_rows, n_bad, shown(value), message))
        for i, stage in enumerate(self._stages if self._heuristics else []):
            same = [at(i)[c].eqNullSafe(at(i + 1)[c]) for c in ("n_rows", "hashes", "crcs")]
            violated = {
                "no_empty_output": empty(i),
                "no_ignored_input": F.lit(i > 0 and not stage.reads_input),
                "no_useless_composition": same[0] & same[1] & same[2],
                "no_lexicographic_numeric_sort": F.lit(stage.sorts_text) & (at(i)["n_rows"] > 0) & (at(i)["n_numeric"] == at(i)["n_rows"]),
            }
            for rule, (side, text) in HEURISTICS.items():
                n_bad = F.when(violated[rule], 1).otherwise(0).cast("long")
                n_rows = at(i + (side == "output"))["n_rows"]
                rows.append(_row(i, stage.name, "heuristic_violation", side, F.lit(rule), n_rows, n_bad, F.lit(None).cast("string"), F.when(n_bad > 0, F.lit(text % stage.name)).otherwise(F.lit("ok"))))
        assumed = spark.createDataFrame(self._assumed, REPORT)
        return held.select(F.explode(F.array(*rows)).alias("r")).select("r.*").unionByName(assumed) if rows else assumed


def _row(i: int, name: str, kind: str, side: str, *rest: Column) -> Column:
    named = [c.alias(n) for c, n in zip(rest, ("pattern", "n_rows", "n_bad", "witness", "message"))]
    return F.struct(F.lit(i).alias("stage_idx"), F.lit(name).alias("stage"), F.lit(kind).alias("kind"), F.lit(side).alias("side"), *named)


def status(report: DataFrame) -> DataFrame:
    """One row: 0 if nothing is violated, else 1."""
    return report.agg(F.when(F.count_if(F.col("n_bad") > 0) > 0, 1).otherwise(0).alias("status"))


def run_status(spark: SparkSession, check: Callable[[], DataFrame]) -> DataFrame:
    """One row (status, message) of a check that is run here: as in status(), or 2 and the reason where it fails."""
    try:
        found = status(check()).first()["status"]
        told = None
    except (PySparkException, ValueError, KeyError) as e:
        found, told = 2, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return spark.createDataFrame([(found, told)], "status int, message string")


def rendered(report: DataFrame, form: str = "human") -> DataFrame:
    """The report as lines: human, compact or json."""
    if form == "json":
        return report.select(F.to_json(F.struct("*")).alias("line"))
    if form == "compact":
        return report.select(F.format_string("%d:%s:%s:%s:%d", "stage_idx", "stage", "kind", "side", F.coalesce("n_bad", F.lit(0))).alias("line"))
    return report.select(F.concat(F.format_string("stage %d (%s): %s", "stage_idx", "stage", "message"), F.coalesce(F.concat(F.lit(", e.g. "), "witness"), F.lit(""))).alias("line"))


def ignored_inputs(spark: SparkSession, stages: list[Stage], takes_input: dict[str, bool]) -> DataFrame:
    """Stages after the first that declare to take no input."""
    rows = [(i, s.name) for i, s in enumerate(stages) if i and not takes_input.get(s.name, True)]
    return spark.createDataFrame(rows, "stage_idx int, stage string")


def empty_outputs(lines: DataFrame, stages: list[Stage]) -> DataFrame:
    """Stages that give nothing (the last one excepted), or only empty lines."""
    parts, now = [], lines
    for i, stage in enumerate(stages):
        now = stage.apply(now)
        none, blank = F.count("*") == 0, (F.count("*") > 0) & (F.count_if(F.col("line") != "") == 0)
        parts.append(now.agg(F.lit(i).alias("stage_idx"), F.lit(stage.name).alias("stage"), (((none) & F.lit(i < len(stages) - 1)) | blank).alias("warn")))
    return reduce(DataFrame.unionByName, parts)


def save_contracts(contracts: DataFrame, path: str) -> None:
    contracts.write.mode("overwrite").parquet(path)


def load_contracts(built_in: DataFrame, path: str) -> DataFrame:
    """Built-in contracts with the saved ones of the same command in their place."""
    own = built_in.sparkSession.read.parquet(path)
    return own.unionByName(built_in.join(own.select("command").distinct(), "command", "left_anti"))


# Output types of line commands, checked on the operators of this package.
OUTPUT_TYPES = {
    "basename": ".+",
    "dirname": ".+",
    "md5sum": "[0-9a-f]{32}  -",
    "nl": " +[0-9]+ +.*",
    "sha1sum": "[0-9a-f]{40}  -",
    "sha224sum": "[0-9a-f]{56}  -",
    "sha256sum": "[0-9a-f]{64}  -",
    "sha384sum": "[0-9a-f]{96}  -",
    "sha512sum": "[0-9a-f]{128}  -",
    "uniq -c": " *[0-9]+ .*",
    "wc": " *[0-9]+( .*)?",
    "wc -l": "[0-9]+",
}


def builtin_contracts(spark: SparkSession) -> DataFrame:
    """The output types of line commands as a table (command, input, output)."""
    return spark.createDataFrame([(c, ".*", p) for c, p in OUTPUT_TYPES.items()], "command string, input string, output string")


def check_outputs(outputs: dict[str, DataFrame], types: dict[str, str] = OUTPUT_TYPES) -> DataFrame:
    """For each command's output: n_rows and n_bad against its type."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(c).alias("command"), F.count("*").alias("n_rows"), F.count_if(~matches(F.col("line"), types[c])).alias("n_bad")) for c, df in outputs.items()])
