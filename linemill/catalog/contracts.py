"""Queries of contracts, pipelines of stages, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linemill.catalog.registry import EVENTS, LINES, ORACLE_SQL, PARTS, doc_lines, event_lines, part_records, query, table
from linemill.functions import charsets, fields
from linemill.functions.patterns import matches
from linemill.operators import aggregate, contracts, explode, filters, order
from linemill.plans import stages
from linemill.plans.storage import shared_folder
from linemill.sources import lines as sources
from linemill.streaming import streams

WORD = "[A-Z][a-z]+"


def _bad(p: str) -> str:
    return f"NOT regexp_full_match(line, '{p}')"


#: The shortest witness in DuckDB: printable first, then by length, then by bytes.
_WITNESS = "arg_min(line, (CAST(length(line) AS BIGINT), line)) FILTER (WHERE {bad})"

query("c01_assert_matches", LINES + f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_bad('[A-Z][^0-9]*')}) AS n_bad FROM lines")(lambda spark, d: contracts.assert_matches(doc_lines(spark, d), "line", "[A-Z][^0-9]*"))
query("c02_witness", LINES + f"SELECT {_WITNESS.format(bad=_bad('[A-Z][^0-9]*'))} AS witness FROM lines")(lambda spark, d: contracts.witness(doc_lines(spark, d), "line", "[A-Z][^0-9]*"))
query("c03_assert_contains", EVENTS + "SELECT count(*) AS n_missing, arg_min(v, (length(v), v)) AS witness FROM (SELECT unnest(['click', 'scroll', 'tap']) AS v) WHERE v NOT IN (SELECT line FROM lines)")(lambda spark, d: contracts.assert_contains(event_lines(spark, d), "line", ["click", "scroll", "tap"]))

CHECKED = [
    stages.Stage("capitals", lambda x: filters.grep(x, "^[A-Z]"), input="[^0-9]*"),
    stages.Stage("lower", lambda x: x.withColumn("line", F.lower("line")), input="[A-Z].*", output="[a-z].*"),
]
RULES = [stages.Rule(0, "assert", "output", "[A-Z][^|]*"), stages.Rule(1, "assert", "output", "[^A-Z]*"), stages.Rule(1, "assume", "input", "[A-Z].*")]


@query(
    "c04_assume",
    LINES
    + f"""SELECT 1 AS stage_idx, 'assumption' AS kind, 'input' AS side, CAST(NULL AS BIGINT) AS n_rows, CAST(NULL AS BIGINT) AS n_bad
UNION ALL SELECT 1, 'assertion_violation', 'output', count(*), count(*) FILTER (WHERE {_bad('[^A-Z]*').replace('(line', '(lower(line)')})
FROM lines WHERE regexp_matches(line, '^[A-Z]')""",
)
def c04(spark, d):
    """The second stage's input is trusted, so it has no count of violations; its output is counted."""
    report = stages.check_pipeline(doc_lines(spark, d), CHECKED, RULES)
    return report.where("stage_idx = 1").select("stage_idx", "kind", "side", "n_rows", "n_bad")


@query(
    "c05_contains",
    LINES
    + """SELECT side, CAST(CASE WHEN count(*) FILTER (WHERE line = wanted) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_bad,
CASE WHEN count(*) FILTER (WHERE line = wanted) = 0 THEN wanted END AS witness
FROM lines, (VALUES ('input', 'no such line'), ('output', 'No such line')) w(side, wanted) WHERE side = 'input' OR regexp_matches(line, '^[A-Z]') GROUP BY side, wanted""",
)
def c05_contains(spark, d):
    rules = [stages.Rule(0, "contains", "input", "no such line"), stages.Rule(0, "contains", "output", "No such line")]
    report = stages.check_pipeline(doc_lines(spark, d), CHECKED[:1], rules)
    return report.where("kind = 'contains_violation'").select("side", "n_bad", "witness")


@query(
    "c05_check_pipeline",
    LINES
    + ", s0 AS (SELECT * FROM lines WHERE regexp_matches(line, '^[A-Z]')), s1 AS (SELECT src, line_no, lower(line) AS line FROM s0) "
    + " UNION ALL ".join(
        f"SELECT {i} AS stage_idx, '{n}' AS stage, '{k}' AS kind, '{side}' AS side, count(*) AS n_rows, count(*) FILTER (WHERE {_bad(p)}) AS n_bad, {_WITNESS.format(bad=_bad(p))} AS witness FROM {t}"
        for i, n, k, side, p, t in [(0, "capitals", "input_mismatch", "input", "[^0-9]*", "lines"), (0, "capitals", "assertion_violation", "output", "[A-Z][^|]*", "s0"), (1, "lower", "assertion_violation", "output", "[^A-Z]*", "s1")]
    ),
)
def c05(spark, d):
    report = stages.check_pipeline(doc_lines(spark, d), CHECKED, RULES).where("n_bad is not null")
    return report.select("stage_idx", "stage", "kind", "side", "n_rows", "n_bad", "witness")


_RULES = [("sort", 1, ["-n"], "[-+]?[0-9]+.*", ".*"), ("sort", 2, ["-n", "-r"], "[0-9]+", ".*"), ("wc", 1, ["-l"], ".*", "[0-9]+")]


@query(
    "c06_lookup_signature",
    "SELECT o_orderkey AS call, CASE WHEN o_orderkey % 4 IN (1, 2) THEN '[-+]?[0-9]+.*' ELSE '.*' END AS input, CASE WHEN o_orderkey % 4 = 3 THEN '[0-9]+' ELSE '.*' END AS output FROM orders",
)
def c06(spark, d):
    rules = spark.createDataFrame(_RULES, "command string, pos int, required array<string>, input string, output string")
    k = F.col("o_orderkey") % 4
    flags = F.when(k == 0, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("-l"))).when(k == 1, F.array(F.lit("-n"))).otherwise(F.array(F.lit("-r"), F.lit("-n")))
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.when(k == 3, "wc").otherwise("sort").alias("command"), flags.alias("flags"))
    return contracts.lookup_signature(calls, rules)


@query("c07_template", EVENTS + "SELECT src, line_no, line_no % 3 <> 0 AS ok FROM lines")
def c07(spark, d):
    counted = event_lines(spark, d).withColumn("out", F.concat(F.lit("  "), F.col("line_no").cast("string"), F.lit(" "), F.when(F.col("line_no") % 3 == 0, F.concat("line", F.lit("?"))).otherwise(F.col("line"))))
    return counted.select("src", "line_no", contracts.template_matches(F.col("out"), F.col("line"), "( )*[0-9]+ {{input}}").alias("ok"))


@query(
    "c07_template_holes",
    """SELECT o_orderkey, o_orderkey % 4 <> 1 AS ok, o_orderkey % 4 NOT IN (1, 2) AS exact, true AS joined FROM orders""",
)
def c07_holes(spark, d):
    """Patterns before, between and after two values of the row; a pattern that is too narrow; all operands."""
    k = F.col("o_orderkey") % 4
    key, status, priority = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    between = F.when(k == 1, F.lit("?")).when(k == 2, F.lit("12-34")).otherwise(F.lit("56"))
    out = F.concat(F.lit("id "), key, between, F.lit("-"), status, F.lit(" tail."))
    values = {"$1": key, "n$1": status, "$2": priority}
    told = contracts.template_matches
    return table(spark, d, "orders").select(
        "o_orderkey",
        told(out, status, "[a-z]+ {{$1}}[0-9-]+{{input}} t.*", values).alias("ok"),
        told(out, status, "id {{$1}}[0-9]+-{{n$1}}[^!]+", values).alias("exact"),
        told(F.concat(F.lit("all: "), key, F.lit(" "), priority), status, "[a-z]+: {{$@}}", values).alias("joined"),
    )


@query("c08_dedupe_rules", "SELECT CAST(o_custkey AS BIGINT) AS stage, o_orderstatus AS kind, max(o_orderkey) AS pos FROM orders GROUP BY o_custkey, o_orderstatus")
def c08(spark, d):
    return contracts.dedupe_rules(table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("stage"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("pos")))


@query("c09_empty_outputs", EVENTS + "SELECT 0 AS stage_idx, 'none' AS stage, NOT EXISTS (SELECT 1 FROM lines WHERE line = 'no') AS warn UNION ALL SELECT 1, 'all', false")
def c09(spark, d):
    lines = event_lines(spark, d)
    return stages.empty_outputs(lines, [stages.Stage("none", lambda x: filters.grep(x, "^no$")), stages.Stage("all", lambda x: lines)])


@query("c10_no_op", EVENTS + "SELECT 'delete' AS stage, NOT EXISTS (SELECT 1 FROM lines WHERE regexp_matches(line, '[XYZ]')) AS no_op UNION ALL SELECT 'squeeze', NOT EXISTS (SELECT 1 FROM lines WHERE regexp_matches(line, 'rr'))")
def c10(spark, d):
    lines = event_lines(spark, d)
    test = lambda name, f: contracts.same_lines(lines, lines.withColumn("line", f(F.col("line")))).select(F.lit(name).alias("stage"), "no_op")
    return test("delete", lambda x: charsets.delete(x, "XYZ")).unionByName(test("squeeze", lambda x: charsets.squeeze(x, "r")))


HINTED = [
    stages.Stage("seq", lambda x: x.withColumn("line", F.col("line_no").cast("string"))),
    stages.Stage("sort", lambda x: x.select("src", "line_no", "line"), input="[0-9]+", sorts_text=True),
    stages.Stage("echo", lambda x: x.withColumn("line", F.concat(F.lit("n"), "line")), reads_input=False),
    stages.Stage("grep", lambda x: filters.grep(x, "^none$")),
    stages.Stage("blank", lambda x: x.withColumn("line", F.lit(""))),
]
HINTS = [stages.Rule(2, "assert", "output", "n[0-4]+"), stages.Rule(3, "assert", "output", "x"), stages.Rule(3, "contains", "input", "n1"), stages.Rule(4, "assert", "output", "y")]
_RULED = """SELECT {i} AS stage_idx, '{n}' AS stage, 'heuristic_violation' AS kind, '{side}' AS side, '{rule}' AS pattern, (SELECT count(*) FROM {t}) AS n_rows, CAST(CASE WHEN {v} THEN 1 ELSE 0 END AS BIGINT) AS n_bad"""
_BOUNDARIES = ["lines", "s0", "s1", "s2", "s3", "s4"]


def _hints_sql():
    """Each heuristic in SQL, over the lines before and after each stage."""
    names, count = [s.name for s in HINTED], "(SELECT count(*) FROM {})".format
    parts = []
    for i, name in enumerate(names):
        before, after = _BOUNDARIES[i : i + 2]
        some = f"(SELECT count(*) FROM {after} WHERE line <> '')"
        none = f"({count(after)} = 0 AND {i} < {len(names) - 1}) OR ({count(after)} > 0 AND {some} = 0)"
        same = f"NOT EXISTS (SELECT line FROM {before} EXCEPT ALL SELECT line FROM {after}) AND {count(before)} = {count(after)}"
        numeric = f"{'true' if name == 'sort' else 'false'} AND (SELECT count(*) > 0 AND bool_and(regexp_full_match(line, '-?[0-9]+([ \\t]*-?[0-9]+)*')) FROM {before})"
        for rule, side, t, v in (("no_empty_output", "output", after, none), ("no_ignored_input", "input", before, "true" if name == "echo" else "false"), ("no_useless_composition", "output", after, same), ("no_lexicographic_numeric_sort", "input", before, numeric)):
            parts.append(_RULED.format(i=i, n=name, side=side, rule=rule, t=t, v=v))
    row = "SELECT {i}, '{n}', '{k}', '{side}', '{p}', (SELECT count(*) FROM {t}), {v}".format
    parts += [
        row(i=1, n="sort", k="input_mismatch", side="input", p="[0-9]+", t="s0", v="(SELECT count(*) FROM s0 WHERE NOT regexp_full_match(line, '[0-9]+'))"),
        row(i=2, n="echo", k="assertion_violation", side="output", p="n[0-4]+", t="s2", v="(SELECT count(*) FROM s2 WHERE NOT regexp_full_match(line, 'n[0-4]+'))"),
        row(i=3, n="grep", k="contains_violation", side="input", p="n1", t="s2", v="CAST(CASE WHEN (SELECT count(*) FROM s3) = 0 THEN NULL WHEN EXISTS (SELECT 1 FROM s2 WHERE line = 'n1') THEN 0 ELSE 1 END AS BIGINT)"),
        row(i=3, n="grep", k="assertion_violation", side="output", p="x", t="s3", v="(SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM s3)"),
        row(i=4, n="blank", k="assertion_violation", side="output", p="y", t="s4", v="(SELECT CASE WHEN count(*) = 0 THEN 0 END FROM s4)"),
    ]
    return EVENTS + ", s0 AS (SELECT src, line_no, CAST(line_no AS VARCHAR) AS line FROM lines), s1 AS (SELECT * FROM s0), s2 AS (SELECT src, line_no, 'n' || line AS line FROM s1), s3 AS (SELECT * FROM s2 WHERE line = 'none'), s4 AS (SELECT src, line_no, '' AS line FROM s3) " + " UNION ALL ".join(parts)


@query("c05_heuristics", _hints_sql())
def c05_heuristics(spark, d):
    """All four heuristics on one pipeline; a stage without output has its other rules skipped."""
    return stages.check_pipeline(event_lines(spark, d), HINTED, HINTS, heuristics=True).select("stage_idx", "stage", "kind", "side", "pattern", "n_rows", "n_bad")


@query("c05_observed", ORACLE_SQL["c05_check_pipeline"])
def c05_observed(spark, d):
    """The report of c05_check_pipeline from the run that writes the lines."""
    folder = f"{shared_folder(spark)}/linemill-observed-{uuid.uuid4().hex}"
    report = stages.observe_pipeline(doc_lines(spark, d), CHECKED, lambda df: df.write.parquet(folder), RULES)
    return report.where("n_bad is not null").select("stage_idx", "stage", "kind", "side", "n_rows", "n_bad", "witness")


@query("c12_ignored_input", EVENTS + "SELECT 1 AS stage_idx, 'b' AS stage, CAST(1 AS BIGINT) AS n_bad, count(*) AS n_rows FROM lines WHERE contains(line, 'i') HAVING count(*) > 0 UNION ALL SELECT 0, 'a', 0, count(*) FROM lines")
def c12(spark, d):
    steps = [stages.Stage("a", lambda x: filters.grep(x, "i"), reads_input=False), stages.Stage("b", lambda x: x, reads_input=False)]
    report = stages.check_pipeline(event_lines(spark, d), steps, heuristics=True).where("pattern = 'no_ignored_input'")
    return report.select("stage_idx", "stage", "n_bad", "n_rows")


query("c11_numeric_sorted_as_text", "SELECT bool_and(regexp_full_match(CAST(o_custkey AS VARCHAR), '-?[0-9]+([ \\t]*-?[0-9]+)*')) AS all_numeric FROM orders")(lambda spark, d: contracts.lexicographic_numeric_sort(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("k")), "k"))


_C13 = ORACLE_SQL["c05_check_pipeline"]


@query("c13_report_compact", f"SELECT stage_idx || ':' || stage || ':' || kind || ':' || side || ':' || n_bad AS line FROM ({_C13}) UNION ALL SELECT '1:lower:assumption:input:0'")
def c13_compact(spark, d):
    return stages.rendered(stages.check_pipeline(doc_lines(spark, d), CHECKED, RULES), "compact")


@query(
    "c13_report_human",
    f"SELECT 'stage ' || stage_idx || ' (' || stage || '): ' || CASE WHEN n_bad > 0 THEN side || ' of ' || stage || ': ' || n_bad || ' of ' || n_rows || ' lines outside ' || CASE kind WHEN 'input_mismatch' THEN '[^0-9]*' WHEN 'assertion_violation' THEN CASE stage_idx WHEN 0 THEN '[A-Z][^|]*' ELSE '[^A-Z]*' END END ELSE 'ok' END || coalesce(', e.g. ' || witness, '') AS line FROM ({_C13}) UNION ALL SELECT 'stage 1 (lower): assumed'",
)
def c13_human(spark, d):
    return stages.rendered(stages.check_pipeline(doc_lines(spark, d), CHECKED, RULES))


@query("c13_report")
def c13(spark, d):
    return stages.rendered(stages.check_pipeline(doc_lines(spark, d), CHECKED, RULES), "json")


query("c14_status", LINES + f"SELECT CASE WHEN count(*) FILTER (WHERE {_bad('[^0-9]*')}) > 0 THEN 1 ELSE 0 END AS status FROM lines")(lambda spark, d: stages.status(stages.check_pipeline(doc_lines(spark, d), CHECKED[:1])))


@query("c14_status_of_a_failure", EVENTS + "SELECT CASE WHEN count(*) FILTER (WHERE line = 'click') > 0 THEN 2 ELSE 0 END AS status, count(*) FILTER (WHERE line = 'click') > 0 AS told FROM lines")
def c14_failure(spark, d):
    broken = stages.Stage("broken", lambda x: x.withColumn("line", F.when(F.col("line") == "click", F.raise_error(F.lit("no clicks"))).otherwise(F.col("line"))), input=".*")
    rules = [stages.Rule(0, "assert", "output", ".*")]
    return stages.run_status(spark, lambda: stages.check_pipeline(event_lines(spark, d), [broken], rules)).select("status", F.col("message").isNotNull().alias("told"))


@query("c15_quarantine", PARTS + "SELECT src, line_no, CASE WHEN regexp_full_match(line, '[^0-9]*#[0-9] .*') THEN 'ok' ELSE 'line outside [^0-9]*#[0-9] .*' END AS reason FROM lines")
def c15(spark, d):
    good, bad = contracts.quarantine(part_records(spark, d), "line", "[^0-9]*#[0-9] .*")
    return good.select("src", "line_no", F.lit("ok").alias("reason")).unionByName(bad.select("src", "line_no", "reason"))


_TYPES = {"lower": "[a-z]+", "short": ".{1,5}", "vowel": "[aeiou].*"}


@query(
    "c16_containment",
    "WITH w AS (SELECT props AS v FROM events UNION ALL SELECT event_type FROM events) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_outside, arg_min(v, (length(v), v)) AS witness FROM w WHERE regexp_full_match(v, '{p}') AND NOT regexp_full_match(v, '{q}') HAVING count(*) > 0" for a, p in _TYPES.items() for b, q in _TYPES.items() if a != b
    ),
)
def c16(spark, d):
    events = table(spark, d, "events")
    return contracts.containment_matrix(events.select(F.col("props").alias("v")).union(events.select("event_type")), "v", _TYPES)


#: 300 types: lines that hold a letter, or start with it, and more than so many characters.
_MANY = {f"{kind}-{c}-{n}": (f"[^{c}]*{c}.{{{n},}}" if kind == "first" else f"{c}.{{{n},}}") for kind in ("first", "starts") for c in "abcdefghijklmnoprstuvwxyz" for n in (0, 1, 2, 5, 9, 40)}
_MANY_SQL = "CASE WHEN t[1] = 'first' THEN instr(v, t[2]) > 0 AND length(v) - instr(v, t[2]) >= CAST(t[3] AS INTEGER) ELSE starts_with(v, t[2]) AND length(v) - 1 >= CAST(t[3] AS INTEGER) END"


@query(
    "c16_many_types",
    f"""WITH v AS (SELECT DISTINCT v FROM (SELECT props AS v FROM events UNION ALL SELECT event_type FROM events)), t AS (SELECT unnest([{", ".join(f"'{n}'" for n in _MANY)}]) AS name),
w AS (SELECT name, v FROM (SELECT name, string_split(name, '-') AS t, v FROM t, v) WHERE {_MANY_SQL}),
n AS (SELECT t.name, (SELECT count(*) FROM w WHERE w.name = t.name) AS n FROM t), met AS (SELECT a.name AS a, b.name AS b, count(*) AS n FROM w a JOIN w b USING (v) GROUP BY ALL),
below AS (SELECT x.name AS a, y.name AS b FROM n x, n y WHERE x.n = coalesce((SELECT met.n FROM met WHERE met.a = x.name AND met.b = y.name), 0)),
same AS (SELECT x.a AS type, min(x.b) AS class FROM below x JOIN below y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
over AS (SELECT DISTINCT x.class AS c, y.class AS d FROM below JOIN same x ON x.type = below.a JOIN same y ON y.type = below.b WHERE x.class <> y.class),
direct AS (SELECT c, d FROM over o WHERE NOT EXISTS (SELECT 1 FROM over p JOIN over q ON p.d = q.c WHERE p.c = o.c AND q.d = o.d))
SELECT type, class, coalesce((SELECT string_agg(d, ' ' ORDER BY d) FROM direct WHERE c = class), '') AS covered_by FROM same""",
)
def c16_many(spark, d):
    """The order of 300 types on the values of two columns: equivalent ones, and what covers each directly."""
    events = table(spark, d, "events")
    ordered = contracts.type_order(events.select(F.col("props").alias("v")).union(events.select("event_type")), "v", _MANY)
    return ordered.select("type", "class", F.array_join("covered_by", " ").alias("covered_by"))


@query("c17_saved_contracts", "SELECT DISTINCT event_type AS command, event_type || '+' AS output FROM events UNION ALL SELECT 'nl', ' +[0-9]+ +.*'")
def c17(spark, d):
    path = f"{shared_folder(spark)}/linemill-contracts-{uuid.uuid4().hex}"
    own = table(spark, d, "events").select(F.col("event_type").alias("command")).distinct().withColumns({"input": F.lit(".*"), "output": F.concat("command", F.lit("+"))})
    stages.save_contracts(own, path)
    known = stages.builtin_contracts(spark).where("command = 'nl'")
    return stages.load_contracts(known, path).select("command", "output")


@query("c18_outputs_fit_types")
def c18(spark, d):
    lines, paths = doc_lines(spark, d), table(spark, d, "pages").select(F.col("url").alias("line"))
    counted = aggregate.word_count(lines)
    text = table(spark, d, "documents")
    return stages.check_outputs(
        {
            "nl": order.numbered(lines),
            "uniq -c": aggregate.uniq_counted(event_lines(spark, d)),
            "wc -l": counted.select(F.col("n_lines").cast("string").alias("line")),
            "wc": counted.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("n_lines", "n_words", "n_bytes")]).alias("line")),
            "basename": paths.select(fields.basename(F.col("line")).alias("line")),
            "dirname": paths.select(fields.dirname(F.col("line")).alias("line")),
            **{f"{k}sum": text.select(aggregate.digest_line(F.col("text"), k).alias("line")) for k in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")},
        }
    )


# Files


@query("s01_read_lines", LINES + "SELECT line, count(*) AS n FROM lines GROUP BY line")
def s01(spark, d):
    folder = f"{shared_folder(spark)}/linemill-text-{uuid.uuid4().hex}"
    doc_lines(spark, d).orderBy("src", "line_no").select("line").write.text(folder)
    return sources.read_lines(spark, folder).groupBy("line").agg(F.count("*").alias("n"))


def _text_files(spark, d):
    """Files of all documents' texts, in a folder for each language."""
    folder = f"{shared_folder(spark)}/linemill-files-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    docs.select("text", F.coalesce("lang", F.lit("none")).alias("language")).write.partitionBy("language").text(folder)
    return sources.list_files(spark, folder, "*.txt")


def _language(path="path"):
    return F.regexp_extract(path, "language=([^/]*)", 1).alias("name")


_BYTES = "CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT)"


@query("s03_list_files", f"SELECT coalesce(lang, 'none') AS name, {_BYTES} AS size, true AS named FROM documents GROUP BY ALL")
def s03(spark, d):
    """Every file that the glob names, in its folder, with all bytes of its texts, and no other one (_SUCCESS)."""
    named = F.col("path").rlike("/language=[^/]+/part-[^/]+\\.txt\\z")
    return _text_files(spark, d).groupBy(_language()).agg(F.sum("length").alias("size"), F.bool_and(named).alias("named"))


@query("s04_file_stats", f"SELECT coalesce(lang, 'none') AS name, {_BYTES} AS size, true AS dated FROM documents GROUP BY ALL")
def s04(spark, d):
    return sources.file_stats(_text_files(spark, d)).groupBy(_language()).agg(F.sum("size").alias("size"), F.bool_and(F.col("mtime") > 0).alias("dated"))


@query("s04_folder_sizes", f"SELECT coalesce(lang, 'none') AS name, {_BYTES} AS size FROM documents GROUP BY ALL")
def s04_folders(spark, d):
    sizes = sources.folder_sizes(_text_files(spark, d))
    return sizes.select(_language("folder"), "size")


@query("s05_cat_paths", LINES + "SELECT src, count(*) AS n FROM lines WHERE src IN (SELECT doc_id FROM documents WHERE lang <> 'es') GROUP BY src")
def s05(spark, d):
    lines = doc_lines(spark, d).withColumn("src", F.concat(F.lit("/docs/"), F.col("src").cast("string")))
    number = F.col("doc_id").cast("string")
    paths = table(spark, d, "documents").select(F.concat(F.lit("/docs"), F.when(F.col("lang") != "es", F.lit("/")).otherwise(F.lit(" /")), number).alias("line"))
    named = sources.cat_paths(paths, lines)
    return named.groupBy("src").agg(F.count("*").alias("n")).select(F.regexp_extract("src", "([0-9]+)", 1).cast("long").alias("src"), "n")


@query("s08_tee", EVENTS + "SELECT line, count(*) AS n FROM lines GROUP BY line")
def s08(spark, d):
    kept = sources.tee(event_lines(spark, d), f"{shared_folder(spark)}/linemill-tee-{uuid.uuid4().hex}")
    return aggregate.line_counts(kept)


@query("s10_split_out", EVENTS + ", p AS (SELECT src, line, row_number() OVER (PARTITION BY src ORDER BY line_no) AS pos FROM lines) SELECT src, CAST(floor((pos - 1) / 50.0) AS BIGINT) AS bucket, line, count(*) AS n FROM p GROUP BY ALL")
def s10(spark, d):
    path = f"{shared_folder(spark)}/linemill-split-{uuid.uuid4().hex}"
    placed = filters.with_position(event_lines(spark, d)).select("src", F.col("pos").alias("line_no"), "line")
    sources.split_out(placed, 50, path)
    return spark.read.parquet(path).groupBy("src", F.col("bucket").cast("long").alias("bucket"), "line").agg(F.count("*").alias("n"))


query("a14_count_named", LINES + "SELECT src, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes FROM lines WHERE src IN (SELECT doc_id FROM documents WHERE lang = 'fr') GROUP BY src")(
    lambda spark, d: aggregate.word_count(doc_lines(spark, d).join(table(spark, d, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("src")), "src", "left_semi")).drop("n_words")
)
query("j07_grep_named", LINES + "SELECT CAST(src AS VARCHAR) || ':' || line AS line FROM lines WHERE src IN (SELECT doc_id FROM documents WHERE lang = 'de') AND contains(line, 'ung')")(
    lambda spark, d: filters.grep(doc_lines(spark, d).join(table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("src")), "src", "left_semi"), "ung").select(F.concat(F.col("src").cast("string"), F.lit(":"), "line").alias("line"))
)


def _named(spark, d, language):
    """A stream that names all files of a language, and one line for each document that names none."""
    files = _text_files(spark, d)
    own = files.where(_language() == language).select(F.col("path").alias("line"))
    return own.unionByName(table(spark, d, "documents").select(F.concat(F.lit("no such file "), F.col("doc_id").cast("string")).alias("line")))


_NAMED_LINES = "WITH lines AS (SELECT doc_id AS src, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE lang = '{}') "


@query("s05_named_files", _NAMED_LINES.format("es") + "SELECT line, count(*) AS n FROM lines GROUP BY line UNION ALL SELECT 'refused', count(*) FROM documents")
def s05_named(spark, d):
    """Lines of the named files only; refused lines are counted beside them."""
    lines, refused = sources.read_named(spark, _named(spark, d, "es"))
    return aggregate.line_counts(lines).unionByName(refused.agg(F.lit("refused").alias("line"), F.count("*").alias("n")))


@query("a14_count_named_files", _NAMED_LINES.format("fr") + "SELECT 'fr' AS name, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(line, '\\S+'))) AS BIGINT) AS n_words, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes FROM lines")
def a14_files(spark, d):
    counts = aggregate.word_count(sources.read_named(spark, _named(spark, d, "fr"))[0])
    return counts.groupBy(_language("src")).agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_words", "n_bytes")])


@query("j07_grep_named_files", _NAMED_LINES.format("de") + "SELECT 'de:' || line AS line FROM lines WHERE contains(line, 'ung')")
def j07_files(spark, d):
    found = filters.grep(sources.read_named(spark, _named(spark, d, "de"))[0], "ung")
    return found.select(F.concat(_language("src"), F.lit(":"), "line").alias("line"))


# Streams over the events table


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if _is_file(spark, f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")


def _is_file(spark, path):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found).isFile()


@query("t01_stream_lines", "SELECT event_id, upper(event_type) AS line FROM events WHERE regexp_matches(event_type, 'i')")
def t01(spark, d):
    stream = _stream(spark, d).select("event_id", F.col("event_type").alias("line"))
    return streams.drained(filters.grep(stream, "i").withColumn("line", F.upper("line")), "append", shared_folder(spark))


@query("t02_stream_contracts", "SELECT 'type' AS rule, count(*) AS n_rows, count(*) FILTER (WHERE NOT regexp_full_match(event_type, '[a-l][a-z]*')) AS n_bad, arg_min(event_type, (length(event_type), event_type)) FILTER (WHERE NOT regexp_full_match(event_type, '[a-l][a-z]*')) AS witness FROM events UNION ALL SELECT 'props', count(*), count(*) FILTER (WHERE NOT regexp_full_match(props, '.*\"k\": [0-9].')), arg_min(props, (length(props), props)) FILTER (WHERE NOT regexp_full_match(props, '.*\"k\": [0-9].')) FROM events")
def t02(spark, d):
    return streams.drained(streams.stream_contracts(_stream(spark, d), [("type", "event_type", "[a-l][a-z]*"), ("props", "props", '.*"k": [0-9].')]), "complete", shared_folder(spark))


@query("t02_updated_contracts", ORACLE_SQL["t02_stream_contracts"])
def t02_updated(spark, d):
    """The same, in update mode: only what a batch changes is written, and the last state of each rule is read."""
    folder = f"{shared_folder(spark)}/linemill-running-{uuid.uuid4().hex}"
    rules = [("type", "event_type", "[a-l][a-z]*"), ("props", "props", '.*"k": [0-9].')]
    streams.keep_running(streams.stream_contracts(_stream(spark, d), rules), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return streams.latest(spark, f"{folder}/rows", ["rule"])


@query("t03_stream_quarantine", "SELECT 'good' AS side, count(*) FILTER (WHERE regexp_full_match(event_type, 'c.*')) AS n FROM events UNION ALL SELECT 'bad', count(*) FILTER (WHERE NOT regexp_full_match(event_type, 'c.*')) FROM events")
def t03(spark, d):
    folder = f"{shared_folder(spark)}/linemill-quarantine-{uuid.uuid4().hex}"
    streams.stream_quarantine(_stream(spark, d), "event_type", "c.*", f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint").awaitTermination()
    count = lambda side: spark.read.parquet(f"{folder}/{side}").agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count("good").unionByName(count("bad"))


query("t04_stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")(lambda spark, d: streams.drained(streams.stream_counts(_stream(spark, d), "event_type"), "complete", shared_folder(spark)))


# Registry of stages


@query("u01_register_stage", LINES + "SELECT src, line_no, lower(line) AS line FROM lines WHERE starts_with(line, 'The')")
def u01(spark, d):
    known = stages.Registry()
    known.register(stages.Stage("pick", lambda x: filters.grep(x, "^A")), built_in=True)
    known.register(stages.Stage("pick", lambda x: filters.grep(x, "^The")))
    known.register(stages.Stage("lower", lambda x: x.withColumn("line", F.lower("line"))))
    return stages.compose(known.get("pick").apply, known.get("lower").apply)(doc_lines(spark, d))


@query("u02_unknown_stage", EVENTS + "SELECT line AS name, line IN ('click', 'view') AS known, CASE line WHEN 'click' THEN '[0-9]+' ELSE '.*' END AS input, CASE line WHEN 'view' THEN 'v+' ELSE '.*' END AS output FROM lines")
def u02(spark, d):
    """Names without a stage have the open type on both sides."""
    known = stages.Registry()
    known.register(stages.Stage("click", lambda x: x, input="[0-9]+"), built_in=True)
    known.register(stages.Stage("view", lambda x: x, input="x", output="y"), built_in=True)
    known.register(stages.Stage("view", lambda x: x, output="v+"))
    return known.signatures(event_lines(spark, d).select(F.col("line").alias("name")))


#: The minimal pipeline end to end: lines, filter, words, counts, contract with witness.
FLAGSHIP_SQL = (
    LINES
    + f", words AS (SELECT unnest(regexp_extract_all(line, '{WORD}')) AS line FROM lines WHERE regexp_matches(line, '{WORD}ing')), n AS (SELECT line, count(*) AS n FROM words GROUP BY line) "
    + "SELECT line, n, regexp_full_match(line, '[A-Z][a-z]{1,6}') AS short FROM n"
)


@query("flagship_word_counts", FLAGSHIP_SQL)
def flagship(spark, d):
    words = explode.only_matching(filters.grep(doc_lines(spark, d), f"{WORD}ing"), WORD)
    return aggregate.line_counts(words).withColumn("short", matches(F.col("line"), "[A-Z][a-z]{1,6}"))
