"""Queries of type inference and profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from linemill.catalog.registry import EVENTS, LINES, doc_lines, event_lines, query, table
from linemill.functions.patterns import matches
from linemill.operators import infer

_ESCAPE = "regexp_replace({v}, '([\\\\.^$|?*+()\\[\\]{{}}])', '\\\\\\1', 'g')"
_SHAPE = "replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({e}, '[A-Z]+', chr(1), 'g'), '[a-z]+', chr(2), 'g'), '[0-9]+', chr(3), 'g'), '[ \\t]+', chr(4), 'g'), chr(1), '[A-Z]+'), chr(2), '[a-z]+'), chr(3), '[0-9]+'), chr(4), '[ \\t]+')"


def shape_sql(v: str) -> str:
    return _SHAPE.format(e=_ESCAPE.format(v=v))


query("i01_concretize", f"SELECT count(*) AS n_values, string_agg({_ESCAPE.format(v='v')}, '|' ORDER BY {_ESCAPE.format(v='v')}) AS pattern FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)")(lambda spark, d: infer.concretize(table(spark, d, "orders"), "o_orderpriority"))
query("i02_infer_shapes", f"SELECT {shape_sql('url')} AS shape, count(*) AS n FROM pages GROUP BY 1")(lambda spark, d: infer.infer_shapes(table(spark, d, "pages"), "url"))
query("i03_infer_charclass", "WITH c AS (SELECT DISTINCT unnest(string_split(c_name, '')) AS c FROM customer) SELECT '[' || string_agg(c, '' ORDER BY c) || ']' || CASE WHEN (SELECT min(length(c_name)) FROM customer) > 0 THEN '+' ELSE '*' END AS type, count(*) AS n_chars FROM c WHERE c <> ''")(lambda spark, d: infer.infer_charclass(table(spark, d, "customer"), "c_name"))
query("i04_infer_affixes", "WITH e AS (SELECT min(url) AS a, max(url) AS b FROM pages) SELECT substr(a, 1, (SELECT max(i) FROM range(0, 200) t(i) WHERE i <= least(length(a), length(b)) AND substr(a, 1, i) = substr(b, 1, i))) AS prefix, '' AS suffix FROM e")(lambda spark, d: infer.infer_affixes(table(spark, d, "pages"), "url"))


@query(
    "i02_one_pattern",
    f"WITH s AS (SELECT {shape_sql('url')} AS shape, url FROM pages) SELECT CAST(count(DISTINCT shape) AS BIGINT) AS n_shapes, count(DISTINCT shape) <= 24 AS readable, CASE WHEN count(DISTINCT shape) <= 24 THEN count(url) ELSE 0 END AS n_match, CASE WHEN count(DISTINCT shape) <= 24 THEN true END AS shorter FROM s",
)
def i02_one_pattern(spark, d):
    """All URLs match the one pattern of their shapes, which is no longer than the union of these."""
    pages = table(spark, d, "pages")
    n_shapes, pattern = infer.infer_pattern(pages, "url").first()
    union = F.sum(F.length("shape") + 1) - 1
    plain = infer.infer_shapes(pages, "url").agg(union.alias("plain"))
    told = F.lit(pattern)
    hits = pages.agg(F.count_if(matches(F.col("url"), pattern or "[^\\s\\S]")).alias("n_match"))
    return hits.crossJoin(plain).select(F.lit(n_shapes).cast("long").alias("n_shapes"), told.isNotNull().alias("readable"), "n_match", (F.length(told) <= F.col("plain")).alias("shorter"))  # one row each


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CLASS_SQL = """(SELECT '{name}' AS name, CASE WHEN count(*) = 26 THEN '.' WHEN 26 - count(*) <= greatest(12, count(*) // 2) THEN '[^' || (SELECT string_agg(l, '' ORDER BY l) FROM (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS l) WHERE l NOT IN (SELECT c FROM c{i})) || ']'
ELSE '[' || string_agg(c, '' ORDER BY c) || ']' END || CASE WHEN (SELECT min(length(v)) FROM v{i}) > 0 THEN '+' ELSE '*' END AS type, count(*) AS n_chars FROM c{i})"""
_CLASS_VALUES = ["regexp_replace(lower(text), '[^a-z]', '', 'g')", "regexp_replace(lower(text), '[^a-z]|[bnt]', '', 'g')", "regexp_replace(lower(text), '[^aeiou]', '', 'g')"]
_CLASS_SOURCES = ", ".join(f"v{i} AS (SELECT {v} AS v FROM documents), c{i} AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(v, '')) AS c FROM v{i}) WHERE c <> '')" for i, v in enumerate(_CLASS_VALUES))


@query("i03_negated_class", f"WITH {_CLASS_SOURCES} " + " UNION ALL ".join(_CLASS_SQL.format(name=n, i=i) for i, n in enumerate(("all", "lacking", "vowels"))))
def i03_negated(spark, d):
    """Letters of the documents: nearly all of them, all but three or more, and few, in the alphabet a to z."""
    low = table(spark, d, "documents").select(F.lower("text").alias("text"))
    kept = {"all": "[^a-z]", "lacking": "[^a-z]|[bnt]", "vowels": "[^aeiou]"}
    found = [infer.infer_charclass(low.select(F.regexp_replace("text", p, "").alias("v")), "v", _LETTERS).withColumn("name", F.lit(n)) for n, p in kept.items()]
    return reduce(lambda a, b: a.unionByName(b), found).select("name", "type", "n_chars")


_LITERALS = {"prefix": "'order ' || o_orderkey", "suffix": "o_orderkey || '.txt'", "both": "'<' || o_orderkey || '> ok'", "inner": "o_orderkey || '-custkey-' || o_custkey", "any": "CAST(o_orderkey AS VARCHAR)", "singleton": "'same (x)'"}
_LITERAL_SQL = """(WITH v AS (SELECT DISTINCT {v} AS v FROM orders), s AS (SELECT arg_min(v, (length(v), v)) AS short, min(v) AS a, max(v) AS b, min(reverse(v)) AS c, max(reverse(v)) AS d FROM v),
e AS (SELECT *, (SELECT max(i) FROM range(0, 200) t(i) WHERE i <= least(length(a), length(b)) AND substr(a, 1, i) = substr(b, 1, i)) AS p, (SELECT max(i) FROM range(0, 200) t(i) WHERE i <= least(length(c), length(d)) AND substr(c, 1, i) = substr(d, 1, i)) AS q FROM s),
parts AS (SELECT i, n, substr(short, i, n) AS part FROM s, range(1, 200) x(i), range(1, 200) y(n) WHERE i + n - 1 <= length(short)),
common AS (SELECT part FROM parts WHERE NOT EXISTS (SELECT 1 FROM v WHERE NOT contains(v, part)) ORDER BY n DESC, i LIMIT 1)
SELECT '{name}' AS name, CASE WHEN a = b THEN short ELSE substr(a, 1, p) END AS prefix, CASE WHEN a <> b AND p = 0 AND q = 0 THEN coalesce((SELECT part FROM common), '') ELSE '' END AS "inner",
CASE WHEN a = b THEN '' ELSE right(short, least(q, length(short) - p)) END AS suffix FROM e)"""


@query("i04_literal_forms", " UNION ALL ".join(_LITERAL_SQL.format(name=n, v=v) for n, v in _LITERALS.items()))
def i04_literals(spark, d):
    """Values with a common start, end, both, a common text inside, none, and all equal."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    values = {
        "prefix": F.concat(F.lit("order "), key), "suffix": F.concat(key, F.lit(".txt")), "both": F.concat(F.lit("<"), key, F.lit("> ok")), "inner": F.concat(key, F.lit("-custkey-"), customer), "any": key, "singleton": F.lit("same (x)"),
    }
    orders = table(spark, d, "orders")
    found = [infer.infer_literal(orders.select(v.alias("v")), "v").withColumn("name", F.lit(n)) for n, v in values.items()]
    return reduce(lambda a, b: a.unionByName(b), found).select("name", "prefix", "inner", "suffix")


query("i05_summarize_type", f"WITH s AS (SELECT {shape_sql('v')} AS shape, count(*) AS n FROM (SELECT DISTINCT url AS v FROM pages) GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_values, count(*) AS n_shapes, count(*) <= 24 AND sum(length(shape) + 1) <= 4096 AS readable FROM s")(lambda spark, d: infer.summarize_type(table(spark, d, "pages"), "url"))
_CLASSIFIED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) FILTER (WHERE regexp_full_match({c}, '{p}')) AS n_match, count({c}) AS n_values FROM events" for c in ("event_type", "props") for t, p in infer.NAMED_TYPES.items())
query("i06_classify_types", _CLASSIFIED)(lambda spark, d: infer.classify_types(table(spark, d, "events"), ["event_type", "props"]))
query("i06_best_types", f"SELECT \"column\", arg_min(type, (-n_match, type)) AS type, max(n_match) AS n_match FROM ({_CLASSIFIED}) GROUP BY \"column\"")(lambda spark, d: infer.best_types(infer.classify_types(table(spark, d, "events"), ["event_type", "props"])))


@query("i07_define_type", "SELECT DISTINCT event_type AS name, CASE event_type WHEN 'click' THEN 'c+' WHEN 'view' THEN 'v+' ELSE '[^\\n]*' END AS pattern FROM events")
def i07(spark, d):
    names = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    built_in = spark.createDataFrame([("click", "c+")], "name string, pattern string")
    own = spark.createDataFrame([("click", "x"), ("view", "v+")], "name string, pattern string")
    return infer.resolve_types(names, built_in, own)


_SIGNATURES = [(1, "listed", "\\|.*\\|"), (2, "assigned", "[a-z]+ = .*"), (3, "license", "[Ll]icense"), (4, "sentence", "^[A-Z].*\\.$"), (5, "other", "")]


@query("i08_classify_lines", LINES + "SELECT CASE WHEN regexp_matches(line, '\\|.*\\|') THEN 'listed' WHEN regexp_matches(line, '[a-z]+ = .*') THEN 'assigned' WHEN regexp_matches(line, '[Ll]icense') THEN 'license' WHEN regexp_matches(line, '^[A-Z].*\\.$') THEN 'sentence' ELSE 'other' END AS name, count(*) AS n FROM lines GROUP BY 1")
def i08(spark, d):
    return infer.classify_lines(doc_lines(spark, d), spark.createDataFrame(_SIGNATURES, "pos int, name string, pattern string"))


# The ASCII classes in RE2's notation.
_RE2 = {"alnum": "[A-Za-z0-9]", "alpha": "[A-Za-z]", "blank": "[ \\t]", "cntrl": "[\\x00-\\x1F\\x7F]", "digit": "[0-9]", "graph": "[\\x21-\\x7E]", "lower": "[a-z]", "print": "[\\x20-\\x7E]", "punct": "[!-/:-@\\[-`{-~]", "space": "[ \\t\\n\\x0B\\f\\r]", "upper": "[A-Z]", "xdigit": "[0-9A-Fa-f]"}
query("i09_posix_profile", " UNION ALL ".join(f"SELECT '{n}' AS class, CAST(sum(len(regexp_extract_all(url, '{p}'))) AS BIGINT) AS n FROM pages" for n, p in _RE2.items()))(lambda spark, d: infer.posix_profile(table(spark, d, "pages"), "url"))
query("i10_bound_parameters", EVENTS + "SELECT DISTINCT line AS name, CASE line WHEN 'view' THEN '[0-9]' ELSE '[^\\n]*' END AS pattern FROM lines")(
    lambda spark, d: infer.resolve_types(event_lines(spark, d).select(F.col("line").alias("name")).distinct(), spark.createDataFrame([("view", "[0-9]")], "name string, pattern string"), spark.createDataFrame([], "name string, pattern string"))
)
