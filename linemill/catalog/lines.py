"""Queries of the filters, fields, replacements, order, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from linemill.catalog.registry import COMMAED, EVENTS, LINES, PARTS, TABBED, doc_lines, event_lines, order_records, part_records, query, table
from linemill.functions import charsets, fields, replace
from linemill.functions.patterns import matches
from linemill.operators import aggregate, explode, filters, order, setops
from linemill.plans.stages import compose
from linemill.sources import lines as sources


def _filter(name, frame, step, sql):
    """A query that filters or rewrites the lines of a frame."""
    query(name, sql)(lambda spark, d: step(frame(spark, d)).select("src", "line_no", "line"))


def _project(name, frame, column, sql):
    """A query that rewrites each line by a Column function; sql is the expression in DuckDB."""
    start = {doc_lines: LINES, part_records: PARTS, event_lines: EVENTS}.get(frame, TABBED)
    query(name, f"{start} SELECT src, line_no, {sql} AS line FROM lines")(lambda spark, d: frame(spark, d).select("src", "line_no", column(F.col("line")).alias("line")))


def commaed(spark, d):
    return order_records(spark, d, ",")


ALL = " SELECT src, line_no, line FROM lines "
POSITIONS = LINES + ", placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY line_no) AS pos FROM lines) "

# Sources
query("s02_lines_from_column", LINES + ALL)(doc_lines)


@query("s06_seq", "SELECT CAST(doc_id AS BIGINT) AS src, CASE WHEN doc_id % 20 + 3 < 1 THEN '' ELSE array_to_string(range(1, doc_id % 20 + 4), ' ') END AS line FROM documents")
def s06(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("src"), sources.sequence_joined(F.lit(1).cast("long"), F.col("doc_id") % 20 + 3, " ").alias("line"))


@query("s07_echo", "SELECT 'order ' || CAST(o_orderkey AS VARCHAR) || ' of ' || CAST(o_custkey AS VARCHAR) || '.' AS line FROM orders")
def s07(spark, d):
    return sources.echo(table(spark, d, "orders"), "order $o_orderkey of ${o_custkey}.")


@query("s09_default_if_empty", LINES + ", none AS (SELECT line FROM lines WHERE line LIKE '%no such line%') SELECT line FROM none UNION ALL SELECT line FROM lines WHERE line_no = 1 AND NOT EXISTS (SELECT 1 FROM none)")
def s09(spark, d):
    lines = doc_lines(spark, d).select("line_no", "line")
    return filters.default_if_empty(filters.grep(lines, "no such line"), lines.where("line_no = 1")).select("line")


@query("s11_concat_streams", TABBED + "SELECT 0 AS stream, line FROM lines UNION ALL SELECT 1 AS stream, n_name AS line FROM nation")
def s11(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("line"))
    return setops.concat_streams(order_records(spark, d).select("line"), names).select("stream", "line")


# Predicates and filters
query("f01_matches", LINES + "SELECT src, line_no, regexp_full_match(line, '[A-Z][a-z ,.]+') AS ok FROM lines")(lambda spark, d: doc_lines(spark, d).select("src", "line_no", matches(F.col("line"), "[A-Z][a-z ,.]+").alias("ok")))
_filter("f02_grep", doc_lines, lambda x: filters.grep(x, "[A-Z][a-z]+ing"), LINES + ALL + "WHERE regexp_matches(line, '[A-Z][a-z]+ing')")
_filter("f02_grep_start", doc_lines, lambda x: filters.grep(x, "^The"), LINES + ALL + "WHERE starts_with(line, 'The')")
_filter("f02_grep_end", doc_lines, lambda x: filters.grep(x, "ing\\.$"), LINES + ALL + "WHERE ends_with(line, 'ing.')")
_filter("f03_grep_invert", doc_lines, lambda x: filters.grep(x, "[aeiou]{2}", invert=True), LINES + ALL + "WHERE NOT regexp_matches(line, '[aeiou]{2}')")
_filter("f04_grep_word", doc_lines, lambda x: filters.grep(x, "of", word=True), LINES + ALL + "WHERE regexp_matches(line, '(?:^|[^A-Za-z0-9_])(?:of)(?:[^A-Za-z0-9_]|$)')")
_filter("f05_grep_fixed", doc_lines, lambda x: filters.grep(x, "a. ", fixed=True), LINES + ALL + "WHERE contains(line, 'a. ')")
_filter("f06_grep_several", doc_lines, lambda x: filters.grep(x, "^And", "license", "ing$"), LINES + ALL + "WHERE starts_with(line, 'And') OR contains(line, 'license') OR ends_with(line, 'ing')")


@query("f07_grep_table", LINES + "SELECT src, line_no, line FROM lines WHERE EXISTS (SELECT 1 FROM (SELECT 'z[a-z]' AS p UNION ALL SELECT 'tion\\.' UNION ALL SELECT '[0-9]{4}') q WHERE regexp_matches(line, p))")
def f07(spark, d):
    patterns = spark.createDataFrame([("z[a-z]",), ("tion\\.",), ("[0-9]{4}",)], "pattern string")
    return filters.grep_table(doc_lines(spark, d), patterns).select("src", "line_no", "line")


_filter("f08_grep_numbered", doc_lines, lambda x: filters.grep_numbered(x, "license"), POSITIONS + "SELECT src, line_no, CAST(pos AS VARCHAR) || ':' || line AS line FROM placed WHERE contains(line, 'license')")


@query("f09_set_algebra", LINES + "SELECT src, line_no, (a AND b) AS x_and, (a OR b) AS x_or, (a AND NOT b) AS x_minus, NOT a AS x_not FROM (SELECT *, regexp_full_match(line, '[A-Z][^0-9]*') AS a, regexp_full_match(line, '.*\\.') AS b FROM lines)")
def f09(spark, d):
    a, b = matches(F.col("line"), "[A-Z][^0-9]*"), matches(F.col("line"), ".*\\.")
    return doc_lines(spark, d).select("src", "line_no", filters.both(a, b).alias("x_and"), filters.either(a, b).alias("x_or"), filters.minus(a, b).alias("x_minus"), filters.complement(a).alias("x_not"))


_filter("f10_drop_matching", doc_lines, lambda x: filters.drop_matching(x, "[0-9#*]"), LINES + ALL + "WHERE NOT regexp_matches(line, '[0-9#*]')")
_filter("f11_drop_line", doc_lines, lambda x: filters.drop_line(x, 2), POSITIONS + "SELECT src, line_no, line FROM placed WHERE pos <> 2")


@query("f12_drop_all", LINES + "SELECT 'read' AS lines, count(*) AS n FROM lines UNION ALL SELECT 'kept', 0")
def f12(spark, d):
    """Lines before and after everything is dropped."""
    lines = doc_lines(spark, d)
    counted = lambda name, frame: frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("lines"), "n")
    return counted("read", lines).unionByName(counted("kept", filters.drop_all(lines)))


AWK2 = "coalesce(string_split_regex(regexp_replace(line, '^[ \\t]+|[ \\t]+$', '', 'g'), '[ \\t]+')[{k}], '')"
_filter("f13_awk_match", part_records, lambda x: filters.awk_match(x, "^r", 1), PARTS + ALL + f"WHERE starts_with({AWK2.format(k=1)}, 'r')")
_filter("f13_awk_no_match", part_records, lambda x: filters.awk_match(x, "1", 3, negate=True), PARTS + ALL + f"WHERE NOT contains({AWK2.format(k=3)}, '1')")
_filter("f14_awk_rule", part_records, lambda x: filters.awk_rule(x, (fields.number(fields.field(F.col("line"), 4)) > 20) & (fields.field_count(F.col("line")) == 4)), PARTS + ALL + f"WHERE coalesce(TRY_CAST({AWK2.format(k=4)} AS DOUBLE), 0) > 20 AND len(string_split_regex(regexp_replace(line, '^[ \\t]+|[ \\t]+$', '', 'g'), '[ \\t]+')) = 4")
_filter("f15_awk_position", doc_lines, lambda x: filters.awk_position(x, (F.col("pos") > 1) & (F.col("pos") % 3 == 1)), POSITIONS + "SELECT src, line_no, line FROM placed WHERE pos > 1 AND pos % 3 = 1")
query("f16_is_empty", LINES + "SELECT count(*) = 0 AS is_empty, count(*) > 0 AND count(*) FILTER (WHERE line <> '') = 0 AS all_blank FROM lines")(lambda spark, d: filters.is_empty(doc_lines(spark, d)))

# Fields and characters
_project("p01_cut_fields", order_records, lambda x: fields.cut_fields(x, [3, 1, 9]), "array_to_string([x FOR x IN [string_split(line, chr(9))[1], string_split(line, chr(9))[3]] IF x IS NOT NULL], chr(9))")
_project("p02_cut_ranges", order_records, lambda x: fields.cut_fields(x, [(2, 2), (3, None)]), "array_to_string(string_split(line, chr(9))[2:], chr(9))")
_HEX = "hex(encode(line))"
_WHOLE = "((?:[0-7]. )|(?:[CD]. [89AB]. )|(?:E. (?:[89AB]. ){2})|(?:F. (?:[89AB]. ){3}))|(?:.. )"
_BYTES = f"decode(unhex(replace(regexp_replace(regexp_replace(substr({_HEX}, 1, 6) || substr({_HEX}, 9, 24) || substr({_HEX}, 61), '(..)', '\\1 ', 'g'), '{_WHOLE}', '\\1', 'g'), ' ', '')))"
_project("p03_cut_bytes", doc_lines, lambda x: fields.cut_bytes(x, [(1, 3), (5, 16), (31, None)]), f"CASE WHEN strlen(line) = length(line) THEN substr(line, 1, 3) || substr(line, 5, 12) || substr(line, 31) ELSE {_BYTES} END")
_project("p03_cut_characters", doc_lines, lambda x: fields.cut_characters(x, [1, 3, (5, 8), (20, None)]), "substr(line, 1, 1) || substr(line, 3, 1) || substr(line, 5, 4) || substr(line, 20)")
query("p04_cut_complement", COMMAED + "SELECT src, line_no, array_to_string([string_split(line, ',')[1], string_split(line, ',')[4]], ',') AS line FROM lines")(lambda spark, d: commaed(spark, d).select("src", "line_no", fields.cut_fields(F.col("line"), [(2, 3)], ",", complement=True).alias("line")))
_project("p05_translate", doc_lines, lambda x: charsets.translate(x, "a-e", "xyz"), "translate(line, 'abcde', 'xyzzz')")
_project("p06_translate_complement", doc_lines, lambda x: charsets.translate_complement(x, "[:alpha:] ", "_"), "regexp_replace(line, '[^A-Za-z ]', '_', 'g')")
_project("p07_delete", doc_lines, lambda x: charsets.delete(x, "aeiou"), "regexp_replace(line, '[aeiou]', '', 'g')")
_project("p07_delete_complement", doc_lines, lambda x: charsets.delete(x, "[:lower:]", complement=True), "regexp_replace(line, '[^a-z]', '', 'g')")
_project("p08_squeeze", doc_lines, lambda x: charsets.squeeze(x, "els"), "regexp_replace(regexp_replace(regexp_replace(line, 'e+', 'e', 'g'), 'l+', 'l', 'g'), 's+', 's', 'g')")
_project("p08_translate_squeeze", doc_lines, lambda x: charsets.squeeze(x, "a-c", "x"), "regexp_replace(translate(line, 'abc', 'xxx'), 'x+', 'x', 'g')")
_project("p09_char_sets", doc_lines, lambda x: charsets.translate(x, "[:lower:]", "[:upper:]"), "translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")
_project("p10_reverse", doc_lines, F.reverse, "reverse(line)")
_project("p11_concat", doc_lines, lambda x: F.concat(F.lit("<"), x, F.lit(">")), "'<' || line || '>'")
_project("p12_repeat", event_lines, lambda x: fields.repeat_line(x, 3, "-"), "line || '-' || line || '-' || line")
_filter("p13_compose", doc_lines, compose(lambda x: filters.grep(x, "^[A-Z]"), lambda x: x.withColumn("line", F.lower("line")), lambda x: filters.grep(x, "ing")), LINES + "SELECT src, line_no, lower(line) AS line FROM lines WHERE regexp_matches(line, '^[A-Z]') AND contains(lower(line), 'ing')")
_project("p14_awk_field", part_records, lambda x: fields.field(x, 2), AWK2.format(k=2))
_project("p15_awk_separator", order_records, lambda x: fields.field(x, 3, "-"), "coalesce(string_split(line, '-')[3], '')")
_project("p16_print_fields", part_records, lambda x: fields.print_fields(x, [3, 1]), AWK2.format(k=3) + " || ' ' || " + AWK2.format(k=1))
_FIELDS = "string_split_regex(regexp_replace(line, '^[ \\t]+|[ \\t]+$', '', 'g'), '[ \\t]+')"
query("p17_last_field", PARTS + f"SELECT src, line_no, {_FIELDS}[-1] AS last, CAST(len({_FIELDS}) AS BIGINT) AS nf FROM lines")(lambda spark, d: part_records(spark, d).select("src", "line_no", fields.last_field(F.col("line")).alias("last"), fields.field_count(F.col("line")).alias("nf")))
_project("p18_print_literals", part_records, lambda x: F.concat(F.lit("name="), fields.field(x, 1), F.lit(";")), "'name=' || " + AWK2.format(k=1) + " || ';'")
query("p19_arithmetic", PARTS + f"SELECT src, line_no, n * 2 + 1 AS x, n % 7 AS y, -n AS z FROM (SELECT *, coalesce(TRY_CAST({AWK2.format(k=4)} AS DOUBLE), 0) AS n FROM lines)")(
    lambda spark, d: part_records(spark, d).select("src", "line_no", fields.number(fields.field(F.col("line"), 4)).alias("n")).select("src", "line_no", (F.col("n") * 2 + 1).alias("x"), (F.col("n") % 7).alias("y"), (-F.col("n")).alias("z"))
)
_project("p20_conditional", event_lines, lambda x: F.when(x == "error", F.lit("bad")).otherwise(F.concat(F.lit("ok "), x)), "CASE WHEN line = 'error' THEN 'bad' ELSE 'ok ' || line END")
query("p21_functions", LINES + "SELECT src, line_no, CAST(length(line) AS BIGINT) AS n, sqrt(length(line)) AS root, printf('%05d', length(line)) AS padded FROM lines")(lambda spark, d: doc_lines(spark, d).select("src", "line_no", F.length("line").cast("long").alias("n"), F.sqrt(F.length("line")).alias("root"), F.format_string("%05d", F.length("line")).alias("padded")))
_project("p22_printf", event_lines, lambda x: F.format_string("%-10s|%3d", x, F.length(x)), "rpad(line, CAST(greatest(10, length(line)) AS INTEGER), ' ') || '|' || lpad(CAST(length(line) AS VARCHAR), 3, ' ')")
_WORDS = ", parts AS (SELECT src, line_no, [x FOR x IN string_split_regex(line, '[ \\t]+') IF x <> ''] AS p FROM lines), words AS (SELECT src, line_no, i, p[i] AS line FROM parts, LATERAL unnest(range(1, len(p) + 1)) t(i)) SELECT src, row_number() OVER (PARTITION BY src ORDER BY line_no, i) AS line_no, line FROM words"
_filter("p23_words_per_line", doc_lines, explode.words_per_line, LINES + _WORDS)
_filter("p24_fold", doc_lines, lambda x: explode.fold(x, 60), LINES + ", cuts AS (SELECT src, line_no, i, substr(line, i, 60) AS line FROM lines, LATERAL unnest(range(1, greatest(1, length(line)) + 1, 60)) t(i)) SELECT src, row_number() OVER (PARTITION BY src ORDER BY line_no, i) AS line_no, line FROM cuts")
_project("p25_expand", part_records, lambda x: fields.expand_tabs(x, 8), "rpad(string_split(line, chr(9))[1], CAST(floor(length(string_split(line, chr(9))[1]) / 8.0) * 8 + 8 AS INTEGER), ' ') || string_split(line, chr(9))[2]")
_project("p25_unexpand", part_records, lambda x: fields.unexpand(x, 2), "chr(9) || substr(line, 3)")
query("p26_paths", "SELECT page_id, regexp_extract(u, '([^/]*)$', 1) AS base, regexp_extract(u, '^(.*)/[^/]*$', 1) AS dir FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS u FROM pages)")(lambda spark, d: table(spark, d, "pages").select("page_id", fields.basename(F.col("url")).alias("base"), fields.dirname(F.col("url")).alias("dir")))
query("p27_base64", LINES + "SELECT src, line_no, to_base64(encode(line)) AS coded, line AS decoded FROM lines")(lambda spark, d: doc_lines(spark, d).select("src", "line_no", fields.to_base64(F.col("line")).alias("coded")).withColumn("decoded", fields.from_base64(F.col("coded"))))

# Replacement and extraction
_project("r01_first_literal", doc_lines, lambda x: replace.substitute(x, "th", "TH"), "regexp_replace(line, 'th', 'TH')")
_project("r02_all_literal", doc_lines, lambda x: replace.substitute(x, "the", "$1", everywhere=True), "replace(line, 'the', '$1')")
_project("r03_first_pattern", doc_lines, lambda x: replace.substitute(x, "[aeiou]+", "#"), "regexp_replace(line, '[aeiou]+', '#')")
_project("r04_all_pattern", doc_lines, lambda x: replace.substitute(x, "[aeiou]+", "#", everywhere=True), "regexp_replace(line, '[aeiou]+', '#', 'g')")
_project("r05_prefix", doc_lines, lambda x: replace.substitute(x, "^[A-Z]+", "*"), "regexp_replace(line, '^[A-Z]+', '*')")
_project("r06_suffix", doc_lines, lambda x: replace.substitute(x, "[a-z.]+$", "*"), "regexp_replace(line, '[a-z.]+$', '*')")
_project("r07_whole", event_lines, lambda x: replace.substitute(x, "^c[a-z]+k$", "tap"), "CASE WHEN regexp_full_match(line, 'c[a-z]+k') THEN 'tap' ELSE line END")
_project("r08_edges", event_lines, lambda x: replace.substitute(replace.substitute(x, "^", ">"), "$", "<"), "'>' || line || '<'")
_filter("r09_commands", doc_lines, compose(lambda x: filters.drop_line(x, 1), lambda x: x.withColumn("line", replace.substitute(F.col("line"), "an", "AN")), lambda x: filters.drop_matching(x, "[0-9]")), POSITIONS + "SELECT src, line_no, regexp_replace(line, 'an', 'AN') AS line FROM placed WHERE pos <> 1 AND NOT regexp_matches(line, '[0-9]')")
_project("r10_groups", doc_lines, lambda x: replace.substitute_groups(x, "([a-z]+) ([a-z]+)", "\\2 \\1", everywhere=True), "regexp_replace(line, '([a-z]+) ([a-z]+)', '\\2 \\1', 'g')")
_filter("r11_only_matching", doc_lines, lambda x: explode.only_matching(x, "[A-Z][a-z]+"), LINES + ", parts AS (SELECT src, line_no, regexp_extract_all(line, '[A-Z][a-z]+') AS p FROM lines), words AS (SELECT src, line_no, i, p[i] AS line FROM parts, LATERAL unnest(range(1, len(p) + 1)) t(i)) SELECT src, row_number() OVER (PARTITION BY src ORDER BY line_no, i) AS line_no, line FROM words")
_filter("r12_extract", doc_lines, lambda x: explode.extract_lines(x, "[a-z]+ing"), LINES + "SELECT src, line_no, regexp_extract(line, '[a-z]+ing') AS line FROM lines WHERE regexp_matches(line, '[a-z]+ing')")


@query("r13_preimage", EVENTS + "SELECT src, line_no, line FROM lines WHERE regexp_replace(line, '[aeiou]', '', 'g') IN ('clck', 'vw')")
def r13(spark, d):
    wanted = spark.createDataFrame([("clck",), ("vw",)], "line string")
    return setops.preimage(event_lines(spark, d), lambda x: charsets.delete(x, "aeiou"), wanted).select("src", "line_no", "line")


# Order
query("d01_number_lines", LINES + "SELECT line, row_number() OVER (ORDER BY line) AS n FROM lines")(lambda spark, d: order.number_lines(doc_lines(spark, d).select("line"), "line").select("line", "n"))
query("d02_sort", EVENTS + "SELECT line, row_number() OVER (ORDER BY line) AS rank FROM lines")(lambda spark, d: order.sort_lines(event_lines(spark, d)))
query("d03_sort_numeric", TABBED + ", keyed AS (SELECT line, coalesce(TRY_CAST(regexp_extract(line, '^[ \\t]*([-+]?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE), 0) AS key FROM lines) SELECT line, key, row_number() OVER (ORDER BY key, line) AS rank FROM keyed")(lambda spark, d: order.sort_numeric(order_records(spark, d)))


@query("d04_sort_human", "WITH keyed AS (SELECT CAST(p_size AS VARCHAR) || ['', 'K', 'M'][p_partkey % 3 + 1] || ' ' || p_name AS line, p_size * [1.0, 1000.0, 1000000.0][p_partkey % 3 + 1] AS k FROM part) SELECT line, CAST(k AS DOUBLE) AS key, row_number() OVER (ORDER BY k, line) AS rank FROM keyed")
def d04(spark, d):
    unit = F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("M")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return order.sort_human(table(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), unit, F.lit(" "), F.col("p_name")).alias("line")))


_filter("d05_head", doc_lines, lambda x: order.head(x, 3), POSITIONS + "SELECT src, line_no, line FROM placed WHERE pos <= 3")
_filter("d05_head_of_large_sources", event_lines, lambda x: order.head(x, 3), EVENTS + ALL + "QUALIFY row_number() OVER (PARTITION BY src ORDER BY line_no) <= 3")
_filter("d06_tail", doc_lines, lambda x: order.tail(x, 3), LINES + ALL + "QUALIFY row_number() OVER (PARTITION BY src ORDER BY line_no DESC) <= 3")
_filter("d06_tail_from", doc_lines, lambda x: order.tail_from(x, 4), POSITIONS + "SELECT src, line_no, line FROM placed WHERE pos >= 4")
_filter("d07_reverse_lines", doc_lines, order.reverse_lines, LINES + "SELECT src, max(line_no) OVER (PARTITION BY src) - line_no + 1 AS line_no, line FROM lines")
query("d08_shuffle", EVENTS + "SELECT src, line_no, line FROM lines")(lambda spark, d: order.shuffle_lines(event_lines(spark, d), 7).drop("place"))
_filter("d09_numbered", doc_lines, order.numbered, POSITIONS + "SELECT src, line_no, ' ' || lpad(CAST(pos AS VARCHAR), CAST(greatest(6, length(CAST(pos AS VARCHAR))) AS INTEGER), ' ') || '  ' || line AS line FROM placed")
query("d10_shortest_examples", LINES + "SELECT line FROM (SELECT DISTINCT line FROM lines) ORDER BY length(line), line LIMIT 4")(lambda spark, d: order.shortest_examples(doc_lines(spark, d)))

# Aggregation
query("a01_word_count", LINES + "SELECT src, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(line, '\\S+'))) AS BIGINT) AS n_words, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes FROM lines GROUP BY src")(lambda spark, d: aggregate.word_count(doc_lines(spark, d)))
query("a02_count_found", LINES + "SELECT src, count(*) FILTER (WHERE regexp_matches(line, '[A-Z]{2}')) AS n FROM lines GROUP BY src")(lambda spark, d: aggregate.count_found(doc_lines(spark, d), "[A-Z]{2}"))
_RUNS = EVENTS + ", f AS (SELECT *, CASE WHEN {key} = lag({key}) OVER (PARTITION BY src ORDER BY line_no) THEN 0 ELSE 1 END AS c FROM lines), r AS (SELECT *, sum(c) OVER (PARTITION BY src ORDER BY line_no) AS run FROM f), g AS (SELECT src, run, min(line_no) AS line_no, arg_min(line, line_no) AS line, count(*) AS n FROM r GROUP BY src, run) "
RUNS = _RUNS.format(key="line")
_filter("a03_uniq", event_lines, aggregate.uniq, RUNS + "SELECT src, line_no, line FROM g")
_filter("a04_uniq_counted", event_lines, aggregate.uniq_counted, RUNS + "SELECT src, line_no, lpad(CAST(n AS VARCHAR), CAST(greatest(7, length(CAST(n AS VARCHAR))) AS INTEGER), ' ') || ' ' || line AS line FROM g")
_filter("a05_uniq_repeated", event_lines, lambda x: aggregate.uniq(x, only="repeated"), RUNS + "SELECT src, line_no, line FROM g WHERE n > 1")
_filter("a05_uniq_single", event_lines, lambda x: aggregate.uniq(x, only="single"), RUNS + "SELECT src, line_no, line FROM g WHERE n = 1")
_filter("a05_uniq_all_repeated", event_lines, aggregate.uniq_all_repeated, RUNS + "SELECT r.src, r.line_no, r.line FROM r JOIN g ON r.src = g.src AND r.run = g.run WHERE n > 1")
_filter("a06_uniq_key", event_lines, lambda x: aggregate.uniq(x, aggregate.run_key(F.col("line"), ignore_case=True, first=1)), _RUNS.format(key="lower(substr(line, 1, 1))") + "SELECT src, line_no, line FROM g")
query("a04_runs_of_large_sources", RUNS + "SELECT src, line_no, line, n FROM g")(lambda spark, d: aggregate.runs(event_lines(spark, d)))
query("a07_line_counts", LINES + "SELECT line, count(*) AS n FROM lines GROUP BY line")(lambda spark, d: aggregate.line_counts(doc_lines(spark, d)))
query("a08_paste_serial", LINES + "SELECT src, string_agg(line, '|' ORDER BY line_no) AS line FROM lines GROUP BY src")(lambda spark, d: aggregate.paste_serial(doc_lines(spark, d), "|"))
query("a09_xargs_echo", EVENTS + "SELECT src, string_agg(line, ' ' ORDER BY line_no) AS line FROM lines GROUP BY src")(lambda spark, d: aggregate.paste_serial(event_lines(spark, d), " "))


@query("a10_grouped_stats", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(avg(value) - 1.96 * sqrt(var_pop(value)) / sqrt(count(*)), 6) AS band_low, round(avg(value) + 1.96 * sqrt(var_pop(value)) / sqrt(count(*)), 6) AS band_high FROM events GROUP BY event_type")
def a10(spark, d):
    stats = aggregate.grouped_stats(table(spark, d, "events"), "event_type", "value")
    return stats.select("event_type", "n", F.round("total", 3).alias("total"), "low", "high", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "band_low", "band_high")])


query("a11_longest_line", LINES + "SELECT src, CAST(max(length(line)) AS BIGINT) AS longest FROM lines GROUP BY src")(lambda spark, d: aggregate.longest_line(doc_lines(spark, d)))
query("a12_digests", "SELECT doc_id, md5(text) || '  -' AS md5, sha1(text) || '  -' AS sha1, sha256(text) || '  -' AS sha256 FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", *[aggregate.digest_line(F.col("text"), k).alias(k) for k in ("md5", "sha1", "sha256")]))
query("a12_long_digests")(lambda spark, d: table(spark, d, "documents").select("doc_id", *[aggregate.digest_line(F.col("text"), k).alias(k) for k in ("sha224", "sha384", "sha512")]))


@query("a13_verify_digests", "SELECT doc_id AS src, CASE WHEN doc_id % 10 = 0 THEN 'FAILED' ELSE 'OK' END AS status FROM documents")
def a13(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("src"), "text")
    expected = docs.select("src", aggregate.digest(F.when(F.col("src") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "md5").alias("digest"))
    return aggregate.verify_digests(docs.select("src", aggregate.digest(F.col("text"), "md5").alias("digest")), expected)


query("a15_sum_integers", "SELECT CAST(sum(o_custkey) FILTER (WHERE o_orderstatus <> 'P') AS BIGINT) AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_bad FROM orders")(
    lambda spark, d: aggregate.sum_integers(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", F.lit("x")).otherwise(F.col("o_custkey").cast("string")).alias("line")))
)

# Joins and set operations: lines of even and of odd sources
_SPLIT = EVENTS + ", a AS (SELECT line || CAST(line_no % 97 AS VARCHAR) AS line FROM lines WHERE src % 2 = 0), b AS (SELECT line || CAST(line_no % 89 AS VARCHAR) AS line FROM lines WHERE src % 2 = 1) "


def _split(spark, d):
    lines = event_lines(spark, d)
    side = lambda r, m: lines.where(F.col("src") % 2 == r).select(F.concat("line", (F.col("line_no") % m).cast("string")).alias("line"))
    return side(0, 97), side(1, 89)


query("j01_comm", _SPLIT + ", c AS (SELECT line, sum(x) AS x, sum(y) AS y FROM (SELECT line, 1 AS x, 0 AS y FROM a UNION ALL SELECT line, 0, 1 FROM b) GROUP BY line) SELECT line, CAST(greatest(x - y, 0) AS BIGINT) AS only_a, CAST(greatest(y - x, 0) AS BIGINT) AS only_b, CAST(least(x, y) AS BIGINT) AS in_both FROM c")(lambda spark, d: setops.comm(*_split(spark, d)))


@query("j02_join", "SELECT CAST(c_nationkey AS VARCHAR) || ' ' || CAST(c_custkey AS VARCHAR) || ' ' || c_mktsegment || ' ' || n_name AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j02(spark, d):
    customers = table(spark, d, "customer").select(F.concat_ws(" ", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("line"))
    nations = table(spark, d, "nation").select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    return setops.join_lines(customers, nations, 2, 1)


@query("j03_paste", LINES + ", a AS (SELECT src, line, row_number() OVER (PARTITION BY src ORDER BY line_no) AS pos FROM lines WHERE line_no % 2 = 1), b AS (SELECT src, line, row_number() OVER (PARTITION BY src ORDER BY line_no) AS pos FROM lines WHERE line_no % 2 = 0) SELECT coalesce(a.src, b.src) AS src, coalesce(a.pos, b.pos) AS line_no, coalesce(a.line, '') || chr(9) || coalesce(b.line, '') AS line FROM a FULL JOIN b ON a.src = b.src AND a.pos = b.pos")
def j03(spark, d):
    lines = doc_lines(spark, d)
    return setops.paste(lines.where("line_no % 2 = 1"), lines.where("line_no % 2 = 0"))


query("j04_intersect", _SPLIT + "SELECT line FROM a INTERSECT SELECT line FROM b")(lambda spark, d: setops.intersect(*_split(spark, d)))
query("j05_subtract", _SPLIT + "SELECT line FROM a EXCEPT ALL SELECT line FROM b")(lambda spark, d: setops.subtract(*_split(spark, d)))
query("j06_union", _SPLIT + "SELECT line FROM a UNION SELECT line FROM b")(lambda spark, d: setops.union(*_split(spark, d)))
