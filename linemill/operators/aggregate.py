"""Counts, runs, joined lines, statistics and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.functions.patterns import found
from linemill.operators import large


def word_count(lines: DataFrame) -> DataFrame:
    """wc: lines, words and bytes (with line feeds) of each source."""
    return lines.groupBy("src").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.regexp_count("line", F.lit(r"[^ \t\n\x0B\f\r]+"))).cast("long").alias("n_words"),
        F.sum(F.octet_length("line") + 1).cast("long").alias("n_bytes"),
    )


def count_found(lines: DataFrame, p: str) -> DataFrame:
    """grep -c for each source."""
    return lines.groupBy("src").agg(F.count_if(found(F.col("line"), p)).alias("n"))


def run_key(line: Column, ignore_case: bool = False, first: int | None = None, skip_chars: int = 0, skip_fields: int = 0) -> Column:
    """What uniq compares: without leading fields, then characters, of a width, case folded."""
    if skip_fields:
        line = F.regexp_replace(line, f"\\A(?:[ \\t]*[^ \\t]+){{0,{skip_fields}}}", "")
    if skip_chars:
        line = F.substring(line, skip_chars + 1, 2**31 - 1)
    if first is not None:
        line = F.substring(line, 1, first)
    return F.lower(line) if ignore_case else line


def runs(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """Runs of adjacent lines of equal key: src, line_no and line of the first, and the length n."""
    return large.runs(lines.select("src", "line_no", "line"), key)


def uniq(lines: DataFrame, key: Column | None = None, only: str | None = None) -> DataFrame:
    """The first line of each run; only 'repeated' or 'single' runs if asked."""
    kept = runs(lines, key)
    kept = kept.where("n > 1") if only == "repeated" else kept.where("n = 1") if only == "single" else kept
    return kept.select("src", "line_no", "line")


def uniq_counted(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """uniq -c: the run's length, seven wide, before its line."""
    width = F.greatest(F.lit(7), F.length(F.col("n").cast("string")))
    return runs(lines, key).select("src", "line_no", F.concat(F.lpad(F.col("n").cast("string"), width, F.lit(" ")), F.lit(" "), F.col("line")).alias("line"))


def uniq_all_repeated(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """uniq -D: all lines of runs of more than one."""
    return large.repeated(lines, key)


def line_counts(lines: DataFrame) -> DataFrame:
    """sort | uniq -c in one hash aggregate."""
    return lines.groupBy("line").agg(F.count("*").alias("n"))


def paste_serial(lines: DataFrame, delimiter: str = "\t") -> DataFrame:
    """paste -s: the lines of each source in one."""
    held = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("src").agg(held.alias("__held")).select("src", F.array_join(F.transform("__held", lambda x: x["line"]), delimiter).alias("line"))


def grouped_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """count, sum, min, max, mean, variance and the 95 percent band of the mean for each key."""
    stats = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")
    )
    half = 1.96 * F.sqrt("variance") / F.sqrt("n")
    return stats.withColumn("band_low", F.col("mean") - half).withColumn("band_high", F.col("mean") + half)


def longest_line(lines: DataFrame) -> DataFrame:
    """The length of each source's longest line."""
    return lines.groupBy("src").agg(F.max(F.length("line")).cast("long").alias("longest"))


def digest(value: Column, kind: str) -> Column:
    """Hexadecimal digest of a text's bytes: md5, sha1, sha224, sha256, sha384 or sha512."""
    raw = F.encode(value, "utf-8")
    if kind == "md5":
        return F.md5(raw)
    return F.sha1(raw) if kind == "sha1" else F.sha2(raw, int(kind.removeprefix("sha")))


def digest_line(value: Column, kind: str) -> Column:
    """The digest as the command prints it for standard input."""
    return F.concat(digest(value, kind), F.lit("  -"))


def verify_digests(found_: DataFrame, expected: DataFrame) -> DataFrame:
    """OK or FAILED for each expected (src, digest)."""
    joined = expected.join(found_.withColumnRenamed("digest", "__digest"), "src", "left")
    return joined.select("src", F.when(F.col("digest") == F.col("__digest"), "OK").otherwise("FAILED").alias("status"))


def sum_integers(lines: DataFrame) -> DataFrame:
    """The sum of lines that are integers, and how many are not."""
    integer = F.col("line").rlike(r"\A[-+]?[0-9]+\z")
    return lines.agg(F.sum(F.when(integer, F.col("line").try_cast("long"))).alias("total"), F.count_if(~integer).alias("n_bad"))
