"""Operators that make several lines of one, numbered anew in their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.functions.patterns import pattern
from linemill.functions.replace import all_matches
from linemill.operators.large import with_position, with_start


def _exploded(lines: DataFrame, parts: Column) -> DataFrame:
    """The parts of each line, an array made of the column line, as lines.

    Whole lines are ordered, with the number of their parts; a part's number is
    that of the parts before its line and its place in it, so parts are not
    moved. Only lines that have one number in one source, whose first parts come
    first, then the second ones, have their parts ordered among themselves.
    """
    placed, ties = with_start(lines.select("src", "line_no", "line"), F.size(parts), "__start", "__tied")
    parted = lambda rows: rows.select("src", F.col("line_no").alias("__line"), "__start", F.posexplode(parts).alias("__sub", "line"))
    alone = parted(placed.where("not __tied")).select("src", (F.col("__start") + F.col("__sub") + 1).alias("line_no"), "line")
    if not ties:
        return alone
    among = with_position(parted(placed.where("__tied")), "__place", ("src", "__line"), ("__sub",))
    return alone.unionByName(among.select("src", (F.col("__start") + F.col("__place")).alias("line_no"), "line"))


def only_matching(lines: DataFrame, p: str) -> DataFrame:
    """grep -o: each match as a line."""
    parts = all_matches(F.col("line"), p).alias("line")  # carried in place of their lines, which are mostly larger
    return _exploded(lines.where(F.col("line").rlike(pattern(p))).select("src", "line_no", parts), F.col("line"))


def extract_lines(lines: DataFrame, p: str) -> DataFrame:
    """Lines reduced to the first match; lines without one are dropped."""
    return lines.where(F.col("line").rlike(pattern(p))).withColumn("line", F.regexp_extract("line", pattern(p), 0))


def words_per_line(lines: DataFrame) -> DataFrame:
    """fmt -w 1: one blank-separated word in a line."""
    return _exploded(lines, F.array_remove(F.split("line", "[ \\t]+"), ""))


def fold(lines: DataFrame, width: int) -> DataFrame:
    """Lines cut to a width; an empty line stays."""
    n = F.greatest(F.lit(1), F.length("line"))
    return _exploded(lines, F.transform(F.sequence(F.lit(1), n, F.lit(width)), lambda i: F.substr(F.col("line"), i, F.lit(width))))
