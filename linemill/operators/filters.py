"""Filters on lines. Every one keeps the columns of its frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.functions.fields import field
from linemill.functions.patterns import found, pattern
from linemill.operators.large import with_position

#: The edge of a word for grep -w.
_EDGE = "[^A-Za-z0-9_]"


def grep(lines: DataFrame, *patterns: str, invert: bool = False, word: bool = False, fixed: bool = False, ignore_case: bool = False) -> DataFrame:
    """Lines in which any of the patterns is found; each keeps its own anchors."""
    line = F.col("line")

    def one(p: str) -> Column:
        if fixed and not word:
            return F.contains(F.lower(line), F.lit(p.lower())) if ignore_case else F.contains(line, F.lit(p))
        if word:
            body = F.lit(("(?i)" if ignore_case else "") + f"(?:\\A|{_EDGE})(?:{pattern(p)})(?:{_EDGE}|\\z)")
            return F.rlike(line, body)
        return found(line, p, ignore_case)

    hit = reduce(lambda a, b: a | b, map(one, patterns))
    return lines.where(~hit if invert else hit)


def grep_table(lines: DataFrame, patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Lines in which any pattern of a table is found.

    Patterns can't be hashed, so the table is broadcast, in chunks of about
    10,000 rows; lines that one chunk has found are not matched with the next.
    """
    rows = patterns.select(F.col(column).alias("__pattern")).distinct()
    chunks = pattern_chunks(rows, "__pattern")
    hits, open_ = [], lines
    for number, chunk in enumerate(chunks):
        hits.append(open_.join(F.broadcast(chunk), F.expr("line rlike __pattern"), "left_semi"))
        if number + 1 < len(chunks):
            open_ = open_.join(F.broadcast(chunk), F.expr("line rlike __pattern"), "left_anti")
    return reduce(DataFrame.unionByName, hits)


def pattern_chunks(patterns: DataFrame, column: str, most: int = 10_000) -> list[DataFrame]:
    """The table in parts of about so many rows, so that each can be broadcast."""
    parts = max(1, -(-patterns.count() // most))
    if parts == 1:
        return [patterns]
    return [patterns.where(F.pmod(F.xxhash64(column), F.lit(parts)) == i) for i in range(parts)]


def grep_numbered(lines: DataFrame, p: str) -> DataFrame:
    """Found lines with their number in front."""
    numbered = grep(with_position(lines), p)
    return numbered.withColumn("line", F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("line"))).drop("pos")


def both(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def minus(condition: Column, *others: Column) -> Column:
    return reduce(lambda a, b: a & ~b, others, condition)


def complement(condition: Column) -> Column:
    return ~condition


def drop_matching(lines: DataFrame, p: str) -> DataFrame:
    """sed '/p/d'."""
    return grep(lines, p, invert=True)


def drop_line(lines: DataFrame, n: int) -> DataFrame:
    """sed 'Nd': all but line n of each source."""
    return with_position(lines).where(F.col("pos") != n).drop("pos")


def drop_all(lines: DataFrame) -> DataFrame:
    """sed 'd'."""
    return lines.where(F.lit(False))


def awk_match(lines: DataFrame, p: str, k: int = 0, separator: str | None = None, negate: bool = False) -> DataFrame:
    """awk '$k ~ /p/' (k 0 is the line), or !~."""
    hit = found(field(F.col("line"), k, separator), p)
    return lines.where(~hit if negate else hit)


def awk_rule(lines: DataFrame, condition: Column) -> DataFrame:
    """awk 'expr': a condition over field(), number(), field_count() and the position column."""
    return lines.where(condition)


def awk_position(lines: DataFrame, condition: Column) -> DataFrame:
    """awk 'NR...': a condition on the column pos."""
    return with_position(lines).where(condition).drop("pos")


def is_empty(lines: DataFrame) -> DataFrame:
    """One row: is_empty, and all_blank if only empty lines are there."""
    return lines.agg((F.count("*") == 0).alias("is_empty"), ((F.count("*") > 0) & (F.count_if(F.col("line") != "") == 0)).alias("all_blank"))


def default_if_empty(lines: DataFrame, default: DataFrame) -> DataFrame:
    """The default lines if there are none."""
    return lines.unionByName(default.join(lines.limit(1).select(F.lit(1).alias("__some")), F.lit(True), "left_anti"))
