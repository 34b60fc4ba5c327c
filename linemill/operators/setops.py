"""Joins and set operations on streams of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.functions.fields import char_fields
from linemill.operators.large import with_position


def comm(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each line how often it is only in a, only in b, and in both."""
    both = a.select("line", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("line", F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = both.groupBy("line").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return counts.select("line", F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("only_a"), F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("only_b"), F.least("x", "y").alias("in_both"))


def join_lines(a: DataFrame, b: DataFrame, key_a: int = 1, key_b: int = 1, delimiter: str = " ") -> DataFrame:
    """Lines of equal key field: the key, a's other fields, b's other fields."""

    def keyed(lines: DataFrame, k: int, rest: str) -> DataFrame:
        parts = char_fields(F.col("line"), delimiter)
        return lines.select(F.get(parts, F.lit(k - 1)).alias("key"), F.filter(parts, lambda x, i: i != k - 1).alias(rest))

    joined = keyed(a, key_a, "__a").join(keyed(b, key_b, "__b"), "key")
    return joined.select(F.array_join(F.concat(F.array("key"), "__a", "__b"), delimiter).alias("line"))


def paste(a: DataFrame, b: DataFrame, delimiter: str = "\t") -> DataFrame:
    """The n-th line of a source in a beside that in b; the longer one goes on alone."""
    left = with_position(a).select("src", "pos", F.col("line").alias("__a"))
    right = with_position(b).select("src", "pos", F.col("line").alias("__b"))
    joined = left.join(right, ["src", "pos"], "full_outer")
    return joined.select("src", F.col("pos").alias("line_no"), F.concat(F.coalesce("__a", F.lit("")), F.lit(delimiter), F.coalesce("__b", F.lit(""))).alias("line"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct lines of both."""
    return a.select("line").intersect(b.select("line"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of a, each as often as a has more of it."""
    return a.select("line").exceptAll(b.select("line"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct lines of either."""
    return a.select("line").union(b.select("line")).distinct()


def concat_streams(*streams: DataFrame) -> DataFrame:
    """All lines of the first stream, then of the next; stream tells which."""
    out = None
    for i, one in enumerate(streams):
        mine = one.withColumn("stream", F.lit(i))
        out = mine if out is None else out.unionByName(mine)
    return out


def preimage(lines: DataFrame, image, wanted: DataFrame) -> DataFrame:
    """Lines whose image under a Column function is among the wanted lines."""
    return lines.withColumn("__image", image(F.col("line"))).join(wanted.select(F.col("line").alias("__image")).distinct(), "__image", "left_semi").drop("__image")
