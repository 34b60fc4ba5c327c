"""Order, numbering and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linemill.operators.large import ranged, ranks, with_position


def number_lines(rows: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """An exact global numbering from 1 in the given order, without a single-partition sort of all rows.

    Rows are range-partitioned and sorted, counted by partition, and numbered in
    their partition after the rows of those before. The order must be total, or
    equal rows be interchangeable. The sorted rows are materialised, since
    partition numbers must not move between the count and the numbering. Where
    the order names all columns, equal rows are counted and ranked together.
    """
    if all(isinstance(o, str) for o in order) and {*order} == {*rows.columns}:
        return ranks(rows, *order, name=name)
    spark = rows.sparkSession
    held = ranged(rows, *order, numbered=True)
    counts = held.groupBy("__part").count().collect()  # one row for each partition
    before, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["__part"]):
        offsets.append((r["__part"], before))
        before += r["count"]
    start = spark.createDataFrame(offsets, "__part int, __before long")
    # monotonically_increasing_id counts a partition's rows in its low 33 bits.
    return held.join(F.broadcast(start), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__at", "__before")


def sort_lines(lines: DataFrame) -> DataFrame:
    """Byte order of lines, with the rank of each."""
    return number_lines(lines.select("line"), "line", name="rank")


def leading_number(line: Column) -> Column:
    """The number a line starts with, 0 if none."""
    return F.coalesce(F.regexp_extract(line, r"\A[ \t]*([-+]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def sort_numeric(lines: DataFrame) -> DataFrame:
    """By leading number, ties by line, with the rank of each."""
    keyed = lines.select("line", leading_number(F.col("line")).alias("key"))
    return number_lines(keyed, "key", "line", name="rank")


#: Unit suffixes of human-readable sizes.
UNITS = {"K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}


def human_number(line: Column) -> Column:
    """The number a line starts with, times its unit K, M, G or T."""
    unit = F.lit(1.0)
    for name, size in UNITS.items():
        unit = F.when(F.regexp_extract(line, r"\A[ \t]*[-+]?[0-9.]+([KMGT]?)", 1) == name, F.lit(size)).otherwise(unit)
    return leading_number(line) * unit


def sort_human(lines: DataFrame) -> DataFrame:
    """By number with unit, ties by line, with the rank of each."""
    keyed = lines.select("line", human_number(F.col("line")).alias("key"))
    return number_lines(keyed, "key", "line", name="rank")


def head(lines: DataFrame, n: int = 10) -> DataFrame:
    """The first n lines of each source."""
    return with_position(lines).where(F.col("pos") <= n).drop("pos")


def tail(lines: DataFrame, n: int = 10) -> DataFrame:
    """The last n lines of each source."""
    return with_position(lines, "__last", order=(F.desc("line_no"),)).where(F.col("__last") <= n).drop("__last")


def tail_from(lines: DataFrame, n: int) -> DataFrame:
    """Each source from its line n on."""
    return with_position(lines).where(F.col("pos") >= n).drop("pos")


def reverse_lines(lines: DataFrame) -> DataFrame:
    """tac: each source's lines from last to first."""
    most = lines.groupBy("src").agg(F.max("line_no").alias("__most"))
    return lines.join(most, "src").withColumn("line_no", F.col("__most") - F.col("line_no") + 1).drop("__most")


def shuffle_lines(lines: DataFrame, seed: int) -> DataFrame:
    """A permutation fixed by the seed, as line numbers of one source."""
    keyed = lines.select("src", "line_no", "line", F.xxhash64(F.lit(seed), "src", "line_no").alias("__key"))
    return number_lines(keyed, "__key", "src", "line_no", name="place").drop("__key")


def numbered(lines: DataFrame) -> DataFrame:
    """nl: each line with its number in front, six wide."""
    width = F.greatest(F.lit(6), F.length(F.col("pos").cast("string")))
    shown = F.concat(F.lit(" "), F.lpad(F.col("pos").cast("string"), width, F.lit(" ")), F.lit("  "), F.col("line"))
    return with_position(lines).withColumn("line", shown).drop("pos")


def shortest_examples(lines: DataFrame, k: int = 4) -> DataFrame:
    """The k shortest distinct lines."""
    return lines.select("line").distinct().orderBy(F.length("line"), "line").limit(k)
