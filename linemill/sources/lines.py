"""Line frames from text columns, files and literals; sinks for them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linemill.functions.patterns import matches

#: What a path must look like to be read from a stream of paths.
PATH = "[^ \\t]+|\".+\"|'.+'"


def lines_from_column(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text split at line feeds: src (the key), line_no from 1, line. A null text has no lines."""
    return df.select(F.col(key).alias("src"), F.posexplode(F.split(text, "\n", -1)).alias("__at", "line")).select("src", (F.col("__at") + 1).cast("long").alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files, numbered exactly in each file.

    Large files are read in blocks; a line's number is its place in its block
    plus the lines of the blocks before, so no file is numbered in one task.
    Rows keep their file order within a block, which is one task's partition.
    """
    from linemill.plans.storage import materialised

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("__block"), F.col("value").alias("line"))
    held = materialised(raw.withColumn("__id", F.monotonically_increasing_id()))
    blocks = held.groupBy("src", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    order = Window.partitionBy("src").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    return held.join(starts, ["src", "__block"]).select("src", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("line_no"), "line")


def list_files(spark: SparkSession, folder: str, name_glob: str = "*") -> DataFrame:
    """find -name: path, length and modification time of files, without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name_glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", "modificationTime")


def file_stats(files: DataFrame) -> DataFrame:
    """stat: path, size and modification time in seconds."""
    return files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """du: bytes and files of each folder."""
    folder = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)
    return files.groupBy(folder.alias("folder")).agg(F.sum("length").alias("size"), F.count("*").alias("n_files"))


def named_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct paths that a stream of lines names, without their quotes (src), and the lines that name none, with the reason."""
    ok = F.coalesce(matches(F.col("line"), PATH), F.lit(False))
    quoted = F.col("line").rlike("\\A(?:\".+\"|'.+')\\z")
    bare = F.when(quoted, F.substr("line", F.lit(2), F.length("line") - 2)).otherwise(F.col("line"))
    return paths.where(ok).select(bare.alias("src")).distinct(), paths.where(~ok).withColumn("reason", F.lit(f"line outside {PATH}"))


def cat_paths(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """xargs cat: lines of the sources that a stream of paths names. named_paths tells which lines of it are refused."""
    return lines.join(named_paths(paths)[0], "src", "left_semi")


def read_named(spark: SparkSession, paths: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """xargs cat FILE: numbered lines of just the files that a stream of paths names, and the refused lines.

    Spark lists only these files. Their paths come to the driver, which plans
    the scan, counted first and at most so many at a time: more are taken in
    parts by a hash of the path. A named file that isn't there raises an error.
    """
    good, refused = named_paths(paths)
    total = good.count()
    if not total:
        return spark.createDataFrame([], "src string, line_no long, line string"), refused
    parts = -(-total // most)
    read = []
    for i in range(parts):
        own = good.where(F.pmod(F.xxhash64("src"), F.lit(parts)) == i) if parts > 1 else good
        if listed := [r["src"] for r in own.collect()]:
            read.append(read_lines(spark, listed))
    return reduce(DataFrame.unionByName, read), refused


def sequence_lines(spark: SparkSession, first: int, last: int) -> DataFrame:
    """seq: the numbers from first to last."""
    return spark.range(first, last + 1).select(F.col("id").cast("string").alias("line"))


def sequence_joined(first: Column, last: Column, separator: str) -> Column:
    """seq -s: the numbers from first to last in one line."""
    return F.when(last < first, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), lambda x: x.cast("string")), separator))


def echo(df: DataFrame, template: str) -> DataFrame:
    """A line for each row: literal text with $NAME and ${NAME} filled from columns."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+))", template):
        parts += [F.lit(template[at : m.start()]), F.col(m[1] or m[2]).cast("string")]
        at = m.end()
    return df.select(F.concat(*parts, F.lit(template[at:])).alias("line"))


def tee(lines: DataFrame, path: str) -> DataFrame:
    """Write the lines as Parquet and go on with what was written."""
    lines.write.parquet(path)
    return lines.sparkSession.read.parquet(path)


def split_out(lines: DataFrame, n: int, path: str) -> None:
    """split -l n: the k-th n lines of each source in the folder of bucket k."""
    bucket = F.floor((F.col("line_no") - 1) / n).cast("long")
    lines.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)
