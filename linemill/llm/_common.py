"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is absent a local temporary folder is made once and given
    to the session, if that runs on one machine, as in tests; on a cluster a
    RuntimeError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-linemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new empty folder under the shared folder."""
    found = f"{shared_dir(spark)}/linemill-{what}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return found


def broadcast_up_to(small: DataFrame, most_rows: int) -> DataFrame:
    """The frame with a broadcast hint if it is counted to have few rows, else as it is."""
    return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, many: int = 1_000, most: int = 100_000) -> DataFrame:
    """Rows with the columns of the group of their key; rows of no group are left out.

    groups has one row for each key, with its number of rows in size; total is
    at least the sum of sizes. Large groups are broadcast, so their rows are not
    shuffled to one task; so few sizes exceed max(many, total / most) that these
    are at most `most` groups. Use a materialised groups, as it is read twice.
    """
    large = F.col(size) > max(many, total // most)
    names = [name for name in groups.columns if name != key]
    hot = F.broadcast(groups.where(large).select(key, F.struct(*names).alias("__group")))
    marked = rows.join(hot, key, "left")
    met = marked.where("__group is not null").select(*rows.columns, *[F.col(f"__group.{name}").alias(name) for name in names])
    others = marked.where("__group is null").select(*rows.columns).join(groups.where(~large), key)
    return met.unionByName(others)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block lasts."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder.

    The shuffle files of the job that writes it go at its end: what comes after
    reads the checkpoint, and otherwise they stay until the driver happens to
    collect its garbage.
    """
    shared_dir(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        # A frame takes the setting when it is made, and no one else holds this one.
        return df.select("*").checkpoint(eager=True)


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo folds; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(-1))
