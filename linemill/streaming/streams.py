"""Running counts, contracts and quarantine on streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.functions.patterns import matches
from linemill.operators.contracts import least_bad


def refuse_ordered(df: DataFrame) -> DataFrame:
    """Raises ValueError for a stream, whose lines have no fixed order."""
    if df.isStreaming:
        raise ValueError("an operator that depends on line order needs a batch frame")
    return df


def stream_contracts(stream: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Running n_rows, n_bad and least bad value for each rule (name, column, pattern)."""
    checks = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(matches(F.col(c), p), F.lit(False)).alias("ok"), F.col(c).cast("string").alias("value")) for n, c, p in rules])
    told = stream.select(F.explode(checks).alias("x")).select("x.*")
    least = least_bad(F.col("value"), ~F.col("ok"))
    return told.groupBy("rule").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("ok")).alias("n_bad"), least.getField("value").alias("witness"))


def stream_counts(stream: DataFrame, column: str) -> DataFrame:
    """Running sort | uniq -c."""
    return stream.groupBy(column).agg(F.count("*").alias("n"))


Sink = Callable[[DataFrame, int], None]


def batch_folder(path: str) -> Sink:
    """A sink that writes each batch in a folder of its number, in place of what a failed attempt left there."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def stream_quarantine(stream: DataFrame, column: str, p: str, good: Sink | str, bad: Sink | str, checkpoint: str):
    """Each micro-batch's valid rows to one sink, the others to another; returns the started query.

    A sink is a path, for batch_folder, or a function of a batch and its number.
    A batch that failed after its first sink is given to both again with the
    same number, so a sink that replaces by number holds every row once.
    """
    sinks = [batch_folder(s) if isinstance(s, str) else s for s in (good, bad)]

    def deal(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("__ok", F.coalesce(matches(F.col(column), p), F.lit(False))).persist()
        try:
            sinks[0](marked.where("__ok").drop("__ok"), number)
            sinks[1](marked.where("not __ok").drop("__ok"), number)
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_running(aggregated: DataFrame, path: str, checkpoint: str):
    """Write what each micro-batch changes of a streaming aggregate, by batch number; returns the started query.

    Only changed groups are written, not the whole result as in complete mode.
    """
    return aggregated.writeStream.outputMode("update").foreachBatch(batch_folder(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The running table that keep_running left: of each key the row of the last batch that changed it."""
    written = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row")).select(*keys, "__row.*")


def compact(spark: SparkSession, path: str, keys: list[str], into: str) -> None:
    """Write the running table's present rows as the first batch of another folder."""
    latest(spark, path, keys).write.parquet(f"{into}/batch=-1")


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that a stream gives for the files there are now, as a batch frame written in folder."""
    spark: SparkSession = stream.sparkSession
    out = f"{folder}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows if mode == "complete" else rows.drop("batch")
