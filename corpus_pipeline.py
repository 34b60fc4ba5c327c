"""A training corpus from raw documents: quality, near-duplicates, personal data, mixture, windows.

Each stage takes (spark, docs, sf_dir) and works on every document that the
stage before it kept; all but the last return the columns of docs. Null texts
are scored as empty, null keys are never linked, and empty tables pass through.

Texts are long rows, so the stages that hand them to Python set Spark's batches
to BATCH_ROWS rows for the session: what a worker and its executor hold at a
time shrinks with it, no result changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm import minhash, mixing, packing, pii, quality_classifier
from linemill.llm._common import broadcast_up_to, cut_lineage, fresh_dir, table
from linemill.llm.queries import PSEUDONYM_KEY, VOCABULARY

#: Documents below this score are rejected.
LEAST_QUALITY = 0.3
#: Rows of an Arrow batch, where a session does not ask for fewer.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(setting))
    if not 0 < held <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents vote good."""
    _small_batches(spark)
    voters = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.quality_scores(docs, voters, score="__quality")
    return scored.where(F.col("__quality") >= LEAST_QUALITY).drop("__quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document of the smallest key.

    Each distinct key and text is a document of its own: texts that only share
    a key are not linked. Of a group's documents of the smallest key the one of
    the smallest hash stays, of rows of one key and text the one that is least
    by its columns in their order. Rows without a key stay.
    """
    _small_batches(spark)
    count = F.count("*").alias("__rows")
    several = cut_lineage(docs.where("doc_id is not null").groupBy("doc_id").agg(count).where("__rows > 1").select("doc_id", F.lit(True).alias("__several")))
    # A key of one row is its own node; the hash stands for the rows of others.
    own = F.when(F.col("__several"), F.xxhash64("doc_id", F.col("text").isNull(), "text")).otherwise(F.col("doc_id").cast("long"))
    marked = docs.join(broadcast_up_to(several, 200_000), "doc_id", "left").select(*docs.columns, F.col("__several").isNotNull().alias("__several"), own.alias("__node"))
    found = minhash.near_duplicates(marked, key="__node")
    if several.isEmpty():
        kept = found.where("kept and __node is not null").select("__node")
    else:
        places = found.where("__node is not null").groupBy("__node").agg(F.min("component_id").alias("component_id"))
        keys = marked.where("__node is not null").groupBy("__node").agg(F.min("doc_id").alias("doc_id"))
        least = F.min(F.struct("doc_id", "__node"))
        kept = places.join(keys, "__node").groupBy("component_id").agg(least.alias("least")).select("least.__node")
    stay = marked.join(kept, "__node")
    once = stay.where("not __several").select(*docs.columns)
    row = F.min(F.struct(*docs.columns)).alias("__row")
    repeated = stay.where("__several").groupBy("__node").agg(row).select("__row.*")
    return once.unionByName(repeated).unionByName(docs.where("doc_id is null"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return pii.pseudonymise(docs, PSEUDONYM_KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights."""
    mixed = mixing.mix(docs.select("doc_id", "source", "text", F.struct("*").alias("__row")))
    return mixing.repeated(mixed, ["__row"]).select("__row.*")


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training windows."""
    _small_batches(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("pii_pseudonyms", private_data),
    ("mixing", mixture),
    ("packing", windows),
]

#: The classifier, the tokenizer and the keyed network have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
