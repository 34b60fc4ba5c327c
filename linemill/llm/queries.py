"""One thin query for each training-data operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm import ann, bpe, hard_negatives, language_id, merkle, twins
from linemill.llm._common import crc_fold, cut_lineage, fresh_dir, table
from linemill.llm.minhash import near_duplicates
from linemill.llm.mixing import mix
from linemill.llm.packing import pack
from linemill.llm.pii import pseudonymise
from linemill.llm.quality_classifier import held_out, quality_scores, train
from linemill.llm.quality_rules import quality_rules
from linemill.llm.tokens import token_counts
from linemill.llm.warc import read_archives, write_archives

#: The vocabulary of the token queries; any other file's path can be given to the operators.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return token_counts(docs, VOCABULARY).withColumn("over_limit", F.col("n_tokens") > 1024)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voters = train(docs, table(spark, sf_dir, "labels"))
    scored = quality_scores(docs, voters)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Key of the pseudonyms in the registered queries; a user passes a secret of their own.
PSEUDONYM_KEY = "public example key"


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    found = pseudonymise(docs, PSEUDONYM_KEY)
    return found.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    written = cut_lineage(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder))
    records = read_archives(spark, folder, written)
    return records.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coder = language_id.train(docs)
    found = language_id.predict(docs.select("doc_id", "text"), coder)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    told = bpe.decode(encoded, VOCABULARY)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return told.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(crc_fold(F.col("doc_id"), 5) == 0, merkle.leaf_digest(*fields, lowered))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf_digest(*fields, F.col("text")).alias("leaf"), tampered.alias("claim"))
    return merkle.manifest(rows, claim="claim").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_pii_pseudonyms": op5_pii_pseudonyms,
        "op6_warc": op6_warc,
        "op7_packing": op7_packing,
        "op8_language_id": op8_language_id,
        "op9_mixing": op9_mixing,
        "op10_quality_rules": op10_quality_rules,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_bpe": op12_bpe,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": twins.HARD_NEGATIVES, "op13_merkle_manifest": twins.MERKLE}
