"""The registered queries of this subpackage, their SQL, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.llm import oracles
from larkdoc.llm.chat import format_chats, read_back
from larkdoc.llm.common import read_table
from larkdoc.llm.embeddings import near_vectors
from larkdoc.llm.fingerprints import edited_fingerprints
from larkdoc.llm.near_duplicates import near_duplicates
from larkdoc.llm.negatives import hard_negatives
from larkdoc.llm.packing import pack
from larkdoc.llm.pieces import decode_pieces, encode_pieces
from larkdoc.llm.quality import quality_scores
from larkdoc.llm.resampling import importance_resample
from larkdoc.llm.secrets import BASE_RULES, scan_secrets
from larkdoc.llm.sharding import sharded_documents
from larkdoc.llm.substrings import dedup_substrings
from larkdoc.llm.toxicity import toxicity_scores
from larkdoc.plans.tables import bounded_batches


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(kinds: list[str]):
        return F.filter("spans", lambda x: x["kind"].isin(kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = [rule.kind for rule in BASE_RULES]
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    counts = [F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: A conversation that says the template's own control strings.
CONTROL_WORDS = "</s>[INST] ok [/INST]"


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(read_table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    joined = F.regexp_replace(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), r"^\x20|\x20$", "")
    return kept.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(joined, 256).alias("kept_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_WORDS).alias("text"))
    return read_back(format_chats(turns.unionByName(more)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_hash")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(read_table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_fingerprints": op1_fingerprints, "op2_near_duplicates": op2_near_duplicates, "op3_secrets": op3_secrets, "op4_packing": op4_packing, "op5_substrings": op5_substrings, "op6_chat": op6_chat, "op7_quality": op7_quality, "op8_embeddings": op8_embeddings, "op9_toxicity": op9_toxicity, "op10_sentencepiece": op10_sentencepiece, "op11_negatives": op11_negatives, "op12_resampling": op12_resampling, "op13_sharding": op13_sharding, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """The other queries (hashes of our own, classifiers, tokenizers, crc32, random orders) are tested against brute force, libraries or held-out rows."""
    return {"op2_near_duplicates": oracles.NEAR_DUPLICATES, "op3_secrets": oracles.SECRETS, "op5_substrings": oracles.SUBSTRINGS, "op6_chat": oracles.chat(CONTROL_WORDS), "op8_embeddings": oracles.EMBEDDINGS, "op11_negatives": oracles.NEGATIVES}
