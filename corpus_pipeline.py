"""The corpus pipeline: quality, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), ``docs`` being what the stage before wrote, and returns a
DataFrame: all but the last one the columns of documents, with ``n_chars`` after the text as it then is.
Rows with a null id are scored and kept by the first stages like others; null texts count as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.llm.common import DOCUMENT_COLUMNS, read_table, written
from larkdoc.llm.near_duplicates import near_duplicates
from larkdoc.llm.packing import pack
from larkdoc.llm.quality import quality_scores
from larkdoc.llm.secrets import redact_secrets
from larkdoc.llm.substrings import dedup_substrings

#: Scores from here on are kept; the classifier is fitted on labelled rows outside its held-out fold.
QUALITY_THRESHOLD = 0.3


def _documents(docs: DataFrame, n_chars: Column | None = None) -> DataFrame:
    counted = docs if n_chars is None else docs.withColumn("n_chars", n_chars)
    return counted.select(*DOCUMENT_COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone`` (doc_id, text_hash); rows of one id are told apart by their texts."""
    marked = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return marked.join(gone, (F.col("doc_id") == F.col("_gone")) & (marked["_hash"] == gone["_hash"]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scores = quality_scores(docs, read_table(spark, sf_dir, "labels"), threshold=QUALITY_THRESHOLD)
    return _documents(_without(docs, scores.where("predicted = 0 and doc_id is not null")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates."""
    return _documents(_without(docs, near_duplicates(docs).where("not kept")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that one with a smaller id has; those with no word left go."""
    cut = dedup_substrings(docs, columns=("lang", "source"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return _documents(cut.where((F.col("n_words") == 0) | (gone < F.col("n_words"))), F.length("text").cast("long"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return _documents(redact_secrets(docs), F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences of 1024."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", packing)]

#: SQL can't express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
