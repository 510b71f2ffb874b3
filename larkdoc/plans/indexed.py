"""Queries of the stored indexes: the rows of the plain searches, from lists and cells that are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.functions import rules, text
from larkdoc.operators import retrieval
from larkdoc.operators.common import scratch
from larkdoc.plans.tables import asked_questions, stored_chunks, table
from larkdoc.sources.cells import CellIndex
from larkdoc.sources.postings import PostingIndex


def postings(spark: SparkSession, sf_dir: str) -> PostingIndex:
    index = PostingIndex(spark, scratch(spark, "postings"))
    index.append(stored_chunks(spark, sf_dir))
    return index


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``retrieve_lexical_topk`` from postings."""
    asked = asked_questions(spark, sf_dir).select("qid", text.token_set(F.col("question")).alias("tokens"))
    return postings(spark, sf_dir).search(asked).select("qid", "chunk_id", "overlap", "rank")


def indexed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rank_fusion`` from postings."""
    asked, chunks = asked_questions(spark, sf_dir), stored_chunks(spark, sf_dir)
    hits = retrieval.variant_hits(retrieval.query_variants(asked), postings(spark, sf_dir))
    return retrieval.rank_fusion(retrieval.fuse_hits(hits), asked, chunks).withColumn("score", F.round("score", 9))


def _cells(spark: SparkSession, sf_dir: str, wanted: dict[str, object] | None = None) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    index = CellIndex(spark, scratch(spark, "cells"))
    index.write(held)
    asked = held.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return index.search(asked, rules.TOP_K, wanted).withColumn("d2", F.round("d2", 9))


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``knn_l2`` from cells."""
    return _cells(spark, sf_dir)


def knn_cells_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``knn_l2_filtered`` from cells."""
    return _cells(spark, sf_dir, {"label": [1, 3]})
