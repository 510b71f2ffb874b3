"""Retrieval for a table of questions: lexical overlap, query variants, rank fusion, relevance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from larkdoc.functions import rules, text
from larkdoc.operators.common import small, top_rows, written
from larkdoc.operators.nearest import Found, best_rows
from larkdoc.operators.vectors import knn_l2
from larkdoc.sources.postings import PostingIndex


def _asked(questions: list[Row]) -> tuple:
    """The questions' distinct tokens, which questions have each, and how many tokens a question has."""
    held: dict[str, list[int]] = {}
    for i, row in enumerate(questions):
        for token in row["tokens"] or []:
            held.setdefault(token, []).append(i)
    sizes = np.array([len(x) for x in held.values()], np.int64)
    owners = np.array([i for x in held.values() for i in x], np.int64)
    return pa.array(list(held), pa.string()), np.cumsum(sizes) - sizes, sizes, owners, np.array([max(1, len(r["tokens"] or [])) for r in questions], float)


def _overlaps(asked: tuple, chunks: pa.RecordBatch, worst: np.ndarray, at_once: int = 1 << 20) -> Found:
    """The negative overlap of questions and chunks (id, tokens) that share a token."""
    known, starts, sizes, owners, n_tokens = asked
    lists = chunks.column(1)
    row = np.repeat(np.arange(chunks.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    token = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    row, token = row[token >= 0], token[token >= 0]
    counts = np.zeros(len(n_tokens) * chunks.num_rows, np.int64)
    step = max(1, at_once // max(1, int(sizes.max(initial=1))))
    for at in range(0, len(token), step):
        t, r = token[at : at + step], row[at : at + step]
        n = sizes[t]
        place = np.arange(n.sum()) + np.repeat(starts[t] - np.cumsum(n) + n, n)
        counts += np.bincount(owners[place] * chunks.num_rows + np.repeat(r, n), minlength=len(counts))
    counts = counts.reshape(len(n_tokens), chunks.num_rows)
    cost = -counts / n_tokens[:, None]
    query, row = np.nonzero((counts > 0) & (cost <= worst[:, None]))
    return query, row, cost[query, row]


def lexical_topk(questions: DataFrame, chunks: DataFrame, k: int = rules.TOP_K, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The ``k`` chunks of each question by token overlap, ties by chunk_id: (qid, chunk_id, overlap, rank).

    ``questions`` has the keys and tokens, ``chunks`` chunk_id and text. A chunk is compared with all
    questions in its own task (``best_rows``), so no pairs of questions and chunks are shuffled.
    """
    held = chunks.select("chunk_id", text.token_set(F.col("text")).alias("tokens"))
    found = best_rows(questions.select(*keys, "tokens"), list(keys), held, k, _asked, _overlaps)
    return found.select(*keys, "chunk_id", (-F.col("cost")).alias("overlap"), "rank")


def query_variants(questions: DataFrame) -> DataFrame:
    """(qid, variant_no, query) from (qid, question): the question, its rewrite, its parts, its focus terms."""
    named = questions.select("qid", text.normalize_ws(F.col("question")).alias("raw"), text.rewrite_question(F.col("question")).alias("rewritten"))
    return named.select("qid", F.posexplode(text.expand_queries(F.col("raw"), F.col("rewritten"))).alias("variant_no", "query"))


def variant_hits(variants: DataFrame, chunks: DataFrame | PostingIndex, k: int = rules.TOP_K) -> DataFrame:
    """(qid, variant_no, chunk_id, rank): each variant's ``k`` best chunks by token overlap, ranks from 0; from an index if there is one."""
    asked, keys = variants.select("qid", "variant_no", text.token_set(F.col("query")).alias("tokens")), ("qid", "variant_no")
    found = chunks.search(asked, k, keys) if isinstance(chunks, PostingIndex) else lexical_topk(asked, chunks, k, keys)
    return found.select("qid", "variant_no", "chunk_id", (F.col("rank") - 1).alias("rank"))


def vector_hits(variants: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], k: int = rules.MAX_TOP_K, wanted: dict[str, object] | None = None) -> DataFrame:
    """Like ``variant_hits``, by squared distance between ``embed`` of a variant and ``vectors`` (chunk_id, embedding, metadata)."""
    asked = variants.select("qid", "variant_no", embed(F.col("query")).alias("embedding"))
    found = knn_l2(asked, vectors.withColumnRenamed("chunk_id", "vec_id"), k, wanted, ("qid", "variant_no"))
    return found.select("qid", "variant_no", F.col("vec_id").alias("chunk_id"), (F.col("rank") - 1).alias("rank"))


def _token_sets(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, _c) of the chunks in ``found`` alone."""
    wanted = small(found.select("chunk_id").distinct())
    return chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", text.token_set(F.col("text")).alias("_c"))


def fuse_hits(hits: DataFrame) -> DataFrame:
    """(qid, chunk_id, best_rank, hits, first_seen) over a question's variants."""
    return hits.groupBy("qid", "chunk_id").agg(F.min("rank").alias("best_rank"), F.count("*").alias("hits"), F.min(F.struct("variant_no", "rank")).alias("first_seen"))


def rank_fusion(fused: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = rules.TOP_K) -> DataFrame:
    """(qid, chunk_id, score, place): 0.6 overlap with the raw question, 0.3 best rank, 0.1 hits; max(k, min(2k, 24)) rows.

    ``questions`` has qid and question, and may have a top_k to use instead of ``k``. Only texts of hits are read.
    """
    own = F.col("top_k") if "top_k" in questions.columns else F.lit(k)
    asked = questions.select("qid", text.token_set(F.col("question")).alias("_q"), F.greatest(F.lit(1), own).alias("_k"))
    joined = fused.join(_token_sets(fused, chunks), "chunk_id").join(small(asked), "qid")
    score = 0.6 * text.overlap_score(F.col("_q"), F.col("_c")) + 0.3 * (1 - F.col("best_rank") / F.col("_k")) + 0.1 * F.least(F.col("hits"), F.lit(3)) / 3
    most = F.greatest("_k", F.least(2 * F.col("_k"), F.lit(24)))
    placed = top_rows(joined.select("qid", "chunk_id", score.alias("score"), "first_seen", most.alias("_most")), ["qid"], [F.desc("score"), "first_seen", "chunk_id"], 24, "place")
    return placed.where("place <= _most").select("qid", "chunk_id", "score", "place")


def relevance_filter(ranked: DataFrame, questions: DataFrame, chunks: DataFrame, least: float = rules.MIN_OVERLAP, enough: int = rules.MIN_RELEVANT, on_insufficient: str = "relax") -> DataFrame:
    """Ranked rows whose overlap with the rewritten question is ``least`` or more.

    If fewer than ``enough`` rows of a question are, "relax" keeps all of them and "fallback" none; a question without tokens keeps all.
    """
    asked = questions.select("qid", text.token_set(text.rewrite_question(F.col("question"))).alias("_q"))
    joined = ranked.join(_token_sets(ranked, chunks), "chunk_id").join(small(asked), "qid")
    joined = joined.withColumn("relevance", text.overlap_score(F.col("_q"), F.col("_c")))
    n = F.count_if(F.col("relevance") >= least).over(Window.partitionBy("qid"))
    few = F.lit(on_insufficient == "relax")
    kept = joined.withColumn("_n", n).where((F.size("_q") == 0) | F.when(F.col("_n") < enough, few).otherwise(F.col("relevance") >= least))
    return kept.drop("_q", "_c", "_n")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = rules.TOP_K) -> DataFrame:
    """Variants, hits by token overlap, fusion and relevance in one: (qid, chunk_id, score, place, relevance)."""
    ranked = written(rank_fusion(written(fuse_hits(variant_hits(query_variants(questions), chunks, k)), "fused"), questions, chunks, k), "ranked")
    return relevance_filter(ranked, questions, chunks)


def retrieve_vectors(questions: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], wanted: dict[str, object] | None = None, base: int = rules.TOP_K) -> DataFrame:
    """Variants, nearest vectors, fusion and relevance in one: (qid, chunk_id, score, place, relevance).

    ``vectors`` has chunk_id, text, embedding and metadata; blank texts are no candidates. Each
    variant takes as many neighbours as its question's own top_k (``effective_top_k`` of ``base``),
    among the rows whose metadata are as ``wanted``.
    """
    settings = questions.select("qid", "question", text.effective_top_k(F.col("question"), base).alias("top_k"))
    held = vectors.where(~text.is_blank(F.col("text")))
    hits = vector_hits(query_variants(questions), held, embed, wanted=wanted).join(small(settings.select("qid", "top_k")), "qid").where("rank < top_k")
    ranked = written(rank_fusion(written(fuse_hits(hits), "fused"), settings, held), "ranked")
    return relevance_filter(ranked, questions, held)
