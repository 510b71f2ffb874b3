"""Extractive answers over retrieved chunks, and a hook for answers by a user's function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkdoc.functions import rules, text
from larkdoc.operators.common import small, top_rows, written


def in_order(order: list[str], value: Column | str, separator: str) -> Column:
    """An aggregate: ``value`` joined by ``separator`` in the order of the columns ``order``; nulls are left out."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_value"))))
    return F.array_join(F.transform(rows, lambda x: x["_value"]), separator)


def rank_sentences(context: DataFrame, questions: DataFrame, least: float = rules.SENTENCE_SCORE, most: int = rules.MAX_SENTENCES) -> DataFrame:
    """(qid, place, sentence_no, sentence, score, rank): a question's best sentences by token overlap.

    ``context`` has qid, place and text; ties go by place, then by the sentence's number.
    """
    asked = questions.select("qid", text.token_set(F.col("question")).alias("_q"))
    said = context.select("qid", "place", F.posexplode(text.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))
    scored = said.join(small(asked), "qid").select("qid", "place", "sentence_no", "sentence", text.overlap_score(F.col("_q"), text.token_set(F.col("sentence"))).alias("score"))
    return top_rows(scored.where((F.col("score") > 0) & (F.col("score") >= least)), ["qid"], [F.desc("score"), "place", "sentence_no"], most)


def extractive_answers(context: DataFrame, questions: DataFrame, most_chars: int = rules.MAX_ANSWER_CHARS) -> DataFrame:
    """(qid, answer, context_found): the best sentences; the whole texts for summaries or without such; the fallback without context."""
    context = written(context, "context")  # read for sentences and for whole texts
    best = rank_sentences(context, questions).groupBy("qid").agg(in_order(["rank"], "sentence", " ").alias("_best"))
    whole = context.where(~text.is_blank(F.col("text"))).groupBy("qid").agg(in_order(["place"], text.strip(F.col("text")), "\n\n").alias("_whole"))
    joined = questions.join(whole, "qid", "left").join(best, "qid", "left")
    chosen = F.when(text.matches(F.col("question"), rules.SUMMARY) | F.col("_best").isNull(), F.col("_whole")).otherwise(F.col("_best"))
    return joined.select("qid", text.truncate_answer(F.coalesce(chosen, F.lit(rules.FALLBACK_ANSWER)), most_chars).alias("answer"), F.col("_whole").isNotNull().alias("context_found"))


def answer_sources(context: DataFrame) -> DataFrame:
    """(qid, sources): distinct source references in the order of places; ``context`` has source, page, chunk_index."""
    ref = text.source_ref(F.col("source"), F.col("page"), F.col("chunk_index"))
    rows = F.array_sort(F.collect_list(F.struct("place", ref.alias("ref"))))
    return context.groupBy("qid").agg(F.array_distinct(F.transform(rows, lambda x: x["ref"])).alias("sources"))


def answer_extractive(ranked: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, answer, context_found, sources) over retrieved rows (qid, chunk_id, place); ``chunks`` has chunk_id, text, source, page, chunk_index."""
    ids = small(ranked.select("chunk_id").distinct())
    context = written(ranked.select("qid", "chunk_id", "place").join(chunks.join(ids, "chunk_id", "left_semi"), "chunk_id"), "context")
    said = extractive_answers(context, questions).join(answer_sources(context), "qid", "left")
    return said.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def answer_with(answer: Callable[[Column, Column], Column], context: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, answer) by a user's column function of (question, context text); the extractive answer where it falls back.

    ``answer`` is usually a pandas UDF around a model. ``context`` has qid, place, source, page and text.
    """
    rows = F.array_sort(F.collect_list(F.struct("place", "source", "page", "text")))
    given = context.groupBy("qid").agg(text.format_context(rows).alias("_context"))
    tried = questions.join(given, "qid", "left").select("qid", answer(F.col("question"), F.coalesce("_context", F.lit(""))).alias("_model"))
    spare = extractive_answers(context, questions)
    bad = F.col("_model").isNull() | text.is_fallback(F.col("_model")) | text.is_blank(F.col("_model"))
    return spare.join(tried, "qid").select("qid", F.when(bad, F.col("answer")).otherwise(F.col("_model")).alias("answer"), "context_found")


def compose_per_document(answers: DataFrame) -> DataFrame:
    """(qid, answer, sources) from (qid, number, label, answer, sources): labelled parts in order, sources without repeats."""
    part = F.concat(F.lit("**"), "label", F.lit("**\n"), F.coalesce("answer", F.lit(rules.FALLBACK_ANSWER)))
    rows = F.array_sort(F.collect_list(F.struct("number", F.coalesce("sources", F.array().cast("array<string>")).alias("s"))))
    return answers.groupBy("qid").agg(in_order(["number"], part, "\n\n").alias("answer"), F.array_distinct(F.flatten(F.transform(rows, lambda x: x["s"]))).alias("sources"))
