"""Bounded samples of labelled rows for the classifiers, and their held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` documents of each label 0 and 1, chosen by a hash of their ids.

    ``docs`` has doc_id and text. Rows of ``labels`` outside ``learn_from`` or with null ids or labels don't
    count; of ids labelled more than once the smallest label counts, of rows that share an id the least text. The chosen ids are at most twice
    ``per_class``, so they are broadcast to the texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(learn_from).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = [known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for value in (0, 1)]
    return docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")) if per_class else docs.withColumn("label", F.lit(0)).where("false")
