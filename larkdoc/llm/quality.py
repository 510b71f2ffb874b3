"""Quality scores by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.common import batched, id_and_text
from larkdoc.llm.labels import fold_of, training_rows

FORMS, WORDS, DIMENSIONS, NEIGHBOURS, PER_CLASS, STRETCH = 1024, 1024, 64, 25, 2500, 64
TERMS = FORMS + WORDS
_RUNS = re.compile(r"([A-Z])[A-Z]+|([a-z])[a-z]+|(0)0+|([^A-Za-z0])\4+")


class _Shapes(dict):
    """Hashes of a word's shape and of the word in lower case; holds a bounded number of words.

    The shape has letters and digits by kind, runs cut to two, so "AND!!" is "AA!!".
    """

    def __missing__(self, word: str) -> int:
        kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
        shape = _RUNS.sub(lambda m: m[0][:2], kinds)
        found = zlib.crc32(shape.encode("utf-8", "replace")) % (1 << 20) << 32 | zlib.crc32(word.lower().encode("utf-8", "replace"))
        if len(self) < 200_000:
            self[word] = found
        return found


def terms(text: str, shapes: dict[str, int] | None = None) -> np.ndarray:
    """Term counts: forms hashed to the first ``FORMS``, words to the other ``WORDS``.

    Forms are word shapes, pairs of them, and words that repeat the one or two before them, as symbols,
    capitals, tables and repeats tell poor text in any language. A longer word than ``STRETCH`` is
    taken as overlapping stretches, so that unspaced text counts by its length. ``shapes`` keeps
    words from one text to the next.
    """
    shapes = _Shapes() if shapes is None else shapes
    words = [w[at : at + STRETCH] for w in text.split() for at in range(0, max(1, len(w) - STRETCH // 2), STRETCH // 2)]
    if not words:
        return np.zeros(TERMS, np.float32)
    both = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    shape, word = both >> 32, both & 0xFFFFFFFF
    repeats = np.zeros(len(words), np.int64)
    for lag in (1, 2):
        repeats[lag:] += np.fromiter(map(operator.eq, words, words[lag:]), np.int64, max(0, len(words) - lag)) if len(words) > lag else 0
    found = np.concatenate([shape, shape[:-1] * 31 + shape[1:] * 7 + 1, repeats + 99_991])
    places = np.concatenate([(found * 2654435761 >> 7) % FORMS, FORMS + word % WORDS])
    return np.bincount(places, minlength=TERMS).astype(np.float32)


@dataclass
class NeighbourModel:
    """Weights and axes of the latent space, and the labelled vectors in it."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts) * self.weights
        rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        found = rows @ self.axes
        size = np.linalg.norm(found, axis=1, keepdims=True)
        return np.where(size > 1e-6, found / np.maximum(size, 1e-6), 0).astype(np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by cosine; the prior where none is near."""
        cosine = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        if not k:
            return np.full(len(counts), self.prior)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** 4
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)


def fit_neighbours(sample: DataFrame) -> NeighbourModel:
    """Latent-semantic analysis of (text, label) rows, at most twice ``PER_CLASS``: weighted term counts, largest singular axes.

    Tasks count terms; the driver gets the counts that aren't 0 of each row of the bounded sample, and holds two tables of ``TERMS`` columns
    of them. Without rows scores are 0.5.
    """

    def packed(counts: np.ndarray) -> bytes:
        used = np.flatnonzero(counts)
        return used.astype(np.uint16).tobytes() + counts[used].tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        rows = ((doc_id, label, packed(terms(text.as_py(), shapes))) for batch in batches for doc_id, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
        return batched(rows, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("counts", pa.binary())]))

    found = sorted(sample.select("doc_id", "label", "text").mapInArrow(task, "doc_id long, label int, counts binary").collect())
    if not found:
        return NeighbourModel(np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    labels, counts = np.array([r["label"] for r in found], float), np.zeros((len(found), TERMS), np.float32)
    for i, r in enumerate(found):
        n = len(r["counts"]) // 6
        counts[i, np.frombuffer(r["counts"], np.uint16, n)] = np.frombuffer(r["counts"], np.float32, n, 2 * n)
    del found
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.1
    products = np.zeros((TERMS, TERMS))
    for at in range(0, len(counts), 256):
        rows = np.log1p(counts[at : at + 256]) * weights
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        products += rows.T @ rows
    _, axes = np.linalg.eigh(products)
    del products
    model = NeighbourModel(weights.astype(np.float32), axes[:, ::-1][:, :DIMENSIONS].astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), labels, float(labels.mean()))
    model.vectors = np.concatenate([model.embed(counts[at : at + 256]) for at in range(0, len(counts), 256)])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, per_class: int = PER_CLASS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, text_hash), one for each row of ``docs``; learns only from the other folds.

    The model (``per_class`` labelled rows of each class at most, ``DIMENSIONS`` numbers each) is broadcast and
    every document is compared with all of it in blocks. A null or empty text scores the sample's
    share of label 1; a null id stays null; repeated rows score alike, and ``text_hash`` tells rows of one id apart; without labels scores are 0.5;
    no rows give no rows; other columns are ignored.
    """
    chosen = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    fold = fold_of(F.col("doc_id"), folds)
    model = docs.sparkSession.sparkContext.broadcast(fit_neighbours(training_rows(chosen.select("doc_id", "text"), labels, label, fold != held_out, per_class)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, shapes = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("text_hash", pa.int64())]), _Shapes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = np.stack([terms(text.as_py(), shapes) for text in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.scores(counts)), part.column(2)], schema=schema)

    scored = chosen.mapInArrow(task, "doc_id long, score double, text_hash long")
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")
