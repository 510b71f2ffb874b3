"""Toxicity scores from subword embeddings averaged into a linear softmax."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.common import batched, id_and_text
from larkdoc.llm.labels import fold_of, training_rows

BUCKETS, DIMENSIONS, PER_CLASS, SHORTEST, LONGEST = 1 << 17, 8, 1500, 3, 5
RAREST, COMMON = 3, 0.02
#: Longer runs are taken in stretches and aren't held.
STRETCH, LONGEST_HELD = 4096, 64
_WORDS = re.compile(r"\w+")


def subwords(word: str) -> Iterator[list[int]]:
    """Buckets of the marked word and of all its character n-grams, so that misspellings share most of them.

    They come in lists of bounded length, one for each ``STRETCH`` characters that n-grams begin in.
    """
    marked = f"<{word}>"
    for at in range(0, len(marked) - SHORTEST + 1, STRETCH):
        part = marked[at : at + STRETCH + LONGEST - 1]
        grams = [] if at else [marked]
        grams += [part[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(min(STRETCH, len(part) - n + 1))]
        yield [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's subwords."""
    counts: Counter[int] = Counter()
    for word, n in Counter(_WORDS.findall(text.lower())).items():
        for buckets in subwords(word):
            for g in buckets:
                counts[g] += n
    return np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))


class SubwordModel:
    """Embeddings of subword buckets and a softmax layer over their average, trained together by gradient descent.

    A subword's weight in the average falls with the share of sample texts that have it; those of
    fewer than ``RAREST`` texts have none, as they would only tell these texts apart.
    """

    def __init__(self, seed: int = 7):
        self.random = np.random.default_rng(seed)
        self.vectors = (self.random.standard_normal((BUCKETS, DIMENSIONS)) * 0.01).astype(np.float32)
        self.layer = (self.random.standard_normal((DIMENSIONS, 2)) * 0.5).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.weights = np.zeros(BUCKETS, np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, batch: int = 32, rate: float = 30.0) -> SubwordModel:
        texts = np.bincount(np.concatenate([b for b, _ in bags]), minlength=BUCKETS)
        self.weights = np.where(texts >= RAREST, COMMON / (COMMON + texts / len(bags)), 0).astype(np.float32)
        rows = []
        for buckets, counts in bags:
            shares = counts * self.weights[buckets]
            kept = shares > 0
            rows.append((buckets[kept], (shares[kept] / max(float(shares.sum()), 1e-9)).astype(np.float32)))
        rounds = min(60, max(10, 40_000 // len(bags)))
        for turn in range(rounds):
            pace, order = 1 - turn / rounds, self.random.permutation(len(rows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                hidden = np.stack([rows[r][1] @ self.vectors[rows[r][0]] for r in chosen])
                logits = hidden @ self.layer + self.bias
                wrong = np.exp(logits - logits.max(1, keepdims=True))
                wrong /= wrong.sum(1, keepdims=True)
                wrong[np.arange(len(chosen)), labels[chosen]] -= 1
                slopes = rate * pace * wrong @ self.layer.T
                for r, slope in zip(chosen, slopes, strict=True):  # a bag has each bucket once
                    self.vectors[rows[r][0]] -= rows[r][1][:, None] * slope
                self.layer -= 0.05 * pace * (hidden.T @ wrong)
                self.bias -= 0.01 * pace * wrong.sum(0)
        return self

    def margins(self) -> tuple[np.ndarray, np.ndarray, float]:
        """What each bucket adds, by its weight, to the logit of label 1 over label 0; the weights; the bias."""
        side = self.layer[:, 1] - self.layer[:, 0]
        return (self.vectors @ side) * self.weights, self.weights, float(self.bias[1] - self.bias[0])


class _Words(dict):
    """Sums of a word's subword margins and weights, as one complex number; holds a bounded number of words of bounded length."""

    def __init__(self, margins: np.ndarray, weights: np.ndarray):
        self.margins, self.weights = margins, weights

    def __missing__(self, word: str) -> complex:
        value = sum((complex(float(self.margins[grams].sum()), float(self.weights[grams].sum())) for grams in subwords(word)), 0j)
        if len(self) < 500_000 and len(word) <= LONGEST_HELD:
            self[word] = value
        return value


def fit_toxicity(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """``SubwordModel.margins`` from (text, label) rows, at most twice ``PER_CLASS``; tasks make the bags, the driver trains."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    buckets, counts = bag(text.as_py())
                    yield doc_id, label, buckets.tobytes(), counts.tobytes()

        return batched(rows(), pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary())]), 256)

    found = sorted(sample.select("doc_id", "label", "text").mapInArrow(task, "doc_id long, label int, buckets binary, counts binary").collect())
    if not found:
        return np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0
    bags = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in found]
    return SubwordModel().fit(bags, np.array([r["label"] for r in found])).margins()


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3, per_class: int = PER_CLASS, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``; learns only from the other folds.

    The model, two numbers for each of 131072 buckets, is broadcast. A text without words has the
    score of the bias alone; a null text is empty; a null id stays null; repeated rows score alike;
    without labels scores are 0.5; no rows give no rows; other columns are ignored.
    """
    chosen = id_and_text(docs, id_col, text_col)
    fold = fold_of(F.col("doc_id"), folds)
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(training_rows(chosen, labels, label, fold != held_out, per_class)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, weights, bias = model.value
        words = _Words(margins, weights)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    total = sum(map(words.__getitem__, _WORDS.findall(text.as_py().lower())), 0j)
                    logit = (total.real / total.imag if total.imag > 0 else 0.0) + bias
                    yield doc_id, 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))

        return batched(rows(), pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))

    scored = chosen.mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
