"""Vectors: hash embeddings, embeddings by a user's function, exact nearest neighbours by squared distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from larkdoc.functions import rules
from larkdoc.operators.nearest import Found, best_rows


def hash_embedding(text: Column, dimensions: int = rules.HASH_DIMENSIONS) -> Column:
    """The bytes of sha256(text + counter), counter from 0, each over 255: ``dimensions`` numbers, the same everywhere."""
    blocks = -(-dimensions // 32)
    whole = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda c: F.sha2(F.concat(text, c.cast("string")), 256))
    numbers = F.flatten(F.transform(whole, lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)))
    return F.slice(numbers, 1, dimensions)


def embed_with(make: Callable[[], Callable[[list[str]], list[list[float]]]], at_once: int = 256) -> Callable[[Column], Column]:
    """A column function that embeds texts, ``at_once`` of an Arrow batch at a time; ``make`` builds the embedder once in each task.

    Vectors go out as soon as they are made, so a worker holds a batch of texts and ``at_once`` vectors.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for texts in batches:
            for at in range(0, len(texts), at_once):
                yield pd.Series([np.asarray(v, np.float32) for v in embedder(texts.iloc[at : at + at_once].fillna("").tolist())], dtype=object)

    return embed


def metadata_filter(df: DataFrame, wanted: dict[str, object], keep: bool = True) -> DataFrame:
    """Rows whose metadata are as ``wanted`` (or, not ``keep``, the others): a list means any of it; values compare as text, a missing one as "None"."""

    def one(key: str, value: object) -> Column:
        held = F.coalesce(F.col(key).cast("string"), F.lit("None")) if key in df.columns else F.lit("None")
        return held.isin([str(v) for v in value]) if isinstance(value, (list, tuple, set)) else held == str(value)

    found = reduce(lambda a, b: a & b, (one(k, v) for k, v in wanted.items()), F.lit(True))
    return df.where(found if keep else ~found)


def by_length(queries: list[Row]) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """How many queries there are, and for each length of vectors the queries' places and vectors."""
    places: dict[int, list[int]] = {}
    for i, row in enumerate(queries):
        places.setdefault(len(row["embedding"]), []).append(i)
    return len(queries), {n: (np.array(at), np.array([queries[i]["embedding"] for i in at], float).reshape(len(at), n)) for n, at in places.items()}


def vectors_by_length(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of the lists of each length."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        mine = np.flatnonzero(sizes == n)
        values = (lists if len(mine) == len(lists) else lists.take(pa.array(mine))).flatten()
        yield int(n), mine, values.to_numpy(zero_copy_only=False).astype(float).reshape(len(mine), int(n))


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``q`` to all of ``x``, difference by difference."""
    return np.concatenate([((q[at : at + 16, None] - x[None]) ** 2).sum(2) for at in range(0, len(q), 16)])


def _distances(asked: tuple[int, dict], vectors: pa.RecordBatch, worst: np.ndarray) -> Found:
    """Squared distances of queries and vectors (id, embedding) of one length."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for n, mine, x in vectors_by_length(vectors.column(1)):
        if n in asked[1]:
            places, q = asked[1][n]
            d2 = squared(q, x)
            i, j = np.nonzero(d2 <= worst[places, None])
            found.append((places[i], mine[j], d2[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def usable(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, embedding as doubles) of the rows whose vector is there, without null or undefined components."""
    plain = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return rows.select(*keys, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").where(plain)


def knn_l2(queries: DataFrame, vectors: DataFrame, k: int, wanted: dict[str, object] | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(qid, vec_id, d2, rank): the ``k`` nearest vectors of each query by squared distance in double precision, ties by vec_id.

    A vector is compared with all queries in its own task (``best_rows``). Vectors of another length
    than a query's are no neighbours of it. ``wanted`` filters before any distance is computed.
    """
    vectors = metadata_filter(vectors, wanted) if wanted else vectors
    return best_rows(usable(queries, *keys), list(keys), usable(vectors, "vec_id"), k, by_length, _distances).select(*keys, "vec_id", F.col("cost").alias("d2"), "rank")
