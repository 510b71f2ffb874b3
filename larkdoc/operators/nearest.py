"""The best rows for each of many queries, found where the rows are: only each task's best are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.operators.common import top_rows, written

#: Queries go to the driver and out to tasks in blocks of about so many.
QUERY_BLOCK = 4096
_SLICE = 512
#: (query, row, cost) of the pairs that count, as three arrays of one length.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class Best:
    """The ``k`` rows of least cost of each of ``n`` queries so far, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.cost, self.who = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    @property
    def worst(self) -> np.ndarray:
        """For each query the cost beyond which a row doesn't get in."""
        return self.cost[:, -1]

    def add(self, query: np.ndarray, cost: np.ndarray, who: np.ndarray) -> None:
        wanted = cost <= self.worst[query]
        query, cost, who = query[wanted], cost[wanted], who[wanted]
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        c, w = np.concatenate([self.cost[touched].ravel(), cost]), np.concatenate([self.who[touched].ravel(), who])
        order = np.lexsort((w, c, q))
        q, c, w = q[order], c[order], w[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.cost[q[keep], rank[keep]], self.who[q[keep], rank[keep]] = c[keep], w[keep]

    def batches(self, labels: pa.RecordBatch, id_name: str) -> Iterator[pa.RecordBatch]:
        """(the queries' labels, id, cost) of all that was found."""
        query, place = np.nonzero(np.isfinite(self.cost))
        for at in range(0, len(query), 10_000):
            q, p = query[at : at + 10_000], place[at : at + 10_000]
            yield labels.take(pa.array(q)).append_column(id_name, pa.array(self.who[q, p])).append_column("cost", pa.array(self.cost[q, p]))


def query_blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """``queries`` in blocks of about ``QUERY_BLOCK``; where there are more, they are written once, so that their plan runs once."""
    first = queries.limit(QUERY_BLOCK + 1).collect()
    if len(first) <= QUERY_BLOCK:
        yield first
        return
    asked = written(queries.withColumn("_at", F.monotonically_increasing_id()), "asked")
    blocks = -(-asked.count() // QUERY_BLOCK)
    for b in range(blocks):
        yield asked.where(F.pmod(F.xxhash64("_at"), F.lit(blocks)) == b).drop("_at").collect()


def block_by_block(queries: DataFrame, keys: list[str], id_name: str, k: int, run: Callable[[list[Row], pa.RecordBatch, T.StructType], DataFrame]) -> DataFrame:
    """(keys, id, cost, rank) of what ``run`` finds for each block of queries; where there are several, one is written before the next begins.

    ``run`` gets the queries, their keys, and the schema (keys, id, cost) of what it returns.
    """
    names = T.StructType([queries.schema[key] for key in keys])
    schema = T.StructType([*names, T.StructField(id_name, T.LongType()), T.StructField("cost", T.DoubleType())])
    spark, found = queries.sparkSession, []
    for asked in query_blocks(queries):
        if found:
            found[-1] = written(found[-1], "best")
        labels = spark.createDataFrame([tuple(r[key] for key in keys) for r in asked], names).toArrow().combine_chunks()
        labels = labels.to_batches()[0] if labels.num_rows else pa.RecordBatch.from_pylist([], schema=labels.schema)
        found.append(run(asked, labels, schema))
    return top_rows(reduce(DataFrame.unionByName, found), keys, ["cost", id_name], k)


def best_rows(queries: DataFrame, keys: list[str], rows: DataFrame, k: int, prepare: Callable[[list[Row]], object], costs: Callable[[object, pa.RecordBatch, np.ndarray], Found]) -> DataFrame:
    """(keys, id, cost, rank): the ``k`` rows of the least cost for each query, ties by id.

    The first column of ``rows`` is a long id. ``prepare`` makes what a task needs of a block of
    queries; ``costs`` gives the pairs of queries and a batch's rows that count, and may leave out
    those beyond a query's worst cost so far. A row meets all queries of a block in its own task,
    which holds ``k`` rows a query. Each further block of ``QUERY_BLOCK`` queries is another scan, and is
    written before the next one is sent, so the driver holds one block.
    """
    id_name = rows.columns[0]
    rows = rows.withColumn(id_name, F.col(id_name).cast("long")).where(F.col(id_name).isNotNull())

    def run(asked: list[Row], labels: pa.RecordBatch, schema: T.StructType) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((labels, prepare(asked)))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels, model = shared.value
            best = Best(labels.num_rows, k)
            for batch in batches:
                for at in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(at, _SLICE)
                    query, row, cost = costs(model, part, best.worst)
                    best.add(query, cost, part.column(0).to_numpy(zero_copy_only=False)[row])
            yield from best.batches(labels, id_name)

        return rows.mapInArrow(task, schema)

    return block_by_block(queries, keys, id_name, k, run)
