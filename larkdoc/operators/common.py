"""Helpers for operators: checked broadcasts, latest rows, written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most; otherwise as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order``."""
    return numbered(df, keys, order, "_place").where("_place = 1").drop("_place")


def top_rows(df: DataFrame, keys: list[str], order: list[Column | str], n: Column | int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; a fixed ``n`` is applied within tasks before the shuffle."""
    return numbered(df, keys, order, name).where(F.col(name) <= n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a session on one machine a temporary one where that is unset.

    A cluster without the setting is refused, as its machines' own folders would each hold a part.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return base or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/larkdoc-{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is read more than once; it goes when the driver's JVM ends."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_a_task: int, *keys: str) -> DataFrame:
    """``df`` dealt over tasks of about ``rows_a_task`` rows, one a core at least, for work that is long beside its rows' bytes.

    Without a number of partitions adaptive execution would join them by their bytes, to one task for a table of short rows.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task))
    return df.repartition(parts, *keys)


def written_by_key(rows: DataFrame, key: str, rows_a_task: int, path: str) -> None:
    """A folder of text for each ``key`` under ``path``, made by as many tasks as ``spread`` gives."""
    spread(rows, rows_a_task, key).write.partitionBy(key).text(path)


def in_key_order(batches: Iterator[pa.RecordBatch], begin: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """A row for each row (id, key, more), which come sorted by key: ``step`` makes it of the key's state and the row, and gives the next state.

    Null keys are one key, as in a group, and so are undefined numbers. Deal the rows by a hash of the key, not by the key: behind a
    join on that key Spark takes the join's own dealing for repartition(), and may give it up again when the join becomes a broadcast.
    """
    now, state = object(), None
    for batch in batches:
        out = []
        for row_id, key, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now and not (key != key and now != now):
                now, state = key, begin()
            state, found = step(state, tuple(more))
            out.append((row_id, *found))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
