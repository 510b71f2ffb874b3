"""Helpers that the operators of this subpackage share: the shared folder, table reading, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in a session on one machine a temporary one where that is unset.

    A cluster without the setting is refused, as its machines' own folders would each hold a part.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return base or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there and no executor holds it.

    The folder goes when the driver's JVM ends, or with ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkdoc-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of ``written`` tables that nothing reads any more."""
    for table in tables:
        target, files = _file_system(table.sparkSession, table.written_path)
        files.delete(target, True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Turns an iterator of tuples into record batches of at most ``size`` rows."""
    columns: list[list] = [[] for _ in schema]
    for row in rows:
        for column, value in zip(columns, row, strict=True):
            column.append(value)
        if len(columns[0]) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            columns = [[] for _ in schema]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator reads, so that extra columns can't clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps, whose rounds grow with the logarithm of the
    longest path, and writes each round's edges to the shared folder. Nodes without an edge don't
    occur in the result. A hub's neighbours are joined by key, never gathered.
    Null ends and self-loops are dropped; repeated edges count once; no edges give no rows.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs if not large else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large: each node sees all neighbours; small: each node sees its smaller ones
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a > b").distinct()

    pairs = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    signature = None
    for _ in range(max_rounds):
        last, pairs = pairs, written(star(star(pairs, True), False), "edges")
        dropped(last)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
