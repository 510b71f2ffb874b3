"""What the registered queries share: their registry, the given tables as the library's own, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Fixed "now" of time-based queries, so that results don't depend on the day they are run.
AS_OF = "2024-01-31 00:00:00"
WORD = r"[\p{L}\p{N}_]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Bytes that a Python worker gets at once; texts and what is made of them take several times as much in it.
BATCH_BYTES = 8 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to ``BATCH_BYTES``; a smaller one stays."""
    held = spark.conf.get(BATCHES).lower().removesuffix("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(BATCHES, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored files of workspaces: owner by source, chat by language, versions by order within a hash."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("username"), F.col("lang").alias("chat_id"), F.col("doc_id").alias("document_id"), F.sha2(F.col("text"), 256).alias("file_hash"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 1000).alias("created_at"))
    return docs.withColumn("version", (F.col("document_id") % 3 + 1).cast("int"))


FILES = "files AS (SELECT source AS username, lang AS chat_id, doc_id AS document_id, sha256(text) AS file_hash, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id % 1000) AS created_at, (doc_id % 3 + 1)::INT AS version FROM documents)"


def stored_messages(spark: SparkSession, sf_dir: str, turns: DataFrame | None = None) -> DataFrame:
    """Turns as messages, a minute apart; user names by chat. ``turns`` may be a stream of the table."""
    turns = table(spark, sf_dir, "conversations") if turns is None else turns
    return turns.select(F.col("conv_id").alias("chat_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.concat(F.lit("user"), (F.col("conv_id") % 20).cast("string")).alias("username"), "role", F.coalesce("text", F.lit("")).alias("text"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 600 + F.col("turn") * 60).alias("created_at"))


MESSAGES = "messages AS (SELECT conv_id AS chat_id, conv_id * 1000 + turn AS message_id, 'user' || (conv_id % 20) AS username, role, coalesce(text, '') AS text, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 600 + turn * 60) AS created_at FROM conversations)"


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD}')"


def ws_sql(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


JOBS = "jobs AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS updated_at, (event_id % 5)::INT AS retry_count, 3 AS max_retries FROM events)"


def stored_jobs(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as jobs. ``events`` may be a stream of the table."""
    events = table(spark, sf_dir, "events") if events is None else events
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind == "click", "processing").when(kind == "error", "failed").otherwise("completed")
    return events.select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), (F.col("event_id") % 5).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"))
