"""Queries of the streams: each reads a whole given table as a stream until no more comes, and returns what the stream wrote."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.operators.common import scratch, written_by_key
from larkdoc.operators import workspace
from larkdoc.plans.tables import AS_OF, query, stored_jobs, stored_messages, table
from larkdoc.streaming import state, streams, timed

#: A time after all events, for what is still open then.
LONG_AFTER = "2100-01-01 00:00:00"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a pattern, as a stream's path without one must be a folder, and a table may be one file
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _clock(spark: SparkSession, until: str) -> DataFrame:
    """A stream (at) that says once that it is ``until``."""
    path = scratch(spark, "clock")
    spark.sql(f"SELECT TIMESTAMP '{until}' AS at").write.parquet(path)
    return spark.readStream.schema("at timestamp").parquet(path)


def _run(rows: DataFrame, label: str, mode: str, rocks: bool = False) -> DataFrame:
    """What a stream wrote: the last whole result in complete mode, all rows in append mode."""
    spark, root = rows.sparkSession, scratch(rows.sparkSession, label)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/batch={number}")

    with timed.rocks_state(spark) if rocks else nullcontext():
        query = rows.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/batch=*")


def _requests(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 11 == 0, 429).otherwise(200)
    return events.select(F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.concat(F.lit("GET /"), "event_type").alias("endpoint"))


REQUESTS = "r AS (SELECT ts, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 11 = 0 THEN 429 ELSE 200 END AS status, 'GET /' || event_type AS endpoint FROM events)"


@query(f"WITH {REQUESTS} SELECT status, endpoint, count(*) AS n FROM r GROUP BY ALL")
def live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(streams.live_metrics(_requests(_stream(spark, sf_dir, "events"))), "live", "complete")


@query(f"WITH {REQUESTS} SELECT date_trunc('minute', ts) AS minute, endpoint, count(*) AS n FROM r GROUP BY ALL")
def requests_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(streams.per_minute(_requests(_stream(spark, sf_dir, "events")), clock=_clock(spark, LONG_AFTER)), "minutes", "append")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY day")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(streams.daily_counts(_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts")), clock=_clock(spark, LONG_AFTER)), "days", "append")
    return found.withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id AS job_id, max(CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 100 ELSE least(99, floor(value)) END)::INT AS progress FROM events GROUP BY user_id")
def progress_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0), "complete").otherwise("progress")
    said = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), kind.alias("kind"), F.floor("value").cast("int").alias("progress"))
    return _run(streams.progress_feed(said), "progress", "complete")


@query("""WITH u AS (SELECT source AS username, lang AS chat_id, sha256(text) AS file_hash, doc_id * 2 + again AS upload_no, doc_id % 1000 + again * 2 AS day FROM documents, (VALUES (0), (1)) AS t(again) WHERE doc_id % 3 <> 0),
s AS (SELECT source, lang, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0)
SELECT username, chat_id, file_hash, upload_no FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE source = username AND lang = chat_id AND h = file_hash) QUALIFY row_number() OVER (PARTITION BY username, chat_id, file_hash ORDER BY day, upload_no) = 1""")
def refused_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that are neither stored nor came before, each sent again two days later: none is let in twice."""
    hashed = lambda df: df.select("doc_id", F.col("source").alias("username"), F.col("lang").alias("chat_id"), F.sha2("text", 256).alias("file_hash"))
    stored = hashed(table(spark, sf_dir, "documents").where("doc_id % 3 = 0"))
    sent = hashed(_stream(spark, sf_dir, "documents").where("doc_id % 3 <> 0")).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    uploads = sent.select("username", "chat_id", "file_hash", (F.col("doc_id") * 2 + F.col("again")).alias("upload_no"), F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 1000 + F.col("again") * 2) * 86400).alias("ts"))
    return _run(timed.refuse_known_uploads(uploads, stored), "uploads", "append", rocks=True).select("username", "chat_id", "file_hash", "upload_no")


def conversation_log_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversation_log`` from a stream of questions and one of answers; a third of the questions has none."""
    spoken = stored_messages(spark, sf_dir, _stream(spark, sf_dir, "conversations")).where("role = 'user'")
    said = spoken.select(F.col("message_id").alias("qid"), "username", "chat_id", F.col("text").alias("question"), "created_at")
    again = stored_messages(spark, sf_dir, _stream(spark, sf_dir, "conversations")).where("role = 'user' and message_id % 3 <> 0")
    sources = F.when(F.col("message_id") % 3 == 2, F.array("username", F.concat(F.lit(" "), "username")))
    replies = again.select(F.col("message_id").alias("qid"), F.concat(F.lit("Answer to "), "text").alias("answer"), sources.alias("sources"), F.timestamp_seconds(F.unix_timestamp("created_at") + 5).alias("answered_at"))
    return _run(timed.live_conversation_log(said, replies, clock=_clock(spark, LONG_AFTER)), "log", "append")


def recovered_jobs_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recovered_jobs`` from a stream of jobs: changes made by timers as the clock reaches ``AS_OF``."""
    stream = stored_jobs(spark, sf_dir, _stream(spark, sf_dir, "events"))
    changes = _run(timed.recover_and_expire_stream(stream, _clock(spark, AS_OF)), "recovered", "append", rocks=True)
    jobs = stored_jobs(spark, sf_dir)
    log = workspace.change_rows(jobs.select("job_id", "status", "updated_at"), "insert", F.col("updated_at"), F.lit(0)).unionByName(changes.withColumn("change_no", F.lit(1)))
    return workspace.current_state(log, ["job_id"]).select("job_id", "status", "updated_at")


def _events(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))


def rate_limit_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rate_limit_replay`` as a stream."""
    return _run(state.rate_limit_stream(_events(_stream(spark, sf_dir, "events")), 3, 3600.0), "limits", "append")


def answer_memo_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answer_memo`` as a stream."""
    asked = _stream(spark, sf_dir, "events").select(F.col("event_id").alias("ask_id"), (F.col("user_id") * 10 + F.col("event_id") % 3).alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return _run(state.answer_memo_stream(asked, 20_000), "memo", "append")


def folded_jobs(spark: SparkSession, sf_dir: str, job_events: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The last snapshot that ``streams.fold_jobs`` keeps of a stream of job events."""
    root = scratch(spark, "jobs")
    streams.fold_jobs(job_events(_stream(spark, sf_dir, "events")), f"{root}/jobs", f"{root}/state").awaitTermination()
    latest = max(int(p.getPath().getName().removeprefix("version=")) for p in _listed(spark, f"{root}/jobs"))
    return spark.read.parquet(f"{root}/jobs/version={latest}")


def _listed(spark: SparkSession, folder: str) -> list:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return list(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))


@query("SELECT 'completed' AS status, 100 AS progress, count(*) AS files_total, count(*) AS chunks_total, count(*) AS chunks FROM supplier")
def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files of their own, ingested by a stream whose micro-batches leave the events of their jobs; summed over the batches."""
    root = scratch(spark, "ingest")
    named = table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(" of "), F.col("s_nationkey").cast("string")).alias("value"), "s_suppkey")
    written_by_key(named, "s_suppkey", 500, f"{root}/files")
    streams.ingest_files(spark, f"{root}/files", f"{root}/chunks", f"{root}/jobs", f"{root}/state", {"owner": "ann"}, events_path=f"{root}/events").awaitTermination()
    jobs = state.job_snapshot(spark.read.parquet(f"{root}/events/batch=*"))
    return jobs.groupBy("status").agg(F.min("progress").alias("progress"), *[F.sum(c).alias(c) for c in ("files_total", "chunks_total", "chunks")])
