"""Streaming counts, ingest and job snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from larkdoc.operators.vectors import hash_embedding
from larkdoc.sources.extract import ingest
from larkdoc.streaming.state import job_snapshot
from larkdoc.streaming.timed import with_clock


def live_metrics(requests: DataFrame) -> DataFrame:
    """Running counts by status and endpoint; for complete or update mode."""
    return requests.groupBy("status", "endpoint").agg(F.count("*").alias("n"))


def per_minute(requests: DataFrame, late: str = "10 minutes", clock: DataFrame | None = None) -> DataFrame:
    """(minute, endpoint, n); in append mode a minute comes once it can't change, and its state goes."""
    return with_clock(requests.select("ts", "endpoint"), "ts", clock, late).groupBy(F.window("ts", "1 minute").alias("w"), "endpoint").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "endpoint", "n")


def daily_counts(rows: DataFrame, late: str = "1 day", clock: DataFrame | None = None) -> DataFrame:
    """(day, n); in append mode a day comes once it can't change."""
    return with_clock(rows.select("ts"), "ts", clock, late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def progress_feed(events: DataFrame) -> DataFrame:
    """The highest progress of each job so far, at most 99 until it is complete."""
    return events.groupBy("job_id").agg(F.max(F.when(F.col("kind") == "complete", 100).otherwise(F.least(F.lit(99), F.coalesce("progress", F.lit(0))))).alias("progress"))


def _progress_rows(spark: SparkSession, job: str, files: int, chunks: int, failed: int) -> DataFrame:
    """The events of one ingested micro-batch, for ``job_snapshot``."""
    said = [("queue", None, None, None), ("claim", None, None, None), ("progress", 30, None, None), ("progress", 95, chunks, chunks), ("complete" if failed < files or not files else "fail", None, chunks, chunks)]
    schema = "job_id string, event_no long, kind string, progress int, chunks long, detail string, files_total long, chunks_total long"
    rows = [(job, n, kind, progress, done, f"{failed} of {files} files failed" if failed else None, files, total) for n, (kind, progress, done, total) in enumerate(said)]
    return spark.createDataFrame(rows, schema).withColumn("ts", F.current_timestamp())


def ingest_files(spark: SparkSession, path: str, chunks_path: str, jobs_path: str, checkpoint: str, stamp: dict[str, str], documents_path: str | None = None, events_path: str | None = None) -> StreamingQuery:
    """Files that appear under ``path`` are ingested (``extract.ingest``): chunks, a job row for each file, and document rows.

    Each micro-batch overwrites its own folders, so one that is run again after a failure leaves no second copy. Under
    ``events_path`` each leaves the events of a job of its own, with files_total, chunks_total and chunks: what passed
    through the writes is counted by ``observe`` as they run, and nothing is read again.
    """
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))

    def run(batch: DataFrame, number: int) -> None:
        documents, chunks, jobs, _ = ingest(batch, stamp, hash_embedding)
        cut, seen = Observation(), Observation()
        chunks.observe(cut, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")
        if documents_path:
            documents.write.mode("overwrite").parquet(f"{documents_path}/batch={number}")
        jobs.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed")).write.mode("overwrite").parquet(f"{jobs_path}/batch={number}")
        if events_path:
            _progress_rows(batch.sparkSession, f"batch-{number}", seen.get["n"], cut.get["n"], seen.get["failed"]).write.mode("overwrite").parquet(f"{events_path}/batch={number}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressCalls(StreamingQueryListener):
    """Calls ``tell`` with (query's id, micro-batch, rows of input, seconds it took, rows of state) as each micro-batch of any stream of the session ends.

    Add it with ``spark.streams.addListener``. It runs on the driver; an error of ``tell`` doesn't stop a stream.
    """

    def __init__(self, tell: Callable[[dict[str, object]], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        """Nothing is known yet."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        """Nothing has changed."""

    def onQueryTerminated(self, event) -> None:
        self.tell({"query": str(event.id), "ended": True, "error": event.exception})


def fold_jobs(events: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """``job_snapshot`` kept up to date by a stream: each micro-batch goes on from the last version of the snapshot.

    So a batch costs as much as its events and the jobs held, however many events came before. The
    version after batch n is ``version=<n>`` under ``state_path``; a batch that is run again starts from
    the version before it, so that one stays and older ones are deleted. Events of a job must come in order of micro-batches.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.parquet(f"{state_path}/version={number - 1}") if number else None
        job_snapshot(batch, held).write.mode("overwrite").parquet(f"{state_path}/version={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/version={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
