"""Streams over time: what comes late, what is forgotten and what is not; null keys in batch and stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkdoc.functions import rules
from larkdoc.streaming import state, timed

T0 = datetime(2024, 5, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


class Feed:
    """A folder that is read as a stream, one run after another from where the last one ended."""

    def __init__(self, spark, root, schema):
        self.spark, self.path, self.schema = spark, f"{root}/in", schema
        self.rows = None

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)
        return self

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def run(spark, rows, root, rocks=False):
    """(rows of this run, rows of state after it)."""
    found = []
    with timed.rocks_state(spark):
        query = rows.writeStream.foreachBatch(lambda batch, n: found.extend(tuple(r) for r in batch.collect())).outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return found, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_a_question_waits_for_its_answer(spark, tmp_path):
    asked = Feed(spark, f"{tmp_path}/q", "qid long, username string, chat_id long, question string, created_at timestamp")
    answers = Feed(spark, f"{tmp_path}/a", "qid long, answer string, sources array<string>, answered_at timestamp")
    asked.put((1, "u", 1, "one", at(0)), (2, "u", 1, "two", at(10)), (3, "u", 1, "three", at(20)))
    answers.put((1, "first", None, at(5)), (3, "too late", None, at(20 + 700)), (9, "to nothing", None, at(30)))
    step = lambda: run(spark, timed.live_conversation_log(asked.stream(), answers.stream(), "10 minutes", "10 minutes"), tmp_path)
    said = lambda rows: sorted((r[0], r[4]) for r in rows)
    assert said(step()[0]) == [("1-assistant", "first"), ("1-user", "one")]
    answers.put((2, "in time", None, at(300)))
    asked.put((4, "u", 1, "four", at(400)))
    assert said(step()[0]) == [("2-assistant", "in time"), ("2-user", "two")]
    asked.put((5, "u", 1, "five", at(9000)))
    answers.put((4, "never", None, at(9001)))
    assert said(step()[0]) == [("3-assistant", rules.FALLBACK_ANSWER), ("3-user", "three"), ("4-assistant", rules.FALLBACK_ANSWER), ("4-user", "four")]
    asked.put((6, "u", 1, "late", at(100)))  # behind the watermark
    assert step()[0] == []


def test_jobs_are_requeued_and_expire(spark, tmp_path):
    jobs = Feed(spark, f"{tmp_path}/j", "job_id long, status string, updated_at timestamp")
    jobs.put((1, "processing", at(0)), (2, "completed", at(0)), (3, "queued", at(0)), (4, "failed", at(50)), (5, "processing", at(60)), (6, "processing", at(0)), (None, "failed", at(0)), (7, None, at(0)))
    step = lambda: run(spark, timed.recover_and_expire_stream(jobs.stream()), tmp_path)
    changes = lambda rows: sorted(r[:3] for r in rows)
    assert step()[0] == []
    jobs.put((6, "completed", at(90)), (5, "processing", at(70)), (8, "queued", at(185)))
    assert changes(step()[0]) == [(1, "update", "queued")]
    jobs.put((8, "queued", at(200)))  # 5 was heard of at 70
    assert changes(step()[0]) == [(5, "update", "queued")]
    jobs.put((8, "queued", at(5000)))
    found, left = step()
    assert changes(found) == [(2, "delete", "completed"), (4, "delete", "failed"), (6, "delete", "completed")]
    assert all(r[4] == at(5000) for r in found) and left == 0


def test_a_repeat_two_days_later_is_refused(spark, tmp_path):
    uploads = Feed(spark, f"{tmp_path}/u", "username string, chat_id string, file_hash string, upload_no long, ts timestamp")
    stored = spark.createDataFrame([("u", "c", "held")] * 2, "username string, chat_id string, file_hash string")
    uploads.put(("u", "c", "held", 1, at(0)), ("u", "c", "new", 3, at(5)), ("u", "c", "new", 2, at(1)), ("u", "d", "held", 4, at(0)), (None, "c", "x", 5, at(0)), (None, "c", "x", 6, at(9)))
    step = lambda: run(spark, timed.refuse_known_uploads(uploads.stream(), stored), tmp_path)[0]
    assert sorted(r[1] for r in step()) == [2, 4, 5]
    uploads.put(("u", "c", "new", 7, at(2 * 86400)), ("u", "c", "held", 8, at(400 * 86400)), ("u", "c", "other", 9, at(0)))
    assert [r[1] for r in step()] == [9]


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_null_keys_are_one_key_in_batch_and_stream(spark, tmp_path, kind):
    events = [(i, None if i % 2 else "7", at(i)) for i in range(10)]
    held = spark.createDataFrame(events, "event_id long, key string, ts timestamp").withColumn("key", F.col("key").cast(kind))
    batch = {r["event_id"]: r["allowed"] for r in state.rate_limit(held, 2, 60.0).collect()}
    assert batch == {i: i < 4 for i in range(10)}
    held.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(held.schema).parquet(f"{tmp_path}/e")
    assert {r[0]: r[1] for r in run(spark, state.rate_limit_stream(stream, 2, 60.0), f"{tmp_path}/l")[0]} == batch
    asked = held.select(F.col("event_id").alias("ask_id"), "key", F.unix_timestamp("ts").alias("at"))
    memo = {r["ask_id"]: r["reused"] for r in state.answer_memo(asked, 300).collect()}
    assert memo == {i: i > 1 for i in range(10)}
    asked = stream.select(F.col("event_id").alias("ask_id"), "key", F.unix_timestamp("ts").alias("at"))
    assert {r[0]: r[1] for r in run(spark, state.answer_memo_stream(asked, 300), f"{tmp_path}/m")[0]} == memo
    messages = held.select(F.col("event_id").alias("message_id"), F.col("key").alias("chat_id"), F.unix_timestamp("ts").alias("at"), (F.col("event_id") < 2).alias("ambiguous"), (F.col("event_id") >= 2).alias("selects"))
    said = {r["message_id"]: r["outcome"] for r in state.pending_scopes(messages, 900).collect()}
    assert said == {i: "waiting" if i < 2 else "resolved" if i < 4 else "plain" for i in range(10)}


def test_progress_is_told(spark, tmp_path):
    from larkdoc.streaming import streams

    told = []
    listener = streams.ProgressCalls(told.append)
    spark.streams.addListener(listener)
    try:
        rows = spark.range(5).withColumn("ts", F.lit(T0))
        rows.write.parquet(f"{tmp_path}/in")
        query = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert any(t.get("rows") == 5 and t["batch"] == 0 for t in told) and any(t.get("ended") and t["error"] is None for t in told)


def test_ingest_leaves_the_events_of_its_batches(spark, tmp_path):
    from larkdoc.streaming import streams

    (tmp_path / "files").mkdir()
    for name, body in (("a.txt", "alpha"), ("b.txt", "beta " * 1000), ("c.json", "{")):
        (tmp_path / "files" / name).write_text(body)
    streams.ingest_files(spark, str(tmp_path / "files"), f"{tmp_path}/chunks", f"{tmp_path}/jobs", f"{tmp_path}/s", {"owner": "o"}, events_path=f"{tmp_path}/events").awaitTermination()
    job = state.job_snapshot(spark.read.parquet(f"{tmp_path}/events/batch=0")).collect()
    n = spark.read.parquet(f"{tmp_path}/chunks/batch=0").count()
    assert [(r["status"], r["progress"], r["files_total"], r["chunks_total"], r["chunks"], r["detail"]) for r in job] == [("completed", 100, 3, n, n, "1 of 3 files failed")] and n > 3
