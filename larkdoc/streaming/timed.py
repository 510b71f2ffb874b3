"""Streams whose results wait for time to pass: conversations, jobs that stall or expire, uploads remembered for ever."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkdoc.functions import rules
from larkdoc.operators.workspace import WORKSPACE, log_of_turns
from larkdoc.streaming.state import BUCKETS

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class rocks_state:
    """Streams that start inside keep their state in RocksDB, on disk and not on the heap, as processors with timers need it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STATE_STORE)
        self.spark.conf.set(STATE_STORE, ROCKS)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(STATE_STORE, self.before)


def with_clock(rows: DataFrame, time: str, clock: DataFrame | None, late: str) -> DataFrame:
    """``rows`` with a watermark ``late`` behind ``time``; rows of ``clock`` (at) move it on as well, so that time passes where nothing is said."""
    if clock is not None:
        rows = rows.withColumn("_tick", F.lit(False)).unionByName(clock.select(F.col("at").alias(time), F.lit(True).alias("_tick")), allowMissingColumns=True)
        # ticks must reach the watermark, so neither this condition nor one behind it may be moved before it: it names the time, and the partition, which varies, holds up the others
        return rows.withWatermark(time, late).where(F.when(~F.col("_tick"), F.col(time)).isNotNull() & (F.spark_partition_id() >= 0)).drop("_tick")
    return rows.withWatermark(time, late)


def live_conversation_log(asked: DataFrame, answers: DataFrame, wait: str = "10 minutes", late: str = "10 minutes", clock: DataFrame | None = None) -> DataFrame:
    """``workspace.conversation_log`` over streams, for append mode.

    ``asked`` has qid, the workspace, question and created_at; ``answers`` qid, answer, sources and answered_at. Questions wait for
    their answer in the join's state, and go out with the fallback once the watermarks of both streams say that none can come within
    ``wait``; answers wait for questions that are late. Rows more than ``late`` behind their stream are left out; answers to nothing
    and those after ``wait`` are dropped. State is bounded by the time, not by the stream.
    """
    asked = with_clock(asked.select("qid", *WORKSPACE, "question", "created_at"), "created_at", clock, late)
    answers = with_clock(answers.select(F.col("qid").alias("_qid"), "answer", "sources", "answered_at"), "answered_at", clock, late)
    in_time = F.expr(f"answered_at >= created_at AND answered_at <= created_at + INTERVAL {wait}")
    return log_of_turns(asked.join(answers, (F.col("qid") == F.col("_qid")) & in_time, "left_outer"))


def _due(status: str, updated_s: int, stale: int, retention: int) -> int | None:
    """The first second at which a job of this status is stale or expired, if it can be."""
    limit = stale if status == "processing" else retention if status in ("completed", "failed") else None
    return None if limit is None else updated_s + limit + 1


def _ended(status: str) -> tuple[str, str]:
    """(op, status) of the change that ends a job held with this status."""
    return ("update", "queued") if status == "processing" else ("delete", status)


class JobTimers(StatefulProcessor):
    """A job's status with the second of its last update, while a timer of event time waits to requeue or to expire it."""

    def __init__(self, stale: int, retention: int):
        self.stale, self.retention = stale, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, updated_us long")

    def _keep(self, held: bool, status: str, updated_us: int) -> None:
        # each use of state is a call to the JVM: a job that isn't held has no timer and nothing to clear
        if held:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        due = _due(status, updated_us // 1_000_000, self.stale, self.retention)
        if due is not None:
            self.job.update((status, updated_us))
            self.handle.registerTimer(due * 1000)
        elif held:
            self.job.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, at = max(((r["status"], r["updated_us"]) for r in rows), key=lambda x: (x[1], x[0]))
        held = self.job.get()
        if held is None or held[1] <= at:
            self._keep(held is not None, status, at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.job.get()
        if held is None:
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.job.clear()
        op, status = _ended(held[0])
        yield Row(job_id=key[0], op=op, status=status, updated_us=now, change_us=now)


def _bucket_timers(stale: int, retention: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """``JobTimers`` for all jobs of a bucket: one state, and one timeout at the first end among them."""

    def end_ms(at: int, status: str) -> int | None:
        due = _due(status, at // 1_000_000, stale, retention)
        return None if due is None else due * 1000

    def bucket(_: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        last: dict[object, tuple[int, str]] = {}
        for frame in () if group.hasTimedOut else frames:
            for job, at, status in zip(*(frame[c].tolist() for c in ("job_id", "updated_us", "status")), strict=True):
                if job not in last or last[job] < (at, status):
                    last[job] = at, status
        held = {job: (at, status) for job, at, status in zip(*group.get, strict=True)} if group.exists else {}
        held |= {job: said for job, said in last.items() if job not in held or held[job][0] <= said[0]}
        now, kept, ended = group.getCurrentWatermarkMs(), [], []
        for job, (at, status) in held.items():
            end = end_ms(at, status)
            if end is not None and end <= now:
                ended.append((job, *_ended(status)))
            elif end is not None:
                kept.append((job, at, status, end))
        if kept:
            jobs, times, statuses, ends = map(list, zip(*kept, strict=True))
            group.update((jobs, times, statuses))
            group.setTimeoutTimestamp(min(ends) - 1)  # it comes once the watermark is beyond this time
        elif group.exists:
            group.remove()
        if ended:
            jobs, ops, statuses = map(list, zip(*ended, strict=True))
            yield pd.DataFrame({"job_id": jobs, "op": ops, "status": statuses, "updated_us": now * 1000, "change_us": now * 1000})

    return bucket


def recover_and_expire_stream(jobs: DataFrame, clock: DataFrame | None = None, stale: int = rules.STALE_SECONDS, retention: int = rules.RETENTION_SECONDS, late: str = "0 seconds", buckets: int | None = BUCKETS) -> DataFrame:
    """Changes (job_id, op, status, updated_at, change_ts) for ``workspace.current_state`` as time passes over ``jobs`` (job_id, status, updated_at), for append mode.

    A processing job without an update for ``stale`` seconds is queued anew, a completed or failed one is deleted ``retention`` seconds
    after its last update, both at the watermark's time. A job with such an end is held with its last update, nothing else, until then;
    queued jobs aren't. Start it under ``rocks_state``. Rows behind the watermark are left out.

    Jobs share a state and a timer by hash, so Python and the state are called for each of the ``buckets`` that a micro-batch touches, however many
    jobs there are. A stream's state keeps to the number that it began with. With None each job has a state and a timer of its own, as streams had that were
    begun before there were buckets: a micro-batch then costs as much as its jobs, at several calls for each, and reads no others.
    """
    timed = with_clock(jobs.select("job_id", "status", "updated_at"), "updated_at", clock, late)
    rows = timed.where("job_id is not null and status is not null").withColumn("updated_us", F.unix_micros("updated_at"))
    kind, ends = jobs.schema["job_id"].dataType, (max(30, stale), max(300, retention))
    said = "op string, status string, updated_us long, change_us long"
    if buckets is None:
        found = rows.groupBy("job_id").transformWithState(JobTimers(*ends), f"job_id {kind.simpleString()}, {said}", "append", "EventTime")
    else:
        plain = isinstance(kind, (T.IntegralType, T.DecimalType, T.StringType, T.BooleanType))  # what pandas and state give back as it was; others go as JSON
        form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
        named = rows if plain else rows.withColumn("job_id", F.to_json(F.struct("job_id"), form))
        name = kind.simpleString() if plain else "string"
        dealt = named.withColumn("_bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)))
        found = dealt.groupBy("_bucket").applyInPandasWithState(_bucket_timers(*ends), f"job_id {name}, {said}", f"job_ids array<{name}>, updated_us array<long>, statuses array<string>", "append", GroupStateTimeout.EventTimeTimeout)
        if not plain:
            found = found.withColumn("job_id", F.from_json("job_id", T.StructType().add("job_id", kind), form)["job_id"])
    return found.select("job_id", "op", "status", F.timestamp_micros("updated_us").alias("updated_at"), F.timestamp_micros("change_us").alias("change_ts"))


class FirstUpload(StatefulProcessor):
    """Whether a key was stored or seen; it is never forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.seen.update((0,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min((r["at"], r["upload_no"]) for r in rows)
        if not self.seen.exists():
            self.seen.update((first[0],))
            yield Row(username=key[0], chat_id=key[1], file_hash=key[2], upload_no=first[1], at=first[0])


def refuse_known_uploads(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """The first (ts, upload_no, workspace, file_hash) of ``uploads`` of each hash in a workspace that isn't in ``stored``, for append mode.

    ``stored`` is read once, as the state to begin with; after that the stream remembers every hash, however long ago,
    in RocksDB, some tens of bytes each. Start it under ``rocks_state``. Of one micro-batch's copies the earliest counts.
    """
    key = [*WORKSPACE, "file_hash"]
    rows = uploads.select(*key, F.col("upload_no").cast("long").alias("upload_no"), F.unix_micros("ts").alias("at")).where("at is not null and upload_no is not null")
    begun = stored.select(*key, F.lit(True).alias("held")).distinct().groupBy(*key)
    found = rows.groupBy(*key).transformWithState(FirstUpload(), "username string, chat_id string, file_hash string, upload_no long, at long", "append", "None", initialState=begun)
    return found.select(F.timestamp_micros("at").alias("ts"), "upload_no", *key)
