"""Sequential state by key, in batch and as streams; both call the same functions."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkdoc.functions import rules
from larkdoc.operators.common import in_key_order

#: What a job's event may set, by its kind: status, stage, progress.
TRANSITIONS = {"queue": ("queued", "queued", 0), "claim": ("processing", "loading", 1), "progress": ("processing", None, None), "complete": ("completed", "completed", 100), "fail": ("failed", "failed", None), "retry": ("queued", "queued", 0)}


def limit_events(times: Iterable[float], limit: int, window: float, log: deque) -> Iterator[tuple[bool, int]]:
    """(allowed, retry_after) for each time in order; ``log`` holds the accepted times, rejected ones don't count."""
    for now in times:
        while log and log[0] <= now - window:
            log.popleft()
        if limit <= 0 or len(log) < limit:
            log.append(now)
            yield True, 0
        else:
            yield False, max(1, int(log[0] + window - now))


def rate_limit(events: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """(event_id, allowed, retry_after) for events (event_id, key, ts), by key in the order of (ts, event_id).

    Rows are dealt by key and read in order, so a key of any size streams through its task.
    """

    def step(log: deque, row: tuple) -> tuple[deque, tuple]:
        return log, next(limit_events(row, limit, window, log))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_key_order(batches, deque, step, ["event_id", "allowed", "retry_after"], [pa.int64(), pa.bool_(), pa.int64()])

    rows = events.select(F.col("event_id").cast("long").alias("event_id"), "key", (F.unix_micros("ts") / 1e6).alias("at")).repartition(F.xxhash64("key")).sortWithinPartitions("key", "at", "event_id")
    return rows.mapInArrow(task, "event_id long, allowed boolean, retry_after long")


#: Seconds added to event times: a stream's first watermark is 1970, and times up to then would come late to it. So event times may lie from 1844 to 2135.
EVENT_SHIFT = 4_000_000_000


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """``rows`` with the seconds ``at``, shifted, as event time."""
    return rows.withColumn("event_time", F.timestamp_micros(((F.col("at") + EVENT_SHIFT) * 1_000_000).cast("long"))).withWatermark("event_time", late)


#: Keys share a state by hash: Python is called for each of these buckets that a micro-batch touches, however many keys there are. A stream's
#: state keeps to the number that it began with.
BUCKETS = 8_192


def _ends_ms(values: list[float], seconds: float) -> int:
    """The watermark, in milliseconds, that ends the state ``values`` of a key."""
    return math.ceil((values[-1] + seconds + EVENT_SHIFT) * 1000)


def _keyed_stream(rows: DataFrame, late: str, seconds: float, step: Callable[[Iterable[float], tuple], tuple[Iterable[float], tuple]], found: dict[str, str]) -> DataFrame:
    """A row of ``found`` (its id first) for each row (id, key, at, more) of a stream, as ``step`` makes it of the key's values and the row's (at, more), beside the key's next values.

    Rows of a micro-batch are read in the order of (at, id). A key's values are numbers, none at first, and go once the watermark has
    passed the last one by ``seconds``. Keys are kept as text, for each bucket of keys in one state.
    """
    row_id, key, at, *more = rows.columns

    def bucket(_: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        held = dict(zip(*group.get, strict=True)) if group.exists else {}
        batch = pd.concat(list(frames)).sort_values([at, row_id])
        out = []
        for name, *row in zip(*(batch[c].tolist() for c in ("_key", at, *more)), strict=True):
            held[name], made = step(held.get(name, ()), tuple(row))
            out.append(made)
        now = group.getCurrentWatermarkMs()
        held = {name: list(values) for name, values in held.items() if len(values) and _ends_ms(values, seconds) > now}
        if held:
            group.update((list(held), list(held.values())))
            group.setTimeoutTimestamp(max(_ends_ms(values, seconds) for values in held.values()))
        elif group.exists:
            group.remove()
        yield pd.DataFrame({row_id: batch[row_id], **dict(zip(list(found)[1:], zip(*out, strict=True), strict=True))})

    kind = rows.schema[key].dataType
    plain = F.to_json(F.struct(key), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}) if isinstance(kind, (T.StructType, T.ArrayType)) else F.col(key).cast("string")
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), plain), F.lit(""))).drop(key)  # a null key is a key of its own
    dealt = _timed(keyed, late).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)))
    schema = ", ".join(f"{c} {t}" for c, t in found.items())
    return dealt.groupBy("_bucket").applyInPandasWithState(bucket, schema, "keys array<string>, held array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(events: DataFrame, limit: int, window: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """``rate_limit`` over a stream: each micro-batch is ordered by (ts, event_id), the accepted times are the key's state.

    Events may come up to ``late`` after later ones; Spark leaves out those that come after it. A key's
    state goes once the watermark has passed the window of its last accepted time.
    """

    def step(times: Iterable[float], row: tuple) -> tuple[deque, tuple]:
        log = times if isinstance(times, deque) else deque(times)
        return log, next(limit_events(row, limit, window, log))

    chosen = events.select("event_id", "key", (F.unix_micros("ts") / 1e6).alias("at"))
    return _keyed_stream(chosen, late, window, step, {"event_id": "long", "allowed": "boolean", "retry_after": "long"})


def job_after(job: tuple, kind: str | None, progress: int | None, chunks: int | None, detail: str | None, ts: int | None, files_total: int | None, chunks_total: int | None) -> tuple:
    """A job's (status, progress, chunks, detail, retry_count, updated_at, files_total, chunks_total) after one more event."""
    status, at, n, said, retries, _, files, of = job
    to, _, fresh = TRANSITIONS.get(kind, (status, None, None))
    given = at if progress is None else max(at, min(100, max(0, progress)))
    said = None if kind == "retry" else said if detail is None else detail
    counts = [old if new is None else max(old, new) for old, new in ((n, chunks), (files, files_total), (of, chunks_total))]
    return to, given if fresh is None else fresh, counts[0], said, retries + (kind == "retry"), ts, *counts[1:]


def job_snapshot(events: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The state of each job after its events (job_id, event_no, kind, progress, chunks, detail, ts, and files_total and chunks_total if they have these).

    ``held`` is an earlier result to go on from; jobs of it without events stay as they were.

    Transitions set the fields of their kind; missing values leave a field as it was; progress is kept
    between 0 and 100 and never falls within a run; chunk counts only rise; a retry counts up.
    Rows are dealt by job and read in order, so a job of any size streams through its task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, job = None, None
        for batch in batches:
            names, types = ["job_id", "status", "progress", "chunks", "detail", "retry_count", "updated_at", "files_total", "chunks_total"], [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            done = []
            for job_id, status, retries, _, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if job is None or job_id != now:
                    if job is not None:
                        done.append((now, *job))
                    now, job = job_id, (None, 0, 0, None, 0, None, 0, 0)
                job = job_after(job, *event) if retries is None else (status, *event[1:4], retries, *event[4:])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if job is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, *job), types, strict=True)], names=names)

    none = F.lit(None)
    totals = [(F.col(c) if c in events.columns else none).cast("long").alias(c) for c in ("files_total", "chunks_total")]
    rows = events.select("job_id", none.cast("string").alias("status"), none.cast("int").alias("retries"), "event_no", "kind", F.col("progress").cast("int").alias("progress"), F.col("chunks").cast("long").alias("chunks"), F.col("detail").cast("string").alias("detail"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *totals)
    if held is not None:
        rows = rows.unionByName(held.select("job_id", "status", F.col("retry_count").alias("retries"), none.cast(rows.schema["event_no"].dataType).alias("event_no"), none.cast("string").alias("kind"), "progress", "chunks", "detail", F.unix_micros("updated_at").alias("at"), "files_total", "chunks_total"))
    rows = rows.repartition(F.xxhash64("job_id")).sortWithinPartitions("job_id", F.col("retries").asc_nulls_last(), "event_no", "kind", "progress", "chunks", "detail", "at")
    folded = rows.mapInArrow(task, f"job_id {events.schema['job_id'].dataType.simpleString()}, status string, progress int, chunks long, detail string, retry_count int, updated_at long, files_total long, chunks_total long")
    return folded.withColumn("updated_at", F.timestamp_micros("updated_at"))


def pending_replies(turns: Iterable[tuple[float, bool, bool]], ttl: float, waiting: float | None) -> Iterator[tuple[str, float | None]]:
    """(what a message is, the time of the question waiting after it) for (time, ambiguous, selects) in order."""
    for at, ambiguous, selects in turns:
        if waiting is not None and at - waiting > ttl:
            waiting = None
        if waiting is not None:
            yield ("resolved" if selects else "cleared"), None
            waiting = None
        elif ambiguous and not selects:
            waiting = at
            yield "waiting", waiting
        else:
            yield "plain", None


def pending_scopes(messages: DataFrame, ttl: float = rules.PENDING_SECONDS) -> DataFrame:
    """(message_id, outcome) for users' messages (message_id, chat_id, at, ambiguous, selects), by chat in the order of (at, message_id)."""

    def step(waiting: float | None, row: tuple) -> tuple[float | None, tuple]:
        outcome, waiting = next(pending_replies([row], ttl, waiting))
        return waiting, (outcome,)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_key_order(batches, lambda: None, step, ["message_id", "outcome"], [pa.int64(), pa.string()])

    rows = messages.select(F.col("message_id").cast("long").alias("message_id"), "chat_id", F.col("at").cast("double").alias("at"), "ambiguous", "selects").repartition(F.xxhash64("chat_id")).sortWithinPartitions("chat_id", "at", "message_id")
    return rows.mapInArrow(task, "message_id long, outcome string")


def answer_memo(asked: DataFrame, ttl: float = rules.MEMO_SECONDS) -> DataFrame:
    """``asked`` (key, at, ask_id) with reused: whether an answer to the key was stored no more than ``ttl`` seconds before.

    A stored answer isn't renewed by its reuse.
    """

    def step(stored: float | None, row: tuple) -> tuple[float, tuple]:
        reused = stored is not None and row[0] - stored < ttl
        return stored if reused else row[0], (reused,)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_key_order(batches, lambda: None, step, ["ask_id", "reused"], [pa.int64(), pa.bool_()])

    rows = asked.select(F.col("ask_id").cast("long").alias("ask_id"), "key", F.col("at").cast("double").alias("at")).repartition(F.xxhash64("key")).sortWithinPartitions("key", "at", "ask_id")
    return rows.mapInArrow(task, "ask_id long, reused boolean")


def pending_scopes_stream(messages: DataFrame, ttl: float = rules.PENDING_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``pending_scopes`` over a stream; the time of the waiting question is the chat's state, kept while it can be replied to.

    Messages may come up to ``late`` after later ones; Spark leaves out those that come after it.
    """

    def step(waits: Iterable[float], row: tuple) -> tuple[Iterable[float], tuple]:
        outcome, waiting = next(pending_replies([row], ttl, next(iter(waits), None)))
        return () if waiting is None else (waiting,), (outcome,)

    chosen = messages.select("message_id", "chat_id", F.col("at").cast("double").alias("at"), "ambiguous", "selects")
    return _keyed_stream(chosen, late, ttl, step, {"message_id": "long", "outcome": "string"})


def answer_memo_stream(asked: DataFrame, ttl: float = rules.MEMO_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``answer_memo`` over a stream; the time of the stored answer is the key's state, kept while it can be reused.

    Questions may come up to ``late`` after later ones; Spark leaves out those that come after it.
    """

    def step(stored: Iterable[float], row: tuple) -> tuple[Iterable[float], tuple]:
        reused = len(stored) > 0 and row[0] - stored[0] < ttl
        return stored if reused else row, (reused,)

    chosen = asked.select("ask_id", "key", F.col("at").cast("double").alias("at"))
    return _keyed_stream(chosen, late, ttl, step, {"ask_id": "long", "reused": "boolean"})
