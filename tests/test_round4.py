"""Findings of round 4: jobs that stall or expire share states, and each has the changes that it had by itself."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkdoc.streaming import timed

T0 = datetime(2024, 5, 1)


def run(spark, rows, root):
    """(rows that the stream wrote, rows of state after each micro-batch)."""
    found = []
    with timed.rocks_state(spark):
        query = rows.writeStream.foreachBatch(lambda batch, n: found.extend(map(tuple, batch.collect()))).outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return found, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


def test_jobs_share_states_and_change_as_by_themselves(spark, tmp_path):
    """Updates that requeue, revive, come late or twice at one time, over several micro-batches: one state a bucket, the same changes at the same times."""
    random_ = random.Random(4)
    schema = "job_id long, status string, updated_at timestamp"
    for part in range(5):
        held = [(random_.randrange(150), random_.choice(("queued", "processing", "completed", "failed")), T0 + timedelta(seconds=part * 200 + random_.randrange(-30, 200))) for _ in range(120)]
        spark.createDataFrame([*held, (None, "failed", T0), (1, None, T0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(0, "queued", T0 + timedelta(seconds=1300))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = lambda buckets: timed.recover_and_expire_stream(jobs, None, 60, 400, "20 seconds", buckets)
    alone, _ = run(spark, stream(None), f"{tmp_path}/alone")
    shared, states = run(spark, stream(4), f"{tmp_path}/shared")
    assert sorted(shared) == sorted(alone) and {r[1] for r in shared} == {"update", "delete"}
    assert len({r[4] for r in shared}) > 3 and 1 <= max(states) <= 4


@pytest.mark.parametrize("buckets", [None, 2])
def test_a_job_ends_at_the_second_after_its_limit(spark, tmp_path, buckets):
    """Older than the limit in whole seconds, as in SQL: not at the limit, but a second later."""
    spark.createDataFrame([(n, "processing", T0 + timedelta(seconds=n)) for n in range(3)], "job_id long, status string, updated_at timestamp").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(T0 + timedelta(seconds=62),)], "at timestamp").write.parquet(f"{tmp_path}/clock")
    clock = spark.readStream.schema("at timestamp").parquet(f"{tmp_path}/clock")
    jobs = spark.readStream.schema("job_id long, status string, updated_at timestamp").parquet(f"{tmp_path}/in")
    found, _ = run(spark, timed.recover_and_expire_stream(jobs, clock, 60, 400, buckets=buckets), tmp_path)
    assert sorted(r[0] for r in found) == [0, 1] and {r[3] for r in found} == {T0 + timedelta(seconds=62)}


def test_jobs_of_a_bucket_may_have_ids_of_any_type(spark, tmp_path):
    given = spark.createDataFrame([("1.5", "processing", T0), ("NaN", "processing", T0), ("NaN", "completed", T0 + timedelta(seconds=1))], "v string, status string, updated_at timestamp")
    spark.createDataFrame([(T0 + timedelta(seconds=500),)], "at timestamp").write.parquet(f"{tmp_path}/clock")
    clock = spark.readStream.schema("at timestamp").parquet(f"{tmp_path}/clock")
    number = F.col("v").cast("double")
    for name, made in {"text": F.col("v"), "number": number, "row": F.struct(number.alias("n"), F.lit(b"\xff").alias("b"))}.items():
        rows = given.select(made.alias("job_id"), "status", "updated_at")
        rows.write.parquet(f"{tmp_path}/{name}")
        changes = timed.recover_and_expire_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{name}"), clock, 60, 400, buckets=1)
        assert dict(changes.dtypes)["job_id"] == dict(rows.dtypes)["job_id"]
        found, _ = run(spark, changes, f"{tmp_path}/{name}-run")
        ended = dict(zip((str(r[0]) for r in rows.collect()), (("update", "queued"), ("delete", "completed"), ("delete", "completed")), strict=True))
        assert len(found) == 2 and {str(r[0]): r[1:3] for r in found} == ended
