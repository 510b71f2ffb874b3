"""Findings of round 3: results that showed only on larger or unusual tables."""

import random

import pytest
from pyspark.sql import functions as F

from larkdoc.operators import outline, workspace
from larkdoc.operators.common import spread
from larkdoc.plans import queries as plans
from larkdoc.plans import tables
from larkdoc.streaming import timed


def test_selected_documents_are_numbered_in_the_order_of_their_ids(spark):
    """Ids uploaded at one time: 9 comes before 10, though not as text."""
    held = spark.createDataFrame([("u", "c", i) for i in (9, 10, 100)], "username string, chat_id string, document_id long").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    wanted = held.select("username", "chat_id", F.col("document_id").cast("string").alias("document_id"))
    found = workspace.resolve_selected(held, wanted).select("document_id", "upload_index").collect()
    assert {tuple(r) for r in found} == {("9", 1), ("10", 2), ("100", 3)}


def test_hash_embedding_gives_whole_vectors(spark, sf_dir):
    made = plans.queries()["hash_embedding"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert set(made.columns) == {"doc_id", "i", "value"}
    assert made.count() == 256 * docs.count() == made.select("doc_id", "i").distinct().count()


def test_labels_meet_texts_and_not_their_shingles(spark, monkeypatch):
    """Of a family of variants a row for each text is joined with its component, not one for each rare shingle."""
    near = pytest.importorskip("larkdoc.llm.near_duplicates")
    held = {}

    def counted(df, label, write=near.written):
        table = write(df, label)
        held[label] = table.count()
        return table

    monkeypatch.setattr(near, "written", counted)
    random_ = random.Random(6)
    texts = [(i, " ".join(f"v{k}-{random_.randrange(5)}" if k % 25 == 3 else f"w{k}" for k in range(200))) for i in range(300)]
    near.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).count()
    assert 0 < held["rare"] <= 300 < held["labelled"]


def test_outlines_move_their_rows_once(spark):
    """A branch's rows go to their id at once, not to each branch first."""
    rows = spark.createDataFrame([(1, 2, "b", ["x", "b", "x", ""]), (1, 1, "a", ["y"]), (1, 3, "b", ["z", None]), (1, 4, "c", []), (1, 0, "", ["n"])], "id long, pos int, branch string, children array<string>")
    made = outline._branches(rows, 2, 2)
    assert [tuple(r) for r in made.orderBy("branch_no").collect()] == [(1, 0, "a", ["y"]), (1, 1, "b", ["x", "z"])]
    assert str(made._jdf.queryExecution().optimizedPlan().toString()).count("Aggregate [") == 1


def test_short_rows_are_spread_over_tasks(spark):
    """However few bytes they have, rows that make a file each aren't one task's."""
    rows = spark.range(2000).withColumnRenamed("id", "k")
    parts = spread(rows, 100, "k").select("k", F.spark_partition_id().alias("p"))
    assert parts.count() == 2000 and parts.select("p").distinct().count() >= 15


def test_python_workers_get_small_batches(spark, sf_dir):
    for before, after in (("64m", "8388608b"), ("1000b", "1000b")):
        spark.conf.set(tables.BATCHES, before)
        tables.table(spark, sf_dir, "documents")
        assert spark.conf.get(tables.BATCHES) == after
    spark.conf.unset(tables.BATCHES)


def test_a_new_job_costs_few_state_calls():
    """Calls go to the JVM one by one: three for a job with an end, one for a job without."""
    calls = []

    class Fake:
        def __getattr__(self, name):
            return lambda *_: calls.append(name)

    timers = timed.JobTimers(60, 600)
    timers.handle = timers.job = Fake()
    timers.handleInputRows((1,), iter([{"status": "processing", "updated_us": 10**6}]), None)
    assert calls == ["get", "update", "registerTimer"]
    calls.clear()
    timers.handleInputRows((2,), iter([{"status": "queued", "updated_us": 10**6}]), None)
    assert calls == ["get"]
