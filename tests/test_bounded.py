"""Summaries and folds of large groups without a row, window or array that holds a group."""

import random

from larkdoc.operators import analytics
from larkdoc.streaming import state


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_latency_summary_counts_by_value(spark):
    random_ = random.Random(3)
    data = [(k, None if random_.random() < 0.1 else random_.choice([random_.uniform(0, 9), 5.0, 1e6, float("inf")])) for k in ("a", "b", None) for _ in range(401)] + [("one", 2.5), ("none", None)]
    df = analytics.latency_summary(spark.createDataFrame(data, "k string, v double"), "k", "v")
    assert not any(f"{f}(" in plan(df) for f in ("percentile", "median", "row_number"))
    for r in df.collect():
        v = sorted(x for k, x in data if k == r["k"] and x is not None)
        n = len(v)
        assert (r["runs"], r["successes"]) == (sum(k == r["k"] for k, _ in data), n)
        assert (r["median"], r["p95"]) == (((v[(n - 1) // 2] + v[n // 2]) / 2, v[int(0.95 * (n - 1))]) if n else (None, None))


def test_job_snapshot_streams_a_hot_job(spark):
    data = [(1, i, "progress", i % 70, i, None) for i in range(30_000)] + [(1, 30_000, "retry", None, None, "x"), (1, 30_001, "progress", 12, 5, "y"), (None, 1, "fail", 200, None, "z"), (None, 2, None, None, None, None)]
    df = state.job_snapshot(spark.createDataFrame(data, "job_id long, event_no long, kind string, progress int, chunks long, detail string").selectExpr("*", "timestamp_seconds(event_no) AS ts"))
    assert "collect_list" not in plan(df)
    assert {r["job_id"]: tuple(r)[1:6] for r in df.collect()} == {1: ("processing", 12, 29_999, "y", 1), None: ("failed", 100, 0, "z", 0)}
