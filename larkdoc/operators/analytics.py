"""Counts and summaries for operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 4096


def dashboard_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with a count for each table."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), counts)  # rows of one


def recent_rows(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))).agg(F.count("*").alias("recent"))


def top_users(messages: DataFrame, n: int = 10) -> DataFrame:
    """(username, messages) of the users who said most, ties by name."""
    return messages.where("role = 'user'").groupBy("username").agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "username").limit(n)


def per_day(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """(day, n) for days with rows since ``days`` before ``as_of``."""
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def usage_report(messages: DataFrame, ts: str, as_of: Column, days: int, n: int = 10) -> DataFrame:
    """(part, name, n) of a period's ``n`` busiest users and messages a day; part is top_users or per_day."""
    users = top_users(messages, n).select(F.lit("top_users").alias("part"), F.col("username").alias("name"), F.col("messages").alias("n"))
    return users.unionByName(per_day(messages, ts, as_of, days).select(F.lit("per_day").alias("part"), F.col("day").cast("string").alias("name"), "n"))


def request_metrics(requests: DataFrame) -> DataFrame:
    """(metric, name, n): totals, counts by status and by endpoint, from (status, endpoint, fallback)."""
    name = F.explode(F.array(F.struct(F.lit("total").alias("metric"), F.lit("requests").alias("name")), F.struct(F.lit("status").alias("metric"), F.col("status").cast("string").alias("name")), F.struct(F.lit("endpoint").alias("metric"), F.col("endpoint").alias("name")), F.when(F.col("fallback"), F.struct(F.lit("total").alias("metric"), F.lit("fallbacks").alias("name"))), F.when(F.col("status") == 429, F.struct(F.lit("total").alias("metric"), F.lit("throttled").alias("name")))))
    return requests.select(name.alias("x")).where("x is not null").groupBy("x.metric", "x.name").agg(F.count("*").alias("n"))


def latency_summary(runs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, runs, successes, mean, median, p95) of a value that is null for failures; p95 is sorted[int(0.95 * (n - 1))].

    Rows are counted by value first. The counts are summed in two steps, over ``BLOCKS`` equal stretches between
    a key's least and greatest value and within those that hold a wanted place, so no window sees a key's rows.
    """
    totals = runs.groupBy(key).agg(F.count("*").alias("runs"), F.count(value).alias("successes"), F.avg(value).alias("mean"), F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    counts = runs.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    share = (F.col("_value").cast("double") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    block = F.when(share.isNull() | F.isnan(share), BLOCKS + 1).otherwise(F.floor(share * BLOCKS))
    placed = counts.join(totals, F.col("_key").eqNullSafe(F.col(key))).select("_key", "_value", "_n", "successes", block.alias("_block"))

    def before(*keys: str) -> Column:
        w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    last = F.col("successes") - 1
    places = F.posexplode(F.array(F.floor(0.95 * last), F.floor(last / 2), F.ceil(last / 2))).alias("_which", "_place")
    blocks = placed.groupBy("_key", "_block", "successes").agg(F.sum("_n").alias("_n"))
    blocks = blocks.withColumn("_before", before("_key", "_block")).select("_key", "_block", "_n", "_before", places)
    wanted = blocks.where("_before <= _place and _place < _before + _n").select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), "_which", (F.col("_place") - F.col("_before")).alias("_place"))
    within = placed.join(wanted, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).withColumn("_before", before("_key", "_which", "_value"))
    found = within.where("_before <= _place and _place < _before + _n").groupBy("_key").agg(*[F.max(F.when(F.col("_which") == i, F.col("_value"))).alias(f"_v{i}") for i in range(3)])
    median = F.when(F.col("_v1") == F.col("_v2"), F.col("_v1").cast("double")).otherwise(F.col("_v1") * F.lit(0.5) + F.col("_v2") * F.lit(0.5))
    return totals.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "runs", "successes", "mean", median.alias("median"), F.col("_v0").alias("p95"))


def admin_counts(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(F.col("role") == "admin").alias("admins"), F.count_if((F.col("role") == "admin") & F.col("is_active")).alias("active_admins"))
