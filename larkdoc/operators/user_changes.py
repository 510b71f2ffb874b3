"""Field-wise changes of keyed rows, and the changes that the rows' state refuses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.operators.common import in_key_order, written


def judged_changes(held: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes`` (change_no, key, op and fields) with reason, null where they take effect, and life, how often the key was inserted by then.

    An insert is refused while its key lives, a set or a delete while it doesn't; unknown operations and null keys are refused.
    Rows are dealt by key and read in the order of change_no, so a key of any number of changes streams through its
    task; only keys and operations are dealt, fields are joined back. change_no is unique.
    """

    def step(state: tuple[bool, int], row: tuple) -> tuple[tuple[bool, int], tuple]:
        op, known, named = row
        alive, life = state
        if known:
            reason, alive = None, True
        elif not named:
            reason = f"no {key}"
        elif op not in ("insert", "set", "delete"):
            reason = "no such operation"
        elif op == "insert" and alive:
            reason = f"{key} exists"
        elif op != "insert" and not alive:
            reason = f"no such {key}"
        else:
            reason, alive, life = None, op != "delete", life + (op == "insert")
        return (alive, life), (reason, life)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_key_order(batches, lambda: (False, 0), step, ["change_no", "reason", "life"], [pa.int64(), pa.string(), pa.int64()])

    rows = changes.select(F.col("change_no").cast("long").alias("change_no"), F.col(key).alias("_key"), "op", F.lit(False).alias("_known"))
    known = held.where(F.col(key).isNotNull()).select(F.lit(None).cast("long").alias("change_no"), F.col(key).alias("_key"), F.lit(None).cast("string").alias("op"), F.lit(True).alias("_known"))
    # keys that are held come as rows in front of their changes
    asked = rows.unionByName(known).withColumn("_named", F.col("_key").isNotNull())
    found = asked.repartition(F.xxhash64("_key")).sortWithinPartitions("_key", F.col("change_no").asc_nulls_first()).mapInArrow(task, "change_no long, reason string, life long")
    return changes.join(found.where("change_no is not null"), "change_no")


def apply_changes(held: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): ``held`` (key, fields) after ``changes`` (change_no, op, key, fields), and the changes that ``judged_changes`` refuses.

    A field is what the last change of the key's present life that says it (isn't null) made it; changes say only the
    fields they mean. What a key had before it was deleted is gone. Values are picked by partial aggregation, so a hot
    key's changes are not gathered.
    """
    judged = written(judged_changes(held, changes, key), "judged")
    first = held.select(key, *fields, F.lit("insert").alias("op"), F.lit(0).cast("long").alias("life"), F.lit(None).cast("long").alias("change_no"))
    rows = first.unionByName(judged.where("reason is null").select(key, *fields, "op", "life", F.col("change_no").cast("long").alias("change_no")))
    at = F.struct("life", F.coalesce("change_no", F.lit(-(1 << 62))))
    said = [F.max_by(F.when(F.col(f).isNotNull(), F.struct(F.col("life").alias("life"), F.col(f).alias("value"))), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    last = rows.groupBy(key).agg(F.max("life").alias("_life"), F.max_by("op", at).alias("_op"), *said).where("_op <> 'delete'")
    now = last.select(key, *[F.when(F.col(f"{f}.life") == F.col("_life"), F.col(f"{f}.value")).alias(f) for f in fields])
    return now, judged.where("reason is not null").drop("life")


USER_FIELDS = ["role", "is_active", "password_hash"]


def apply_user_changes(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``apply_changes`` to users by username, any case, without spaces around; an unset role is user, an unset is_active true."""
    named = lambda df: df.withColumn("username", F.lower(F.trim("username")))
    rows, refused = apply_changes(named(users).select("username", *USER_FIELDS), named(changes), "username", USER_FIELDS)
    return rows.withColumns({"role": F.coalesce("role", F.lit("user")), "is_active": F.coalesce("is_active", F.lit(True))}), refused
