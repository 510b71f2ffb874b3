"""Row numbers and running sums over whole tables: ranges are sorted apart, and only counts of ranges meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkdoc.operators.common import written

_ROW = (1 << 33) - 1


@dataclass
class Ranges:
    """A table in order: ``rows`` has it with ``_at`` (range and place in it), ``before`` the rows in front of each range."""

    rows: DataFrame
    before: dict[int, int]
    total: int

    def numbered(self, name: str = "rank") -> DataFrame:
        """All rows with their number from 1, a long, in place of ``_at``."""
        spark = self.rows.sparkSession
        starts = spark.createDataFrame(sorted(self.before.items()), "_range long, _before long")
        joined = self.rows.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")  # a row for each range
        return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_ROW) + 1).drop("_range", "_before", "_at")

    def between(self, first: int, last: int, name: str = "rank") -> DataFrame:
        """The rows numbered ``first`` to ``last``; other ranges' files are left out by their statistics."""
        ends = dict(zip(self.before, [*self.before.values(), self.total][1:], strict=True))
        wanted = [r for r, n in self.before.items() if n < last and ends[r] >= first]
        if not wanted:
            return self.numbered(name).where("false")
        near = Ranges(self.rows.where(F.col("_at").between(min(wanted) << 33, (max(wanted) << 33) + _ROW)), self.before, self.total)
        return near.numbered(name).where(F.col(name).between(first, last))


def in_ranges(rows: DataFrame, order: list[Column | str]) -> Ranges:
    """``rows`` sorted by ``order``, written once by range partitions; the driver gets a count for each.

    No task sees more than its range, whatever the keys are: sparse or hashed ids need no blocks of numbers.
    ``order`` should end in a unique column, as rows of one key lie in one range.
    """
    held = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = sorted((r["_range"], r["n"]) for r in held.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for number, n in counts:
        before[number], total = total, total + n
    return Ranges(held, before, total)


def running_sums(rows: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each in ``order``: summed in ranges, and over the ranges' sums."""
    held = in_ranges(rows, order)
    marked = held.rows.withColumn("_range", F.shiftright("_at", 33))
    sums, total = [], 0
    for r in sorted(marked.groupBy("_range").agg(F.sum(value).alias("s")).collect()):
        sums.append((r["_range"], total))
        total += r["s"] or 0
    starts = rows.sparkSession.createDataFrame(sums, "_range long, _start long")
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn(name, F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start", "_at")


def page_with_total(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """The page of ``workspace.page`` with place (from 1) and total, the number of all rows; however deep, only the ranges it touches are read again."""
    held = in_ranges(rows, order)
    offset, limit = max(0, offset), min(200, max(1, limit))
    return held.between(offset + 1, offset + limit, "place").withColumn("total", F.lit(held.total).cast("long"))
