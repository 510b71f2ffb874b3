"""A uniform shuffle of all rows into shards of exact sizes, planned by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.common import written

#: Rows that a block of a shard should have, and blocks of a shard at most.
BLOCK_ROWS, MOST_BLOCKS = 1 << 13, 128
_ROW = (1 << 33) - 1
_NUMPY_MOST = 10**9 - 1


def hypergeometric(random: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from good + bad are good; populations of any size."""
    if good + bad <= _NUMPY_MOST:
        return int(random.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(good, n)
    # from the most likely count outwards, as far as a double can tell the tail from nothing
    middle = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    reach = 30 + int(10 * np.sqrt(n * (good / (good + bad)) * (bad / (good + bad)) + 1))
    up, down = np.arange(middle, min(high, middle + reach), dtype=float), np.arange(middle, max(low, middle - reach), -1, dtype=float)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    return middle - len(below) + int(np.searchsorted(np.cumsum(weights), random.random() * weights.sum(), "right").clip(0, len(weights) - 1))


def split_counts(random: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows drawn without replacement come from each of ``sizes``."""
    if sizes.sum() <= _NUMPY_MOST:
        return random.multivariate_hypergeometric(sizes, n, method="marginals")
    out, rest = np.zeros_like(sizes), int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        rest -= size
        out[i] = hypergeometric(random, size, rest, n)
        n -= int(out[i])
    return out


def matrix_row(i: int, before: np.ndarray, blocks: np.ndarray, seed: int) -> np.ndarray:
    """Row ``i`` of the communication matrix: how many rows of part ``i`` go to each block.

    ``before`` has the rows in front of each part, and all rows at its end. A binary tree over the
    parts splits the blocks' room between its halves, each node with a generator of its own; so a task finds its
    row on one path of the tree, all tasks agree, and nobody holds the matrix.
    """
    low, high, room = 0, len(before) - 1, blocks
    while high - low > 1:
        middle = (low + high) // 2
        left = split_counts(np.random.default_rng((seed, 1, low, high)), room, int(before[middle] - before[low]))
        low, high, room = (low, middle, left) if i < middle else (middle, high, room - left)
    return room


def shard_rows(rows: DataFrame, shards: int = 8, seed: int = 13) -> DataFrame:
    """``rows`` with shard int and slot long: a uniform random order cut into shards whose counts differ by one at most.

    The rows are written once, each with its part (the task that wrote it) and its place there. Shards
    are made of blocks of fixed sizes, one shard's slots running through its blocks. The matrix of exact counts from each part to
    each block is drawn hypergeometrically (``matrix_row``), a part's rows are dealt by a permutation of its labels, rows move
    once to their blocks, and a second permutation in each block gives the slots. All orders of all rows are
    equally likely, up to the generator. A task holds a number for each row of its part or block, no rows;
    the driver gets a count for each part. With ``MOST_BLOCKS`` blocks in each shard, blocks grow with the table beyond that.

    Nulls and repeated rows are dealt like other rows, and equal rows apart, as a uniform order needs. The order depends on how
    the rows lie in parts and on ``seed`` alone; what is read again after a loss is the same. Columns named shard
    or slot are replaced. Fewer rows than shards leave shards empty; no rows give no rows.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    marked = written(rows.withColumn("_at", F.monotonically_increasing_id()), "parts")
    counted = sorted((r["part"], r["n"]) for r in marked.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counted)
    each = int(np.clip(-(-total // (shards * BLOCK_ROWS)), 1, MOST_BLOCKS))
    even = lambda n, parts: np.array([n // parts + (i < n % parts) for i in range(parts)], np.int64)
    blocks = np.concatenate([even(n, each) for n in even(total, shards)])
    starts = np.concatenate([np.cumsum([0, *b[:-1]]) for b in blocks.reshape(shards, each)])
    shared = spark.sparkContext.broadcast((np.array([p for p, _ in counted], np.int64), np.concatenate([[0], np.cumsum([n for _, n in counted])]).astype(np.int64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, before = shared.value
        now, labels = None, None
        for batch in batches:
            at = batch.column("_at").to_numpy()
            found = np.empty(len(at), np.int32)
            part = np.searchsorted(parts, at >> 33)
            for i in np.unique(part):
                if i != now:
                    now = i
                    labels = np.random.default_rng((seed, 2, int(i))).permutation(np.repeat(np.arange(len(blocks), dtype=np.int32), matrix_row(int(i), before, blocks, seed)))
                mine = part == i
                found[mine] = labels[at[mine] & _ROW]
            yield batch.append_column("_block", pa.array(found))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, seen = None, None, 0
        for batch in batches:
            block = batch.column("_block").to_numpy()
            slot = np.empty(len(block), np.int64)
            for b in np.unique(block):
                if b != now:
                    now, seen = b, 0
                    slots = starts[b] + np.random.default_rng((seed, 3, int(b))).permutation(np.arange(blocks[b], dtype=np.uint32 if blocks[b] < 1 << 32 else np.int64))
                mine = np.flatnonzero(block == b)
                slot[mine] = slots[seen : seen + len(mine)]
                seen += len(mine)
            yield batch.append_column("shard", pa.array((block // each).astype(np.int32))).append_column("slot", pa.array(slot))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    dealt = marked.mapInArrow(deal, f"{kinds}, _block int").repartitionById(len(blocks), "_block").sortWithinPartitions("_block", "_at")
    return dealt.mapInArrow(order, f"{kinds}, _block int, shard int, slot long").select(*rows.columns, "shard", "slot")


def write_shards(rows: DataFrame, path: str, shards: int = 8, seed: int = 13) -> None:
    """``shard_rows`` as Parquet, a folder for each shard; files in the order of their names, and rows in them, follow the slots."""
    shard_rows(rows, shards, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharded_documents(docs: DataFrame, shards: int = 8, seed: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) of ``shard_rows`` by the law `rows`: counts at most one apart.

    ``size`` is the UTF-8 bytes of the text and one; a null text has no bytes. ``grown_shard`` is null, as the law isn't `key`.
    Only these numbers move, not the texts; ``shard_rows`` and ``write_shards`` take whole rows.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"))
    return shard_rows(rows, shards, seed).withColumn("grown_shard", F.lit(None).cast("int"))
