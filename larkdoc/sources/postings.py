"""An inverted index of chunks as Parquet tables, and the best chunks by token overlap from its lists alone."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.functions import rules, text
from larkdoc.operators.common import small
from larkdoc.operators.nearest import Best, block_by_block

#: Chunks and token occurrences of a shard at most; folders of tokens.
SHARD_CHUNKS, SHARD_TOKENS, BUCKETS = 1 << 13, 1 << 22, 32
#: Tasks that the lists of one bucket may be written by; tokens that a plan may name.
_SPREAD, MOST_LITERALS = 8, 2000


def _inverted(batches: Iterator[pa.RecordBatch], shard_chunks: int) -> Iterator[pa.RecordBatch]:
    """(shard, token, chunk_ids) of the chunks (chunk_id, tokens) of a task, shard by shard."""
    ids, lists, chunks, held, number = [], [], 0, 0, 0

    def closed() -> Iterator[pa.RecordBatch]:
        tokens = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists])
        owner, code = np.repeat(np.concatenate(ids), sizes), tokens.indices.to_numpy()
        order = np.lexsort((owner, code))
        starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(tokens.dictionary)))])
        shard = (TaskContext.get().partitionId() << 24) + number
        found = pa.RecordBatch.from_arrays([pa.array(np.full(len(starts) - 1, shard)), tokens.dictionary, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(owner[order], pa.int64()))], names=["shard", "token", "chunk_ids"])
        yield from (found.slice(at, 10_000) for at in range(0, found.num_rows, 10_000))

    for batch in batches:
        for at in range(0, batch.num_rows, min(1024, shard_chunks)):
            part = batch.slice(at, min(1024, shard_chunks))
            n = len(part.column(1).flatten())
            if chunks and (chunks + part.num_rows > shard_chunks or held + n > SHARD_TOKENS):
                yield from closed()
                ids, lists, chunks, held, number = [], [], 0, 0, number + 1
            ids.append(part.column(0).to_numpy())
            lists.append(part.column(1))
            chunks, held = chunks + part.num_rows, held + n
    if chunks:
        yield from closed()


class _Asked:
    """A block of questions: their distinct tokens, and which questions have each."""

    def __init__(self, questions: list[Row]):
        held: dict[str, list[int]] = {}
        for i, row in enumerate(questions):
            for token in row["tokens"] or []:
                held.setdefault(token, []).append(i)
        self.tokens, self.owners = pa.array(list(held), pa.string()), [np.array(x) for x in held.values()]
        self.sizes = np.array([max(1, len(r["tokens"] or [])) for r in questions])


def best_counts(lists: list[np.ndarray], n_chunks: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, counts): all of the ``k`` chunks in most of ``lists``, and those that tie with the last, each in ``least`` lists at least.

    Lists hold places of chunks. The shortest are counted first. What is not seen so far is in no more
    lists than are left, so once that is less than what the k-th best has already, no new chunk gets in; from then on the longer lists are
    only looked up for the chunks that can still get there.
    """
    lists = sorted(lists, key=len)
    counts = np.zeros(n_chunks, np.int32)
    least = max(1, least)
    for i, places in enumerate(lists):
        left = len(lists) - i
        if left <= i and (left < 8 or i % 4 == 0) and k <= n_chunks:
            least = max(least, int(np.partition(counts, n_chunks - k)[n_chunks - k]))
        if left < least:
            chosen = np.flatnonzero(counts + left >= least)
            for at, longer in enumerate(lists[i:]):
                place = np.searchsorted(longer, chosen)
                counts[chosen] += longer[np.minimum(place, len(longer) - 1)] == chosen
                chosen = chosen[counts[chosen] + left - at - 1 >= least]
            break
        counts[places] += 1
    else:
        chosen = np.flatnonzero(counts >= least)
    if len(chosen) > k:
        chosen = chosen[counts[chosen] >= np.partition(counts[chosen], len(chosen) - k)[len(chosen) - k]]
    return chosen, counts[chosen]


class PostingIndex:
    """Postings by token under one folder: rows (shard, token, chunk_ids), a shard being some thousand chunks of one task.

    Lists lie in folders of tokens' hashes, sorted by token, so a search reads the folders and row groups of
    its questions' tokens and nothing else; no text and no other token is touched. An append adds a part; a part is in
    the index once its write has ended. Chunk ids are unique; chunks with a null id or without tokens aren't found.
    """

    def __init__(self, spark: SparkSession, root: str, shard_chunks: int = SHARD_CHUNKS):
        self.spark, self.root, self.shard_chunks = spark, root, shard_chunks

    def append(self, chunks: DataFrame) -> None:
        """Adds ``chunks`` (chunk_id, text): inverted in their own tasks, then the lists alone are shuffled to their folders."""
        held = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), text.token_set(F.col("text")).alias("tokens")).where("chunk_id is not null and size(tokens) > 0")
        most = self.shard_chunks
        lists = held.mapInArrow(lambda batches: _inverted(batches, most), "shard long, token string, chunk_ids array<long>").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"))
        lists = lists.repartition("bucket", F.pmod("shard", F.lit(_SPREAD))).sortWithinPartitions("bucket", "token", "shard")
        lists.write.partitionBy("bucket").parquet(f"{self.root}/part={uuid.uuid4().hex}")

    def _parts(self) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in files.listStatus(path(self.root))] if files.exists(path(self.root)) else []
        return sorted(str(p) for p in found if files.exists(path(p, "_SUCCESS")))

    def lists(self, tokens: list[str]) -> DataFrame:
        """(part, shard, token, chunk_ids) of ``tokens``: a filter of folders and one that reaches the files' statistics."""
        schema = "shard long, token string, chunk_ids array<long>, bucket int, part string"
        if not (parts := self._parts()):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.root).parquet(*parts)
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(buckets))
        if len(tokens) <= MOST_LITERALS:
            rows = rows.where(F.col("token").isin(tokens))
        else:  # too many for a plan; the folders are still picked
            rows = rows.join(small(self.spark.createDataFrame([(t,) for t in tokens], "token string")), "token", "left_semi")
        return rows.select("part", "shard", "token", "chunk_ids")

    def search(self, questions: DataFrame, k: int = rules.TOP_K, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
        """The rows of ``retrieval.lexical_topk``, (keys, chunk_id, overlap, rank), for ``questions`` (keys, tokens).

        The lists of a block of questions meet by shard, whose task finds each question's best chunks by
        ``best_counts``; a question passes over a shard that has lists for fewer of its tokens than its k-th best chunk
        in the task holds. Each shard's lists, with at most ``SHARD_TOKENS`` places, are in memory at once.
        """

        def run(asked: list[Row], labels: pa.RecordBatch, schema: T.StructType) -> DataFrame:
            shared = self.spark.sparkContext.broadcast((labels, _Asked(asked)))

            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                labels, model = shared.value
                best = Best(labels.num_rows, k)
                for shard in _shards(batches):
                    _search_shard(shard, model, best, k)
                yield from best.batches(labels, "chunk_id")

            lists = self.lists(shared.value[1].tokens.to_pylist()).repartition("part", "shard").sortWithinPartitions("part", "shard")
            return lists.mapInArrow(task, schema)

        found = block_by_block(questions.select(*keys, "tokens"), list(keys), "chunk_id", k, run)
        return found.select(*keys, "chunk_id", (-F.col("cost")).alias("overlap"), "rank")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows (part, shard, token, chunk_ids) of one shard after another; they come in its order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, shards = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (shards[1:] != shards[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in (0, 1)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _search_shard(shard: pa.Table, model: _Asked, best: Best, k: int) -> None:
    token = pc.index_in(shard.column("token"), value_set=model.tokens).combine_chunks().to_numpy(zero_copy_only=False)
    lists = shard.column("chunk_ids").combine_chunks()
    ids, places = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    cuts = np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]
    own = np.split(places, cuts)
    owners = [model.owners[t] for t in token]
    question, which = np.concatenate(owners), np.repeat(np.arange(len(token)), [len(o) for o in owners])
    order = np.argsort(question, kind="stable")
    question, which = question[order], which[order]
    starts = np.flatnonzero(np.diff(question, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(question)], strict=True):
        q = int(question[a])
        # as a count; the costs are negative shares
        least = int(np.ceil(-best.worst[q] * model.sizes[q] - 1e-9)) if np.isfinite(best.worst[q]) else 1
        if b - a < least:
            continue
        chosen, counts = best_counts([own[i] for i in which[a:b]], len(ids), k, least)
        best.add(np.full(len(chosen), q), -counts / model.sizes[q], ids[chosen])
