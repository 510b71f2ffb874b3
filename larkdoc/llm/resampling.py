"""Documents drawn by how much likelier their words are in a target: weights from arrays, exact ranks by parallel sorting."""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.common import id_and_text, written

#: Words are runs of digits, letters and characters from 128 on; of letters only A to Z are lower-cased.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Words whose buckets a task remembers; runs and segments of the sort at most, rows that a segment should have.
KEPT_WORDS, MOST_RUNS, SEGMENT_ROWS = 1 << 17, 1024, 1 << 12
_ROW = (1 << 33) - 1


class _Buckets(dict):
    """The bucket of a feature, looked up or made."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.n
        return found


def _features(text: str, longest: int) -> tuple[int, list[bytes]]:
    """How many words a text has, and its runs of 1 to ``longest`` words."""
    words = text.encode().translate(_WORD_BYTES).split()
    runs = words
    for n in range(2, longest + 1):
        runs = runs + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), runs


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of the column ``text`` lie in each bucket, summed up in tasks before the shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                _, runs = _features(text.as_py(), longest)
                counts += np.bincount(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), one added to each bucket."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(source, target, strict=True)], np.int64)


def _weighed(texts: DataFrame, gain: np.ndarray, longest: int, seed: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(gain)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        known = _Buckets(len(gain))
        for batch in batches:
            n_words, n_features, weight, score = [], [], [], []
            for text, h in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                n, runs = _features(text.as_py(), longest)
                n_words.append(n)
                n_features.append(len(runs))
                weight.append(int(gain[np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))].sum()))
                score.append(weight[-1] + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    asked = texts.select("doc_id", "text", F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long").alias("h"))
    return asked.mapInArrow(task, "doc_id long, n_words long, n_features long, weight long, score long")


def _key(score: int, doc_id: int | None, at: int) -> tuple:
    return -score, doc_id is None, doc_id or 0, at


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` (doc_id, score, eligible and others) with rank 1 to ``drawn`` among the eligible ones by score, then doc_id; null for the others.

    Parallel sorting by regular sampling: at most ``MOST_RUNS`` locally sorted runs are written, each gives
    samples at regular places, and the samples' own regular places are the splitters. Each row's segment
    between splitters is looked up, the segments' counts are known before anything moves, and only segments that reach into
    the drawn ranks are exchanged, merged in order, and numbered from their prefix count on. Splitters
    are whole keys, the row's own place the last part, so ties and repeated rows can't make a segment large: none has over
    about twice the mean. The driver gets at most a count for each run and segment, and ``MOST_RUNS`` samples of a run.
    """
    spark, order = rows.sparkSession, [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    held = written(rows, "scored")
    runs = held.coalesce(MOST_RUNS).sortWithinPartitions(F.desc("eligible"), *order).withColumn("_at", F.monotonically_increasing_id())
    runs = written(runs.withColumn("_run", F.shiftright("_at", 33)), "runs")
    sorted_rows = runs.where("eligible")
    sizes = {r["_run"]: r["n"] for r in sorted_rows.groupBy("_run").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    n_segments = int(np.clip(total // SEGMENT_ROWS, 1, MOST_RUNS))
    strides = spark.createDataFrame([(run, -(-n // n_segments)) for run, n in sizes.items()], "_run long, _stride long")
    picked = sorted_rows.join(F.broadcast(strides), "_run").where(F.col("_at").bitwiseAND(_ROW) % F.col("_stride") == 0)
    samples = sorted(_key(r["score"], r["doc_id"], r["_at"]) for r in picked.select("score", "doc_id", "_at").collect())
    splitters = [samples[len(samples) * i // n_segments] for i in range(1, n_segments)] if samples else []
    first = np.array([s[0] for s in splitters], np.int64)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column("score").to_numpy()
            low, high = np.searchsorted(first, -score, "left"), np.searchsorted(first, -score, "right")
            close = np.flatnonzero(low < high)  # of a splitter's own score
            part = batch.take(pa.array(close))
            keys = zip(score[close].tolist(), part.column("doc_id").to_pylist(), part.column("_at").to_pylist(), strict=True)
            low[close] = [bisect.bisect_right(splitters, _key(*k), a, b) for k, a, b in zip(keys, low[close].tolist(), high[close].tolist(), strict=True)]
            yield batch.append_column("_segment", pa.array(low.astype(np.int32)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    placed = sorted_rows.mapInArrow(locate, f"{kinds}, _segment int")
    counts = np.zeros(n_segments, np.int64)
    for r in placed.groupBy("_segment").agg(F.count("*").alias("n")).collect():
        counts[r["_segment"]] = r["n"]
    before = np.concatenate([[0], np.cumsum(counts)])
    needed = int(np.searchsorted(before[:-1], drawn, "left"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = -1, 0
        for batch in batches:
            segment = batch.column("_segment").to_numpy()
            rank = np.empty(len(segment), np.int64)
            for at, stop in zip(edges := [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist()], [*edges[1:], len(segment)], strict=True):
                if stop == at:
                    continue
                if segment[at] != now:
                    now, seen = int(segment[at]), 0
                rank[at:stop] = before[now] + seen + 1 + np.arange(stop - at)
                seen += stop - at
            yield batch.append_column("rank", pa.array(rank, pa.int64(), mask=rank > drawn))

    names = [*rows.columns, "rank"]
    moved = placed.where(F.col("_segment") < needed).repartitionById(max(1, needed), "_segment").sortWithinPartitions("_segment", *order, "_at").mapInArrow(number, f"{kinds}, _segment int, rank long")
    left = placed.where(F.col("_segment") >= needed).withColumn("rank", F.lit(None).cast("long"))
    out = runs.where("not eligible").withColumn("rank", F.lit(None).cast("long"))
    return moved.select(*names).unionByName(left.select(*names)).unionByName(out.select(*names))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each document; rank is null where it isn't drawn.

    Features are runs of 1 to ``longest`` words, hashed by crc32 into ``buckets``. A document's weight is
    the sum of its features' gains, looked up in one array; its score adds a Gumbel number made from sha256 of ``seed``
    and its id, so the highest scores are a draw without replacement in proportion to exp(weight / 1000). Of the N documents
    with ``least_words`` or more, floor(``percent`` * N / 100) are drawn, ties to the smaller id (see ``ranked``).

    Texts are read twice, for counts and for weights, and never shuffled. ``target`` has a column of texts of the same name.
    A null text has no words. A null id is seeded as "null" and comes last in ties; rows that share an id
    have the same Gumbel number and count each. No documents give no rows; an empty target has no counts. Other columns are ignored.
    """
    texts = id_and_text(docs, id_col, text_col)
    goal = target.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts, buckets, longest), bucket_counts(goal, buckets, longest))
    rows = written(_weighed(texts, gain, longest, seed).withColumn("eligible", F.col("n_words") >= least_words), "weighed")
    n = rows.where("eligible").count()
    return ranked(rows, percent * n // 100).select("doc_id", "n_features", "weight", "score", "rank")
