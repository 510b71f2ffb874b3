"""Removal of passages that a document with a smaller id has too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm import rolling
from larkdoc.llm.common import id_and_text, written

WINDOW, ANCHOR = 50, 16
#: Up to so many ids (16 MB) are broadcast to pick rows by; beyond, the rows are shuffled by id instead.
BROADCAST_IDS = 1_000_000


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window of words the least hash of the shorter windows in it."""
    return rolling.window_minima(rolling.windows(hashes, anchor), window - anchor + 1)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is (left_semi) or isn't (left_anti) among ``ids``, which are distinct."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, columns: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` without the words that lie in a window which a document with a smaller id has too.

    Rows: doc_id, text, ``columns``, n_words, removed. A word is a run of characters other than space
    and 9 to 13; a window is ``window`` consecutive words. ``removed`` are the maximal intervals of
    word numbers, end exclusive; ``text`` is what is left, joined by one space, or the text as it
    was if nothing is removed. All windows are judged on the input.

    Windows are told apart by Rabin-Karp hashes. Each window's anchor is the least hash of the
    ``anchor``-word windows in it, so equal windows have equal anchors, and an anchor that only one
    document has rules out all its windows. A document's distinct anchors, a seventeenth of its
    windows, are counted first; then the hashes of all windows whose anchor is repeated are, and
    the smallest id of each is joined back. Texts of exact copies (of the same words) only count
    once and are removed whole. Counts and joins are by hash, with partial aggregation. Windows are
    counted by two hashes to two bases, 128 bits together; anchors and windows of one document by 64.

    A null text has no words; a row with a null id is kept whole and removes nothing; rows that
    share an id don't remove from each other; no rows give no rows; texts of any length are hashed
    in blocks. Extra columns are ignored unless named in ``columns``.
    """
    base = id_and_text(docs, id_col, text_col) if not columns else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *columns)
    texts = base.select("doc_id", "text").where("doc_id is not null")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, found = [], []
            for text in batch.column(1):
                data = text.as_py().encode("utf-8", "replace")
                hashes = rolling.words(data)[0]
                same.append(hashlib.sha256(b" ".join(data.split())).digest() if len(hashes) >= window else None)
                found.append(_signed(np.unique(_anchors(hashes, window, anchor))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "same", "anchors"])

    scanned = written(texts.mapInArrow(scan, "doc_id long, same binary, anchors array<long>").where("same is not null"), "anchors")
    firsts = scanned.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = scanned.join(firsts, "same").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("same").alias("whole"))
    single = scanned.groupBy("same").agg(F.min(F.struct("doc_id", "anchors")).alias("least")).select("least.*")
    anchors = single.select("doc_id", F.explode("anchors").alias("anchor"))
    repeated = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    candidates = written(anchors.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "candidates")

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, wanted in zip(*batch.columns, strict=True):
                hashes = rolling.words(text.as_py().encode("utf-8", "replace"))[0]
                wanted = wanted.values.to_numpy(zero_copy_only=False)
                chosen = np.isin(_signed(_anchors(hashes, window, anchor)), wanted)
                found, at = np.unique(rolling.windows(hashes, window)[chosen], return_index=True)
                check = rolling.windows(hashes, window, "check")[chosen][at]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(found)), pa.array(_signed(check)), pa.array(np.full(len(found), doc_id.as_py(), np.int64))], names=["window", "check", "doc_id"])

    hit = _picked(texts, candidates.select("doc_id"), "left_semi").join(candidates, "doc_id")
    found = written(hit.select("doc_id", "text", "anchors").mapInArrow(hash_windows, "window long, check long, doc_id long"), "windows")
    first = found.groupBy("window", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "check", "first")
    later = found.join(first, ["window", "check"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    marks = written(later.join(copies, "doc_id", "full_outer"), "marks")

    def remove(marked: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new, n_words, removed = [], [], []
                for i, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    data = text.encode("utf-8", "replace")
                    hashes, starts, ends = rolling.words(data)
                    gone = np.zeros(len(hashes), bool)
                    if marked:
                        windows, whole = batch.column(batch.num_columns - 2)[i], batch.column(batch.num_columns - 1)[i].as_py()
                        if whole and hashlib.sha256(b" ".join(data.split())).digest() in whole:
                            gone[:] = True
                        elif windows.is_valid:
                            hit = np.isin(_signed(rolling.windows(hashes, window)), windows.values.to_numpy(zero_copy_only=False))
                            steps = np.zeros(len(hashes) + 1, np.int64)
                            steps[: len(hit)] += hit
                            steps[window : window + len(hit)] -= hit
                            gone = np.cumsum(steps[:-1]) > 0
                    if gone.any():
                        text = b" ".join(data[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)).decode("utf-8")
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    new.append(text)
                    n_words.append(len(hashes))
                    removed.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                extra = [batch.column(k) for k in range(2, 2 + len(columns))]
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), *extra, pa.array(n_words, pa.int64()), pa.array(removed, spans)], names=["doc_id", "text", *columns, "n_words", "removed"])

        return task

    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ("doc_id", "text", *columns)), "n_words long", "removed array<struct<start:long,end:long>>"])
    ids = marks.select("doc_id")
    changed = _picked(base, ids, "left_semi").join(marks, "doc_id").select("doc_id", "text", *columns, "windows", "whole").mapInArrow(remove(True), schema)
    return _picked(base, ids, "left_anti").select("doc_id", "text", *columns).mapInArrow(remove(False), schema).unionByName(changed)
