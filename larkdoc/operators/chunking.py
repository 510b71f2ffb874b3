"""Documents into overlapping chunks, numbered over the whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.functions import rules, text
from larkdoc.operators.common import written
from larkdoc.operators.ranks import running_sums

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(body: str, separator: str) -> list[str]:
    """Cut before each separator, which stays at the start of the piece behind it."""
    if not separator:
        return list(body)
    first, *rest = body.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces joined up to ``size``; each chunk begins with up to ``overlap`` characters of the last one."""
    window: list[str] = []
    total = 0
    for piece in pieces:
        if window and total + len(piece) > size:
            if chunk := "".join(window).strip():
                yield chunk
            while total > overlap or (total and total + len(piece) > size):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    if chunk := "".join(window).strip():
        yield chunk


def split_text(body: str, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that occurs."""
    at = next(i for i, s in enumerate(separators) if not s or s in body)
    fitting: list[str] = []
    for piece in _pieces(body, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        yield from _merged(fitting, size, overlap)
        fitting = []
        if at + 1 < len(separators):
            yield from split_text(piece, size, overlap, separators[at + 1 :])
        else:
            yield piece
    yield from _merged(fitting, size, overlap)


def with_starts(body: str, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP) -> Iterator[tuple[int, str]]:
    """(start, chunk); the start is where the chunk is found, no earlier than the last one's end less the overlap."""
    at = before = 0
    for chunk in split_text(body, size, overlap):
        at = body.find(chunk, max(0, at + before - overlap))
        before = len(chunk)
        yield at, chunk


def chunk_documents(docs: DataFrame, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, chunk_no, start_index, text) from (keys, text); blank documents are dropped, other columns are ignored.

    Documents that fit into one chunk stay inside the JVM; only longer ones go through Python.
    """
    rows = docs.select(*keys, "text").where(~text.is_blank(F.col("text")))
    clean = text.strip(F.col("text"))
    fits = F.length("text") < size
    whole = rows.where(fits).select(*keys, F.lit(0).alias("chunk_no"), (F.instr("text", clean) - 1).alias("start_index"), clean.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, k, start, chunk) for at, body in enumerate(batch.column(len(keys)).to_pylist()) for k, (start, chunk) in enumerate(with_starts(body, size, overlap))]
            whose = pa.array([x[0] for x in found], pa.int64())
            made = [pa.array([x[i] for x in found], kind) for i, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(whose) for i in range(len(keys))), *made], names=[*keys, "chunk_no", "start_index", "text"])

    return whole.unionByName(rows.where(~fits).mapInArrow(cut, whole.schema))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` with chunk_index, running over the batch by (doc_id, chunk_no), and chunk_chars.

    Documents' chunk counts are summed by ranges of ids (``ranks.running_sums``), so no window sees all rows, however sparse
    the ids are. Chunks are written once, so that texts are cut once.
    """
    chunks = written(chunks, "chunks")
    starts = running_sums(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), ["doc_id"], "n", "first").select("doc_id", "first")
    return chunks.join(starts, chunks["doc_id"].eqNullSafe(starts["doc_id"])).select(chunks["doc_id"], "chunk_no", "start_index", "text", (F.col("first") + F.col("chunk_no")).alias("chunk_index"), F.length("text").alias("chunk_chars"))
