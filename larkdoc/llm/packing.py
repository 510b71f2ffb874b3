"""Packing of token streams into sequences of a fixed capacity by minimum bin slack."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larkdoc.llm.byte_bpe import byte_bpe
from larkdoc.llm.common import batched, id_and_text

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def closest_multiset(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length (at most ``counts``) come closest to ``target`` from below.

    Subset sums are the set bits of one integer; a length's count is split into powers of two, and
    the integers before each step lead back from the largest sum to the counts.
    """
    reach, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], target // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> target & 1:
            break
    top, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> top & 1:
            chosen[length] = chosen.get(length, 0) + take
            top -= length * take
    return chosen


class Packer:
    """Packs (doc_id, start, ids, doc_tokens) pieces; emits full sequences, and powers of two at the end.

    Whole blocks of ``capacity`` ids are sequences of their own. The remainders wait, ``window`` at
    most; each bin starts with the longest and takes the multiset of the others that comes closest
    to its capacity. What a bin still lacks is cut from the shortest remainder that is long enough.
    """

    def __init__(self, capacity: int, window: int, first_sequence: int):
        self.capacity, self.window, self.sequence = capacity, window, first_sequence
        self.waiting: dict[int, list[tuple]] = {}
        self.n, self.tokens = 0, 0

    def _put(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        self.waiting.setdefault(len(ids) // 4, []).append((doc_id, start, ids, doc_tokens))
        self.n, self.tokens = self.n + 1, self.tokens + len(ids) // 4

    def _get(self, length: int) -> tuple:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
        self.n, self.tokens = self.n - 1, self.tokens - length
        return piece

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            yield doc_id, start, len(ids) // 4, ids, doc_tokens, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    def _fill(self, capacity: int) -> Iterator[tuple]:
        """One sequence of exactly ``capacity`` ids; as many must wait."""
        fitting = [x for x in self.waiting if x <= capacity]
        pieces = [self._get(max(fitting))] if fitting else []
        lack = capacity - sum(len(p[2]) // 4 for p in pieces)
        for length, n in closest_multiset({k: len(v) for k, v in self.waiting.items() if k <= lack}, lack).items():
            pieces += [self._get(length) for _ in range(n)]
            lack -= length * n
        if lack:
            doc_id, start, ids, doc_tokens = self._get(min(x for x in self.waiting if x > lack))
            pieces.append((doc_id, start, ids[: 4 * lack], doc_tokens))
            self._put(doc_id, start + lack, ids[4 * lack :], doc_tokens)
        yield from self._sequence(pieces)

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        n, step = len(ids) // 4, 4 * self.capacity
        whole = n // self.capacity * step
        for at in range(0, whole, step):
            yield from self._sequence([(doc_id, at // 4, ids[at : at + step], n)])
        if whole < len(ids):
            self._put(doc_id, whole // 4, ids[whole:], n)
        while self.n > self.window and self.tokens >= self.capacity:
            yield from self._fill(self.capacity)

    def finish(self) -> Iterator[tuple]:
        while self.tokens >= self.capacity:
            yield from self._fill(self.capacity)
        while self.tokens:
            yield from self._fill(1 << (self.tokens.bit_length() - 1))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset), one for each piece of a document's ids.

    Each document's ids end with ``end_id``. Every sequence holds ``capacity`` ids, but for those at
    the end of a task, whose lengths are falling powers of two: nothing is padded. Each task packs
    its own rows and holds ``window`` remainders at most, so there is no shuffle; a task run again
    gives the same rows. ``ids`` are little-endian unsigned 32-bit integers.

    A null or empty text is ``end_id`` alone; a null id is kept as null; repeated rows are packed
    as often as they occur; no rows give no pieces. Very long texts make many sequences. Other
    columns are ignored. The tokenizer's path must be readable where tasks run.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = struct.pack("<I", end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_bpe(tokenizer_path)
        packer = Packer(capacity, window, TaskContext.get().partitionId() << 40)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from packer.add(doc_id, tokens.packed(text.as_py()) + end)
            yield from packer.finish()

        return batched(rows(), _ARROW, 1024)

    return id_and_text(docs, id_col, text_col).mapInArrow(task, PIECES)
