"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces and one pass of dynamic programming."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.common import batched, id_and_text

SPACE = "▁"


class Pieces:
    """A piece vocabulary: ``pieces`` and ``scores`` by id, ``byte_ids`` for the bytes of unknown characters.

    One Viterbi pass serves both kinds: at each position the automaton's output links give the
    pieces that end there, and each relaxes the best score reached. ``kind`` "unigram": a path's
    score is the sum of its pieces' scores. ``kind`` "bpe": the scores are merge priorities, whose
    sums mean nothing; a path scores 0 where merging leaves each two neighbours as they are, and
    minus infinity elsewhere. One path scores 0, and that is what merging pair by pair gives.

    Pieces hold a space mark only at their beginning (or alone), so what stands between two spaces
    is encoded alone, and kept for the next time; ``words`` bounds how many are kept.
    """

    def __init__(self, pieces: dict[int, str], scores: dict[int, float], byte_ids: list[int], kind: str = "bpe", unknown_id: int = 0, words: int = 350_000):
        if any(SPACE in p.lstrip(SPACE) for p in pieces.values()):
            raise ValueError("a piece holds a space mark behind its beginning")
        self.pieces, self.scores, self.byte_ids, self.kind, self.unknown_id, self.words = pieces, scores, byte_ids, kind, unknown_id, words
        self.id_of = {p: i for i, p in pieces.items()}
        self.text_of = {i: p.replace(SPACE, " ").encode() for i, p in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)} | ({} if unknown_id in byte_ids else {unknown_id: " ⁇ ".encode()})
        self.chars = frozenset(p for p in self.id_of if len(p) == 1)
        self.splits: dict[int, tuple[int, int]] = {}
        self.order = {i: k for k, i in enumerate(sorted(pieces, key=lambda i: (-scores[i], i)))}
        self.joins: dict[int, int] = {}
        if kind == "bpe":
            self._learn_splits()
        self.gains = scores if kind != "bpe" else dict.fromkeys(pieces, 0.0)
        self.automaton = ahocorasick.Automaton()
        for i, p in pieces.items():
            if len(p) == 1 or kind != "bpe" or i in self.splits:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.id_of)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "pairs": {}}

    def _learn_splits(self) -> None:
        """The last merge of each piece that merging can make, and the rank of any two pieces' merge."""
        for i, p in self.pieces.items():
            for k in range(1, len(p)):
                if (a := self.id_of.get(p[:k])) is not None and (b := self.id_of.get(p[k:])) is not None:
                    self.joins[a << 32 | b] = self.order[i]
        for i in sorted(self.pieces, key=lambda i: len(self.pieces[i])):
            parts = [self.id_of.get(c) for c in self.pieces[i]]
            if None in parts or len(parts) == 1:
                continue
            while len(parts) > 1:
                joins = [(self.order[j], k, j) for k in range(len(parts) - 1) if (j := self.id_of.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])) is not None]
                if not joins:
                    break
                _, k, joined = min(joins)
                last, parts[k : k + 2] = (parts[k], parts[k + 1]), [joined]
            if parts == [i]:
                self.splits[i] = last
        self.ranks = {i: self.order[i] for i in self.splits}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters leaves these two pieces; kept in ``pairs``.

        Walks back through both pieces' merges, the latest first: the parts that touch at the seam
        must not have had a merge with each other before the merge that took them away.
        """
        key = left << 32 | right
        joins, ranks, splits = self.joins, self.ranks, self.splits
        before, on_right, good = 1 << 60, False, True
        while True:
            joined = joins.get(left << 32 | right)
            # of two merges of one kind the left one comes first
            if joined is not None and (joined < before or joined == before and on_right):
                good = False
                break
            a, b = ranks.get(left, -1), ranks.get(right, -1)
            if a < 0 and b < 0:
                break
            on_right = b >= a
            if on_right:
                before, right = b, splits[right][0]
            else:
                before, left = a, splits[left][1]
        if len(self.pairs) > 250_000:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def _segment(self, text: str) -> list[int]:
        """Ids of a stretch of known characters."""
        n, merged, gains, pairs = len(text), self.kind == "bpe", self.gains, self.pairs
        last, best = [-1] * (n + 1), [0.0] + [-math.inf] * n
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            reached = best[end - size] + gains[i]
            if reached > best[end]:
                if merged and end > size:
                    good = pairs.get(last[end - size] << 32 | i)
                    if not (self.compatible(last[end - size], i) if good is None else good):
                        continue
                best[end], last[end] = reached, i
        ids = []
        while n:
            ids.append(last[n])
            n -= len(self.pieces[last[n]])
        return ids[::-1]

    def _chunk(self, chunk: str) -> list[int]:
        if self.chars.issuperset(chunk):
            return self._segment(chunk)
        ids, at = [], 0
        for k, c in enumerate(chunk):
            if c not in self.id_of:
                if k > at:
                    ids += self._segment(chunk[at:k])
                ids += [self.byte_ids[b] for b in c.encode("utf-8", "replace")] if self.byte_ids else [self.unknown_id]
                at = k + 1
        return ids + self._segment(chunk[at:]) if at < len(chunk) else ids

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers; an empty text has none."""
        if not text:
            return b""
        chunks, known = self.chunks.findall(SPACE + text.replace(" ", SPACE)), self.known
        if new := set(chunks).difference(known):
            if len(known) > self.words:  # the younger half goes: frequent chunks are met early
                for chunk in list(islice(known, self.words // 2, None)):
                    del known[chunk]
                new = set(chunks).difference(known)
            for chunk in new:
                ids = self._chunk(chunk)
                known[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        out = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def load_pieces(path: str, kind: str = "bpe") -> Pieces:
    """The vocabulary of a model file; its normaliser must be the identity with a space put before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "a  B é x "
    if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("the model's normaliser changes texts")
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    byte_ids = sorted((i for i in range(n) if model.is_byte(i)), key=lambda i: int(model.id_to_piece(i)[3:5], 16))
    return Pieces({i: model.id_to_piece(i) for i in plain}, {i: model.get_score(i) for i in plain}, byte_ids, kind, model.unk_id())


def encode_pieces(docs: DataFrame, model_path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids), one for each row of ``docs``; ``ids`` are little-endian unsigned 32-bit integers.

    A null or empty text has no ids; a null id stays null; repeated rows are encoded each; no rows
    give no rows; texts are encoded whole, however long; other columns are ignored. The model's path
    must be readable by the driver and where tasks run.
    """
    load_pieces(model_path, kind)  # refuses a bad model before any task runs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_pieces(model_path, kind).encode
        rows = ((doc_id, encode(text.as_py())) for batch in batches for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        return batched(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]), 1024)

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """Rows (doc_id, ids, text) for rows (doc_id, ids); null ids decode to an empty text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load_pieces(model_path, kind).decode
        rows = ((doc_id, ids, decode(ids or b"")) for batch in batches for doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return batched(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())]), 1024)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(task, "doc_id long, ids binary, text string")
