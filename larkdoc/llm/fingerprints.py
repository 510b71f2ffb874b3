"""Document fingerprints: a homomorphic hash of the multiset of a document's paragraphs.

A paragraph (a stretch between newlines) is hashed to a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors, each lane modulo a power of two. So the paragraphs' order doesn't
matter, and paragraphs are added and taken away by adding and subtracting their vectors.

A vector has two parts. The first, 16 lanes modulo 2**64, is an extendable-output hash of the whole
paragraph: equal sums mean equal multisets of paragraphs. The second, 96 lanes modulo 2**32, adds a
hashed sign to a hashed lane for each window of 8 bytes that begins in the paragraph; the cosine of
two such parts tells how much of their text two documents share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.llm.common import batched, id_and_text

EXACT_LANES, NEAR_LANES, WINDOW = 16, 96, 8
_BLOCK = 1 << 18
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _near(data: bytes) -> np.ndarray:
    """Signed counts of hashed byte windows; windows end, zero-filled, where their paragraph ends."""
    lanes = np.zeros(NEAR_LANES, np.int64)
    for at in range(0, len(data), _BLOCK):
        size = min(_BLOCK, len(data) - at)
        part = np.zeros(size + WINDOW - 1, np.uint8)
        part[: min(len(part), len(data) - at)] = np.frombuffer(data, np.uint8, min(len(part), len(data) - at), at)
        inside, windows = part[:size] != 10, np.zeros(size, np.uint64)
        begins = inside.copy()
        for k in range(WINDOW):
            inside = inside & (part[k : k + size] != 10)
            windows |= np.where(inside, part[k : k + size], 0).astype(np.uint64) << np.uint64(8 * k)
        windows = windows[begins]
        windows *= _MIX[0]
        windows ^= windows >> np.uint64(29)
        windows *= _MIX[1]
        key = windows >> np.uint64(32)
        lanes += np.bincount((key % np.uint64(2 * NEAR_LANES)).astype(np.int64), minlength=2 * NEAR_LANES).reshape(NEAR_LANES, 2) @ np.array([1, -1])
    return lanes


def fingerprint(text: str) -> bytes:
    """The fingerprint of a text; an empty text, or newlines alone, give the zero vector."""
    data = text.encode("utf-8", "replace")
    paragraphs = [p for p in data.split(b"\n") if p]
    exact = np.zeros(EXACT_LANES, np.uint64)
    for i in range(0, len(paragraphs), 4096):
        hashes = b"".join(hashlib.shake_128(p).digest(8 * EXACT_LANES) for p in paragraphs[i : i + 4096])
        exact += np.frombuffer(hashes, np.uint64).reshape(-1, EXACT_LANES).sum(0, dtype=np.uint64)
    return exact.tobytes() + _near(data).astype(np.uint32).tobytes()


def combined(first: bytes, second: bytes, sign: int = 1) -> bytes:
    """The fingerprint after inserting (sign 1) or deleting (sign -1) the second one's paragraphs."""
    split, out = 8 * EXACT_LANES, []
    for kind, a, b in ((np.uint64, first[:split], second[:split]), (np.uint32, first[split:], second[split:])):
        x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
        out.append((x + y if sign > 0 else x - y).tobytes())
    return b"".join(out)


def likeness(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Row by row 0 to 1: 1 for equal fingerprints, else the cosine of their near lanes, not below 0."""
    near = [np.ascontiguousarray(x[:, 8 * EXACT_LANES :]).view(np.uint32).astype(np.int32).astype(float) for x in (first, second)]
    size = np.sqrt((near[0] ** 2).sum(1) * (near[1] ** 2).sum(1))
    cosine = np.divide((near[0] * near[1]).sum(1), size, out=np.zeros(len(size)), where=size > 0)
    return np.where((first == second).all(1), 1.0, np.clip(cosine, 0.0, 1.0))


@F.pandas_udf(T.BinaryType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """A text column's fingerprints; a null text counts as empty."""
    return texts.map(lambda t: fingerprint(t or ""))


@F.pandas_udf(T.BinaryType())
def inserted(prints: pd.Series, more: pd.Series) -> pd.Series:
    return pd.Series([combined(a, b) for a, b in zip(prints, more, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def deleted(prints: pd.Series, less: pd.Series) -> pd.Series:
    return pd.Series([combined(a, b, -1) for a, b in zip(prints, less, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def likeness_of(first: pd.Series, second: pd.Series) -> pd.Series:
    if not len(first):
        return pd.Series([], dtype=float)
    rows = [np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (first, second)]
    return pd.Series(likeness(*rows))


@F.pandas_udf(T.StringType())
def as_string(prints: pd.Series) -> pd.Series:
    return prints.map(lambda p: base64.b64encode(p).decode())


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint), one for each row of ``docs``.

    A null text is empty; a null id stays null; repeated rows have repeated results; very long texts
    are read in blocks; no rows give no rows; other columns are ignored.
    """
    return id_and_text(docs, id_col, text_col).select("doc_id", fingerprint_of("text").alias("fingerprint"))


def in_ranges(docs: DataFrame, rows_a_range: int = 2000, most_ranges: int = 200_000) -> DataFrame:
    """(range, guest, doc_id, text) sorted so that each row stands before its next one by ascending doc_id, the last before the first.

    Ids are cut into ranges at the first id of each of Spark's own range partitions, a number for
    each range (``most_ranges`` bounds them) being all that the driver sees. The rows with a range's
    first id also go, as guests (``guest`` over 0), behind the range before, so that one shuffle by
    range brings every row together with its next one. Rows with the same id are ordered by text; a
    null id comes before all others.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    ranges = max(1, min(most_ranges, ids.count() // rows_a_range))
    firsts = ids.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("first"))
    heads = spark.sparkContext.broadcast(np.array(sorted(r["first"] for r in firsts.collect()), np.int64))

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        keys = keys.to_numpy()
        found = np.searchsorted(heads.value, keys, side="right") - 1
        n, first = len(heads.value), heads.value[found] == keys
        return pd.Series([[i, (i - 1) % n] if head else [i] for i, head in zip(found.tolist(), first.tolist(), strict=True)], dtype=object)

    # not deterministic to the optimiser, or it would run a second time to drop empty arrays
    dealt = docs.select("doc_id", "text", F.posexplode(places.asNondeterministic()(key)).alias("guest", "range"))
    return dealt.select("range", "guest", "doc_id", "text").repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last quarter (rounded down) of the code points replaced by the first as
    many of the next document, or all it has. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A document alone is its own next one. A task hashes and
    compares in one Python worker, which holds an Arrow batch and two documents at a time. For nulls,
    ties and the rest see ``document_fingerprints`` and ``in_ranges``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
        hashed = pa.schema([*heads, ("print", pa.binary()), ("edited_print", pa.binary()), ("next_print", pa.binary())])
        schema = pa.schema([*heads, ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

        def rows() -> Iterator[tuple]:
            held = None
            for batch in batches:
                for place, guest, doc_id, value in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                    if guest and held is None:
                        continue
                    text = value.as_py()
                    own = fingerprint(text)
                    if held is not None and held[0] == place:
                        cut = len(held[2]) // 4
                        edited = held[2][: len(held[2]) - cut] + text[:cut]
                        yield held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), held[3], fingerprint(edited), own
                    held = None if guest else (place, doc_id, text, own)

        for made in batched(rows(), hashed):
            prints = [c.to_pylist() for c in made.columns[3:]]
            own, edited, following = (np.frombuffer(b"".join(p), np.uint8).reshape(len(p), -1) for p in prints)
            strings = [pa.array([base64.b64encode(x).decode() for x in p]) for p in prints[:2]]
            yield pa.RecordBatch.from_arrays([*made.columns[:3], *strings, pa.array(likeness(own, edited)), pa.array(likeness(own, following))], schema=schema)

    return in_ranges(id_and_text(docs, id_col, text_col)).mapInArrow(task, EDITED)
