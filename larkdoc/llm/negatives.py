"""Hard negatives by exact integer scores, looked up in the subset sums of eight dimensions at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.common import written
from larkdoc.operators.common import small, top_rows

#: Anchors and candidates that a task scores against each other; within it so many at once.
ANCHORS, CANDIDATES, ANCHORS_AT_ONCE, CANDIDATES_AT_ONCE = 2048, 8192, 128, 1024
_GROUP = 8
_LEAST = -(1 << 62)


def planes(values: np.ndarray) -> np.ndarray:
    """Integers (rows x columns) as bytes (rows x planes x groups of eight columns), bit by bit in two's complement: the last plane is the sign's."""
    values = np.pad(values, ((0, 0), (0, -values.shape[1] % _GROUP)))
    n = 1 + max(int(values.max(initial=0)), ~int(values.min(initial=0))).bit_length()
    bits = (values[:, None] >> np.arange(n)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def integers(packed: np.ndarray) -> np.ndarray:
    """What ``planes`` packed, with its columns padded to a multiple of eight."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weights = np.left_shift(1, np.arange(packed.shape[1]))
    weights[-1] *= -1
    return np.einsum("rpc,p->rc", bits, weights)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups x 256 x anchors): for each byte the sum of the anchor's components at its set bits."""
    parts = anchors.reshape(len(anchors), -1, _GROUP).transpose(1, 2, 0).astype(kind)
    tables = np.zeros((parts.shape[0], 1 << _GROUP, len(anchors)), kind)
    for j in range(_GROUP):
        tables[:, 1 << j : 2 << j] = tables[:, : 1 << j] + parts[:, None, j]
    return tables


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products of candidates and anchors: plane by plane from the sign's down, shift and add what the tables hold for the plane's bytes."""
    found = np.zeros((len(packed), tables.shape[2]), tables.dtype)
    looked = np.empty_like(found)
    for plane in reversed(range(packed.shape[1])):
        found <<= 1
        for group, table in enumerate(tables):
            np.take(table, packed[:, plane, group], axis=0, out=looked)
            found += looked
        if plane == packed.shape[1] - 1:
            np.negative(found, out=found)
    return found


def _stacked(column: pa.ChunkedArray, n_planes: np.ndarray, groups: int) -> np.ndarray:
    """Rows of packed planes with as many planes and groups each; a sign's plane stands for all above it."""
    out = np.zeros((len(n_planes), int(n_planes.max(initial=1)), groups), np.uint8)
    for i, (data, n) in enumerate(zip(column.to_pylist(), n_planes, strict=True)):
        row = np.frombuffer(data, np.uint8).reshape(n, -1)
        out[i, :n, : row.shape[1]] = row
        out[i, n:, : row.shape[1]] = row[-1]
    return out


class _Best:
    """The ``k`` best (score, then place) of each of ``n`` queries so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.places = k, np.full((n, k), _LEAST), np.full((n, k), -1)

    def add(self, query: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        """Rows whose places come after all those that were added before."""
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        s = np.concatenate([self.scores[touched].ravel(), score])
        p = np.concatenate([self.places[touched].ravel(), place])
        order = np.lexsort((p, -s, q))
        q, s, p = q[order], s[order], p[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.scores[q[keep], rank[keep]], self.places[q[keep], rank[keep]] = s[keep], p[keep]


def _packed(vectors: DataFrame, scale: int) -> DataFrame:
    """(place, vec_id, label, n_planes, planes), place being a number of the row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data, sizes = [b""] * part.num_rows, [1] * part.num_rows
                lists = part.column(2).to_pylist()
                lengths = np.array([len(v) for v in lists])
                for length in np.unique(lengths):
                    mine = np.flatnonzero(lengths == length)
                    whole = np.floor(scale * np.array([lists[i] for i in mine], float).reshape(len(mine), -1))
                    if np.abs(whole).max(initial=0) >= 1 << 53:
                        raise OverflowError("components this large have no exact integers")
                    bits = planes(whole.astype(np.int64))
                    for i, row in zip(mine, bits, strict=True):
                        data[i], sizes[i] = row.tobytes(), bits.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "label", "n_planes", "planes"])

    return vectors.mapInArrow(pack, "vec_id long, label string, n_planes int, planes binary").withColumn("place", F.monotonically_increasing_id())


_SCORED = "anchor long, anchor_id long, slot int, positive_id long, positive_score long, vec_id long, score long"


def _scored(anchors: DataFrame, candidates: DataFrame, keys: list[str], k: int, same_label: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The ``k`` best candidates of each anchor in each pair of blocks, or of each anchor and positive among scores within percents of the positive's."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        names = _SCORED.replace(" long", "").replace(" int", "").split(", ")
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n == "slot" else pa.int64()) for n in names})
        right = right.sort_by("vec_id")
        sides = [(t.column("planes"), t.column("n_planes").to_numpy()) for t in (left, right)]
        groups = max(1, *(len(data.as_py()) // n for rows, sizes in sides for data, n in zip(rows, sizes, strict=True)))
        asked, held = (_stacked(rows, sizes, groups) for rows, sizes in sides)
        asked = integers(asked)
        most = groups * _GROUP * (int(np.abs(asked).max(initial=0)) + 1) << held.shape[1]
        if most >= 1 << 56:
            raise OverflowError("scores of components this large don't fit a long")
        kind = np.int32 if most < 1 << 31 else np.int64
        ids, own = right.column("vec_id").to_numpy(), left.column("anchor_id").to_numpy()
        _, codes = np.unique(np.concatenate([t.column("label").to_pandas().to_numpy(str) for t in (left, right)]), return_inverse=True)
        label, mine = codes[left.num_rows :], codes[: left.num_rows]
        slots = [(0, None, None)] if same_label else []
        if not same_label:
            goals = np.full((left.num_rows, max(1, max(map(len, left.column("positive_scores").to_pylist())))), _LEAST)
            for i, row in enumerate(left.column("positive_scores").to_pylist()):
                goals[i, : len(row)] = row
            given = goals > _LEAST
            lows, highs = np.where(given, -((-low * np.where(given, goals, 0)) // 100), 1), np.where(given, high * np.where(given, goals, 0) // 100, 0)
            slots = [(s, lows[:, s], highs[:, s]) for s in range(goals.shape[1])]
        found = [_Best(left.num_rows, k) for _ in slots]
        for a in range(0, left.num_rows, ANCHORS_AT_ONCE):
            block = slice(a, a + ANCHORS_AT_ONCE)
            tables = subset_sums(asked[block], kind)
            for c in range(0, right.num_rows, CANDIDATES_AT_ONCE):
                part = slice(c, c + CANDIDATES_AT_ONCE)
                score = scores(tables, held[part])
                fits = (label[part, None] == mine[None, block]) == same_label
                fits &= ids[part, None] != own[None, block]
                for best, (_, least, greatest) in zip(found, slots, strict=True):
                    wanted = score > best.scores[block, -1]  # a later row of the same score has a larger id
                    if least is not None:
                        wanted &= (score >= least[block]) & (score <= greatest[block])
                    row, column = np.nonzero(wanted & fits)
                    if len(row):
                        best.add(column + a, score[row, column].astype(np.int64), row + c)
        out = []
        for best, (slot, _, _) in zip(found, slots, strict=True):
            at, rank = np.nonzero(best.places >= 0)
            at_, n = pa.array(at), len(at)
            goal = [pa.nulls(n, pa.int64())] * 2 if same_label else [pa.array([row[slot] for row in left.column(c).take(at_).to_pylist()], pa.int64()) for c in ("positive_ids", "positive_scores")]
            out.append(pa.table([left.column("anchor").take(at_), left.column("anchor_id").take(at_), pa.array(np.full(n, slot, np.int32)), *goal, pa.array(ids[best.places[at, rank]]), pa.array(best.scores[at, rank])], names=names))
        return pa.concat_tables(out)

    return anchors.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(task, _SCORED)


def _blocked(rows: DataFrame, place: str, own: str, blocks: Column | str, other: str, others: Column | str) -> DataFrame:
    """Each row in its own block, once for every block of the other side; rows that meet no block go."""
    copies = F.sequence(F.lit(0).cast("long"), F.col(others) - 1) if isinstance(others, str) else F.sequence(F.lit(0).cast("long"), others - 1)
    return rows.withColumn(own, F.pmod(F.col(place), F.col(blocks) if isinstance(blocks, str) else blocks)).withColumn(other, F.explode(copies))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    Components count as floor(``scale`` * x). A row's score is its integer inner product with the anchor;
    higher scores come first, then smaller ids. The positives of an anchor are its first ``positives`` other rows of
    its label; for each, the first ``negatives`` rows of another label come whose score is ``low`` to ``high`` percent of the positive's.

    Every row is packed once: bytes of the bits of eight components, a byte for each bit's plane. A task
    takes a block of anchors and one of candidates, makes the anchors' subset sums of each eight
    dimensions and scores all pairs exactly by look-ups, shifts and additions; only its best rows leave it. Positives
    are sought in blocks of one label, negatives in blocks of all rows, so each pair is scored once or
    twice. Blocks hold at most ``ANCHORS`` and about ``CANDIDATES`` rows whatever the labels' sizes. All anchors
    meet all rows: work grows with their product, and a row is sent once to each block of anchors.

    Rows with a null id, label or vector or with a null or non-finite component take no part. Shorter
    vectors count as if zeros followed. An anchor's others are the rows with another id; rows that share an id each count as
    others, equal ones of them as one anchor, and unequal ones as an anchor each. Scores that
    could exceed 2**56, or components from 2**53 on, are an error. No rows give no rows; other columns are ignored.
    """
    plain = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(plain)
    candidates = written(_packed(rows.select("vec_id", "label", "v"), scale), "packed")
    asks = rows.where("asks").select("vec_id").distinct()
    anchors = candidates.join(small(asks), "vec_id", "left_semi").select(F.col("vec_id").alias("anchor_id"), "label", "n_planes", "planes").distinct()
    anchors = written(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    sizes = candidates.groupBy("label").agg(F.ceil(F.count("*") / CANDIDATES).alias("candidate_blocks")).join(anchors.groupBy("label").agg(F.ceil(F.count("*") / ANCHORS).alias("anchor_blocks")), "label")
    sizes = small(written(sizes, "sizes"))
    near = _scored(
        _blocked(anchors.join(sizes, "label"), "anchor", "a", "anchor_blocks", "c", "candidate_blocks").drop("candidate_blocks", "anchor_blocks"),
        _blocked(candidates.join(sizes, "label"), "place", "c", "candidate_blocks", "a", "anchor_blocks").drop("candidate_blocks", "anchor_blocks"),
        ["label", "a", "c"], positives, True,
    )
    first = top_rows(near, ["anchor"], [F.desc("score"), "vec_id"], positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    asked = anchors.join(first, "anchor").select("anchor", "anchor_id", "label", "n_planes", "planes", F.col("p.vec_id").alias("positive_ids"), F.col("p.score").alias("positive_scores"))
    asked = written(asked, "positives")
    n = candidates.agg(F.count("*")).first()[0]
    blocks = [F.lit(max(1, -(-count // most))).cast("long") for count, most in ((asked.count(), ANCHORS), (n, CANDIDATES))]
    far = _scored(_blocked(asked, "anchor", "a", blocks[0], "c", blocks[1]), _blocked(candidates, "place", "c", blocks[1], "a", blocks[0]), ["a", "c"], negatives, False, low, high)
    best = top_rows(far, ["anchor", "slot"], [F.desc("score"), "vec_id"], negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), (F.col("slot") + 1).alias("positive_rank"))
