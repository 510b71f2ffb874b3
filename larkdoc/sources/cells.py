"""Vectors laid out by their nearest centre, and exact nearest neighbours that skip what bounds exclude."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.operators.common import written
from larkdoc.operators.nearest import Best, block_by_block
from larkdoc.operators.vectors import by_length, metadata_filter, squared, usable, vectors_by_length

#: Vectors that the centres are fitted on, centres at most, tasks that one cell may be written by.
SAMPLE, MOST_CELLS, _SPREAD = 8192, 4096, 8
#: Bounds are taken a little wider than computed, so that rounding excludes nothing.
_SLACK = 1e-9
#: The cell of lengths that the sample lacks; its centre is the origin.
REST = -1


def _fitted(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres by some rounds of Lloyd's iteration from points of the sample."""
    random = np.random.default_rng(5)
    centres = points[random.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Cells:
    """What a search knows before it reads a vector: for each length its cells' numbers, centres and radii."""

    numbers: dict[int, np.ndarray]
    centres: dict[int, np.ndarray]
    sizes: dict[int, int]  # rows of a cell
    radii: dict[int, tuple[float, float]]  # least and greatest distance from the centre in a cell

    def bounds(self, length: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, distances of ``q`` to their centres, distances within which a cell holds nothing for ``q``).

        A vector of a cell is as far from the centre as the cell's radii say, and no farther from it than from
        any other centre; so it is neither within the gap between the radii and the query's own distance, nor before
        the plane midway between the two centres. The larger gap holds.
        """
        numbers = np.append(self.numbers.get(length, np.zeros(0, int)), REST)
        centres = np.concatenate([self.centres.get(length, np.zeros((0, length))), np.zeros((1, length))])
        away = np.sqrt(squared(q, centres))
        low, high = np.array([self.radii.get(int(c), (np.inf, -np.inf)) for c in numbers]).T
        gap = np.maximum(np.maximum(away - high, low - away), 0)
        if len(centres) > 2:
            own = centres[:-1]
            between = np.sqrt(squared(own, own))
            nearest = away[:, :-1].argmin(1)
            apart = between[nearest]
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = (away[:, :-1] ** 2 - (away[np.arange(len(q)), nearest] ** 2)[:, None]) / (2 * apart)
            gap[:, :-1] = np.maximum(gap[:, :-1], np.where(apart > 0, beyond, 0))
        return numbers, away, gap * (1 - _SLACK) - _SLACK


class CellIndex:
    """Vectors under one folder by cell: a folder for each centre, its rows sorted by their distance from the centre."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        #: Pairs of a query and a vector whose distance the searches' tasks have computed; a task that is run again counts again.
        self.computed = spark.sparkContext.accumulator(0)

    def write(self, vectors: DataFrame, n_cells: int | None = None) -> None:
        """Lays out ``vectors`` (vec_id, embedding and metadata); about the square root of their number of cells unless told.

        Centres are fitted on at most ``SAMPLE`` vectors, chosen by a hash of their ids, for each length among them; all
        vectors are assigned in their own tasks and move once. Vectors of other lengths share one cell.
        """
        names = [c for c in vectors.columns if c != "embedding"]
        rows = usable(vectors.where("vec_id is not null"), *names)
        sample = by_length(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect())[1]
        n, taken = rows.count(), sum(len(x) for _, x in sample.values())
        centres, at = {}, 0
        for length, (_, x) in sorted(sample.items()):
            k = int(np.clip((n_cells or np.sqrt(n)) * len(x) / taken, 1, min(len(x), MOST_CELLS)))
            if length and at + k <= MOST_CELLS:
                centres[length] = (at, _fitted(x, k))
                at += k

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    cell, radius = np.full(part.num_rows, REST, np.int32), np.zeros(part.num_rows)
                    for length, mine, x in vectors_by_length(part.column(part.schema.get_field_index("embedding"))):
                        first, own = centres.get(length, (REST, np.zeros((1, length))))
                        near = ((own**2).sum(1) - 2 * x @ own.T).argmin(1)
                        cell[mine], radius[mine] = first + near, np.sqrt(((x - own[near]) ** 2).sum(1))
                    yield part.append_column("radius", pa.array(radius)).append_column("cell", pa.array(cell))

        schema = T.StructType([*rows.schema, T.StructField("radius", T.DoubleType()), T.StructField("cell", T.IntegerType())])
        placed = rows.mapInArrow(assign, schema).repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(_SPREAD))).sortWithinPartitions("cell", "radius")
        placed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/rows")
        placed.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/columns")
        stored = [(length, first + i, c.tolist()) for length, (first, own) in centres.items() for i, c in enumerate(own)]
        sizes = self.spark.read.schema(schema).parquet(f"{self.root}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
        known = self.spark.createDataFrame(stored, "length int, cell int, centre array<double>")
        known.join(sizes, "cell", "full_outer").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cells")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.root}/columns").schema).parquet(f"{self.root}/rows")

    def cells(self) -> Cells:
        """The table of cells, at most ``MOST_CELLS`` and one."""
        found = self.spark.read.parquet(f"{self.root}/cells").collect()
        own = sorted((r for r in found if r["cell"] != REST), key=lambda r: r["cell"])
        lengths = {r["length"] for r in own}
        return Cells(
            {n: np.array([r["cell"] for r in own if r["length"] == n]) for n in lengths},
            {n: np.array([r["centre"] for r in own if r["length"] == n]) for n in lengths},
            {r["cell"]: r["n"] or 0 for r in found},
            {r["cell"]: (r["low"], r["high"]) for r in found if r["n"]},
        )

    def search(self, queries: DataFrame, k: int, wanted: dict[str, object] | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
        """The rows of ``vectors.knn_l2``, (keys, vec_id, d2, rank), found exactly without comparing all pairs.

        Each query first searches the cells nearest to it until they hold ``k`` vectors; the ``k``-th
        distance bounds its neighbours. Then it searches the other cells that its bound leaves open (``Cells.bounds``),
        and in a cell only vectors whose radius differs from the query's own distance by no more than the bound. Other cells'
        folders are not read. ``wanted`` filters rows by metadata; where the nearest cells hold too few such rows, all cells stay open.
        """
        cells, rows = self.cells(), self.rows()
        rows = metadata_filter(rows, wanted) if wanted else rows

        def scan(labels: pa.RecordBatch, model: list[tuple], n: int, schema: T.StructType) -> DataFrame:
            """The best of the queries' pairs with the cells that they search; model: (length, places, queries, cell numbers, distances, searches, bounds) for each length."""
            read = sorted({int(c) for _, _, _, numbers, _, searches, _ in model for c in numbers[searches.any(0)]})
            shared = self.spark.sparkContext.broadcast((labels, {m[0]: m[1:] for m in model}))
            computed = self.computed

            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                labels, model = shared.value
                best, pairs = Best(n, k), 0
                for batch in batches:
                    for at in range(0, batch.num_rows, 512):
                        part = batch.slice(at, 512)
                        ids, radius, cell = (part.column(c).to_numpy() for c in (0, 2, 3))
                        for length, mine, x in vectors_by_length(part.column(1)):
                            if length not in model:
                                continue
                            places, q, numbers, away, searches, bound = model[length]
                            for number in np.unique(cell[mine]):
                                here = np.flatnonzero(cell[mine] == number)
                                column = int(np.flatnonzero(numbers == number)[0])
                                asks = np.flatnonzero(searches[:, column])
                                if not len(asks):
                                    continue
                                most = np.minimum(bound[asks], np.sqrt(best.worst[places[asks]]) * (1 + _SLACK) + _SLACK)
                                i, j = np.nonzero(np.abs(radius[mine][here][None] - away[asks, column][:, None]) <= most[:, None])
                                for some in range(0, len(i), 1 << 16):
                                    a, b = asks[i[some : some + (1 << 16)]], here[j[some : some + (1 << 16)]]
                                    best.add(places[a], ((q[a] - x[b]) ** 2).sum(1), ids[mine[b]])
                                pairs += len(i)
                computed.add(pairs)
                yield from best.batches(labels, "vec_id")

            held = rows.where(F.col("cell").isin(read)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "radius", "cell")
            return held.mapInArrow(task, schema)

        def run(asked: list[Row], labels: pa.RecordBatch, schema: T.StructType) -> DataFrame:
            n, lengths = by_length(asked)
            model, bounds = [], []
            for length, (places, q) in lengths.items():
                numbers, away, gap = cells.bounds(length, q)
                sizes = np.array([cells.sizes.get(int(c), 0) for c in numbers])
                order = np.argsort(gap, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                nearest = np.zeros(gap.shape, bool)
                np.put_along_axis(nearest, order, (before < k) & (sizes[order] > 0), axis=1)
                model.append((length, places, q, numbers, away, nearest, np.full(len(q), np.inf)))
                bounds.append(gap)
            first = written(scan(labels, model, n, schema), "near")
            reached = dict.fromkeys(range(n), np.inf)
            place: dict[tuple, list[int]] = {}
            for i, row in enumerate(labels.to_pylist()):
                place.setdefault(tuple(row.values()), []).append(i)
            kth = first.groupBy(*labels.schema.names).agg(F.sort_array(F.collect_list("cost")).alias("c")).where(F.size("c") >= k)  # k for each task at most
            for r in kth.select(*labels.schema.names, F.col("c")[k - 1].alias("d2")).collect():
                reached |= dict.fromkeys(place[tuple(r[name] for name in labels.schema.names)], float(np.sqrt(r["d2"])))
            rest = []
            for (length, places, q, numbers, away, nearest, _), gap in zip(model, bounds, strict=True):
                bound = np.array([reached[p] for p in places.tolist()]) * (1 + _SLACK) + _SLACK
                rest.append((length, places, q, numbers, away, ~nearest & (gap <= bound[:, None]), bound))
            return first.unionByName(scan(labels, rest, n, schema))

        found = block_by_block(usable(queries, *keys), list(keys), "vec_id", k, run)
        return found.select(*keys, "vec_id", F.col("cost").alias("d2"), "rank")
