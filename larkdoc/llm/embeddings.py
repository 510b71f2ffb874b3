"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.common import components, written

SAMPLE, SUBSPACES, CODES, MOST_LISTS, BLOCK = 8192, 8, 64, 4096, 8192
#: Queries and entries whose products are added up at once, in the cache.
QUERIES_AT_ONCE, ENTRIES_AT_ONCE = 512, 512


def _kmeans(points: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    centres = points[random.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


@dataclass
class ProductIndex:
    """Coarse centres and, for each subspace, the codebook of the residuals; vectors have length 1."""

    coarse: np.ndarray
    books: np.ndarray  # subspaces x codes x width
    groups: np.ndarray  # a number for each list; lists of a number are neighbours and are searched together

    @staticmethod
    def fit(sample: np.ndarray, lists: int, seed: int = 3, n_groups: int = 1) -> ProductIndex:
        random = np.random.default_rng(seed)
        coarse = _kmeans(sample, min(lists, len(sample)), 8, random)
        rest = sample - coarse[((coarse**2).sum(1) - 2 * sample @ coarse.T).argmin(1)]
        width = -(-sample.shape[1] // SUBSPACES)
        rest = np.pad(rest, ((0, 0), (0, width * SUBSPACES - sample.shape[1])))
        books = [_kmeans(rest[:, s * width : (s + 1) * width], CODES, 8, random) for s in range(SUBSPACES)]
        k = max(map(len, books))
        return ProductIndex(coarse, np.stack([np.pad(b, ((0, k - len(b)), (0, 0)), mode="edge") for b in books]), _nearest(coarse, _kmeans(coarse, min(n_groups, len(coarse)), 8, random)))

    def _split(self, rest: np.ndarray) -> np.ndarray:
        width = self.books.shape[2]
        return np.pad(rest, ((0, 0), (0, width * SUBSPACES - rest.shape[1]))).reshape(len(rest), SUBSPACES, width)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error): the error is the distance between a vector and what its codes stand for."""
        near = ((self.coarse**2).sum(1) - 2 * vectors @ self.coarse.T).argmin(1)
        rest = self._split(vectors - self.coarse[near])
        codes = np.stack([((self.books[s] ** 2).sum(1) - 2 * rest[:, s] @ self.books[s].T).argmin(1) for s in range(SUBSPACES)], 1).astype(np.uint8)
        back = np.stack([self.books[s][codes[:, s]] for s in range(SUBSPACES)], 1)
        return near, codes, np.sqrt(((rest - back) ** 2).sum((1, 2)))

    def probes(self, vectors: np.ndarray, reach: float) -> np.ndarray:
        """For each vector and list whether the list may hold a vector within ``reach``.

        A step s from a vector into another list has 2 s (c2 - c1) >= gap, the difference of the squared
        distances to the two centres; s (c2 - c1) is at most ``reach`` times the distance between them.
        """
        square = (self.coarse**2).sum(1) - 2 * vectors @ self.coarse.T
        own = square.argmin(1)
        gap = square - square[np.arange(len(vectors)), own][:, None]
        return gap <= 2 * reach * np.sqrt(np.maximum(self.between[own], 0)) + 1e-9

    @cached_property
    def between(self) -> np.ndarray:
        """Squared distances between the centres."""
        size = (self.coarse**2).sum(1)
        return size[:, None] + size[None] - 2 * self.coarse @ self.coarse.T

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes of vectors stand for."""
        rest = np.concatenate([self.books[s][codes[:, s]] for s in range(SUBSPACES)], 1)
        return self.coarse[lists] + rest[:, : self.coarse.shape[1]]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(subspaces x codes x queries): the products of the queries' parts with all codes, looked up for each entry instead of multiplied."""
        return np.einsum("scw,qsw->scq", self.books, self._split(queries)).astype(np.float32)


def _joined(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ``ids`` the smallest id that the links (i, j), positions in ``ids``, lead to."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``.

    Two vectors are linked if their cosine, in double precision, is ``cosine`` or more; ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id that links lead to.

    Equal vectors are collapsed first and weigh as many rows as they are. The index is fitted on at
    most ``SAMPLE`` vectors, chosen by a hash of their ids; every vector is coded and every vector is
    a query. A query probes all lists that can hold a vector within the distance of ``cosine`` (see
    ``ProductIndex.probes``), and drops an entry if the distance to what its codes stand for exceeds that distance
    by more than the entry's own coding error; the rest are reranked by exact cosines. So no link is
    missed. Vectors without structure in many columns probe nearly all lists, and time then grows
    with the square of the distinct vectors; a query is sent once to each group of lists from its own on, not to each
    list. A group is searched in blocks of about ``BLOCK`` entries and queries: tables of the queries' products with all codes
    are looked up for each entry and added to the product with its centre; a block gives counts and a smallest linked id for each vector, never pairs.

    Vectors of each length are compared among themselves, with an index of their own, one length
    after another. Null or zero vectors and those with null, infinite or undefined components link
    with nothing, as do rows with a null id. Rows that share an id count each and are linked by their own vectors only. No rows give no rows;
    other columns are ignored.
    """
    kind = np.float32 if "float" in dict(vectors.dtypes)[vector_col] else np.float64  # sent as they came
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = finite & F.col("vec_id").isNotNull()
    classes = written(rows.where(good).groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "vectors")  # ids may be shared, so classes have keys of their own
    lengths = classes.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).where("n > 1").collect()  # a row for each length
    found = [_links(classes.where(F.size("v") == r["length"]), r["n"], cosine, kind) for r in sorted(lengths)]
    if found:
        found = reduce(DataFrame.unionByName, found)
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        labels = components(found.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
        classes = classes.join(counts, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
        least = classes.where("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
        classes = classes.join(least, "component", "left")
    else:
        classes = classes.withColumns({"links": F.lit(None).cast("long"), "smallest": F.lit(None).cast("long")})
    # a vector finds itself, with all its copies
    named = classes.select("v", (F.coalesce("links", "copies") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component_id"))
    linked = rows.where(good).join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, n: int, cosine: float, kind: type) -> DataFrame:
    """Rows (rep, links, least) of the ``n`` vectors of one length in ``classes`` (v, rep, copies): a block's counts and smallest linked ids."""
    spark = classes.sparkSession
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()], float)
    index = ProductIndex.fit(_units(sample), int(np.clip(np.sqrt(n), 1, MOST_LISTS)), n_groups=-(-n // BLOCK))
    shared = spark.sparkContext.broadcast(index)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = np.array(part.column(0).to_pylist(), kind)
                units = _units(raw.astype(float))
                lists, codes, errors = shared.value.encode(units)
                groups = shared.value.groups
                probed = np.zeros((len(units), groups.max() + 1), bool)
                again, lead = np.nonzero(shared.value.probes(units, reach))
                probed[again, groups[lead]] = True
                probed &= np.arange(probed.shape[1]) >= groups[lists][:, None]  # a pair of groups is searched from one side
                again, asked = np.nonzero(probed)
                entry = np.concatenate([np.ones(len(units), bool), np.zeros(len(again), bool)])
                source = np.concatenate([np.arange(len(units)), again])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([groups[lists], asked]).astype(np.int32)),
                        pa.array(lists[source].astype(np.int32)),
                        pa.array(entry),
                        part.column(1).take(pa.array(source)),
                        part.column(2).take(pa.array(source)),
                        pa.array([raw[i].tobytes() for i in source], pa.binary()),
                        pa.array([codes[i].tobytes() if e else None for i, e in zip(source, entry, strict=True)], pa.binary()),
                        pa.array(errors[source]),
                    ],
                    names=["group", "list", "entry", "rep", "copies", "vector", "codes", "error"],
                )

    dealt = written(classes.select("v", "rep", "copies").repartition("rep").mapInArrow(deal, "group int, list int, entry boolean, rep long, copies long, vector binary, codes binary, error double"), "lists")
    blocks = dealt.groupBy("group").agg(F.ceil(F.count_if("entry") / BLOCK).alias("entry_blocks"), F.ceil(F.count_if(~F.col("entry")) / BLOCK).alias("query_blocks"))
    placed = dealt.join(F.broadcast(blocks.where("entry_blocks > 0 and query_blocks > 0")), "group")  # at most MOST_LISTS rows
    own = F.when(F.col("entry"), F.pmod(F.xxhash64("rep"), "entry_blocks")).otherwise(F.pmod(F.xxhash64("rep"), "query_blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("entry"), F.col("query_blocks")).otherwise(F.col("entry_blocks")) - 1)
    placed = placed.withColumn("own", own).withColumn("other", F.explode(others))
    placed = placed.select("group", "list", F.when(F.col("entry"), F.col("own")).otherwise(F.col("other")).alias("entries"), F.when(F.col("entry"), F.col("other")).otherwise(F.col("own")).alias("queries"), "entry", "rep", "copies", "vector", "codes", "error")

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The links of a block; where a query comes from another group, they count for its entries too, as these aren't sent there."""
        entries, queries = frame[frame["entry"]], frame[~frame["entry"]]
        if not len(entries) or not len(queries):
            return pd.DataFrame({"rep": [], "links": [], "least": []})
        index, entries = shared.value, entries.sort_values("list")
        x, q = (_units(np.frombuffer(b"".join(side["vector"]), kind).reshape(len(side), -1).astype(float)) for side in (entries, queries))
        codes = np.frombuffer(b"".join(entries["codes"]), np.uint8).reshape(len(entries), -1)
        lists, weights, asking_weights = entries["list"].to_numpy(), entries["copies"].to_numpy(), queries["copies"].to_numpy()
        guest = index.groups[queries["list"].to_numpy()] != key[0]
        ids, node = np.unique(np.concatenate([queries["rep"].to_numpy(), entries["rep"].to_numpy()]), return_inverse=True)
        places, links, edges = np.arange(len(ids)), np.zeros(len(ids), np.int64), []
        # |q - c|^2 <= (reach + error)^2 as a product, for |q| = 1; single precision needs the slack
        coded = index.decoded(lists, codes)
        least_product = ((1 + (coded**2).sum(1) - (reach + entries["error"].to_numpy() + 1e-4) ** 2 - 1e-5) / 2).astype(np.float32)
        for first in range(0, len(q), QUERIES_AT_ONCE):
            asking = q[first : first + QUERIES_AT_ONCE]
            probed, tables, base = index.probes(asking, reach).T, index.tables(asking), (index.coarse @ asking.T).astype(np.float32)
            for begin in range(0, len(x), ENTRIES_AT_ONCE):
                end = min(begin + ENTRIES_AT_ONCE, len(x))
                numbers = np.unique(lists[begin:end])
                if probed[numbers].mean() > 0.25:
                    parts = [(np.arange(begin, end), np.arange(len(asking)))]
                else:  # where few lists are probed, each of them with its own queries
                    parts = [(begin + np.flatnonzero(lists[begin:end] == n), np.flatnonzero(probed[n])) for n in numbers if probed[n].any()]
                hits = []
                for some, chosen in parts:
                    whole = len(chosen) == len(asking)
                    own = tables if whole else np.ascontiguousarray(tables[:, :, chosen])
                    product = base[lists[some]] if whole else base[lists[some]][:, chosen]
                    looked = np.empty_like(product)
                    for s in range(SUBSPACES):
                        product += np.take(own[s], codes[some, s], axis=0, out=looked)
                    j, i = np.nonzero(product >= least_product[some, None])
                    j, i = some[j], chosen[i]
                    open_ = probed[lists[j], i]
                    hits.append((i[open_] + first, j[open_]))
                if not hits:
                    continue
                i, j = (np.concatenate(h) for h in zip(*hits, strict=True))
                exact = np.empty(len(i))
                for at in range(0, len(i), 1 << 17):
                    exact[at : at + (1 << 17)] = np.einsum("ij,ij->i", q[i[at : at + (1 << 17)]], x[j[at : at + (1 << 17)]])
                linked = exact >= cosine
                i, j = i[linked], j[linked]
                np.add.at(links, node[i], weights[j])
                np.add.at(links, node[j + len(q)][guest[i]], asking_weights[i][guest[i]])
                i, j = node[i], node[j + len(q)]
                if (i != j).any():
                    least = _joined(i, j, places)
                    moved = np.flatnonzero(least != places)
                    edges.append(np.stack([moved, least[moved]]))
        label = _joined(*np.concatenate(edges, 1), places) if edges else places
        used = np.flatnonzero((links > 0) | (label != places))
        return pd.DataFrame({"rep": ids[used], "links": links[used], "least": ids[label[used]]})

    return written(placed.groupBy("group", "entries", "queries").applyInPandas(search, "rep long, links long, least long"), "found")


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large or small components neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
