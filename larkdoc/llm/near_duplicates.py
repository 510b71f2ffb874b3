"""Near-duplicate documents by BagMinHash signatures of word shingles, bands, and verified multiset overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkdoc.llm import rolling
from larkdoc.llm.common import components, id_and_text, written
from larkdoc.llm.substrings import BROADCAST_IDS

SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 24, 5
#: Buckets up to this size are compared pair by pair, so pairs grow in proportion to rows; larger ones by a hub and rare shingles.
SMALL_BUCKET = 16
#: Of a common rare shingle's rows, how many a task has on one side.
MOST_TOGETHER = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = 40
BAGS_AT_ONCE = 400_000


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the multiset of ``size`` consecutive words; of a shorter text, all its words as one; of none, nothing."""
    hashes = rolling.words(text.encode("utf-8", "replace"))[0]
    return np.unique(rolling.windows(hashes, min(size, len(hashes))), return_counts=True) if len(hashes) else (hashes, np.zeros(0, np.int64))


def overlap(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if either is empty."""
    _, i, j = np.intersect1d(first[0], second[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(first[1][i], second[1][j]).sum())
    return both / max(1, int(first[1].sum()) + int(second[1].sum()) - both)


def _draw(keys: np.ndarray, salt: int) -> np.ndarray:
    """Random bits of (key, salt); keys that differ by a multiple of the constant don't meet in each other's salts."""
    return rolling.mixed(rolling.mixed(keys) ^ np.uint64((salt * int(_GOLDEN) ^ salt << 17) % (1 << 64)))


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Signatures (bags x ``size``, 64-bit) whose slots agree with a probability of the bags' weighted Jaccard similarity.

    Weights are cut at 0, 1, 2, 4, 8 ...; each (element, interval) has its own Poisson process of a
    rate equal to the interval's width, whose points fall on a slot and on a weight in the interval.
    A point counts for a bag if it lies below the element's weight there, so bags that share an
    element share the points below the lesser weight. A slot keeps its earliest point. Points are
    drawn in order of time up to a limit by which all slots have a point as a rule; where one
    hasn't, the limit is doubled. The limit doesn't alter the result. An empty bag's slots are -1.
    """
    out = np.full((len(bags), size), -1, np.int64)
    weight = np.array([float(c.sum()) for _, c in bags])
    limit = np.divide(size * (np.log(size) + 5), weight, out=np.zeros(len(bags)), where=weight > 0)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        keys = np.concatenate([bags[b][0] for b in todo])
        counts = np.concatenate([bags[b][1] for b in todo]).astype(float)
        owner = np.repeat(np.arange(len(todo)), [len(bags[b][0]) for b in todo])
        until = limit[todo][owner]
        slots = np.full(len(todo) * size, np.inf)
        for level in range(_LEVELS):
            low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            at = np.flatnonzero(counts > low)
            if not len(at):
                break
            seeds = _draw(keys[at], 1000 + level)
            time = np.zeros(len(at))
            for k in range(1 << 20):
                draw = _draw(seeds, 3 * k + 1)
                time = time - np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53) / width
                live = time <= until[at]
                if not live.all():
                    at, seeds, time = at[live], seeds[live], time[live]
                if not len(at):
                    break
                slot = (_draw(seeds, 3 * k + 2) % np.uint64(size)).astype(np.int64)
                place = owner[at] * size + slot
                if level:
                    below = low + width * (_draw(seeds, 3 * k + 3) >> np.uint64(11)).astype(float) * 2.0**-53 < counts[at]
                    np.minimum.at(slots, place[below], time[below])
                else:
                    np.minimum.at(slots, place, time)
        found = slots.reshape(len(todo), size)
        full = np.isfinite(found).all(1)
        out[todo[full]] = found[full].view(np.int64)
        todo = todo[~full]
        limit[todo] *= 2
    return out


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different bands having different keys."""
    parts = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(signatures), 1))
    for k in range(rows):
        keys = rolling.mixed(keys ^ parts[:, :, k])
    return keys.view(np.int64)


def tokens_of(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set of 64-bit tokens: a shingle that is there for the k-th time is a token of its own."""
    keys, counts = bag
    turn = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return rolling.mixed(np.repeat(keys, counts) + turn.astype(np.uint64) * _GOLDEN)


def parity_sketch(tokens: np.ndarray) -> bytes:
    """Whether the tokens at each of a power of two of bits are odd in number; four times as many bits as tokens, from 256 to 65,536.

    Two sets differ in at least as many tokens as their sketches do in bits, whatever the hash.
    """
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, 4 * len(tokens)))), 8, 16))
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of words) with as many words as ``size``: halves that fall together are added without carry."""
    while sketch.shape[1] > size:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def most_differences(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """In how many tokens two sets of ``sizes`` tokens together may differ at most if they overlap by ``similarity``."""
    return sizes * (1 - 2 * similarity / (1 + similarity)) + 1e-6


def may_overlap(first: list[np.ndarray], second: list[np.ndarray], i: np.ndarray, j: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """For pairs first[i], second[j] of sketches, ``sizes`` tokens together, whether these leave an overlap of ``similarity`` possible. No such pair is lost."""
    words = [np.array([len(x) for x in side]) for side in (first, second)]
    least, differ = np.minimum(words[0][i], words[1][j]), np.zeros(len(i), np.int64)
    for size in np.unique(least):
        sides = []
        for side, own, at in ((first, words[0], i), (second, words[1], j)):
            used, place = np.unique(at[least == size], return_inverse=True)
            matrix = np.empty((len(used), size), np.uint64)
            for length in np.unique(own[used]):
                mine = np.flatnonzero(own[used] == length)
                matrix[mine] = folded(np.stack([side[k] for k in used[mine]]), int(size))
            sides.append((matrix, place))
        (x, at), (y, to) = sides
        step = max(1, (1 << 20) // int(size))
        differ[least == size] = np.concatenate([np.bitwise_count(x[at[k : k + step]] ^ y[to[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(at), step)])
    return differ <= most_differences(sizes, similarity)


def dealt(pairs: DataFrame, pairs_a_group: int = 500) -> DataFrame:
    """``pairs`` (a, b) with a ``part``: an ``a`` with many pairs is spread over parts of about ``pairs_a_group``, so that no task holds it alone."""
    busy = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / pairs_a_group).alias("parts")).where("parts > 1"), "busy")
    few = busy.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return pairs.join(F.broadcast(busy) if few else busy, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).alias("part"))


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The (a, b, part) of ``pairs`` that sizes and parity sketches leave possible, so that texts that only share a passage aren't fetched and compared."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (3, 4))
            at = np.arange(batch.num_rows)
            yield batch.select([0, 1, 2]).filter(pa.array(may_overlap(first, second, at, at, batch.column(5).to_numpy(), similarity)))

    left = pairs.select("a", "part").distinct().join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("_a"), F.col("size").alias("_m")), "a")
    joined = pairs.join(left, ["a", "part"]).join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("_b"), F.col("size").alias("_n")), "b")
    near = F.abs(F.col("_m") - F.col("_n")) <= (F.col("_m") + F.col("_n")) * (1 - 2 * similarity / (1 + similarity)) + 1e-6
    return joined.where(near).select("a", "b", "part", "_a", "_b", F.col("_m") + F.col("_n")).mapInArrow(task, "a long, b long, part long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, part) whose texts' shingle multisets overlap by ``similarity`` or more.

    A task reads a part in order, the text of ``a`` first, and holds one multiset.
    """
    left = pairs.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), "text")
    right = pairs.join(texts, F.col("b") == F.col("doc_id")).select("a", "part", F.lit(1).alias("side"), "b", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            links = []
            for a, side, b, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                bag = shingles(text.as_py())
                if side == 0:
                    held = bag
                elif overlap(held, bag) >= similarity:
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return rows.select("a", "side", "b", "text").mapInArrow(task, "a long, b long")


def _compared(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The links among ``pairs`` (a, b), which may repeat."""
    tried = written(dealt(written(pairs.distinct(), "pairs")), "dealt")
    return written(verified(written(possible(tried, sketches, similarity), "possible"), texts, similarity), "links")


def rare_shingles(texts: DataFrame, similarity: float) -> DataFrame:
    """Rows (token, doc_id, at, size): the rarest shingles of each of ``texts`` (doc_id, text), as many as a link needs.

    Texts are sets of ``size`` tokens (``tokens_of``). All texts order their tokens alike, by the number of texts with it and then by
    hash; ``at`` is a token's place in its text. Two sets of an overlap of ``similarity`` have one of
    their first size - ceil(similarity * size) + 1 tokens in common, as the rest is too small to be
    all of what they share. Tokens of one text only aren't given, but count as the first places.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = tokens_of(shingles(text.as_py()))
                if n := len(tokens):
                    yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.full(n, doc_id)), pa.array(np.full(n, n))], names=["token", "doc_id", "size"])

    tokens = written(texts.select("doc_id", "text").mapInArrow(task, "token long, doc_id long, size long"), "tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    whole = Window.partitionBy("doc_id")
    placed = tokens.join(shared, "token").withColumn("at", F.col("size") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("n", "token")) - 1)
    return placed.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9)).select("token", "doc_id", "at", "size")


def _may_link(similarity: float, a: str, b: str) -> Column:
    """Whether two rows of ``rare_shingles`` with one token, if it is the first that their texts share, leave enough tokens behind it."""
    left = F.least(F.col(f"{a}.size") - F.col(f"{a}.at"), F.col(f"{b}.size") - F.col(f"{b}.at"))
    return left * (1 + similarity) >= (F.col(f"{a}.size") + F.col(f"{b}.size")) * similarity - 1e-9


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of one for each ``doc_id``, with the component that ``labels`` (node, component) have for it, or itself, as ``label``."""
    return rows.join(labels, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")


def _classes(hits: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Components (node, component) of the links between documents that share a bucket; ``hits`` has (key, doc_id, n).

    Small buckets are compared pair by pair. In a larger one the member that shares the most
    buckets with others is compared with all, which settles most groups of copies. The members of
    buckets with any left out of its component go on to exact filters instead of pairs: they
    meet by their rare shingles (``rare_shingles``), and only if sizes and places allow a link. Texts
    that share no more than a common passage, however many, have that behind their first places and don't meet.
    """
    small = hits.where(F.col("n") <= SMALL_BUCKET)
    pairs = small.select("key", F.col("doc_id").alias("a")).join(small.select("key", F.col("doc_id").alias("b")), "key").where("a < b").select("a", "b")
    large = hits.where(F.col("n") > SMALL_BUCKET).select("key", "doc_id")
    if large.isEmpty():
        return components(_compared(pairs, sketches, texts, similarity))
    degree = hits.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    large = written(large.join(degree, "doc_id"), "large-buckets")
    hubs = written(large.groupBy("key").agg(F.max_by("doc_id", F.struct("degree", -F.col("doc_id"))).alias("hub")), "hubs")
    # a hub's text is the one that is held
    links = _compared(pairs.unionByName(large.join(hubs, "key").where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))), sketches, texts, similarity)
    labels = written(components(links), "labels")
    home = hubs.join(labels, F.col("hub") == F.col("node"), "left").select("key", F.coalesce("component", "hub").alias("home"))
    named = _labelled(large.groupBy("doc_id").agg(F.collect_list("key").alias("key")), labels).select(F.explode("key").alias("key"), "label").join(home, "key")
    open_ = written(named.groupBy("key").agg(F.max(F.col("label") != F.col("home")).alias("open")).where("open").select("key"), "open-buckets")
    if open_.isEmpty():
        return labels
    members = written(large.join(open_, "key", "left_semi").select("doc_id").distinct(), "open")
    rare = rare_shingles(texts.join(members, "doc_id", "left_semi"), similarity)
    rare = written(rare.groupBy("doc_id", "size").agg(F.collect_list(F.struct("token", "at")).alias("rare")), "rare")  # a row for each text, so that labels meet texts and not their shingles

    def labelled(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rare shingles with the components of their texts, and the size of each that several components have."""
        rows = written(_labelled(rare, labels).select(F.explode("rare").alias("rare"), "doc_id", "size", "label").select("rare.token", "doc_id", "rare.at", "size", "label"), "labelled")
        best = F.max_by(F.struct("doc_id", "at", "size", "label"), F.struct(F.col("size") - F.col("at"), -F.col("doc_id"))).alias("best")
        return rows, written(rows.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), best).where("low < high").select("token", "n", "best"), "met")

    rows, met = labelled(labels)
    first = met.where(F.col("n") > SMALL_BUCKET).select("token", "best.*").alias("a").join(rows.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.label") != F.col("b.label")) & _may_link(similarity, "a", "b"))
    links = _compared(first.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")), sketches, texts, similarity)
    if not links.isEmpty():
        labels = _joined(labels, links)
        rows, met = labelled(labels)
    # all others, a common token's rows dealt over tasks; only pairs that may link leave them
    met = met.select("token", F.ceil(F.col("n") / MOST_TOGETHER).alias("parts"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    both = rows.join(met, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = both.join(sketches.select("doc_id", "sketch"), "doc_id")
    blocks = both.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "at", "size", "label", "sketch")
    rest = blocks.groupBy("token", "i", "j").applyInArrow(lambda key, block: _pairs_of_block(block, key[1].as_py(), key[2].as_py(), similarity), "a long, b long")
    links = _compared(rest, sketches, texts, similarity)
    return labels if links.isEmpty() else _joined(labels, links)


def _pairs_of_block(block: pa.Table, i: int, j: int, similarity: float) -> pa.Table:
    """The pairs (a, b) of a token's parts ``i`` and ``j`` that have different labels and that places, sizes and sketches leave possible."""
    own, doc, at, size, label = (block.column(c).to_numpy() for c in ("own", "doc_id", "at", "size", "label"))
    sketches = [np.frombuffer(x, np.uint64) for x in block.column("sketch").to_pylist()]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, len(left), 256):
        x = left[start : start + 256]
        rest = np.minimum((size - at)[x][:, None], (size - at)[right][None])
        both = size[x][:, None] + size[right][None]
        fits = (label[x][:, None] != label[right][None]) & (rest * (1 + similarity) >= both * similarity - 1e-9)
        if i == j:
            fits &= doc[x][:, None] < doc[right][None]
        p, q = np.nonzero(fits)
        for some in range(0, len(p), 1 << 17):
            m, n = x[p[some : some + (1 << 17)]], right[q[some : some + (1 << 17)]]
            kept = may_overlap(sketches, sketches, m, n, size[m] + size[n], similarity)
            found.append((np.minimum(doc[m[kept]], doc[n[kept]]), np.maximum(doc[m[kept]], doc[n[kept]])))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more links: only the components that these join are looked at anew."""
    ends = links.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b", "left")
    merged = written(components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))).withColumnRenamed("component", "least"), "merged")
    known = labels.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    fresh = merged.join(labels.select("node"), "node", "left_anti").select("node", F.col("least").alias("component"))
    return written(known.unionByName(fresh), "labels")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, class_id, kept, text_hash), one for each row of ``docs``: the smallest id of each class of near copies is kept.

    Two documents are linked if their multisets of ``SHINGLE`` consecutive words overlap by
    ``similarity`` or more (weighted Jaccard), or their words are the same; classes are what links
    connect. Texts of the same words count once from the start. Candidates share a band of
    ``rows`` slots out of ``bands``: at 0.8 all but one in ten thousand pairs do. Links are verified
    on whole texts. Signatures, buckets, pairs and links stay in tables.

    A null text has no words, as an empty one has, and these texts are one class; a row with a null
    id has a null class and is kept; texts are told apart by their words, not by ids, so rows that share an id may be in
    different classes; no rows give no rows; other columns are ignored. The column ``text_hash`` of the result tells such rows apart.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signed(rows_: list[tuple], bags: list) -> pa.RecordBatch:
            ids, hashes, same, sketches, sizes = zip(*rows_, strict=True)
            keys = pa.array(list(bands_of(bag_minhash(bags, bands * rows), bands, rows)), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(same, pa.binary()), keys, pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "same", "bands", "sketch", "size"])

        # signatures are drawn for many texts at once, as many as have BAGS_AT_ONCE shingles together
        told, bags, held = [], [], 0
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                bags.append(shingles(text))
                tokens = tokens_of(bags[-1])
                told.append((doc_id, text_hash, hashlib.sha256(b" ".join(text.encode("utf-8", "replace").split())).digest(), parity_sketch(tokens), len(tokens)))
                held += len(bags[-1][0]) + 100
                if held >= BAGS_AT_ONCE:
                    yield signed(told, bags)
                    told, bags, held = [], [], 0
        if told:
            yield signed(told, bags)

    scanned = written(texts.mapInArrow(scan, "doc_id long, text_hash long, same binary, bands array<long>, sketch binary, size long"), "signatures")
    alike = scanned.where("doc_id is not null").groupBy("same").agg(F.min(F.struct("doc_id", "text_hash", "bands", "sketch", "size")).alias("least")).select("same", "least.*")
    alike = written(alike.withColumn("node", F.monotonically_increasing_id()), "texts")  # a node for each text; ids may have several
    keyed = alike.where(F.col("same") != F.lit(hashlib.sha256(b"").digest())).select(F.col("node").alias("doc_id"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hits = written(keyed.join(shared, "key"), "buckets")
    wanted = written(alike.select("node", "doc_id", "text_hash").join(hits.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi"), "wanted")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    nodes = alike.select(F.col("node").alias("doc_id"), "sketch", "size")
    classes = _classes(hits, nodes, written(chosen, "candidate-texts"), similarity)
    placed = alike.select("same", "node", "doc_id").join(classes, "node", "left")
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = placed.join(least, "component", "left").select("same", F.coalesce("least", "doc_id").alias("class_id"))
    known = scanned.where("doc_id is not null").select("doc_id", "text_hash", "same").join(named, "same").select("doc_id", "class_id", "text_hash")
    unknown = scanned.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), "text_hash")
    return known.unionByName(unknown).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "text_hash")
