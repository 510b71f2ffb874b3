"""Hard negatives, importance resampling and sharding against plain versions, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkdoc.llm import negatives, resampling, sharding
from larkdoc.llm.queries import op12_resampling, op13_sharding

# --- hard negatives ---


def test_planes_and_scores():
    random = np.random.default_rng(1)
    for most, width in ((1, 3), (150, 64), (5000, 17), (0, 8)):
        x, y = (random.integers(-most, most + 1, (40, width)) for _ in range(2))
        packed = negatives.planes(x)
        assert (negatives.integers(packed)[:, :width] == x).all()
        tables = negatives.subset_sums(negatives.integers(negatives.planes(y)), np.int64)
        assert (negatives.scores(tables, packed) == x @ y.T).all()


def plain_negatives(rows, asks, n_positives=5, n_negatives=3):
    whole = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in {(i, l, tuple(v)) for i, l, v in whole if asks(i)}:
        score = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in whole if i != a)
        same = [(s, i) for s, i, l in score if l == label][:n_positives]
        for place, (s, i) in enumerate(same, 1):
            fit = [(t, j) for t, j, l in score if l != label and 50 * -s <= 100 * -t <= 95 * -s][:n_negatives]
            out += [(a, i, rank, j, -s, -t, place) for rank, (t, j) in enumerate(fit, 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>, score int, place int, anchor int"


@pytest.mark.parametrize("blocks", [(2048, 8192), (2, 7)])
def test_negatives_equal_a_plain_search(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ANCHORS", blocks[0])
    monkeypatch.setattr(negatives, "CANDIDATES", blocks[1])
    random, nan = np.random.default_rng(5), float("nan")
    data = [(i, int(random.integers(0, 3)), [round(float(x), 1) for x in random.normal(size=6)]) for i in range(150)]  # coarse, so that scores tie
    data += [(150 + i, 0, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # one vector many times
    data += [(None, 1, [1.0] * 6), (300, None, [1.0] * 6), (301, 1, None), (302, 1, [None] * 6), (303, 1, [nan] * 6), (310, 1, [float("inf")] * 6), (304, 1, [])]
    data += [(305, 1, [1.0, 2.0]), (306, 2, [3.0] * 11), (0, 1, [2.0] * 6), data[7], data[7], (-10, 2, [0.5] * 6), (400, 9, [1.0] * 6), (500, 1, [1000.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in data], SCHEMA)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(data, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(df.where("false"), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
    with pytest.raises(Exception, match="this large"):
        negatives.hard_negatives(spark.createDataFrame([(1, 1, [1e300]), (2, 1, [1.0])], "vec_id long, label int, embedding array<double>"), F.lit(True)).collect()


# --- importance resampling ---


def plain_draw(docs, target, percent=10, least=20, longest=1):
    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for text in texts for f in runs(text)[1]) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, features = runs(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for place, r in enumerate(order[: percent * len(order) // 100], 1):
        rank.setdefault(r, []).append(place)
    return sorted((tuple((r[0], *r[2:], rank[r].pop(0) if rank.get(r) else None)) for r in rows), key=repr)


@pytest.mark.parametrize(("segment", "percent", "longest"), [(1 << 12, 10, 1), (5, 10, 1), (3, 60, 1), (4, 100, 2), (5, 0, 1)])
def test_draw_equals_a_plain_one(spark, monkeypatch, segment, percent, longest):
    monkeypatch.setattr(resampling, "SEGMENT_ROWS", segment)
    random = np.random.default_rng(3)
    words = ["the", "Und", "ÄÖ", "x9", "quoted'word", "字字", "a-b", "É"]
    docs = [(i, " ".join(random.choice(words, random.integers(0, 60)))) for i in range(300)]
    docs += [(None, None), (1000, None), (1001, ""), (1002, "the " * 50_000), (7, docs[7][1]), (7, docs[7][1]), (9, "other " * 30), (None, "the " * 25), (None, "the " * 25)]
    docs += [(2000, "same " * 30)] * 80  # one row many times
    target = ["the the und", None, "ÄÖ x9 new"]
    df = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id long, text string, score int, rank int").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted((tuple(r) for r in resampling.importance_resample(df, goal, percent, longest=longest).collect()), key=repr)
    assert got == plain_draw(docs, target, percent, longest=longest)
    assert resampling.importance_resample(df.where("false"), goal).count() == 0
    assert resampling.importance_resample(df, goal.where("false")).count() == len(docs)


def test_draw_query(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in op12_resampling(spark, sf_dir).collect()), key=repr)
    assert got == plain_draw([(r["doc_id"], r["text"]) for r in docs], [r["text"] for r in target])


# --- sharding ---


def test_large_populations_are_drawn_like_small_ones(monkeypatch):
    small, large = [], []
    for seed in range(4000):
        small.append(sharding.hypergeometric(np.random.default_rng(seed), 300, 700, 50))
    monkeypatch.setattr(sharding, "_NUMPY_MOST", 0)
    for seed in range(4000):
        large.append(sharding.hypergeometric(np.random.default_rng(seed), 300, 700, 50))
    exact = [math.comb(300, k) * math.comb(700, 50 - k) / math.comb(1000, 50) for k in range(51)]
    for draws in (small, large):
        seen = np.bincount(draws, minlength=51)
        kept = np.array(exact) * 4000 >= 5
        assert (((seen - np.array(exact) * 4000) ** 2 / (np.array(exact) * 4000))[kept]).sum() < 60  # some 25 counts
    assert sharding.split_counts(np.random.default_rng(1), np.array([0, 5, 3]), 8).tolist() == [0, 5, 3]
    assert sharding.hypergeometric(np.random.default_rng(1), 10**12, 10**12, 0) == 0
    assert abs(sharding.hypergeometric(np.random.default_rng(1), 10**12, 3 * 10**12, 10**8) - 25 * 10**6) < 40_000


def test_matrix_has_exact_sums():
    for seed in range(20):
        random = np.random.default_rng(seed)
        rows = random.integers(0, 40, 13)
        blocks = np.diff(np.concatenate([[0], np.sort(random.integers(0, rows.sum() + 1, 5)), [rows.sum()]]))
        matrix = np.array([sharding.matrix_row(i, np.concatenate([[0], np.cumsum(rows)]), blocks, seed) for i in range(13)])
        assert (matrix.sum(1) == rows).all() and (matrix.sum(0) == blocks).all() and (matrix >= 0).all()


def slots_of(df, **more):
    return [(r["shard"], r["slot"]) for r in sharding.shard_rows(df, **more).collect()]


@pytest.mark.parametrize(("n", "parts", "block"), [(1000, 5, 1 << 13), (1003, 7, 20), (5, 3, 2), (1, 1, 1), (0, 1, 1)])
def test_shards_have_exact_sizes(spark, monkeypatch, n, parts, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    df = spark.range(n).repartition(parts).selectExpr("cast(id % 3 as string) as text", "id", "9 as shard", "9 as slot")
    found = sharding.shard_rows(df)
    rows = found.collect()
    assert found.columns == ["text", "id", "shard", "slot"] and sorted(r["id"] for r in rows) == list(range(n))
    sizes = Counter(r["shard"] for r in rows)
    assert [sizes[s] for s in range(8)] == [n // 8 + (s < n % 8) for s in range(8)]
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert sorted(slots_of(df)) == sorted((r["shard"], r["slot"]) for r in rows)


def test_order_is_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 2)
    df = spark.range(24).coalesce(3).cache()
    seen = np.zeros((24, 24))
    for seed in range(30):
        for r in sharding.shard_rows(df, 3, seed).collect():
            seen[r["id"], r["shard"] * 8 + r["slot"]] += 1
    assert seen.sum(0).tolist() == [30] * 24
    assert 400 < ((seen - 1.25) ** 2 / 1.25).sum() < 680  # 529 degrees of freedom


def test_sharded_query_and_files(spark, sf_dir, tmp_path):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op13_sharding(spark, sf_dir).collect():
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "ä" * 100_000, 3)], "doc_id long, text string, law int")
    assert sorted((r["size"], r["text_crc32"]) for r in sharding.sharded_documents(odd).collect()) == sorted([(1, 0)] * 3 + [(200_001, zlib.crc32(("ä" * 100_000).encode()))])
    assert sharding.sharded_documents(odd.where("false")).count() == 0
    sharding.write_shards(odd, f"{tmp_path}/shards", 2)
    assert spark.read.parquet(f"{tmp_path}/shards/shard=1").count() == 2
