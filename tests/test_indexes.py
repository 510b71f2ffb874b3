"""Stored indexes against the plain searches, and what they don't read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkdoc.functions import text
from larkdoc.operators import nearest, retrieval, vectors
from larkdoc.sources import cells, postings


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_best_counts_equal_plain_counts():
    random_ = np.random.default_rng(4)
    for trial in range(300):
        n, k = int(random_.integers(1, 60)), int(random_.integers(1, 8))
        lists = [np.sort(random_.choice(n, int(random_.integers(1, n + 1)), replace=False)) for _ in range(int(random_.integers(1, 40)))]
        counts = np.bincount(np.concatenate(lists), minlength=n)
        least = int(random_.integers(0, 5))
        kth = max(least, 1, np.sort(counts)[::-1][k - 1] if k <= n else 1)
        found, said = postings.best_counts(lists, n, k, least)
        assert dict(zip(found.tolist(), said.tolist(), strict=True)) == {i: c for i, c in enumerate(counts.tolist()) if c >= kth}, trial


def corpus(spark, n=600):
    random_ = random.Random(8)
    words = [f"w{int(random_.paretovariate(0.6))}" for _ in range(20_000)]
    texts = [" ".join(random_.sample(words, random_.randrange(1, 60))) for _ in range(n)]
    chunks = spark.createDataFrame([(i * 7919 % 10_007, t) for i, t in enumerate(texts)] + [(None, "w1 w2"), (20_000, None), (20_001, ""), (20_002, "w1 " * 5000)], "chunk_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(random_.sample(words, 12))) for i in range(40)] + [(40, None), (41, "nowhere"), (42, "w1"), (None, "w1 w2")], "qid long, question string")
    return chunks, asked.select("qid", text.token_set(F.col("question")).alias("tokens"))


@pytest.mark.parametrize(("block", "literals"), [(4096, 2000), (7, 3)])
def test_postings_find_what_a_scan_finds(spark, tmp_path, monkeypatch, block, literals):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    monkeypatch.setattr(postings, "MOST_LITERALS", literals)
    chunks, asked = corpus(spark)
    index = postings.PostingIndex(spark, f"{tmp_path}/postings", shard_chunks=50)
    assert index.search(asked, 4).count() == 0
    index.append(chunks.where("chunk_id % 3 = 0"))
    index.append(chunks.where("chunk_id % 3 <> 0 or chunk_id is null").repartition(3))
    assert index.lists(["w1"]).select("part", "shard").distinct().count() >= 12
    assert rows(index.search(asked, 4)) == rows(retrieval.lexical_topk(asked, chunks, 4))
    assert index.search(asked.where("false"), 4).count() == 0


def test_a_search_reads_its_tokens_alone(spark, tmp_path):
    chunks, _ = corpus(spark, 50)
    index = postings.PostingIndex(spark, f"{tmp_path}/postings")
    index.append(chunks)
    plan = index.lists(["w5", "w1"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(token, [w1,w5])" in plan


def grouped(spark, width=24):
    random_ = np.random.default_rng(9)
    middles = random_.normal(size=(40, width)) * 3
    data = [(i, (middles[i % 40] + random_.normal(size=width) * 0.2).tolist(), i % 5) for i in range(4000)]
    data += [(5000 + i, [1.0, 2.0, float(i)], 1) for i in range(9)] + [(6000, None, 1), (6001, [None] * width, 1), (6002, [float("nan")] * width, 1), (6003, [], 1), (None, [0.0] * width, 1)]
    data += [(7000 + i, data[0][1], 2) for i in range(30)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize(("block", "wanted"), [(4096, None), (30, {"label": [1, 3]})])
def test_cells_find_what_a_scan_finds(spark, tmp_path, monkeypatch, block, wanted):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    held = grouped(spark)
    asked = held.where("vec_id % 50 = 0 or vec_id > 4999").select(F.col("vec_id").alias("qid"), "embedding").union(spark.createDataFrame([(-1, [5.0] * 24), (-2, [1.0] * 7), (-3, [0.0] * 3)], "qid long, embedding array<double>"))
    index = cells.CellIndex(spark, f"{tmp_path}/cells")
    index.write(held)
    found = rows(index.search(asked, 6, wanted))
    assert found == rows(vectors.knn_l2(asked, held, 6, wanted))
    if wanted is None:  # groups: few pairs are left
        assert 0 < index.computed.value < 0.2 * asked.count() * held.count()
        assert index.search(asked.where("false"), 6).count() == 0


def test_cells_of_rare_lengths_and_of_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE", 20)
    data = [(i, [float((i * j) % 11) for j in range(1, 4 + i % 3)]) for i in range(200)] + [(900 + i, [float(i)] * 9) for i in range(3)]
    held = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index = cells.CellIndex(spark, f"{tmp_path}/cells")
    index.write(held, 5)
    asked = held.select(F.col("vec_id").alias("qid"), "embedding")
    assert rows(index.search(asked, 4)) == rows(vectors.knn_l2(asked, held, 4))
    index.write(held.where("false"))
    assert index.search(asked, 4).count() == 0


def test_an_index_by_scope_reads_its_folders_alone(spark, tmp_path):
    from larkdoc.sources.index import ChunkIndex

    data = [(i, f"o{i % 3}", None if i % 7 == 0 else str(i % 4).zfill(3), [float(i), 1.0]) for i in range(120)]
    held = spark.createDataFrame(data, "vec_id long, owner string, chat_id string, embedding array<double>")
    index, plain = ChunkIndex(spark, f"{tmp_path}/by-scope", ("owner", "chat_id")), ChunkIndex(spark, f"{tmp_path}/plain")
    for one in (index, plain):
        one.write(held.where("vec_id < 80"))
        one.append(held.where("vec_id >= 80"))
    assert index.read().columns == plain.read().columns
    asked = held.limit(5).select(F.col("vec_id").alias("qid"), "embedding")
    for wanted in ({"owner": "o1", "chat_id": "002"}, {"owner": ["o0", "o2"]}, {"chat_id": "None"}, {"owner": "o9"}, None):
        assert rows(index.search(asked, 4, wanted)) == rows(plain.search(asked, 4, wanted))
    narrowed = index._narrowed(index._read(index.parts()), {"owner": "o1", "chat_id": ["002", "003"]})
    plan = narrowed._jdf.queryExecution().toString()
    assert "in_owner#" in plan.split("PartitionFilters: ")[1].split("]")[0] and narrowed.count() == len([r for r in data if r[1] == "o1" and r[2] in ("002", "003")])
    scopes = spark.createDataFrame([(1, "o1", "002"), (2, "o0", None), (3, "o9", "001")], "qid long, owner string, chat_id string").where("qid < 3")
    found = index.rows_of(scopes)
    assert rows(found.select("qid", "vec_id")) == sorted((((1 if r[1] == "o1" else 2), r[0]) for r in data if (r[1], r[2]) in (("o1", "002"), ("o0", None))), key=repr)
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert index.delete({"owner": "o1"}) == plain.delete({"owner": "o1"}) == 40
    assert rows(index.read()) == rows(plain.read())
    index.compact()
    assert rows(index.read()) == rows(plain.read()) and len(index.parts()) == 1
