"""Cases that only the whole job gets right: links between dense groups, words longer than a block, ends of long runs."""

import re

import numpy as np
import pytest

from larkdoc.llm import embeddings, quality, rolling, substrings, toxicity


def dense_groups(width):
    """Groups of near copies whose middles have cosines of 0.90 to 0.97, pair by pair, and a plane of many angles."""
    random_, found = np.random.default_rng(12), []
    for cosine in (0.9, 0.92, 0.95, 0.97):
        basis = np.linalg.qr(random_.standard_normal((width, 2)))[0].T
        for middle in (basis[0], cosine * basis[0] + np.sqrt(1 - cosine**2) * basis[1]):
            found.append(middle + random_.standard_normal((150, width)) * 0.01 / np.sqrt(width))
    turns = random_.uniform(0, 2 * np.pi, 300)
    found.append(np.stack([np.cos(turns), np.sin(turns)], 1) @ np.linalg.qr(random_.standard_normal((width, 2)))[0].T)
    return random_.permutation(np.concatenate(found))


@pytest.mark.parametrize("block", [8192, 100])
def test_links_between_dense_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    x = dense_groups(64)
    x = np.concatenate([x, x[::5], x[::15]])  # copies count for vectors of other groups too
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([label[row].min() for row in near])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert [found[i] for i in range(len(x))] == list(zip((near.sum(1) - 1).tolist(), label.tolist(), strict=True))


GIANT = "Ωx7é" * 600_000  # 3.6 MB; no block ends between its characters


@pytest.mark.parametrize("text", [GIANT, f"x{GIANT} b", f" a {GIANT}\n{GIANT} c ", "a" * (1 << 20) + " b", "a" * (1 << 21), "b " + "a" * ((1 << 20) - 2) + " c"])
def test_a_giant_word_is_one_word(text):
    data = text.encode()
    hashes, starts, ends = rolling.words(data)
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == spans
    said = [data[a:b] for a, b in spans]
    assert [[x == y for y in hashes.tolist()] for x in hashes.tolist()] == [[x == y for y in said] for x in said]
    last = rolling.words(data[:-1] + b"!")[0]
    assert data.endswith(b" ") or last[-1] != hashes[-1]


def test_a_passage_beside_a_giant_word_is_removed(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, passage), (2, f"a{GIANT} {passage} b")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in substrings.dedup_substrings(docs).collect()}
    assert found[2]["text"] == f"a{GIANT} b" and found[2]["n_words"] == 52


def test_subwords_reach_the_end_of_a_run():
    for run in ("clean" * 30 + "poison", "字" * 5000 + "毒药汤" + "字" * 5000):
        marked = f"<{run}>"
        grams = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        assert sorted(g for part in toxicity.subwords(run) for g in part) == sorted(toxicity.zlib.crc32(g.encode()) % toxicity.BUCKETS for g in grams)
    buckets, counts = toxicity.bag("_" * 70 + "poison")
    assert {toxicity.zlib.crc32(g.encode()) % toxicity.BUCKETS for g in ("pois", "son>")} <= set(buckets.tolist())
    assert counts.sum() == 1 + 78 - 2 + 78 - 3 + 78 - 4


def test_toxic_ends_of_long_runs_score(spark):
    texts = [(i, "_".join(["kind", "words", "only", "here"] * 5 + (["poison"] if i % 2 else ["petal"]))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    scores = toxicity.toxicity_scores(docs, labels).where("held_out").select("doc_id", "score").collect()
    assert len({r["doc_id"] % 2 for r in scores}) == 2
    assert min(r["score"] for r in scores if r["doc_id"] % 2) > max(r["score"] for r in scores if not r["doc_id"] % 2)


def test_a_long_word_has_terms_for_all_of_it():
    short, long = quality.terms("ab" * 32), quality.terms("ab" * 32 + "#?" * 500)
    assert long.sum() > 20 * short.sum()
    assert (quality.terms("x" * 64 + "A1") != quality.terms("x" * 64 + "b2")).any()
    words = quality._Shapes()
    assert words["x" * 64 + "A1"] != words["x" * 64]
