"""Near-duplicate classes against all pairs, where many texts share a passage without being linked."""

import random

import pytest

from larkdoc.llm import near_duplicates as nd


def classes(data):
    bags = {i: nd.shingles(t) for i, t in data}
    label = {i: i for i in bags}
    links = [(a, b) for a in bags for b in bags if a < b and nd.overlap(bags[a], bags[b]) >= 0.8]
    for _ in range(40):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return links, label


def with_passage(n, share, seed):
    """Texts of which a share is one passage, some of them in near copies and in chains of near copies, some with repeats."""
    random_ = random.Random(seed)
    passage = [f"p{i}" for i in range(100)]
    data = []
    for i in range(n):
        size = int(100 / share * random_.uniform(0.97, 1.03)) - 100
        own = [f"o{random_.randrange(10**6)}" for _ in range(size)]
        data.append(own[: size // 2] + passage + own[size // 2 :])
    for i in range(0, n, 7):  # a chain of texts, each a little off the one before
        words = list(data[i])
        for _ in range(3):
            words = list(words)
            words[random_.randrange(len(words))] = f"c{random_.randrange(10**6)}"
            data.append(words)
    data += [["again"] * k + passage[:20] for k in (100, 105, 90, 60)]
    return [(k, " ".join(w)) for k, w in enumerate(data)]


@pytest.mark.parametrize("share", [0.6, 0.86, 0.9])
def test_texts_that_share_a_passage(spark, share):
    data = with_passage(120, share, 3)
    links, label = classes(data)
    assert links
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == label


def test_a_large_bucket_makes_few_pairs(spark, monkeypatch):
    """Thousands of texts with one passage, none linked: what is compared grows with the texts, not with their pairs."""
    random_ = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    data = [(i, f"{passage} " + " ".join(f"o{random_.randrange(10**7)}" for _ in range(20))) for i in range(3000)]
    compared = []
    plain = nd.dealt
    monkeypatch.setattr(nd, "dealt", lambda pairs: compared.append(pairs.count()) or plain(pairs))
    found = nd.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert all(r["kept"] for r in found) and len(found) == 3000
    assert sum(compared) < 40 * 3000 and compared[1:] == [0, 0]


def family(n, seed=6):
    """Texts of 200 words with 8 of them swapped for one of 5 others each; as a rule no two are linked."""
    random_ = random.Random(seed)
    base, places = [f"w{i}" for i in range(200)], random.Random(1).sample(range(200), 8)
    return [(k, " ".join(f"v{i}-{random_.randrange(5)}" if i in places else w for i, w in enumerate(base))) for k in range(n)]


def test_a_family_of_variants_makes_few_pairs(spark, monkeypatch):
    plain, made = nd.dealt, {}
    for n in (400, 1600):
        compared = []
        monkeypatch.setattr(nd, "dealt", lambda pairs, compared=compared: compared.append(pairs.count()) or plain(pairs))
        data = family(n)
        found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
        assert n > 400 or found == classes(data)[1]
        made[n] = compared
    assert sum(made[1600]) < 6 * sum(made[400]), made


def test_sketches_lose_no_link():
    random_ = random.Random(2)
    for size in (1, 3, 60, 700, 30_000):
        for _ in range(8):
            words = [f"w{random_.randrange(size)}" for _ in range(size + 4)]
            other = list(words)
            for _ in range(random_.randrange(max(1, size // 20) + 1)):
                other[random_.randrange(len(other))] = f"x{random_.randrange(10**6)}"
            other = other[: len(other) - random_.randrange(max(1, size // 8))]
            bags = [nd.shingles(" ".join(w)) for w in (words, other)]
            tokens = [nd.tokens_of(b) for b in bags]
            sketches = [[nd.np.frombuffer(nd.parity_sketch(t), nd.np.uint64)] for t in tokens]
            differ = len(set(tokens[0].tolist()) ^ set(tokens[1].tolist()))
            possible = nd.may_overlap(*sketches, nd.np.array([0]), nd.np.array([0]), nd.np.array([sum(map(len, tokens))]), 0.8)[0]
            assert possible or nd.overlap(*bags) < 0.8
            if differ <= nd.most_differences(nd.np.array([sum(map(len, tokens))]), 0.8)[0]:
                assert possible


def test_rare_shingles_meet_all_links(spark):
    random_ = random.Random(9)
    data = []
    for i in range(80):
        words = [f"w{random_.randrange(4)}" for _ in range(random_.randrange(1, 60))]
        data.append((2 * i, " ".join(words)))
        if words and random_.random() < 0.7:
            words.insert(random_.randrange(len(words)), "x")
        data.append((2 * i + 1, " ".join(words[: max(1, len(words) - random_.randrange(3))])))
    links, _ = classes(data)
    assert len(links) > 20
    rare = nd.rare_shingles(spark.createDataFrame(data, "doc_id long, text string"), 0.8)
    joined = rare.alias("a").join(rare.alias("b"), "token").where("a.doc_id < b.doc_id").where(nd._may_link(0.8, "a", "b"))
    met = {(r["a"], r["b"]) for r in joined.selectExpr("a.doc_id as a", "b.doc_id as b").distinct().collect()}
    assert set(links) <= met


def test_busy_ids_are_dealt(spark):
    pairs = spark.range(3000).selectExpr("7L as a", "id as b").unionByName(spark.createDataFrame([(8, 1)], "a long, b long"))
    found = nd.dealt(pairs).groupBy("a", "part").count().collect()
    assert sum(r["count"] for r in found) == 3001
    assert len([r for r in found if r["a"] == 7]) == 6 and max(r["count"] for r in found) < 1000
