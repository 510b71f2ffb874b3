"""Operators against plain versions of themselves, against libraries, and on held-out labels."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkdoc.llm import chat, embeddings, fingerprints, near_duplicates, packing, pieces, quality, queries, secrets, substrings, toxicity
from larkdoc.llm.common import components

P = pytest.importorskip("public_tokenizers")


def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- 1 ---


@given(st.lists(st.text(alphabet="abc de\n", max_size=30), max_size=6), st.text(alphabet="abcd", min_size=1, max_size=20))
def test_fingerprints_are_homomorphic(paragraphs, more):
    whole = "\n".join(paragraphs)
    with_more = fingerprints.fingerprint(f"{whole}\n{more}")
    assert with_more == fingerprints.combined(fingerprints.fingerprint(whole), fingerprints.fingerprint(more))
    assert fingerprints.fingerprint(whole) == fingerprints.combined(with_more, fingerprints.fingerprint(more), -1)
    assert fingerprints.fingerprint("\n".join(reversed(whole.split("\n")))) == fingerprints.fingerprint(whole)


def test_edited_fingerprints(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ids = sorted(docs)
    found = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}
    better = 0

    def windows(text):
        """Signed counts by plain loops over the bytes of each paragraph."""
        lanes, mask = [0] * fingerprints.NEAR_LANES, (1 << 64) - 1
        for part in text.encode().split(b"\n"):
            for at in range(len(part)):
                x = int.from_bytes(part[at : at + fingerprints.WINDOW], "little") * 0x9E3779B97F4A7C15 & mask
                key = ((x ^ x >> 29) * 0xC2B2AE3D27D4EB4F & mask) >> 32
                lanes[key % (2 * len(lanes)) // 2] += 1 - 2 * (key % 2)
        return np.array(lanes, float)

    def alike(a, b):
        if sorted(p for p in a.split("\n") if p) == sorted(p for p in b.split("\n") if p):
            return 1.0
        x, y = windows(a), windows(b)
        size = np.sqrt((x @ x) * (y @ y))
        return min(1.0, max(0.0, x @ y / size)) if size else 0.0

    for k, i in enumerate(ids):
        text, following = docs[i], docs[ids[(k + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["n_chars"] == len(text)
        if len(text) < 3000:
            assert found[i]["near_edited"] == pytest.approx(alike(text, edited)) and found[i]["near_next"] == pytest.approx(alike(text, following))
        better += found[i]["near_edited"] > found[i]["near_next"]
    assert better > 0.97 * len(ids)


# --- 2 ---


def test_bag_minhash_is_unbiased():
    random_ = np.random.default_rng(2)
    keys = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = keys[:50], random_.integers(1, 12, 50)
    second = keys[8:], np.maximum(1, np.concatenate([first[1][8:] + random_.integers(-3, 4, 42), np.full(10, 2)]))
    signatures = near_duplicates.bag_minhash([first, second], 8000)
    assert abs((signatures[0] == signatures[1]).mean() - near_duplicates.overlap(first, second)) < 0.02


def test_a_hub_of_near_copies_is_one_class(spark):
    """Copies that are only near the hub, not near each other, and a bucket larger than any that is compared pair by pair."""
    random_ = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    data = [(1000, " ".join(base))]
    for i in range(60):
        words = list(base)
        for at in random_.sample(range(0, 120, 6), 2):
            words[at] = f"x{i}_{at}"
        data.append((i, " ".join(words)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    bags = {i: near_duplicates.shingles(t) for i, t in data}
    links = [(a, b) for a in bags for b in bags if a < b and near_duplicates.overlap(bags[a], bags[b]) >= 0.8]
    assert any(b == 1000 for _, b in links)
    label = {i: i for i in bags}
    for _ in bags:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(df).collect()} == label


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: c for x, c in label.items() if any(a != b and x in (a, b) for a, b in pairs)}


# --- 3 ---

PARTS = ["password", "passwd", "SECRET", "token", "api_key", "apikey", "'", '"', " ", ":", "=", "AKIA", "ABCDEF123", "0123456789abcdef", "deadbeef", "é", "_", ".", "-", "zz", "\n", "abcdefghijkl", "ghp_", "A" * 36, "xoxb-", "eyJ"]
RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def test_secrets_match_plain_patterns():
    scan, random_ = secrets.scanner(secrets.BASE_RULES + secrets.MORE_RULES).spans, random.Random(1)
    for _ in range(4000):
        text = "".join(random_.choice(PARTS) for _ in range(random_.randint(0, 14)))
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, pattern, group, least) in enumerate(RULES) for m in pattern.finditer(text) if len(m[group]) >= least)
        assert [s for s in scan(text) if s[0] in ("assign", "access", "hex")] == [(kind, a, b) for a, _, kind, b in want], text


def test_redaction():
    text = 'a token = "0123456789abcdef0123" b'
    spans = secrets.scanner(secrets.BASE_RULES).spans(text)
    assert secrets.redacted(text, spans, "*") == 'a *" b'


# --- 4 ---


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(1, 90))
def test_closest_multiset_is_closest(counts, target):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    found = packing.closest_multiset(counts, target)
    assert all(n <= counts[x] for x, n in found.items())
    assert sum(x * n for x, n in found.items()) == max(s for s in sums if s <= target)


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in documents(spark, sf_dir).items()}
    pieces_of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op4_packing(spark, sf_dir).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
        pieces_of[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for found, wanted in ((pieces_of, {i: len(x) for i, x in ids.items()}), (sequences, None)):
        for k, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == wanted[k] if wanted else at <= 1024 and at & (at - 1) == 0


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|>", "<|endoftext", "no such token", "字 <|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.pack(docs.coalesce(1), path, end_id=7).orderBy("doc_id", "start").collect()
    for i, text in enumerate(texts):
        ids = np.frombuffer(b"".join(r["ids"] for r in found if r["doc_id"] == i), "<u4").tolist()
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 7]


# --- 5 ---


def test_windows_are_told_apart_by_both_hashes(spark, monkeypatch):
    """With a first hash that knows few values, windows that only it confuses aren't removed."""
    random_ = random.Random(8)
    shared = [f"s{i}" for i in range(60)]
    data = [(i, " ".join([f"a{random_.random()}" for _ in range(30)] + shared[:49] + [f"b{random_.random()}" for _ in range(30)])) for i in range(6)]
    data.append((9, " ".join(shared)))
    plain = substrings.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert all(not r["removed"] for r in plain)
    first = substrings.rolling.windows(np.arange(200, dtype=np.uint64) * np.uint64(977), 50)
    second = substrings.rolling.windows(np.arange(200, dtype=np.uint64) * np.uint64(977), 50, "check")
    assert not set(first.tolist()) & set(second.tolist()) and len(set(second.tolist())) == 151


def test_substrings(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    data = [(1, f"a b {passage} c"), (2, f"{passage}\n\tz"), (3, passage), (4, f"x {passage[:-4]} y"), (5, f"{passage} {passage}"), (None, passage), (3, passage)]
    found = [(r["doc_id"], r["text"], [(x["start"], x["end"]) for x in r["removed"]]) for r in substrings.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(1, data[0][1], []), (2, "z", [(0, 50)]), (3, "", [(0, 50)]), (3, "", [(0, 50)]), (4, data[3][1], []), (5, "", [(0, 100)]), (None, passage, [])], key=str)


# --- 6 ---


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "<s>"]), st.text(alphabet="ab\\<>[]/INSTs| SY\n", max_size=25)), min_size=1, max_size=6))
def test_chats_read_back(turns):
    template = chat.INSTRUCTION_TEMPLATE
    segments, _ = template.segments(turns)
    assert template.parsed("".join(t for t, _ in segments)) == turns
    assert [template.unescaped(t) for t, loss in segments if loss] == [t for role, t in turns if role == "assistant"]
    assert not any(c in template.escaped(text) for _, text in turns for c in template.controls)


# --- 7, 9 ---


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality", "quality", 0.98), ("op9_toxicity", "toxic", 0.85)])
def test_held_out_labels(spark, name, label, least):
    import os

    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("the tables are not here")
    scores = queries.queries()[name](spark, sf_dir).where("held_out")
    rows = scores.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("score", label).collect()
    yes, no = ([r["score"] for r in rows if r[label] == v] for v in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
    assert area >= least


TEXTS = ["kind words about the sea", "CLICK !!! BUY now", "the the the the", "x1 | y2 | z3", "", "eine ruhige Nacht am Meer", "AAA 111 !!! $$$", "soft rain, and then sun"]


def test_quality_is_a_plain_vote(spark):
    """The same scores from dense matrices: weighted terms, singular axes, all cosines, the nearest by a full sort."""
    docs = [(i, TEXTS[i % 8] + (f" w{i % 5}" if i % 8 != 4 else "")) for i in range(160)]
    labels = {i: int(i % 8 not in (1, 6)) for i, _ in docs}
    learnt = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5]
    counts = {i: quality.terms(t) for i, t in docs}
    raw = np.stack([counts[i] for i in learnt]).astype(float)
    idf = np.log((1 + len(learnt)) / (1 + (raw > 0).sum(0))) + 0.1

    def unit(x):
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(size > 1e-6, x / np.maximum(size, 1e-6), 0)

    _, _, axes = np.linalg.svd(unit(np.log1p(raw) * idf), full_matrices=False)
    axes = axes[: quality.DIMENSIONS]
    space = unit(unit(np.log1p(raw) * idf) @ axes.T)
    frame = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    for r in quality.quality_scores(*frame).collect():
        own = unit(unit(np.log1p(counts[r["doc_id"]].astype(float))[None] * idf) @ axes.T)[0]
        cosines = space @ own
        near = np.argsort(-cosines)[: quality.NEIGHBOURS]
        if cosines[near[-1]] - np.sort(-cosines)[quality.NEIGHBOURS] * -1 < 1e-4 and len({labels[learnt[k]] for k in np.flatnonzero(np.abs(cosines - cosines[near[-1]]) < 1e-4)}) > 1:
            continue  # neighbours at one distance with both labels: any of them may vote
        weight = np.maximum(cosines[near], 0) ** 4
        want = (weight * [labels[learnt[k]] for k in near]).sum() / weight.sum() if weight.sum() > 0 else np.mean([labels[k] for k in learnt])
        assert r["score"] == pytest.approx(want, abs=2e-3), r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_words_count_in_quality():
    assert (quality.terms("soft rain") != quality.terms("hard luck")).any()
    assert (quality.terms("Soft Rain")[quality.FORMS :] == quality.terms("soft rain")[quality.FORMS :]).all()


def test_toxicity_is_a_softmax_of_averages():
    """The additive margins give the softmax of the averaged vectors, by plain loops; training fits what it is shown."""
    texts = ["you are an idiot", "what a lovely day", "idiots all of you", "lovely flowers here", "such an idiot", "a day of flowers", "idiotic stuff", "lovely stuff", "idiot idiot", "day of days"]
    labels = np.array([1, 0] * 5)
    model = toxicity.SubwordModel().fit([toxicity.bag(t) for t in texts], labels)
    margins, weights, bias = model.margins()
    words = toxicity._Words(margins, weights)
    for text, label in zip([*texts, "an idi0t", "", "zzz qqq"], [*labels, None, None, None], strict=True):
        total = sum(map(words.__getitem__, toxicity._WORDS.findall(text.lower())), 0j)
        logit = (total.real / total.imag if total.imag > 0 else 0.0) + bias
        hidden, size = np.zeros(toxicity.DIMENSIONS), 0.0
        for word in re.findall(r"\w+", text.lower()):
            marked = f"<{word}>"
            for gram in [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]:
                bucket = zlib.crc32(gram.encode()) % toxicity.BUCKETS
                hidden, size = hidden + model.vectors[bucket] * model.weights[bucket], size + model.weights[bucket]
        logits = (hidden / size if size else hidden) @ model.layer + model.bias
        assert 1 / (1 + np.exp(-logit)) == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum(), abs=1e-4)
        assert label is None or (logit > 0) == bool(label)


# --- 8 ---


def test_vectors_have_all_links(spark):
    random_ = np.random.default_rng(6)
    x = random_.standard_normal((600, 24))
    x[300:] = x[:300] + random_.standard_normal((300, 24)) * random_.uniform(0.02, 0.6, (300, 1))
    x[:40] = x[0] + random_.standard_normal((40, 24)) * 0.3
    x[590:] = x[580]
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}
    got = np.array([found[i]["n_links"] for i in range(600)])
    assert (got <= near.sum(1)).all() and got.sum() >= 0.97 * near.sum()


# --- 10 ---


@given(st.text(alphabet=st.sampled_from(list("abeint  \n\t!()=/.,世é́🙂")), max_size=40))
@settings(deadline=None)
def test_pieces_equal_the_library(text):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = pieces.load_pieces(path)
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == model.encode(text)
    assert own.decode(ids) == text


@given(st.text(alphabet="abc ", min_size=1, max_size=9))
def test_unigram_pieces_have_the_best_score(text):
    names = ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "ca", "▁ab"]
    scores = [-3.0, -2.1, -2.2, -2.3, -3.05, -2.9, -4.2, -5.5, -4.15, -5.9]
    own = pieces.Pieces(dict(enumerate(names, 1)), dict(enumerate(scores, 1)), [], "unigram")

    def best(rest):
        return max((scores[k] + best(rest[len(n) :]) for k, n in enumerate(names) if rest.startswith(n)), default=0.0 if not rest else -1e9)

    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert "".join(names[i - 1] for i in ids) == "▁" + text.replace(" ", "▁")
    assert sum(scores[i - 1] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))


def test_pieces_on_documents(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = documents(spark, sf_dir)
    for r in queries.op10_sentencepiece(spark, sf_dir).collect():
        ids = model.encode(docs[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


# --- pipeline ---


def test_pipeline_is_its_operators_one_after_another(spark, sf_dir):
    import corpus_pipeline

    from larkdoc.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = documents(spark, sf_dir)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        seen.append((name, {r["doc_id"] for r in docs.select("doc_id").collect()}))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rejected = {r["doc_id"] for r in queries.op7_quality(spark, sf_dir).where("predicted = 0").collect()}
    assert seen[0][1] == set(texts) - rejected
    kept = {i: texts[i] for i in seen[1][1]}
    bags = {i: near_duplicates.shingles(texts[i]) for i in seen[0][1]}
    assert not any(near_duplicates.overlap(bags[a], bags[b]) >= 0.8 for a in kept for b in kept if a < b)
    assert all(any(near_duplicates.overlap(bags[a], bags[b]) >= 0.8 for b in bags if b < a) for a in seen[0][1] - set(kept))
    assert seen[-1][1] == seen[3][1] == seen[2][1] <= seen[1][1]
