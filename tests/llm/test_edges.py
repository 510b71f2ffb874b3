"""Every operator on nulls, empty and very long texts, ties, repeated rows, no rows, and extra columns."""

import pytest
from pyspark.sql import functions as F

from larkdoc.llm import chat, embeddings, fingerprints, near_duplicates, packing, pieces, quality, secrets, substrings, toxicity

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_words int, bands string, spans string, fingerprint string, score int, same int, label int, range int"
LONG = "lorem ipsum dolor " * 40_000


def rows(spark, *pairs):
    return spark.createDataFrame([(i, t, 1, "b", "s", "f", 2, 3, 4, 5) for i, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null text, empty text, one very long text, a repeated row, a repeated id with another text."""
    return rows(spark, (None, "no id here"), (1, None), (2, ""), (3, LONG), (4, "twice the same"), (4, "twice the same"), (5, "one"), (5, "other")).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None), (3, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")


def apply_all(docs, labels):
    bpe, sp = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    return {
        "fingerprints": fingerprints.document_fingerprints(docs),
        "edited": fingerprints.edited_fingerprints(docs),
        "near": near_duplicates.near_duplicates(docs),
        "secrets": secrets.scan_secrets(docs),
        "substrings": substrings.dedup_substrings(docs),
        "quality": quality.quality_scores(docs, labels),
        "toxicity": toxicity.toxicity_scores(docs, labels),
        "pieces": pieces.decode_pieces(pieces.encode_pieces(docs, sp), sp),
    }, packing.pack(docs, bpe)


def test_one_row_for_each_row(spark, odd, labels):
    found, packed = apply_all(odd, labels)
    for name, df in found.items():
        got = sorted((r["doc_id"] is not None, r["doc_id"]) for r in df.select("doc_id").collect())
        assert got == sorted((i is not None, i) for i in (None, 1, 2, 3, 4, 4, 5, 5)), name
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id = 1").first()["n"] == 1


def test_no_rows(spark, odd, labels):
    found, packed = apply_all(odd.where("false"), labels.where("false"))
    for name, df in found.items():
        assert df.count() == 0, name
    assert packed.count() == 0


def test_defined_results(spark, odd, labels):
    near = {(r["doc_id"], r["class_id"], r["kept"]) for r in near_duplicates.near_duplicates(odd).collect()}
    assert near == {(None, None, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)}
    without = quality.quality_scores(odd, labels.where("false")).select("score").distinct().collect()
    assert [r["score"] for r in without] == [0.5]
    assert {r["score"] for r in toxicity.toxicity_scores(odd, labels.where("false")).collect()} == {0.5}
    assert all(r["near_next"] == 1.0 for r in fingerprints.edited_fingerprints(rows(spark, (7, "alone in here"))).collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages(spark, tmp_path):
    """Each stage on nulls, an empty and a giant text, repeated ids, more columns, and no rows."""
    import corpus_pipeline

    long = "lorem ipsum dolor " * 5000 + "x" * 1_500_000
    data = [(None, "no id here", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (4, "twice the same", "en", "s", 14), (4, "twice the same", "en", "s", 14), (5, "token = 0123456789abcdef0123", "en", None, 28)]
    docs = spark.createDataFrame(data, COLUMNS).withColumns({c: F.lit(1) for c in ("score", "same", "kept", "removed", "spans")}).cache()
    spark.createDataFrame([(5, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = sorted((i or 0) for i, *_ in data)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = found.collect()
        got = sorted({r["doc_id"] or 0 for r in rows})
        assert got == sorted(set(ids)) if name in ("substring_dedup", "secrets", "packing") else set(got) <= set(ids), name
        if name == "near_dedup":  # the null and the empty text are one class; a row without an id stays
            assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 3, 4, 4, 5]
        if name == "secrets":
            assert not any("0123456789abcdef" in (r["text"] or "") for r in rows)
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_redacting_odd_rows(spark, odd):
    found = secrets.redact_secrets(odd)
    assert sorted((r["doc_id"] or 0) for r in found.collect()) == [0, 1, 2, 3, 4, 4, 5, 5]
    assert secrets.redact_secrets(odd.where("false")).count() == 0


def test_a_giant_word(spark):
    giant = "y" * 3_000_000
    docs = rows(spark, (1, f"a {giant} b"), (2, f"a {giant} b"), (3, giant))
    assert {(r["doc_id"], r["class_id"]) for r in near_duplicates.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    bpe, sp = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    short = rows(spark, (1, "ab" * 150_000))
    assert packing.pack(short, bpe).agg(F.sum("length")).first()[0] == packing.pack(short, bpe).first()["doc_tokens"]
    assert pieces.decode_pieces(pieces.encode_pieces(short, sp), sp).first()["text"] == "ab" * 150_000


def test_one_id_for_all_rows(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "cast(id as string) as text")
    assert fingerprints.edited_fingerprints(docs).count() == 3000


def test_chats(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns int"
    turns = spark.createDataFrame([(None, 0, "user", "a", 9), (1, None, None, None, 9), (1, 1, "user", "x", 9), (1, 1, "user", "x", 9), (2, 0, "tool", LONG, 9)], schema)
    found = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert {k: (r["n_turns"], r["refused_turn"]) for k, r in found.items()} == {None: (1, 1), 1: (3, 0), 2: (1, 0)}
    assert chat.INSTRUCTION_TEMPLATE.parsed(found[2]["formatted"]) == [("tool", LONG)]
    assert chat.read_back(chat.format_chats(turns.where("false"))).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [1.0, 0.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [nan, 1.0], "x"), (7, [inf, 1.0], "x"), (8, [1.0, None], "x"), (9, [1.0], "x"), (13, [1.0, 0.0, 0.0], "x"), (14, [2.0, 0.0, 0.0], "x"), (15, [1.0] * 4, "x"), (16, [1.0] * 4, "x"), (None, [1.0, 0.0], "x"), (10, [0.0, 1.0], "x"), (11, [1e-200, 0.0], "x"), (12, [], "x")]
    for kind in ("double", "float"):
        df = spark.createDataFrame(data if kind == "double" else [r for r in data if r[0] != 11], f"vec_id long, embedding array<{kind}>, rep string")
        found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
        linked = (1, 2, 3, 11) if kind == "double" else (1, 2, 3)
        for i in linked:
            assert found[i] == (len(linked) - 1, 1, i == 1)
        assert all(found[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12))
        assert found[None] == (0, None, True)
        assert [found[i] for i in (13, 14, 15, 16)] == [(1, 13, True), (1, 13, False), (1, 15, True), (1, 15, False)]
        assert embeddings.near_vectors(df.where("false")).count() == 0


def test_vectors_that_share_an_id(spark):
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0])]
    found = lambda rows: sorted(tuple(r) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found(data) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]
    assert found([*data, (3, [0.01, 1.0])]) == [(1, 0, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    for data in ([(5, a), (5, b), (9, b + " more")], [(5, b), (5, a), (9, b + " more")]):
        found = sorted(tuple(r)[:3] for r in near_duplicates.near_duplicates(rows(spark, *data).coalesce(1)).collect())
        assert found == [(5, 5, True), (5, 5, True), (9, 5, False)]


def test_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    import corpus_pipeline

    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((1, a), (5, a), (5, b))], COLUMNS)
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (5, b)]
    good, bad = [f"The river carried {w} past the old mill and the miller watched it go." for w in ("boats", "logs", "leaves", "swans")], ["!!! $$$ ### 123 ~~~", "zzz zzz zzz zzz", "@@@@ 99 %% 99", "kkk ## kkk ##"]
    texts = [(i, t) for i, t in enumerate((good + bad) * 5)] + [(1000, good[0]), (1000, bad[0])]
    spark.createDataFrame([(i, int(t in good), 0) for i, t in texts if i < 1000], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], COLUMNS)
    kept = [r["text"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect() if r["doc_id"] == 1000]
    assert kept == [good[0]]


def test_training_rows_of_shared_ids_are_the_same_in_any_order(spark):
    data = [(i % 7, f"text {i * 13 % 29} words {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    scored = [sorted((r["doc_id"], r["text_hash"], round(r["score"], 8)) for r in quality.quality_scores(rows(spark, *d), labels).collect()) for d in (data, data[::-1])]
    assert scored[0] == scored[1]
