"""Ranks over ranges, and field-wise changes, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from larkdoc.operators import chunking, ranks, user_changes


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in several ranges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_ranks_and_sums(spark):
    data = [(random.Random(i).randrange(10**15), i % 7) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, n long").repartition(9)
    held = ranks.in_ranges(df, ["id"])
    assert len(held.before) > 1 and held.total == 3000
    order = sorted(data)
    assert {r["id"]: r["rank"] for r in held.numbered().collect()} == {i: k for k, (i, _) in enumerate(order, 1)}
    sums = {r["id"]: r["s"] for r in ranks.running_sums(df, ["id"], "n", "s").collect()}
    assert sums == {i: sum(n for _, n in order[:k]) for k, (i, _) in enumerate(order)}
    for offset, limit in ((0, 5), (1498, 20), (2990, 50), (5000, 5), (-3, 0)):
        page = sorted((r["place"], r["id"], r["total"]) for r in ranks.page_with_total(df, ["id"], offset, limit).collect())
        first, n = max(0, offset), max(1, limit)
        assert page == [(k, order[k - 1][0], 3000) for k in range(first + 1, min(first + n, 3000) + 1)]
    assert ranks.page_with_total(df.where("false"), ["id"], 0, 5).count() == 0
    assert ranks.running_sums(df.where("false"), ["id"], "n", "s").count() == 0


def test_chunks_of_sparse_ids_are_numbered(spark):
    random_ = random.Random(3)
    docs = [(random_.randrange(1 << 62), "word " * random_.randrange(1, 900)) for _ in range(200)]
    found = chunking.number_chunks(chunking.chunk_documents(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert [r["chunk_index"] for r in sorted(found, key=lambda r: (r["doc_id"], r["chunk_no"]))] == list(range(len(found)))


def plain_changes(users, changes):
    held, refused = {u: dict(f) for u, f in users.items()}, []
    for no, name, op, fields in sorted(changes):
        if name is None or op not in ("insert", "set", "delete") or (op == "insert") == (name in held):
            refused.append(no)
        elif op == "delete":
            del held[name]
        else:
            held.setdefault(name, {}).update({k: v for k, v in fields.items() if v is not None})
    return held, refused


def test_changes_apply_field_by_field(spark):
    random_ = random.Random(1)
    users = {f"u{i}": {"role": "user", "is_active": i % 2 == 0, "password_hash": f"h{i}"} for i in range(6)}
    changes = []
    for no in range(800):
        name = random_.choice([*(f"u{i}" for i in range(12)), "u1", "u1", "u1", None])
        fields = {f: random_.choice([None, v]) for f, v in (("role", random_.choice(["admin", "user"])), ("is_active", no % 3 == 0), ("password_hash", f"p{no}"))}
        changes.append((no, name, random_.choice(["insert", "set", "set", "delete", "drop", None]), fields))
    held = spark.createDataFrame([(f" {u.upper()} ", *f.values()) for u, f in users.items()], "username string, role string, is_active boolean, password_hash string")
    log = spark.createDataFrame([(no, u, op, *f.values()) for no, u, op, f in changes], "change_no long, username string, op string, role string, is_active boolean, password_hash string").repartition(5)
    rows, refused = user_changes.apply_user_changes(held, log)
    want, out = plain_changes(users, changes)
    assert {r["username"]: (r["role"], r["is_active"], r["password_hash"]) for r in rows.collect()} == {u: (f.get("role", "user"), f.get("is_active", True), f.get("password_hash")) for u, f in want.items()}
    assert sorted(r["change_no"] for r in refused.collect()) == out
    rows, refused = user_changes.apply_user_changes(held, log.where(F.lit(False)))
    assert rows.count() == 6 and refused.count() == 0


def test_names_are_found_in_blocks(spark, monkeypatch):
    from larkdoc.operators import aliases

    monkeypatch.setattr(aliases, "ALIASES", 7)
    monkeypatch.setattr(aliases, "QUESTIONS", 11)
    random_ = random.Random(5)
    spaces = [("u", 1), ("u", 1), ("u", 1), ("v", 2), (None, 3)]
    names = [(*random_.choice(spaces), i, "".join(random_.choice("ab ") for _ in range(random_.randrange(5)))) for i in range(80)]
    asked = [(q, *random_.choice(spaces), "".join(random_.choice("ab ") for _ in range(random_.randrange(30)))) for q in range(90)]
    want = {(q, i) for q, u, c, text in asked for v, d, i, alias in names if u is not None and (u, c) == (v, d) and alias and text and alias in text}
    held = spark.createDataFrame(names, "username string, chat_id long, upload_index int, alias string")
    questions = spark.createDataFrame(asked, "qid long, username string, chat_id long, folded string")
    assert {tuple(r) for r in aliases.named_in(questions, held).collect()} == want
    assert aliases.named_in(questions, held.where(F.lit(False))).count() == 0
