"""Sequential and text operators against plain Python models of them."""

import io
import os
import pathlib
import re
import unicodedata
import zipfile
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkdoc.functions import rules, text
from larkdoc.operators import answers, chunking, outline, vectors, workspace
from larkdoc.sources import extract
from larkdoc.sources.index import ChunkIndex
from larkdoc.streaming import state, streams

# --- chunking ---


@given(st.text(alphabet="ab \n.", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_chunks_cover_the_text(body, size, overlap):
    chunks = list(chunking.with_starts(body, size, overlap)) if body.strip() else []
    covered = set()
    for start, chunk in chunks:
        assert len(chunk) <= size and body[start : start + len(chunk)] == chunk
        covered |= set(range(start, start + len(chunk)))
    assert all(c.isspace() or i in covered for i, c in enumerate(body)) or overlap > 0


def plain_chunks(body, lo, hi, size, overlap, separators):
    """The splitter by places in the text instead of pieces of it."""
    separator, rest = next((s, separators[i + 1 :]) for i, s in enumerate(separators) if s in body[lo:hi])
    cuts, at = [lo], body.find(separator, lo, hi) if separator else hi
    while separator and at >= 0:
        cuts.append(at)
        at = body.find(separator, at + len(separator), hi)
    cuts = [*range(lo, hi)] if not separator else cuts
    spans = [(a, b) for a, b in zip(cuts, [*cuts[1:], hi]) if a < b]
    runs, out = [[]], []
    for span in spans:
        if span[1] - span[0] < size:
            runs[-1].append(span)
        else:
            runs += [span, []]
    for run in runs:
        if isinstance(run, tuple):
            out += plain_chunks(body, *run, size, overlap, rest) if rest else [body[run[0] : run[1]]]
            continue
        first = last = 0
        while last < len(run):
            last = first
            while last < len(run) and run[last][1] - run[first][0] <= size:
                last += 1
            if said := body[run[first][0] : run[last - 1][1]].strip():
                out.append(said)
            if last < len(run):
                while first < last and (run[last - 1][1] - run[first][0] > overlap or run[last][1] - run[first][0] > size):
                    first += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(2, 12), st.integers(0, 5))
def test_chunks_are_the_plain_splitters(body, size, overlap):
    overlap = min(overlap, size - 1)
    assert list(chunking.split_text(body, size, overlap)) == plain_chunks(body, 0, len(body), size, overlap, chunking.SEPARATORS)


def test_all_documents_are_cut_like_the_plain_splitters(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {}
    for r in docs.where("text is not null").collect():
        cut = plain_chunks(r["text"], 0, len(r["text"]), rules.CHUNK_SIZE, rules.CHUNK_OVERLAP, chunking.SEPARATORS)
        want |= {(r["doc_id"], i): c for i, c in enumerate(cut)}
    got = {(r["doc_id"], r["chunk_no"]): r["text"] for r in chunking.chunk_documents(docs).collect()}
    assert got == want


def test_chunk_numbers(spark):
    docs = spark.createDataFrame([(5, "a"), (9000, "word " * 700), (2, " x "), (3, " \n ")], "doc_id long, text string")
    found = chunking.number_chunks(chunking.chunk_documents(docs)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in found] == list(range(len(found)))
    assert [(r["doc_id"], r["chunk_no"]) for r in found] == sorted((r["doc_id"], r["chunk_no"]) for r in found)
    assert found[0]["start_index"] == 1 and len(found) == 2 + len(list(chunking.split_text("word " * 700)))


# --- text ---


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aÉßđ²_9 .-́\t \nTÓM", max_size=20), min_size=1, max_size=20))
def test_tokens_and_strips_are_pythons(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.tokens(F.col("t")).alias("w"), text.strip(F.col("t")).alias("s"), text.normalize_ws(F.col("t")).alias("n"), text.fold_text("t").alias("f")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        assert r["w"] == [w.lower() for w in re.findall(r"\w+", t)]
        assert (r["s"], r["n"]) == (t.strip(), " ".join(t.split()))
        folded = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower()
        assert r["f"] == re.sub(r"[^a-z0-9]+", " ", folded).strip()


def test_questions(spark):
    asked = ["Tóm tắt", "define X", "plain question", "MAIN points", "biểu đồ doanh thu", "how should we compare a very long plan; and what about the second part of it?"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    got = df.select("i", text.rewrite_question(F.col("q")).alias("r"), text.effective_top_k(F.col("q")).alias("k"), text.split_question(F.col("q")).alias("s"), text.focus_terms(F.col("q")).alias("f")).orderBy("i").collect()
    assert got[0]["r"] == rules.REWRITES[4][1] and got[1]["r"] == rules.REWRITES[6][1] and got[2]["r"] == "plain question"
    assert got[3]["r"] == rules.REWRITES[0][1] and got[4]["r"] == rules.REWRITES[15][1]
    assert [r["k"] for r in got] == [6, 6, 6, 6, 6, 8]
    assert got[5]["s"] == ["how should we compare a very long plan", "and what about the second part of it"]
    assert got[5]["f"] == ["should", "compare", "very", "long", "plan", "second", "part"]


def test_sources_round_trip(spark):
    row = spark.range(1).select(text.attach_sources(F.lit("answer"), F.array(*map(F.lit, (" a.txt ", "b", "a.txt", "")))).alias("m")).select("m", text.extract_sources(F.col("m")).alias("x")).first()
    assert row["m"].startswith("answer\n\n<!--") and (row["x"]["text"], row["x"]["sources"]) == ("answer", ["a.txt", "b"])
    bad = spark.range(1).select(text.extract_sources(F.lit("t <!--larkdoc:sources:!!!-->")).alias("x")).first()["x"]
    assert bad["sources"] == []


def test_names(spark):
    path = "/d/" + "0" * 32 + "_my file.txt"
    row = spark.range(1).select(text.source_ref(F.lit(path), F.lit(3), F.lit(None).cast("int")).alias("r"), text.document_aliases(F.lit("Annual Report for 2024.docx")).alias("a"), text.is_fallback(F.lit(f" {rules.FALLBACK_ANSWER}. ")).alias("b")).first()
    assert row["r"] == "my file.txt (trang 3)" and row["b"]
    assert row["a"] == ["annual report for 2024 docx", "annual report for 2024", "report for 2024"]


# --- vectors ---


def test_hash_embedding_and_neighbours(spark, tmp_path):
    import hashlib

    want = [b / 255 for c in range(8) for b in hashlib.sha256(f"héllo{c}".encode()).digest()]
    assert spark.range(1).select(text_vector().alias("v")).first()["v"] == want
    random = np.random.default_rng(1)
    x = random.standard_normal((200, 8)).round(1)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    asked = df.where("vec_id < 5").select(F.col("vec_id").alias("qid"), "embedding")
    found = {(r["qid"], r["rank"]): r["vec_id"] for r in vectors.knn_l2(asked, df, 4, {"label": 1}).collect()}
    x32 = x.astype(np.float32).astype(float)
    for q in range(5):
        order = sorted((((x32[q] - x32[i]) ** 2).sum(), i) for i in range(200) if i % 3 == 1)[:4]
        assert [found[q, k + 1] for k in range(4)] == [i for _, i in order]
    index = ChunkIndex(spark, f"{tmp_path}/index")
    assert index.count() == 0 and index.append(df) == 200 and index.delete({"label": [1]}) == 67 and index.count() == 133
    assert index.backup(f"{tmp_path}/b", "20240101T000000Z").first()["document_count"] == 133
    index.clear()
    assert index.count() == 0 and index.restore_latest(f"{tmp_path}/b").first()["document_count"] == 133
    assert not index.restore_latest(f"{tmp_path}/none").first()["restored"]


def test_index_changes_write_only_what_changes(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/index")
    rows = lambda ids, **more: spark.createDataFrame([(i, [float(i), 1.0], "even" if i % 2 == 0 else "odd") for i in ids], "id long, embedding array<double>, label string").withColumns({k: F.lit(v) for k, v in more.items()})
    assert index.append(rows(range(10))) == 10 and index.append(rows([21, 23], lang="en")) == 2
    first, second = index.parts()
    assert index.delete({"label": "even"}) == 5 and index.parts()[0] == second and first not in index.parts() and len(index.parts()) == 2
    assert {(r["id"], r["lang"]) for r in index.read().collect()} == {(i, None) for i in (1, 3, 5, 7, 9)} | {(21, "en"), (23, "en")}
    assert index.delete({"label": "none"}) == 0 and index.count() == 7 and index.read("version=0000000001").count() == 10
    narrow = rows([31]).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert index.append(narrow) == 1 and index.count() == 8 and len(index.parts()) == 1
    assert index.append(rows([])) == 0 and index.count() == 8
    with pytest.raises(ValueError):
        index.append(spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"))
    index.append(rows([40]))
    index.compact()
    assert len(index.parts()) == 1 and index.count() == 9


def text_vector():
    return vectors.hash_embedding(F.lit("héllo"))


def test_missing_metadata_is_none(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, owner string")
    assert [r["id"] for r in vectors.metadata_filter(df, {"owner": "None"}).collect()] == [1]
    assert vectors.metadata_filter(df, {"nothing": "None"}).count() == 2


# --- state ---

TIMES = st.lists(st.floats(0, 100, allow_nan=False), max_size=30).map(sorted)


@given(TIMES, st.integers(0, 3), st.floats(1, 50))
def test_rate_limit_model(times, limit, window):
    accepted = []
    for (ok, retry), now in zip(state.limit_events(times, limit, window, deque()), times, strict=True):
        recent = [t for t in accepted if t > now - window]
        assert ok == (limit <= 0 or len(recent) < limit)
        if ok:
            accepted.append(now)
        else:
            assert retry == max(1, int(recent[0] + window - now))


def events(spark, n=60):
    rows = [(i, i % 4, datetime(2024, 1, 1) + timedelta(seconds=7 * i + (i * i) % 11)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, key long, ts timestamp")


def test_rate_limit_stream_is_the_batch(spark, tmp_path):
    whole = events(spark)
    for k, part in enumerate((whole.where("event_id < 30"), whole.where("event_id >= 30"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    query = state.rate_limit_stream(source, 3, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in state.rate_limit(whole, 3, 60.0).collect()}
    assert {tuple(r) for r in spark.sql("select event_id, allowed, retry_after from limited").collect()} == want and len(want) == 60


def streamed(spark, tmp_path, whole, apply, name):
    """What ``apply`` gives over a stream of ``whole`` in two parts, by ``n``."""
    for k, part in enumerate((whole.where("n < 20"), whole.where("n >= 20"))):
        part.drop("n").coalesce(1).write.parquet(f"{tmp_path}/{name}/part={k}")
    source = spark.readStream.schema(whole.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/part=*")
    query = apply(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return {tuple(r) for r in spark.sql(f"select * from {name}").collect()}


def test_state_streams_are_the_batches(spark, tmp_path):
    rows = [(i, i % 3, float(i * 37), i % 2 == 0, i % 5 == 0, i) for i in range(40)]
    said = spark.createDataFrame(rows, "message_id long, chat_id long, at double, ambiguous boolean, selects boolean, n int")
    assert streamed(spark, tmp_path, said, lambda s: state.pending_scopes_stream(s, 120.0), "pending") == {tuple(r) for r in state.pending_scopes(said, 120.0).collect()}
    asked = spark.createDataFrame([(i, i % 4, float(i * 50), i) for i in range(40)], "ask_id long, key long, at double, n int")
    assert streamed(spark, tmp_path, asked, lambda s: state.answer_memo_stream(s, 500.0), "memo") == {tuple(r) for r in state.answer_memo(asked, 500.0).collect()}


def test_state_ends_with_its_window(spark, tmp_path):
    rows = [(i, i, float(i % 20 + i // 20 * 100_000), i) for i in range(40)]
    asked = spark.createDataFrame(rows, "ask_id long, key long, at double, n int")
    for k, part in enumerate((asked.where("n < 20"), asked.where("n >= 20"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    source = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    timed = source.select(F.col("ask_id").alias("event_id"), "key", F.timestamp_seconds("at").alias("ts"))
    said = source.select(F.col("ask_id").alias("message_id"), F.col("key").alias("chat_id"), "at", F.lit(True).alias("ambiguous"), F.lit(False).alias("selects"))
    for name, stream in (("limits", state.rate_limit_stream(timed, 3, 60.0)), ("memos", state.answer_memo_stream(source, 500.0)), ("replies", state.pending_scopes_stream(said, 120.0))):
        query = stream.writeStream.format("memory").queryName(f"ended_{name}").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(f"ended_{name}").count() == 40 and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 20


def test_daily_counts_stream_is_the_batch(spark, tmp_path):
    whole = events(spark, 200).withColumn("ts", F.expr("ts + make_dt_interval(0, event_id * 2)"))
    whole.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in")
    query = streams.daily_counts(source).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in whole.groupBy(F.to_date("ts")).count().collect()}
    assert {tuple(r) for r in spark.sql("select day, n from daily").collect()} == want


def test_job_snapshot(spark):
    rows = [(1, 1, "queue", None, None, None), (1, 2, "claim", None, None, None), (1, 3, "progress", 250, 7, None), (1, 4, "progress", 30, 5, None), (1, 5, "fail", None, None, "bad"), (1, 6, "retry", None, None, None), (2, 1, "queue", None, None, None), (2, 2, "complete", None, 3, None)]
    df = spark.createDataFrame(rows, "job_id long, event_no long, kind string, progress int, chunks long, detail string").withColumn("ts", F.timestamp_seconds("event_no"))
    found = {r["job_id"]: r for r in state.job_snapshot(df).collect()}
    assert (found[1]["status"], found[1]["progress"], found[1]["chunks"], found[1]["detail"], found[1]["retry_count"]) == ("queued", 0, 7, None, 1)
    assert (found[2]["status"], found[2]["progress"], found[2]["chunks"]) == ("completed", 100, 3)


@given(st.lists(st.tuples(st.floats(0, 3000, allow_nan=False), st.booleans(), st.booleans()), max_size=12).map(sorted))
def test_pending_replies_model(turns):
    waiting, out = None, []
    for turn in turns:
        outcome, waiting = next(state.pending_replies([turn], 900, waiting))
        out.append(outcome)
    assert all(o in ("waiting", "plain", "resolved", "cleared") for o in out)
    for i, o in enumerate(out):
        if o in ("resolved", "cleared"):
            assert out[i - 1] == "waiting" and turns[i][0] - turns[i - 1][0] <= 900


# --- files ---


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    files = {
        "a.txt": "één\r\ntwee".encode("latin-1"),
        "b.csv": b'x,"y\nz" ,\n,,\n1,2\n',
        "c.json": b'{"a": {"b": [1, null, true]}, "c": "x"}',
        "d.xml": b"<r xmlns='urn:x'>t<k>v</k>tail</r>",
        "e.html": b"<html><title>T</title><nav>no</nav><p>one <b>two</b></p><script>no</script><!-- no --></html>",
        "f.docx": office({"word/document.xml": f"<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>para</w:t></w:r></w:p></w:body></w:document>"}),
        "g.json": b"{bad",
        "h.exe": b"x",
        "i.xlsx": office({"xl/workbook.xml": "<workbook xmlns:r='urn:r'><sheets><sheet name='S' r:id='r1'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='r1' Target='worksheets/s.xml'/></Relationships>", "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>", "xl/worksheets/s.xml": "<worksheet><sheetData><row><c t='s'><v>0</v></c><c><v>3</v></c></row></sheetData></worksheet>"}),
        "j.pptx": office({"ppt/slides/slide2.xml": "<p:sld xmlns:p='urn:p' xmlns:a='urn:a'><p:sp><a:p><a:r><a:t>hello</a:t></a:r></a:p></p:sp></p:sld>", "ppt/slides/slide1.xml": "<p:sld xmlns:p='urn:p'/>"}),
    }
    folder = tmp_path / "files"
    folder.mkdir()
    for name, body in files.items():
        (folder / name).write_bytes(body)
    accepted, rejected = extract.read_files(spark, str(folder))
    assert [r["reason"] for r in rejected.collect()] == ["unsupported: .exe"]
    rows, bad = extract.extract_rows(accepted)
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows.collect()}
    assert got["a.txt"]["text"] == "één\ntwee" and got["b.csv"]["text"] == "x, y\nz, \n1, 2"
    assert got["c.json"]["text"] == "a.b[0]: 1\na.b[1]: None\na.b[2]: True\nc: x"
    assert got["d.xml"]["text"] == "r: t\nk: v\ntail" and got["e.html"]["text"] == "T\none\ntwo"
    assert got["f.docx"]["text"] == "para\nc1 | c2" and got["i.xlsx"]["text"] == "shared | 3" and got["i.xlsx"]["sheet"] == "S"
    assert got["j.pptx"]["slide"] == 2 and [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["g.json"]
    query = streams.ingest_files(spark, str(folder), f"{tmp_path}/chunks", f"{tmp_path}/jobs", f"{tmp_path}/cp", {"owner": "o"})
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/jobs").where("status = 'completed'").count() == 9
    assert spark.read.parquet(f"{tmp_path}/chunks").where("size(embedding) = 256 and owner = 'o'").count() == 8


# --- answers, outlines, workspace ---


def test_answer_with_falls_back(spark):
    context = spark.createDataFrame([(1, 1, "s", None, "The sky is blue. Grass is green."), (2, 1, "s", 4, "Nothing here.")], "qid long, place int, source string, page int, text string")
    asked = spark.createDataFrame([(1, "sky blue?"), (2, "colour"), (3, "none")], "qid long, question string")
    found = {r["qid"]: (r["answer"], r["context_found"]) for r in answers.answer_with(lambda q, c: F.when(q == "colour", F.concat(F.lit("model: "), c)).otherwise(F.lit(rules.FALLBACK_ANSWER)), context, asked).collect()}
    assert found == {1: ("The sky is blue.", True), 2: ("model: [1] source=s | page=4\nNothing here.", True), 3: (rules.FALLBACK_ANSWER, False)}


def test_answer_repairs(spark):
    answer = "x\n```mermaid\ngraph TD\nA -->|yes|> B\n```\n| a | b |\n| 1 | 2 |\nend"
    row = spark.createDataFrame([(answer,)], "a string").select(outline.repair_answer("a").alias("r"), outline.strip_diagrams("a").alias("s")).first()
    assert row["r"] == "x\n```mermaid\nflowchart TD\nA -->|yes| B\n```\n| a | b |\n| --- | --- |\n| 1 | 2 |\nend"
    # lines that look like a diagram's go too: an ``end``, a word of up to four letters
    assert row["s"] == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_outline(spark):
    df = spark.createDataFrame([(1, "- Alpha: one\n- Alpha: two\n| Beta | x | y | z |\n|---|---|---|---|\nno")], "id long, text string")
    rows = outline.outline_rows(df)
    assert [(r["branch"], r["children"]) for r in rows.orderBy("branch_no").collect()] == [("Alpha", ["one", "two"]), ("Beta", ["x", "y"])]
    assert outline.render_outline(rows).first()["bullets"] == "- **Alpha**: one, two\n- **Beta**: x, y"


def test_document_selection(spark):
    docs = spark.createDataFrame([("u", "c", 1, "Budget Plan.xlsx"), ("u", "c", 2, "Travel notes.txt"), ("u", "c", 3, "x.txt")], "username string, chat_id string, upload_index int, name string")
    asked = spark.createDataFrame([(1, "u", "c", "tài liệu 2 nói gì"), (2, "u", "c", "what is in the budget plan?"), (3, "u", "c", "tất cả tài liệu"), (4, "u", "c", "tóm tắt"), (5, "u", "c", "compare document 1 and document 3")], "qid long, username string, chat_id string, question string")
    found = {r["qid"]: (r["mode"], r["indexes"]) for r in workspace.question_scopes(asked, docs).collect()}
    assert found == {1: ("combined", [2]), 2: ("combined", [1]), 3: ("per_document", [1, 2, 3]), 4: ("ask_user", []), 5: ("combined", [1, 3])}


def test_admin_rules(spark):
    users = spark.createDataFrame([("Ann", "admin", True), ("bob", "user", True)], "username string, role string, is_active boolean")
    changes = spark.createDataFrame([(1, "ann", "ANN ", "role", "user"), (2, "ann", "ann", "status", "false"), (3, "ann", "ann", "delete", None), (4, "ann", "bob", "delete", None), (5, "ann", "bob", "role", "king"), (6, "ann", "eve", "role", "user")], "change_no int, actor string, username string, op string, value string")
    found = {r["change_no"]: r["violation"] for r in workspace.admin_violations(users, changes).collect()}
    assert found == {1: "last admin", 2: "last active admin", 3: "own account", 4: None, 5: "no such role", 6: "no such user"}


def test_diagram_repairs(spark):
    cases = {
        "```mermaid\ngraph TD\nA --> two  words > B[b]  C --> D\n```": "```mermaid\nflowchart TD\nA -->|two words| B[b]\nC --> D\n```",
        "```MERMAID\n\nA ==>  | x  y |>  B\n```": "```mermaid\nA ==>|x y| B\n```",
        "graph is no diagram": "graph is no diagram",
        "```\ngraph TD\n```": "```\ngraph TD\n```",
    }
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select(outline.repair_diagrams("a").alias("r"), "b").collect()
    assert [r["r"] for r in rows] == [r["b"] for r in rows]


def test_stripped_diagrams(spark):
    cases = {
        "keep it\n```mermaid\nA --> B\n```\nkeep this too": "keep it\n\nkeep this too",
        "keep it\n```python\ny = 1\nx = f(2)\n```": "keep it\n```python\ny = 1\nx = f(2)\n```",
        "keep it\n```\ngraph TD\nA\n```\nand this": "keep it\nand this",
        "one line\ngraph TD\n\nA --> B\nplain words again\nB[box of words]\nend": "one line\nplain words again",
        "mindmap\n  root\n- a list line": "- a list line",
        "open fence\n```text\nnever closed here": "open fence\n```text\nnever closed here",
        "| a | b |\n|---|---|\n| 1 | 2 |": "| a | b |\n| --- | --- |\n| 1 | 2 |",
    }
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select(outline.strip_diagrams("a").alias("r"), "b").collect()
    assert [r["r"] for r in rows] == [r["b"] for r in rows]


def test_merged_outlines(spark):
    schema = "id long, branch_no int, branch string, children array<string>"
    first = spark.createDataFrame([(1, 0, "a", ["x"]), (1, 1, "b", [])], schema)
    second = spark.createDataFrame([(1, 0, "c", ["z"]), (1, 1, "a", ["y", "x"]), (2, 0, "d", [])], schema)
    both = [tuple(r) for r in outline.merge_outlines(first, second).orderBy("id", "branch_no").collect()]
    assert both == [(1, 0, "a", ["x", "y"]), (1, 1, "b", []), (1, 2, "c", ["z"]), (2, 0, "d", [])]
    assert outline.merge_outlines(first, second, extend=False).where("branch = 'a'").first()["children"] == ["x"]


def test_post_processing(spark):
    own = "some text\n```mermaid\nmindmap\n  root\n    A\n    B\n    C\n```\nA --> B"
    few = "Words.\n- One: first\n- Two: second\n- Three\n- Four"
    long = " ".join(f"w{i}" for i in range(60))
    asked = [(1, "tạo mindmap", own), (2, "tạo mindmap", few), (3, "compare", long), (4, "what", rules.FALLBACK_ANSWER + "."), (5, "who", "short\ngraph TD\nA --> B"), (6, "mind map", "nothing else")]
    answers = spark.createDataFrame(asked, "qid long, question string, answer string")
    context = spark.createDataFrame([(3, 1, "/x/" + "a" * 32 + "_plan.txt", "Alpha: one\nBeta: two")], "qid long, place int, source string, text string")
    found = {r["qid"]: r["answer"] for r in outline.post_process_answers(answers, context).collect()}
    assert found[1] == "```mermaid\nmindmap\n  root\n    A\n    B\n    C\n```\n\nsome text"
    assert found[2] == "```mermaid\nmindmap\n  root((Mindmap: tạo mindmap))\n    One\n      first\n    Two\n      second\n    Three\n    Four\n```\n\n" + few
    assert found[3].startswith(f"{long}\n\n### Tóm tắt nhanh\n- **Alpha**: one\n- **Beta**: two\n\n### Bảng tổng hợp\n| Chủ đề | Điểm chính |\n|---|---|\n| Alpha | one |\n| Beta | two |\n\n### Sơ đồ tổng quan\n```mermaid\n")
    assert "Tổng quan plan.txt" in found[3]
    assert (found[4], found[5], found[6]) == (rules.FALLBACK_ANSWER + ".", "short", "nothing else")


def test_routing_with_ids_and_replies(spark):
    docs = spark.createDataFrame([("u", "c", "a", 1, "One plan.txt"), ("u", "c", "b", 2, "Two notes.txt"), ("v", "d", "e", 1, "Only file.txt")], "username string, chat_id string, document_id string, upload_index int, name string")
    pending = spark.createDataFrame([("u", "c", "tóm tắt")], "username string, chat_id string, question string")
    rows = [(1, "u", "c", "hi", [" a", "x"]), (2, "u", "c", "1 and 2", None), (3, "u", "c", "never mind", []), (4, "u", "c", "so sánh", ["a", "b"]), (5, "v", "d", "tóm tắt", None), (6, "w", "z", "tóm tắt", None)]
    asked = spark.createDataFrame(rows, "qid long, username string, chat_id string, question string, selected_ids array<string>")
    found = {r["qid"]: (r["question"], r["mode"], r["indexes"], r["clears_pending"]) for r in workspace.route_questions(asked, docs, pending).collect()}
    assert found[1] == ("hi", "combined", [1], True)
    assert found[2] == ("tóm tắt", "per_document", [1, 2], True)
    assert found[3] == ("never mind", "combined", [], True)
    assert found[4] == ("so sánh", "combined", [1, 2], True)
    assert found[5] == ("tóm tắt", "combined", [], False)
    assert found[6] == ("tóm tắt", "combined", [], False)


def test_first_admin(spark):
    users = spark.createDataFrame([("Ann", "user", True)], "username string, role string, is_active boolean")
    now = F.lit("2024-01-01").cast("timestamp")
    for name, detail in ((" ann", "promoted_existing_user"), ("Bob", "created_new_admin")):
        changes, audit = workspace.first_admin(users, name, now)
        assert [(r["username"].lower(), r["role"], r["is_active"]) for r in changes.collect()] == [(name.strip().lower(), "admin", True)]
        assert audit.first()["detail"] == detail
    changes, audit = workspace.first_admin(users.withColumn("role", F.lit("admin")), "bob", now)
    assert changes.count() == audit.count() == 0


def test_lookups_and_bounds(spark, tmp_path):
    (tmp_path / "users.json").write_text('[{"username": "Ann", "password_hash": "h"}, {"username": "bob", "password_hash": "h", "role": "admin", "is_active": false}]')
    users = workspace.read_users(spark, str(tmp_path / "users.json"))
    assert [(r["role"], r["is_active"]) for r in workspace.find(users, username=" ANN ").collect()] == [("user", True)]
    asked = spark.createDataFrame([("ab", "x" * 9), ("abc", "short"), ("abc", "x" * 9)], "username string, password string")
    assert [r["error"] for r in workspace.field_errors(asked).collect()] == ["username is too short", "password is too short", None]
    assert workspace.scope_filter("u", "c", ["p", "p"]) == {"owner": "u", "chat_id": "c", "source": "p"}
    chats = spark.createDataFrame([(1, "old"), (2, "older")], "chat_id long, title string")
    names = spark.createDataFrame([(1, " new "), (2, " ")], "chat_id long, name string")
    changes, refused = workspace.renamed(chats, names, "chat_id", "title", F.current_timestamp(), F.lit(1))
    assert [(r["chat_id"], r["title"], r["op"]) for r in changes.collect()] == [(1, "new", "update")] and refused.count() == 1
    docs = spark.createDataFrame([("u", "c", "1"), ("u", "c", "2")], "username string, chat_id string, document_id string")
    left, chunks, counts = workspace.delete_documents(docs, docs.unionByName(docs), docs.where("document_id = '2'"))
    assert (left.count(), chunks.count(), tuple(counts.first())) == (1, 2, (1, 2))
    assert all(spark.createDataFrame([], ddl).columns for ddl in workspace.TABLES.values())


def test_folding_goes_on(spark, tmp_path):
    schema = "job_id long, event_no long, kind string, progress int, chunks long, detail string, ts timestamp"
    now = datetime(2024, 1, 1)
    data = [(j, n, kind, p, n, f"d{n}", now + timedelta(minutes=n)) for j in range(5) for n, (kind, p) in enumerate([("queue", None), ("claim", None), ("progress", 40 + j), ("fail", None), ("retry", None), ("progress", 10)][: 6 - j])]
    for part in range(3):  # a file for each two events, read one a micro-batch
        spark.createDataFrame([r for r in data if r[1] // 2 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/e/part{part}")
        os.utime(next(pathlib.Path(f"{tmp_path}/e/part{part}").glob("*.parquet")), (1_700_000_000 + part,) * 2)
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    query = streams.fold_jobs(source, f"{tmp_path}/s", f"{tmp_path}/c")
    query.awaitTermination(120)
    last = sorted(p.name for p in pathlib.Path(f"{tmp_path}/s").glob("version=*"))[-1]
    assert last == "version=2"
    whole = state.job_snapshot(spark.createDataFrame(data, schema))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/s/{last}").select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_ingest_keeps_documents_and_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("words " * 600)
    (folder / ("b" * 32 + "_named.json")).write_text('{"k": 1}')
    (folder / "bad.json").write_text("{")
    accepted, _ = extract.read_files(spark, str(folder))
    documents, chunks, jobs, result = extract.ingest(accepted, {"owner": "o", "chat_id": "c"}, vectors.hash_embedding)
    assert sorted(r["name"] for r in documents.collect()) == ["a.txt", "named.json"]
    rows = chunks.where("path like '%a.txt'").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and len(rows) > 2 and all(r["chunk_chars"] == len(r["text"]) and r["owner"] == "o" and len(r["embedding"]) == 256 for r in rows)
    assert {r["path"][-8:]: r["status"] for r in jobs.collect()}["bad.json"] == "failed"
    assert tuple(result.first()) == (3, len(rows) + 1)


def test_names_are_found_inside_words(spark):
    names = ["ab.x", "plan.txt", "Quarterly budget review.pdf", "x.txt", "longer name than twelve.md"]
    docs = spark.createDataFrame([("u", "c", i + 1, n) for i, n in enumerate(names)], "username string, chat_id string, upload_index int, name string")
    texts = ["the planning", "about quarterly budget review pdf", "see ab x now", "a longer name than twelve md and document 9", "nothing", ""]
    asked = spark.createDataFrame([(i, "u", "c", q) for i, q in enumerate(texts)], "qid long, username string, chat_id string, question string")
    found = {(r["qid"], r["upload_index"]) for r in workspace.select_documents(asked, docs).collect()}
    aliases = {r["upload_index"]: r["a"] for r in docs.select("upload_index", text.document_aliases(F.col("name")).alias("a")).collect()}
    assert found == {(i, k) for i, q in enumerate(texts) for k, held in aliases.items() if any(a in q for a in held)}
    assert {(0, 2), (1, 3), (2, 1), (3, 5)} <= found


def test_legacy_documents_are_windows_1252(spark):
    body = "\x00\x01\r\u201cCaf\xe9\u201d costs \u2014 much\r\r~~~~~~~~~~\rabc\x07\rSecond  part\ttwo\n\nthree".encode("cp1252") + b"\r\x81\x8d\x8f\x90ab"
    got = spark.createDataFrame([(body,)], "content binary").select(extract.scraped(F.col("content"))).first()[0]
    assert got == "\u201cCaf\xe9\u201d costs \u2014 much\nSecond  part\ttwo\n\nthree"
