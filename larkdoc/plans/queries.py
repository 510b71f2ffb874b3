"""The registered queries of the library over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkdoc.functions import rules, text
from larkdoc.operators import analytics, answers, chunking, outline, retrieval, vectors, workspace
from larkdoc.operators.common import written
from larkdoc.plans import changes, feeds, files, indexed, texts, uploads  # noqa: F401  (they register theirs)
from larkdoc.plans.tables import AS_OF, FILES, JOBS, MESSAGES, ORACLES, QUERIES, Query, asked_questions, query, quoted, stored_chunks, stored_files, stored_jobs, stored_messages, strip_sql, table, tokens_sql, ws_sql
from larkdoc.sources import extract
from larkdoc.streaming import state

# --- tokens and lexical retrieval ---

TOPK = f"""WITH q AS (SELECT item_id AS qid, list_distinct({tokens_sql("coalesce(text, '')")}) AS tokens FROM benchmark),
qt AS (SELECT qid, len(tokens) AS n, unnest(tokens) AS token FROM q),
ct AS (SELECT doc_id AS chunk_id, unnest(list_distinct({tokens_sql("coalesce(text, '')")})) AS token FROM documents),
o AS (SELECT qid, chunk_id, count(*) / greatest(1, any_value(n)) AS overlap FROM ct JOIN qt USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, chunk_id)::INT AS rank FROM o)
SELECT qid, chunk_id, overlap, rank FROM r WHERE rank <= 6"""


@query(TOPK)
def retrieve_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asked_questions(spark, sf_dir).select("qid", text.token_set(F.col("question")).alias("tokens"))
    return retrieval.lexical_topk(asked, stored_chunks(spark, sf_dir)).select("qid", "chunk_id", "overlap", "rank")


@query(f"SELECT doc_id, len({tokens_sql('text')})::BIGINT AS n_tokens, len(list_distinct({tokens_sql('text')}))::BIGINT AS n_distinct FROM documents")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(text.token_set(F.col("text"))).cast("long").alias("n_distinct"))


# --- questions ---

STOPS = "[" + ", ".join(quoted(w) for w in rules.STOP_WORDS) + "]"
FOCUS = f"list_filter(toks, lambda t, i: list_position(toks, t) = i AND length(t) > 2 AND NOT list_contains({STOPS}, t) AND NOT regexp_full_match(t, '\\p{{Nd}}+'))"
REWRITE = "CASE " + " ".join(f"WHEN regexp_matches(raw, {quoted('(?i)^(?:' + p + ')')}) THEN {quoted(r)}" for p, r in rules.REWRITES) + " ELSE raw END"
SPLIT = f"CASE WHEN length(raw) >= 40 THEN list_slice(list_filter(list_transform(regexp_split_to_array(raw, '[;\\n?]+'), lambda p: regexp_replace({ws_sql('p')}, '^[.,: -]+|[.,: -]+$', '', 'g')), lambda p: length(p) >= 16 AND len(list_distinct({tokens_sql('p')})) >= 3), 1, 4) ELSE [] END"
QUESTION = f"""q0 AS (SELECT item_id AS qid, {ws_sql("coalesce(text, '')")} AS raw FROM benchmark),
q1 AS (SELECT *, {REWRITE} AS rewritten, {tokens_sql('raw')} AS toks FROM q0),
q2 AS (SELECT *, {FOCUS} AS focus, {SPLIT} AS parts FROM q1),
q3 AS (SELECT *, list_filter(list_concat([raw, rewritten], parts, [CASE WHEN len(focus) >= 3 THEN array_to_string(list_slice(focus, 1, 8), ' ') END, CASE WHEN rewritten <> raw AND len(focus) >= 2 THEN rewritten || '. ' || array_to_string(list_slice(focus, 1, 6), ' ') END]), lambda x: x IS NOT NULL AND trim(x) <> '') AS found FROM q2),
v0 AS (SELECT qid, raw, rewritten, list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: lower(y)), lower(x)) = i) AS variants FROM q3),
v AS (SELECT qid, raw, rewritten, unnest(range(len(variants)))::INT AS variant_no, unnest(variants) AS query FROM v0)"""


@query(f"WITH {QUESTION} SELECT qid, variant_no, query FROM v")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.query_variants(asked_questions(spark, sf_dir))


@query(f"""WITH {QUESTION} SELECT qid, rewritten, greatest(1, least(20, 6 + CASE WHEN n >= 30 THEN 4 WHEN n >= 18 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(raw, {quoted('(?i)(?:' + rules.COMPLEX + ')')}) THEN 2 ELSE 0 END))::INT AS top_k
FROM (SELECT *, len(list_distinct(toks)) AS n FROM q1)""")
def question_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_questions(spark, sf_dir).select("qid", text.rewrite_question(F.col("question")).alias("rewritten"), text.effective_top_k(F.col("question")).alias("top_k"))


FLAGS = {"mindmap": rules.MINDMAP, "visual": rules.VISUAL, "complex": rules.COMPLEX, "simple_fact": rules.SIMPLE_FACT, "timeline": rules.TIMELINE, "pie": rules.PIE, "flow": rules.FLOW, "summary": rules.SUMMARY}


@query("SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, {quoted('(?i)(?:' + p + ')')}), false) AS {n}" for n, p in FLAGS.items()) + " FROM documents")
def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text.question_flags(F.col("text")).items()])


@query("SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(q, {quoted('(?i)(?:' + p + ')')}) THEN '{k}'" for k, p in (("timeline", rules.TIMELINE), ("pie", rules.PIE), ("mindmap", rules.MINDMAP), ("flowchart", rules.FLOW))) + " ELSE ['flowchart', 'mindmap', 'timeline', 'pie'][(instr('0123456789abcdef', right(sha1(CASE WHEN q = '' THEN 'Branch ' || item_id ELSE lower(q) END), 1)) - 1) % 4 + 1] END AS kind FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '' ELSE text END AS q FROM benchmark)")
def diagram_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of questions, a quarter of them empty, with the branches of an outline each."""
    question = F.when(F.col("item_id") % 4 == 0, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.diagram_kind(question, F.concat(F.lit("Branch "), F.col("item_id").cast("string"))).alias("kind"))


# --- fusion, relevance, answers ---

LEXICAL_HITS = f"""vt AS (SELECT qid, variant_no, list_distinct({tokens_sql('query')}) AS toks FROM v),
vx AS (SELECT qid, variant_no, len(toks) AS n, unnest(toks) AS token FROM vt),
c0 AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text, list_distinct({tokens_sql("coalesce(text, '')")}) AS ctoks FROM documents),
ct AS (SELECT chunk_id, unnest(ctoks) AS token FROM c0),
o AS (SELECT qid, variant_no, chunk_id, count(*) / greatest(1, any_value(n)) AS overlap FROM ct JOIN vx USING (token) GROUP BY ALL),
k AS (SELECT qid, 6 AS top_k FROM v0),
h AS (SELECT *, row_number() OVER (PARTITION BY qid, variant_no ORDER BY overlap DESC, chunk_id) - 1 AS rank FROM o QUALIFY rank < 6)"""


def _embedded(column: str) -> str:
    """The hash embedding times 255."""
    return f"list_transform(range(256), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT) AS e FROM (SELECT *, array_to_string(list_transform(range(8), lambda c: sha256({column} || c)), '') AS h"


VECTOR_HITS = f"""c0 AS (SELECT doc_id AS chunk_id, text, source, lang, list_distinct({tokens_sql('text')}) AS ctoks FROM documents WHERE regexp_matches(text, '\\S')),
ce AS (SELECT chunk_id, {_embedded('text')} FROM c0 WHERE lang IN ('en', 'de'))),
ve AS (SELECT qid, variant_no, {_embedded('query')} FROM v)),
k AS (SELECT qid, greatest(1, least(20, 6 + CASE WHEN n >= 30 THEN 4 WHEN n >= 18 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(raw, {quoted('(?i)(?:' + rules.COMPLEX + ')')}) THEN 2 ELSE 0 END))::INT AS top_k FROM (SELECT *, len(list_distinct(toks)) AS n FROM q1)),
o AS (SELECT qid, variant_no, chunk_id, list_sum(list_transform(list_zip(ve.e, ce.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM ve, ce),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, variant_no ORDER BY d2, chunk_id) - 1 AS rank FROM o) JOIN k USING (qid) WHERE rank < top_k)"""

FUSION = f"""f AS (SELECT qid, chunk_id, min(rank) AS best_rank, count(*) AS hits, min({{'a': variant_no, 'b': rank}}) AS seen FROM h GROUP BY ALL),
s AS (SELECT f.*, top_k, 0.6::DOUBLE * (len(list_intersect(list_distinct({tokens_sql('raw')}), ctoks)) / greatest(1, len(list_distinct({tokens_sql('raw')})))) + 0.3::DOUBLE * (1 - best_rank / top_k) + 0.1::DOUBLE * least(hits, 3) / 3 AS score, rewritten, ctoks FROM f JOIN c0 USING (chunk_id) JOIN v0 USING (qid) JOIN k USING (qid)),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, chunk_id)::INT AS place FROM s QUALIFY place <= greatest(top_k, least(2 * top_k, 24))),
rel AS (SELECT *, len(list_intersect(list_distinct({tokens_sql('rewritten')}), ctoks)) / greatest(1, len(list_distinct({tokens_sql('rewritten')}))) AS relevance, len({tokens_sql('rewritten')}) AS nq FROM p),
kept AS (SELECT *, count(*) FILTER (relevance >= 0.15) OVER (PARTITION BY qid) AS n FROM rel QUALIFY nq = 0 OR CASE WHEN n < 1 THEN true ELSE relevance >= 0.15 END)"""
HITS = f"{LEXICAL_HITS}, {FUSION}"


@query(f"WITH {QUESTION}, {HITS} SELECT qid, chunk_id, round(score, 9) AS score, place FROM p")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, chunks = asked_questions(spark, sf_dir), stored_chunks(spark, sf_dir)
    fused = retrieval.fuse_hits(retrieval.variant_hits(retrieval.query_variants(asked), chunks))
    return retrieval.rank_fusion(fused, asked, chunks).withColumn("score", F.round("score", 9))


query(TOPK)(indexed.indexed_topk)
query(ORACLES["rank_fusion"])(indexed.indexed_fusion)


@query(f"WITH {QUESTION}, {HITS} SELECT qid, chunk_id, place, round(relevance, 9) AS relevance FROM kept")
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve(asked_questions(spark, sf_dir), stored_chunks(spark, sf_dir)).select("qid", "chunk_id", "place", F.round("relevance", 9).alias("relevance"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indexed chunks with hash embeddings."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang", vectors.hash_embedding(F.col("text")).alias("embedding"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve_vectors(asked_questions(spark, sf_dir), _vectors(spark, sf_dir), vectors.hash_embedding, {"lang": ["en", "de"]})


@query(f"WITH {QUESTION}, {VECTOR_HITS}, {FUSION} SELECT qid, chunk_id, place, round(score, 9) AS score, round(relevance, 9) AS relevance FROM kept")
def retrieve_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).select("qid", "chunk_id", "place", F.round("score", 9).alias("score"), F.round("relevance", 9).alias("relevance"))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical best chunks of each question as an answer's context."""
    asked = asked_questions(spark, sf_dir).select("qid", text.token_set(F.col("question")).alias("tokens"))
    chunks = stored_chunks(spark, sf_dir)
    return retrieval.lexical_topk(asked, chunks).select("qid", "chunk_id", F.col("rank").alias("place")).join(chunks, "chunk_id")


BEST = f"""sl AS (SELECT qid, place, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[' || chr(1) || '\\n]+'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM ctx),
se AS (SELECT qid, place, unnest(range(len(l)))::INT AS sentence_no, unnest(l) AS sentence FROM sl),
sc AS (SELECT se.*, len(list_intersect(q.tokens, list_distinct({tokens_sql('sentence')}))) / greatest(1, len(q.tokens)) AS score FROM se JOIN q USING (qid)),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place, sentence_no)::INT AS rank FROM sc WHERE score > 0 AND score >= 0.15 QUALIFY rank <= 5)"""
SENTENCES = TOPK.replace("SELECT qid, chunk_id, overlap, rank FROM r WHERE rank <= 6", "") + f""", ctx AS (SELECT qid, chunk_id, rank AS place, coalesce(text, '') AS text FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 6),
{BEST}"""
ANSWER = f"""w AS (SELECT qid, string_agg({strip_sql('text')}, chr(10) || chr(10) ORDER BY place) AS whole FROM ctx WHERE regexp_matches(text, '\\S') GROUP BY qid),
b AS (SELECT qid, string_agg(sentence, ' ' ORDER BY rank) AS best FROM best GROUP BY qid),
answer AS (SELECT item_id AS qid, left(coalesce(CASE WHEN regexp_matches(text, {quoted('(?i)(?:' + rules.SUMMARY + ')')}) OR best IS NULL THEN whole ELSE best END, {quoted(rules.FALLBACK_ANSWER)}), 2500) AS answer, whole IS NOT NULL AS context_found
FROM benchmark LEFT JOIN w ON w.qid = item_id LEFT JOIN b ON b.qid = item_id)"""


@query(SENTENCES + " SELECT qid, place, sentence_no, sentence, round(score, 9) AS score, rank FROM best")
def rank_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.rank_sentences(_context(spark, sf_dir), asked_questions(spark, sf_dir)).select("qid", "place", "sentence_no", "sentence", F.round("score", 9).alias("score"), "rank")


@query(f"{SENTENCES}, {ANSWER} SELECT * FROM answer")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.extractive_answers(_context(spark, sf_dir), asked_questions(spark, sf_dir))


@query(f"{SENTENCES}, {ANSWER} SELECT qid, CASE WHEN length(coalesce(text, '')) % 4 < 2 THEN answer ELSE 'M ' || text END AS answer FROM answer JOIN benchmark ON item_id = qid")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.model_answers(spark, sf_dir, _context(spark, sf_dir))


@query(f"""WITH {QUESTION}, {VECTOR_HITS}, {FUSION}, ctx AS (SELECT qid, chunk_id, place, text, source FROM kept JOIN c0 USING (chunk_id)), q AS (SELECT item_id AS qid, list_distinct({tokens_sql("coalesce(text, '')")}) AS tokens FROM benchmark),
{BEST}, {ANSWER}, refs AS (SELECT qid, source || ' [đoạn ' || (chunk_id % 7) || ']' AS ref, min(place) AS first_at FROM ctx GROUP BY ALL),
src AS (SELECT qid, list(ref ORDER BY first_at) AS sources FROM refs GROUP BY qid)
SELECT answer.*, coalesce(sources, []) AS sources FROM answer LEFT JOIN src USING (qid)""")
def answer_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", F.lit(None).cast("int").alias("page"), (F.col("doc_id") % 7).alias("chunk_index"))
    return answers.answer_extractive(_retrieved(spark, sf_dir), asked_questions(spark, sf_dir), held)


@query("""SELECT source, array_to_string(list(ref ORDER BY doc_id), '; ') AS refs FROM (SELECT source, doc_id, ref FROM (SELECT doc_id, source, 'note' || (doc_id % 5) || '.txt' || CASE WHEN doc_id % 2 = 0 THEN ' (trang ' || (doc_id % 3) || ')' ELSE '' END || ' [đoạn ' || (doc_id % 4) || ']' AS ref FROM documents) QUALIFY row_number() OVER (PARTITION BY source, ref ORDER BY doc_id) = 1) GROUP BY source""")
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/data/"), F.md5(F.col("doc_id").cast("string")), F.lit("_note"), (F.col("doc_id") % 5).cast("string"), F.lit(".txt"))
    ref = text.source_ref(path, F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3), F.col("doc_id") % 4)
    firsts = docs.select("source", "doc_id", ref.alias("ref")).groupBy("source", "ref").agg(F.min("doc_id").alias("doc_id"))
    return firsts.groupBy("source").agg(answers.in_order(["doc_id"], "ref", "; ").alias("refs"))


@query(f"SELECT doc_id, {strip_sql('text')} AS text, [source, lang] AS sources FROM documents")
def source_marker_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = text.attach_sources(F.regexp_replace(text.strip(F.col("text")), r"\n{3,}", "\n\n"), F.array(F.concat(F.lit(" "), "source"), "lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.extract_sources(sent).alias("x")).select("doc_id", "x.text", "x.sources")


# --- files, chunks, vectors ---


@query("SELECT doc_id, sha256(text) AS file_hash, strlen(text)::BIGINT AS size FROM documents")
def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *extract.fingerprint(F.col("text").cast("binary")))


@query(f"""SELECT doc_id, 0 AS chunk_no, (strpos(text, {strip_sql('text')}) - 1)::INT AS start_index, {strip_sql('text')} AS text FROM documents WHERE regexp_matches(text, '\\S') AND length(text) < 1500""")
def chunk_short_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents").where(F.length("text") < rules.CHUNK_SIZE))


@query()
def chunk_all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.number_chunks(chunking.chunk_documents(table(spark, sf_dir, "documents")))


@query(r"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '[!-~]+'), lambda w: length(w) <= 200)))::BIGINT AS n_words, true AS begins, true AS ends, true AS fits, true AS exact FROM documents WHERE regexp_matches(text, '\S')""")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the chunks of all whole texts lose no word, begin and end where the text does, have the size at most and stand where start_index says."""
    chunks = chunking.chunk_documents(table(spark, sf_dir, "documents"))
    whole = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"), text.strip(F.col("text")).alias("clean"))
    words = lambda column: F.array_distinct(F.filter(F.regexp_extract_all(column, F.lit("([!-~]+)"), 1), lambda w: F.length(w) <= 200))
    seen = chunks.join(whole, "doc_id").withColumn("exact", F.substring("whole", F.col("start_index") + 1, F.length("text")) == F.col("text"))
    found = seen.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(words(F.col("text"))))).alias("w"), F.min_by("text", "chunk_no").alias("first"), F.max_by("text", "chunk_no").alias("last"), F.max(F.length("text")).alias("most"), F.min("exact").alias("exact"))
    both = found.join(whole, "doc_id")
    return both.select("doc_id", F.size(F.array_intersect("w", words(F.col("whole")))).cast("long").alias("n_words"), F.startswith("clean", "first").alias("begins"), F.endswith("clean", "last").alias("ends"), (F.col("most") <= rules.CHUNK_SIZE).alias("fits"), "exact")


@query("SELECT doc_id, doc_id || '||' || (doc_id % 7) || '||' || sha1(left(text, 512)) AS chunk_key FROM documents")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", text.chunk_key(F.col("doc_id"), none, F.col("doc_id") % 7, none, F.col("text")).alias("chunk_key"))


@query("""SELECT doc_id, i::INT AS i, (('0x' || substr(sha256(text || (i // 32)), 2 * (i % 32)::INT + 1, 2))::INT / 255.0::DOUBLE) AS value FROM (SELECT doc_id, text, unnest(range(256)) AS i FROM documents)""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole vectors of all documents, a row for each number; a null text has null numbers."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.hash_embedding(F.col("text"))).alias("i", "value"))


def _knn_sql(where: str) -> str:
    return f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT q.vec_id AS qid, x.vec_id, list_sum(list_transform(range(1, len(x.e) + 1), lambda i: (q.e[i] - x.e[i]) * (q.e[i] - x.e[i]))) AS d2 FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q, (SELECT * FROM v {where}) x)
SELECT qid, vec_id, round(d2, 9) AS d2, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id)::INT AS rank FROM d QUALIFY rank <= 6"""


@query(_knn_sql(""))
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    asked = held.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.knn_l2(asked, held, rules.TOP_K).withColumn("d2", F.round("d2", 9))


@query(_knn_sql("WHERE label IN (1, 3)"))
def knn_l2_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    asked = held.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.knn_l2(asked, held, rules.TOP_K, {"label": [1, 3]}).withColumn("d2", F.round("d2", 9))


query(_knn_sql(""))(indexed.knn_cells)
query(_knn_sql("WHERE label IN (1, 3)"))(indexed.knn_cells_filtered)


@query("SELECT label, count(*) AS n FROM embeddings WHERE NOT (label IN (1, 3)) GROUP BY label")
def delete_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.metadata_filter(table(spark, sf_dir, "embeddings"), {"label": [1, 3]}, keep=False).groupBy("label").agg(F.count("*").alias("n"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", extract.html_to_text("html").alias("text"))


@query("SELECT event_id, CASE WHEN props IS NULL THEN NULL ELSE array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || ': ' || coalesce(json_extract_string(props, '$.' || k), 'None')), chr(10)) END AS text FROM events")
def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", extract.flatten_object(F.col("props")).alias("text"))


# --- workspace tables ---

FOLDED = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {FILES} SELECT username, chat_id, document_id, row_number() OVER (PARTITION BY username, chat_id ORDER BY created_at, document_id)::INT AS upload_index FROM files")
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.document_numbers(stored_files(spark, sf_dir)).select("username", "chat_id", "document_id", "upload_index")


@query(f"WITH {FILES} SELECT file_hash, count(*) AS n, min(document_id) AS first_id FROM files GROUP BY file_hash HAVING count(*) > 1")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_files(spark, sf_dir).groupBy("file_hash").agg(F.count("*").alias("n"), F.min("document_id").alias("first_id")).where("n > 1")


@query(f"WITH {FILES} SELECT username, chat_id, file_hash, document_id, version FROM files QUALIFY row_number() OVER (PARTITION BY username, chat_id, file_hash ORDER BY version DESC, created_at DESC, document_id) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.latest_versions(stored_files(spark, sf_dir)).select("username", "chat_id", "file_hash", "document_id", "version")


UPLOADS = f"WITH {FILES}, stored AS (SELECT * EXCLUDE (username, chat_id), 'u' AS username, 'c' AS chat_id FROM files WHERE document_id % 2 = 0), uploads AS (SELECT 'u' AS username, 'c' AS chat_id, document_id AS upload_no, file_hash, document_id // 10 AS batch_id FROM files WHERE document_id % 2 = 1)"


def _uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(uploads, stored): odd documents meet even ones in one workspace."""
    files = stored_files(spark, sf_dir).withColumns({"username": F.lit("u"), "chat_id": F.lit("c")})
    return files.where("document_id % 2 = 1").select("username", "chat_id", F.col("document_id").alias("upload_no"), "file_hash", F.expr("document_id div 10").alias("batch_id")), files.where("document_id % 2 = 0")


@query(UPLOADS + """, held AS (SELECT file_hash, max(version) AS m FROM stored GROUP BY file_hash)
SELECT upload_no, (coalesce(m, 0) + row_number() OVER (PARTITION BY file_hash ORDER BY upload_no))::INT AS version FROM uploads LEFT JOIN held USING (file_hash)""")
def assign_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.assign_versions(*_uploads(spark, sf_dir)).select("upload_no", "version")


@query(UPLOADS + """, held AS (SELECT file_hash, document_id FROM stored QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY version DESC, created_at DESC, document_id) = 1),
jobs AS (SELECT document_id AS job_id, file_hash FROM stored WHERE document_id % 16 = 0 ORDER BY created_at DESC, document_id DESC LIMIT 200),
pend AS (SELECT DISTINCT file_hash FROM jobs),
u AS (SELECT uploads.*, held.document_id::VARCHAR AS old_id, pend.file_hash IS NOT NULL AS p FROM uploads LEFT JOIN held USING (file_hash) LEFT JOIN pend USING (file_hash))
SELECT upload_no, CASE WHEN bool_or(p) OVER (PARTITION BY batch_id) THEN 'reject_pending' WHEN old_id IS NULL THEN 'insert' WHEN upload_no % 3 = 0 THEN 'replace' WHEN upload_no % 3 = 1 THEN 'keep_both' ELSE 'reject' END AS decision, old_id FROM u""")
def duplicate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads, stored = _uploads(spark, sf_dir)
    path = F.concat(F.lit("/up/"), F.col("document_id").cast("string"))
    jobs = stored.where("document_id % 16 = 0").select("username", "chat_id", F.col("document_id").alias("job_id"), F.lit("queued").alias("status"), "created_at", F.array(path).alias("file_paths"))
    prints = stored.select(path.alias("path"), "file_hash")
    action = workspace.normalize_action(F.when(F.col("upload_no") % 3 == 0, " Replace").when(F.col("upload_no") % 3 == 1, "keep_both"))
    found = workspace.stored_duplicates(uploads, stored).unionByName(workspace.pending_duplicates(uploads, jobs, prints))
    return workspace.duplicate_decisions(uploads, found, action).select("upload_no", "decision", "old_id")


@query(UPLOADS + """, gone AS (SELECT DISTINCT file_hash FROM uploads WHERE upload_no % 3 = 0),
old AS (SELECT document_id FROM (SELECT document_id, file_hash FROM stored QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY version DESC, created_at DESC, document_id) = 1) WHERE file_hash IN (FROM gone)),
kept AS (SELECT * FROM stored WHERE document_id NOT IN (FROM old)),
new AS (SELECT upload_no, file_hash FROM uploads WHERE upload_no % 3 < 2 OR file_hash NOT IN (SELECT file_hash FROM stored)),
held AS (SELECT file_hash, max(version) AS m FROM kept GROUP BY file_hash)
SELECT 'document' AS kind, document_id::VARCHAR AS id, version FROM kept UNION ALL
SELECT 'document', 'upload-' || upload_no, (coalesce(m, 0) + row_number() OVER (PARTITION BY file_hash ORDER BY upload_no))::INT FROM new LEFT JOIN held USING (file_hash) UNION ALL
SELECT 'chunk', document_id::VARCHAR, 0 FROM kept UNION ALL SELECT 'refused', upload_no::VARCHAR, 0 FROM uploads WHERE upload_no NOT IN (SELECT upload_no FROM new)""")
def applied_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads, stored = _uploads(spark, sf_dir)
    action = workspace.normalize_action(F.when(F.col("upload_no") % 3 == 0, " Replace").when(F.col("upload_no") % 3 == 1, "keep_both"))
    decided = workspace.duplicate_decisions(uploads, workspace.stored_duplicates(uploads, stored), action)
    documents, chunks, refused = workspace.apply_decisions(decided, stored, stored.select("username", "chat_id", "document_id"))
    left = documents.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "version")
    none = F.lit(0).alias("version")
    return left.unionByName(chunks.select(F.lit("chunk").alias("kind"), F.col("document_id").alias("id"), none)).unionByName(refused.select(F.lit("refused").alias("kind"), F.col("upload_no").cast("string").alias("id"), none))


@query(f"WITH {MESSAGES} SELECT chat_id, any_value(username) AS username, count(*) AS messages, max(created_at) AS last_at FROM messages GROUP BY chat_id")
def chat_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.list_chats(stored_messages(spark, sf_dir))


@query(f"WITH {MESSAGES} SELECT chat_id, message_id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, message_id)::INT AS rank FROM messages QUALIFY rank <= 200")
def message_first_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.first_messages(stored_messages(spark, sf_dir)).select("chat_id", "message_id", "rank")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 20")
def paged_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.page(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), "c_custkey"], 20, 50).select("c_custkey", "c_name")


@query(f"WITH {MESSAGES} SELECT message_id, (len(list_filter(range(1, length(text)::BIGINT + 1), lambda i: lower(substr(text, i, 2)) = 'en')))::INT AS occurrences FROM messages WHERE role IN ('user', 'assistant') AND contains(lower(text), 'en')")
def search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.search_messages(stored_messages(spark, sf_dir), "En").select("message_id", "occurrences")


@query("SELECT user_id, event_type, event_id AS last_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("change_ts"), F.col("event_id").alias("change_no"), "event_type", F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"))
    return workspace.current_state(changes, ["user_id"]).select("user_id", "event_type", F.col("change_no").alias("last_id"))


@query(f"WITH {FILES}, gone AS (SELECT DISTINCT username, chat_id FROM files WHERE document_id % 97 = 0) SELECT username, chat_id, count(*) AS n FROM files ANTI JOIN gone USING (username, chat_id) GROUP BY ALL")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored_files(spark, sf_dir)
    left = workspace.delete_cascade({"documents": files}, files.where("document_id % 97 = 0"))["documents"]
    return left.groupBy("username", "chat_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'new' FROM events WHERE event_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_type = 'new' DESC) = 1""")
def merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return workspace.merge_latest(events.where("event_id % 3 = 0"), events.where("event_id % 2 = 0").withColumn("event_type", F.lit("new")), "event_id")


@query(f"""WITH {JOBS}, a AS (SELECT *, floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(updated_at)) AS age FROM jobs)
SELECT job_id, status IN ('queued', 'processing') AS active, status = 'failed' AND retry_count < max_retries AS can_retry, status = 'processing' AND age > 120 AS stale, status IN ('completed', 'failed') AND age > 3600 AS expired FROM a""")
def job_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.job_flags(stored_jobs(spark, sf_dir), F.lit(AS_OF).cast("timestamp")).select("job_id", "active", "can_retry", "stale", "expired")


@query(f"""WITH {JOBS}, a AS (SELECT *, floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(updated_at)) AS age FROM jobs)
SELECT job_id, CASE WHEN status = 'processing' AND age > 120 THEN 'queued' ELSE status END AS status, CASE WHEN status = 'processing' AND age > 120 THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM a WHERE NOT (status IN ('completed', 'failed') AND age > 3600)""")
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, now = stored_jobs(spark, sf_dir), F.lit(AS_OF).cast("timestamp")
    log = workspace.change_rows(jobs, "insert", F.col("updated_at"), F.lit(0)).unionByName(workspace.recover_and_expire(jobs, now, F.lit(1)).withColumn("change_ts", F.lit("9999-01-01").cast("timestamp")))
    return workspace.current_state(log, ["job_id"]).select("job_id", "status", "updated_at")


query(ORACLES["recovered_jobs"])(feeds.recovered_jobs_live)


@query("SELECT username, chat_id, job_id, place FROM (SELECT *, row_number() OVER (PARTITION BY username, chat_id ORDER BY created_at DESC, job_id DESC)::INT AS place FROM (SELECT source AS username, lang AS chat_id, doc_id AS job_id, doc_id % 1000 AS created_at FROM documents WHERE doc_id % 3 < 2)) WHERE place <= 5")
def listed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("document_id") % 3 == 0, "queued").when(F.col("document_id") % 3 == 1, "processing").otherwise("failed")
    jobs = stored_files(spark, sf_dir).select("username", "chat_id", F.col("document_id").alias("job_id"), status.alias("status"), "created_at")
    return workspace.list_jobs(jobs, 5, True).select("username", "chat_id", "job_id", "place")


@query("SELECT doc_id AS job_id FROM documents WHERE doc_id % 3 = 0 ORDER BY doc_id % 1000, doc_id LIMIT 20")
def oldest_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("document_id") % 3 == 0, "queued").otherwise("failed")
    return workspace.next_queued(stored_files(spark, sf_dir).select(F.col("document_id").alias("job_id"), status.alias("status"), "created_at"), 20).select("job_id")


@query(f"""WITH {MESSAGES}, m AS (SELECT message_id AS qid, chat_id, username, text, created_at, message_id % 3 AS k FROM messages WHERE role = 'user')
SELECT qid || '-user' AS message_id, chat_id, username, 'user' AS role, text AS content, created_at FROM m UNION ALL
SELECT qid || '-assistant', chat_id, username, 'assistant', CASE k WHEN 0 THEN {quoted(rules.FALLBACK_ANSWER)} WHEN 1 THEN 'Answer to ' || text ELSE 'Answer to ' || text || chr(10) || chr(10) || '<!--larkdoc:sources:' || to_base64(('["' || username || '"]')::BLOB) || '-->' END, created_at + INTERVAL 1 MICROSECOND FROM m""")
def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = stored_messages(spark, sf_dir).where("role = 'user'").select(F.col("message_id").alias("qid"), "username", "chat_id", F.col("text").alias("question"), "created_at")
    sources = F.when(F.col("qid") % 3 == 2, F.array("username", F.concat(F.lit(" "), "username")))
    replies = said.where("qid % 3 <> 0").select("qid", F.concat(F.lit("Answer to "), "question").alias("answer"), sources.alias("sources"))
    return workspace.conversation_log(said, replies)


query(ORACLES["conversation_log"])(feeds.conversation_log_live)


@query("""WITH f AS (SELECT source AS username, lang AS chat_id, doc_id AS document_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id % 1000, doc_id)::INT AS i FROM documents), n AS (SELECT username, chat_id, count(*) AS n FROM f GROUP BY ALL)
SELECT document_id AS qid, CASE document_id % 5 WHEN 1 THEN 'summary' ELSE CASE document_id % 5 WHEN 0 THEN 'ids' WHEN 2 THEN 'document 1 and document 2' WHEN 3 THEN 'compare document 1 and document 2' ELSE 'hello there' END END AS question,
CASE WHEN document_id % 5 = 1 AND n > 1 THEN 'ask_user' WHEN document_id % 5 = 2 AND n > 1 THEN 'per_document' ELSE 'combined' END AS mode,
CASE document_id % 5 WHEN 0 THEN [i] WHEN 2 THEN list_slice([1, 2], 1, least(n, 2)) WHEN 3 THEN list_slice([1, 2], 1, least(n, 2)) ELSE [] END AS indexes FROM f JOIN n USING (username, chat_id)""")
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, name = F.col("document_id") % 5, F.concat(F.lit("zz"), F.md5(F.col("document_id").cast("string")), F.lit(".txt"))
    held = workspace.document_numbers(stored_files(spark, sf_dir)).withColumn("name", name)
    said = F.when(kind == 0, "ids").when(kind == 1, "summary").when(kind == 2, "document 1 and document 2").when(kind == 3, "compare document 1 and document 2").otherwise("hello there")
    ids = F.when(kind == 0, F.array(F.concat(F.lit(" "), F.col("document_id").cast("string"))))
    asked = held.select(F.col("document_id").alias("qid"), "username", "chat_id", said.alias("question"), ids.alias("selected_ids"))
    return workspace.route_questions(asked, held.select("username", "chat_id", "document_id", "upload_index", "name")).drop("clears_pending")


@query(f"""WITH {MESSAGES}, u AS (SELECT username, count(*) AS n FROM messages WHERE role = 'user' GROUP BY username ORDER BY n DESC, username LIMIT 10)
SELECT 'top_users' AS part, username AS name, n FROM u UNION ALL SELECT 'per_day', strftime(created_at, '%Y-%m-%d'), count(*) FROM messages WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY ALL""")
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.usage_report(stored_messages(spark, sf_dir), "created_at", F.lit(AS_OF).cast("timestamp"), 14)


@query(f"""WITH {JOBS}, w AS (SELECT DISTINCT event_id * 2 AS job_id FROM events)
SELECT job_id, CASE WHEN status IS NULL THEN 'not found' WHEN status <> 'failed' THEN 'not failed' WHEN retry_count >= max_retries THEN 'limit exceeded' END AS error FROM w LEFT JOIN jobs USING (job_id)""")
def retry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").select((F.col("event_id") * 2).alias("job_id"))
    return workspace.retry_errors(wanted, stored_jobs(spark, sf_dir))


@query(f"""WITH t AS (SELECT source AS username, lang AS chat_id, doc_id, list_distinct({tokens_sql('text')}) AS toks, {tokens_sql('text')} AS l FROM documents WHERE len({tokens_sql('text')}) > 0),
u AS (SELECT doc_id, token, min(pos) AS pos FROM (SELECT doc_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM t) GROUP BY ALL),
e AS (SELECT doc_id, arg_min(token, pos) AS first_token, arg_max(token, pos) AS last_token FROM u GROUP BY doc_id),
d AS (SELECT username, chat_id, row_number() OVER (PARTITION BY username, chat_id ORDER BY doc_id)::INT AS upload_index, 'Report ' || first_token || ' ' || last_token || '.txt' AS name FROM t JOIN e USING (doc_id)),
a0 AS (SELECT *, {FOLDED.format('name')} AS full_name, {FOLDED.format("regexp_replace(name, '[.][^.]*$', '')")} AS stem FROM d),
a AS (SELECT username, chat_id, upload_index, unnest([CASE WHEN length(full_name) >= 3 THEN full_name END, CASE WHEN length(stem) >= 3 THEN stem END, CASE WHEN len(string_split(stem, ' ')) >= 3 THEN array_to_string(string_split(stem, ' ')[-3:], ' ') END]) AS alias FROM a0),
q AS (SELECT item_id AS qid, 'src' || (item_id % 20) AS username, 'en' AS chat_id, {FOLDED.format("'document ' || (item_id % 9 + 1) || ' ' || text")} AS folded FROM benchmark),
n AS (SELECT qid, username, chat_id, unnest(regexp_extract_all(folded, {quoted(rules.DOCUMENT_NUMBER)}, 1))::INT AS upload_index FROM q)
SELECT qid, upload_index FROM n JOIN d USING (username, chat_id, upload_index) UNION SELECT qid, upload_index FROM q JOIN d USING (username, chat_id) WHERE regexp_matches(folded, {quoted(rules.ALL_DOCUMENTS)}) UNION SELECT qid, upload_index FROM q JOIN a USING (username, chat_id) WHERE contains(folded, alias)""")
def select_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda tokens: F.when(F.size(tokens) > 0, F.concat(F.lit("Report "), F.element_at(tokens, 1), F.lit(" "), F.element_at(tokens, -1), F.lit(".txt")))
    called = F.element_at(F.transform(F.array(text.token_set(F.col("text"))), name), 1)  # a lambda, so that a text's tokens are made once
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("username"), F.col("lang").alias("chat_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("created_at"), called.alias("name"))
    named = workspace.document_numbers(written(docs, "names").where("name is not null"))
    numbers = F.concat(F.lit("document "), (F.col("item_id") % 9 + 1).cast("string"), F.lit(" "), F.col("text"))
    spaces = named.select("username", "chat_id").distinct()
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("username"), F.lit("en").alias("chat_id"), numbers.alias("question")).join(spaces, ["username", "chat_id"], "left_semi")
    return workspace.select_documents(asked, named)


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_text("text").alias("folded"))


# --- analytics ---


@query("SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(DISTINCT conv_id) FROM conversations) AS chats, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS messages")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return analytics.dashboard_counts({"users": table(spark, sf_dir, "customer"), "chats": turns.select("conv_id").distinct(), "documents": table(spark, sf_dir, "documents"), "messages": turns})


@query(f"WITH {MESSAGES} SELECT username, count(*) AS messages FROM messages WHERE role = 'user' GROUP BY username ORDER BY messages DESC, username LIMIT 10")
def top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_users(stored_messages(spark, sf_dir))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY day")
def messages_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.per_day(table(spark, sf_dir, "events"), "ts", F.lit(AS_OF).cast("timestamp"), 14).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT count(*) AS recent FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def recent_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.recent_rows(table(spark, sf_dir, "events").where("event_type = 'signup'"), "ts", F.lit(AS_OF).cast("timestamp"), 7)


REQUESTS = "r AS (SELECT CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 11 = 0 THEN 429 ELSE 200 END AS status, 'GET /' || event_type AS endpoint, event_id % 13 = 0 AS fallback FROM events)"


@query(f"WITH {REQUESTS} SELECT 'total' AS metric, 'requests' AS name, count(*) AS n FROM r UNION ALL SELECT 'status', status::VARCHAR, count(*) FROM r GROUP BY status UNION ALL SELECT 'endpoint', endpoint, count(*) FROM r GROUP BY endpoint UNION ALL SELECT 'total', 'fallbacks', count(*) FROM r WHERE fallback UNION ALL SELECT 'total', 'throttled', count(*) FROM r WHERE status = 429")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 11 == 0, 429).otherwise(200)
    return analytics.request_metrics(table(spark, sf_dir, "events").select(status.alias("status"), F.concat(F.lit("GET /"), "event_type").alias("endpoint"), (F.col("event_id") % 13 == 0).alias("fallback")))


@query("""WITH r AS (SELECT event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS ms FROM events), p AS (SELECT event_type, ms, row_number() OVER (PARTITION BY event_type ORDER BY ms) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM r WHERE ms IS NOT NULL)
SELECT event_type, runs, successes, mean, median, p95 FROM (SELECT event_type, count(*) AS runs, count(ms) AS successes, round(avg(ms), 6) AS mean, median(ms) AS median FROM r GROUP BY event_type) LEFT JOIN (SELECT event_type, ms AS p95 FROM p WHERE i = floor(0.95 * (n - 1)) + 1) USING (event_type)""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("ms"))
    return analytics.latency_summary(runs, "event_type", "ms").withColumn("mean", F.round("mean", 6))


# --- sequential state ---


@query("""WITH RECURSIVE a AS (SELECT event_id, user_id AS k, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, k, i, [sec] AS log, true AS allowed, 0::BIGINT AS retry_after FROM a WHERE i = 1 UNION ALL
SELECT a.event_id, a.k, a.i, CASE WHEN len(f) < 3 THEN list_append(f, a.sec) ELSE f END, len(f) < 3, CASE WHEN len(f) < 3 THEN 0 ELSE greatest(1, trunc(f[1] + 3600 - a.sec))::BIGINT END FROM (SELECT s.k, s.i, s.log FROM s) s JOIN a ON a.k = s.k AND a.i = s.i + 1, LATERAL (SELECT list_filter(s.log, lambda x: x > a.sec - 3600) AS f))
SELECT event_id, allowed, retry_after FROM s""")
def rate_limit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return state.rate_limit(events, 3, 3600.0)


def _job_events(events: DataFrame) -> DataFrame:
    kinds = {"view": "progress", "click": "claim", "error": "fail", "purchase": "complete", "signup": "queue"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("event_no"), F.when((kind == "queue") & (F.col("event_id") % 2 == 0), "retry").otherwise(kind).alias("kind"), F.floor("value").cast("int").alias("progress"), F.floor(F.col("value") / 2).cast("long").alias("chunks"), F.when(kind == "fail", F.col("props")).alias("detail"), F.col("ts").cast("timestamp").alias("ts"))


@query("""SELECT job_id, status, retry_count, chunks FROM (SELECT user_id AS job_id, max_by(CASE WHEN event_type = 'view' OR event_type = 'click' THEN 'processing' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' ELSE 'queued' END, event_id) AS status, (count(*) FILTER (event_type = 'signup' AND event_id % 2 = 0))::INT AS retry_count, greatest(0, max(floor(value / 2)))::BIGINT AS chunks FROM events GROUP BY user_id)""")
def job_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.job_snapshot(_job_events(table(spark, sf_dir, "events"))).select("job_id", "status", "retry_count", "chunks")


@query(ORACLES["job_snapshot"])
def job_snapshot_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.folded_jobs(spark, sf_dir, _job_events).select("job_id", "status", "retry_count", "chunks")


query(ORACLES["rate_limit_replay"])(feeds.rate_limit_live)


@query(f"""WITH RECURSIVE {MESSAGES}, a AS (SELECT message_id, chat_id, epoch(created_at) AS sec, message_id % 3 = 0 AS unclear, regexp_matches(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), {quoted(rules.DOCUMENT_NUMBER)}) OR message_id % 4 = 0 AS selects, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, message_id) AS i FROM messages WHERE role = 'user'),
s AS (SELECT message_id, chat_id, i, CASE WHEN unclear AND NOT selects THEN sec END AS waits, CASE WHEN unclear AND NOT selects THEN 'waiting' ELSE 'plain' END AS outcome FROM a WHERE i = 1 UNION ALL
SELECT a.message_id, a.chat_id, a.i, CASE WHEN (s.waits IS NULL OR a.sec - s.waits > 900) AND unclear AND NOT selects THEN a.sec END, CASE WHEN s.waits IS NOT NULL AND a.sec - s.waits <= 900 THEN CASE WHEN selects THEN 'resolved' ELSE 'cleared' END WHEN unclear AND NOT selects THEN 'waiting' ELSE 'plain' END FROM s JOIN a ON a.chat_id = s.chat_id AND a.i = s.i + 1)
SELECT message_id, outcome FROM s""")
def pending_scope_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = stored_messages(spark, sf_dir).where("role = 'user'")
    folded = text.fold_text("text")
    return state.pending_scopes(said.select("message_id", "chat_id", F.unix_timestamp("created_at").alias("at"), (F.col("message_id") % 3 == 0).alias("ambiguous"), (text.matches(folded, rules.DOCUMENT_NUMBER) | (F.col("message_id") % 4 == 0)).alias("selects")))


@query("""WITH RECURSIVE a AS (SELECT event_id, user_id * 10 + (event_id % 3) AS k, floor(epoch(ts)) AS sec, row_number() OVER (PARTITION BY user_id * 10 + (event_id % 3) ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
s AS (SELECT event_id, k, i, sec AS stored, false AS reused FROM a WHERE i = 1 UNION ALL SELECT a.event_id, a.k, a.i, CASE WHEN a.sec - s.stored < 20000 THEN s.stored ELSE a.sec END, a.sec - s.stored < 20000 FROM s JOIN a ON a.k = s.k AND a.i = s.i + 1)
SELECT event_id AS ask_id, reused FROM s""")
def answer_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("ask_id"), (F.col("user_id") * 10 + F.col("event_id") % 3).alias("key"), F.unix_timestamp("ts").alias("at"))
    return state.answer_memo(asked, 20_000)


query(ORACLES["answer_memo"])(feeds.answer_memo_live)


# --- outlines ---


@query()
def outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.outline_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline rows: nations of regions as branches, their first suppliers as children."""
    held = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    first = held.groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.slice(F.array_sort(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), F.struct("s_suppkey", "s_name")))), 1, 4).alias("s"))
    return first.select(F.col("n_regionkey").alias("id"), F.col("n_nationkey").cast("int").alias("branch_no"), F.col("n_name").alias("branch"), F.transform("s", lambda x: x["s_name"]).alias("children"))


@query("""WITH c AS (SELECT n_regionkey AS id, n_nationkey AS no, n_name AS b, coalesce(list(s_name ORDER BY s_suppkey) FILTER (s_name IS NOT NULL), [])[1:4] AS l FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY no) AS i FROM c),
t AS (SELECT r.*, 'Tổng quan ' || r_name AS root FROM r JOIN region ON r_regionkey = id)
SELECT id, string_agg('- **' || b || '**' || CASE WHEN len(l) > 0 THEN ': ' || array_to_string(l[1:2], ', ') ELSE '' END, chr(10) ORDER BY i) FILTER (i <= 6) AS bullets,
CASE WHEN count(*) >= 2 THEN '| Chủ đề | Điểm chính |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || b || ' | ' || CASE WHEN len(l) > 0 THEN array_to_string(l[1:3], ', ') ELSE 'Nội dung chính trong tài liệu' END || ' |', chr(10) ORDER BY i) FILTER (i <= 8) END AS "table",
'```mermaid' || chr(10) || 'flowchart TD' || chr(10) || '  R["' || any_value(root) || '"]' || chr(10) || string_agg('  R --> B' || i || '["' || b || '"]' || array_to_string(list_transform(l[1:2], lambda x, j: chr(10) || '  B' || i || ' --> B' || i || '_' || j || '["' || x || '"]'), ''), chr(10) ORDER BY i) FILTER (i <= 6) || chr(10) || '```' AS flowchart,
'```mermaid' || chr(10) || 'mindmap' || chr(10) || '  root((' || any_value(root) || '))' || chr(10) || string_agg('    ' || b || array_to_string(list_transform(l[1:2], lambda x: chr(10) || '      ' || x), ''), chr(10) ORDER BY i) FILTER (i <= 6) || chr(10) || '```' AS mindmap,
'```mermaid' || chr(10) || 'timeline' || chr(10) || '  title ' || any_value(root) || chr(10) || string_agg('  ' || b || ' : ' || CASE WHEN len(l) > 0 THEN array_to_string(l[1:2], ' | ') ELSE 'Noi dung chinh' END, chr(10) ORDER BY i) FILTER (i <= 6) || chr(10) || '```' AS timeline,
'```mermaid' || chr(10) || 'pie showData' || chr(10) || '  title ' || any_value(root) || chr(10) || string_agg('  "' || b || '" : ' || greatest(1, least(2, len(l))), chr(10) ORDER BY i) FILTER (i <= 6) || chr(10) || '```' AS pie,
'```mermaid' || chr(10) || 'mindmap' || chr(10) || '  root((' || any_value(root) || '))' || chr(10) || string_agg('    ' || b || array_to_string(list_transform(l, lambda x: chr(10) || '      ' || x), ''), chr(10) ORDER BY i) FILTER (i <= 8) || chr(10) || '```' AS wide_mindmap
FROM t GROUP BY id""")
def render_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("Tổng quan "), "r_name").alias("root"))
    return outline.render_outline(_branch_names(spark, sf_dir), roots)


@query("""SELECT l_orderkey AS id, '```mermaid' || chr(10) || 'flowchart LR' || chr(10) || 'A[x] -->|' || l_linestatus || '| B[y]' || chr(10) || 'B ==>|' || l_returnflag || '| C(z)' || chr(10) || '```' || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || l_linenumber || ' |' AS answer FROM lineitem WHERE l_linenumber = 1""")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    drawn = F.concat(F.lit("```mermaid\ngraph LR\nA[x] --> "), "l_linestatus", F.lit(" > B[y]  B ==> | "), "l_returnflag", F.lit(" |> C(z)\n```\n| a | b |\n| 1 | "), F.col("l_linenumber").cast("string"), F.lit(" |"))
    return rows.select(F.col("l_orderkey").alias("id"), outline.repair_answer(drawn).alias("answer"))


@query("""SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' is ' || o_orderstatus || chr(10) || chr(10) || '- of ' || o_custkey AS answer FROM orders""")
def stripped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("```mermaid\nmindmap\n  root\n```\nOrder "), F.col("o_orderkey").cast("string"), F.lit(" is "), "o_orderstatus", F.lit("\nB1[box]\nsubgraph s\nend\nx <-- y\n%%c\n```text\nA --> B\nB --> C\n```\n\ngraph TD\n\nA --> B\n- of "), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), outline.strip_diagrams(said).alias("answer"))


@query()
def post_process_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as answers to asked and mapped questions, with a benchmark item as context."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").agg(F.min_by("text", "item_id").alias("text"))
    asked = F.when(F.col("doc_id") % 2 == 0, "mindmap").otherwise("compare the risks")
    said = docs.select(F.col("doc_id").alias("qid"), asked.alias("question"), F.col("text").alias("answer"))
    context = docs.select(F.col("doc_id").alias("qid"), F.lit(1).alias("place"), "source").crossJoin(F.broadcast(items))  # one row
    return outline.post_process_answers(said, context)


@query(r"""SELECT doc_id, coalesce(regexp_matches(text, '(?m)^[ \t]*\|.+\|[ \t]*\n[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$'), false) AS has_table, coalesce(regexp_matches(text, '(?m)^[ \t]*([-*•]|\d+[.)])[ \t]+\S'), false) AS has_bullets FROM documents""")
def markdown_table_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.has_table(F.col("text")).alias("has_table"), text.has_bullets(F.col("text")).alias("has_bullets"))


@query(r"""WITH l AS (SELECT item_id, regexp_replace(trim(regexp_replace(regexp_replace(text, '[`*_#>\[\](){}|"\\/<]', ' ', 'g'), '\s+', ' ', 'g')), '^[ \-:;,._\t]+|[ \-:;,._\t]+$', '', 'g') AS p FROM benchmark) SELECT item_id, CASE WHEN length(p) > 64 THEN rtrim(left(p, 61)) || '...' ELSE p END AS label FROM l""")
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.clean_label(F.col("text")).alias("label"))


@query("SELECT qid, string_agg('**' || label || '**' || chr(10) || answer, chr(10) || chr(10) ORDER BY number) AS answer, list_sort(list_distinct(list(source))) AS sources FROM (SELECT doc_id // 20 AS qid, doc_id AS number, lang AS label, text AS answer, source FROM documents) GROUP BY qid")
def compose_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("qid"), F.col("doc_id").alias("number"), F.col("lang").alias("label"), F.col("text").alias("answer"), F.array("source").alias("sources"))
    return answers.compose_per_document(parts).withColumn("sources", F.array_sort("sources"))


# --- small workspace functions over whole tables ---


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 5 + floor((event_id % 50) / 49 * 25) WHEN 'click' THEN 35 WHEN 'error' THEN 40 + floor((event_id % 50) / 49 * 55) WHEN 'purchase' THEN 98 ELSE 100 END::INT AS percent FROM events""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {"view": "loading", "click": "chunking", "error": "indexing", "purchase": "saving"}
    stage = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in stages.items()], F.lit("completed"))
    return table(spark, sf_dir, "events").select("event_id", text.progress_percent(stage, F.col("event_id") % 50, F.lit(49)).alias("percent"))


@query("""WITH n AS (SELECT source, doc_id // 100 AS chat, array_to_string(list(doc_id || '.txt' ORDER BY doc_id), chr(1)) AS l, count(*) AS k FROM documents GROUP BY ALL)
SELECT source, chat, CASE WHEN k > 1 THEN 'Compare.' || chr(10) || chr(10) || array_to_string(list_transform(string_split(l, chr(1)), lambda x, i: i || '. ' || x), chr(10)) ELSE 'Compare.' END AS question FROM n""")
def annotated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: F.concat(i.cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 100").alias("chat")).agg(names.alias("names")).select("source", "chat", text.annotate_question(F.lit("Compare."), F.col("names")).alias("question"))


@query(r"""WITH j AS (SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'queued' END AS status, try_cast(regexp_extract(props, '(\d+)', 1) AS INT) AS p, (event_id % 5)::INT AS retry_count FROM events)
SELECT job_id, status, least(100, greatest(0, coalesce(p, 0))) AS progress, 0 AS files_total, retry_count, 3 AS max_retries, status = 'failed' AND retry_count < 3 AS can_retry FROM j""")
def normalized_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", " FAILED").when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), F.nullif(F.regexp_extract("props", r"(\d+)", 1), F.lit("")).alias("progress"), F.lit("many").alias("files_total"), (F.col("event_id") % 5).cast("string").alias("retry_count"), F.lit(None).cast("string").alias("max_retries"))
    return workspace.normalize_jobs(raw)


@query(f"""WITH {FILES} SELECT username, chat_id, document_id || '.txt' AS name, 100 AS progress, false AS pending FROM files WHERE document_id % 4 <> 0 UNION ALL SELECT username, chat_id, document_id || '.txt', least(99, document_id % 150)::INT, true FROM files WHERE document_id % 4 = 0""")
def upload_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored_files(spark, sf_dir).withColumn("name", F.concat(F.col("document_id").cast("string"), F.lit(".txt")))
    jobs = files.where("document_id % 4 = 0").select("username", "chat_id", F.lit("processing").alias("status"), F.array("name").alias("original_names"), (F.col("document_id") % 150).cast("int").alias("progress"))
    return workspace.upload_listing(files.where("document_id % 4 <> 0"), jobs)


@query(f"""WITH {FILES} SELECT document_id AS job_id, CASE WHEN document_id % 7 = 0 THEN 'no owner or chat' WHEN document_id % 5 = 0 THEN 'no files' WHEN document_id % 3 = 0 THEN 'missing files: /up/' || document_id END AS error FROM files""")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored_files(spark, sf_dir)
    path, n = F.concat(F.lit("/up/"), F.col("document_id").cast("string")), F.col("document_id")
    jobs = files.select(n.alias("job_id"), F.when(n % 7 != 0, F.col("username")).alias("username"), "chat_id", F.when(n % 5 != 0, F.array(path)).otherwise(F.array().cast("array<string>")).alias("file_paths"))
    return workspace.payload_errors(jobs, files.where("document_id % 3 <> 0").select(path.alias("path")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
