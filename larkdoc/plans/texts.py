"""Queries of the small text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.functions import rules, text
from larkdoc.operators import answers, outline, workspace
from larkdoc.plans.tables import query, quoted, strip_sql, table, tokens_sql

#: Lines of orders: a few of each, so that what is joined of them stays small however many orders there are.
LINES = "li AS (SELECT l_orderkey AS id, l_linenumber AS no, 'part-' || l_partkey || '.txt' AS name, l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS i FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with i, their place in their order by (line, part, supplier)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), "l_partkey", "l_suppkey", "l_returnflag")
    named = rows.withColumn("name", F.concat(F.lit("part-"), F.col("l_partkey").cast("string"), F.lit(".txt")))
    return workspace.numbered(named, ["id"], ["no", "l_partkey", "l_suppkey"], "i")


def _named_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("i", "name")))
    return _lines(spark, sf_dir).groupBy("id").agg(F.transform(rows, lambda x: x["name"]).alias("names"))


NAMED = "n AS (SELECT id, count(*) AS k, string_agg(i || '. ' || name, chr(10) ORDER BY i) AS l FROM li GROUP BY id)"


@query(f"WITH {LINES}, {NAMED} SELECT id, CASE WHEN k > 1 THEN 'Compare.' || chr(10) || chr(10) || l ELSE 'Compare.' END AS question FROM n")
def order_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_orders(spark, sf_dir).select("id", text.annotate_question(F.lit("Compare."), F.col("names")).alias("question"))


@query(f"WITH {LINES}, {NAMED} SELECT id, 'Which document do you mean?' || chr(10) || l AS prompt FROM n")
def clarifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_orders(spark, sf_dir).select("id", text.clarification_text(F.col("names")).alias("prompt"))


@query(f"""WITH {LINES}, p AS (SELECT *, CASE WHEN l_suppkey % 9 = 0 THEN {quoted(rules.FALLBACK_ANSWER)} ELSE 'answer ' || i END AS answer FROM li), s AS (SELECT id, l_returnflag, min(i) AS i FROM p GROUP BY ALL),
o AS (SELECT id, list(l_returnflag ORDER BY i) AS sources FROM s GROUP BY id)
SELECT id AS qid, string_agg('**' || name || '**' || chr(10) || answer, chr(10) || chr(10) ORDER BY i) AS answer, any_value(sources) AS sources FROM p JOIN o USING (id) GROUP BY id""")
def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("answer "), F.col("i").cast("string")))
    return answers.compose_per_document(_lines(spark, sf_dir).select(F.col("id").alias("qid"), F.col("i").alias("number"), F.col("name").alias("label"), said.alias("answer"), F.array("l_returnflag").alias("sources")))


@query(f"WITH {LINES} SELECT id, string_agg('[' || i || '] source=' || name || CASE WHEN l_suppkey % 2 = 0 THEN ' | page=' || l_suppkey ELSE '' END || chr(10) || l_returnflag, chr(10) || chr(10) ORDER BY i) AS context FROM li GROUP BY id")
def order_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("id", "i", F.col("name").alias("source"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("page"), F.col("l_returnflag").alias("text"))
    return rows.groupBy("id").agg(text.format_context(F.array_sort(F.collect_list(F.struct("i", "source", "page", "text")))).alias("context"))


@query(f"""WITH {LINES}, b AS (SELECT id, 0 AS side, i, 'P' || (l_partkey % 3) AS branch, 'S' || (l_suppkey % 5) AS child FROM li UNION ALL SELECT id, 1, i, 'P' || (l_partkey % 4), 'T' || (l_suppkey % 3) FROM li),
f AS (SELECT id, branch, min((side, i)) AS pos FROM b GROUP BY ALL), c AS (SELECT id, branch, child, min((side, i)) AS pos FROM b GROUP BY ALL),
l AS (SELECT id, branch, list(child ORDER BY pos)[1:4] AS children FROM c GROUP BY ALL)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INT AS branch_no, branch, children FROM f JOIN l USING (id, branch) QUALIFY branch_no < 10""")
def merged_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)

    def side(branches: int, letter: str, children: int) -> DataFrame:
        name = lambda prefix, key, n: F.concat(F.lit(prefix), (F.col(key) % n).cast("string"))
        return rows.select("id", F.col("i").alias("branch_no"), name("P", "l_partkey", branches).alias("branch"), F.array(name(letter, "l_suppkey", children)).alias("children"))

    return outline.merge_outlines(side(3, "S", 5), side(4, "T", 3))


@query(f"SELECT doc_id, coalesce(regexp_replace(lower({strip_sql('answer')}), '\\.+$', '') = {quoted(rules.FALLBACK_ANSWER.lower())}, false) AS fallback FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  ' || upper({quoted(rules.FALLBACK_ANSWER)}) || '...' WHEN 1 THEN {quoted(rules.FALLBACK_ANSWER)} || ' x' WHEN 2 THEN text ELSE {quoted(rules.FALLBACK_ANSWER)} END AS answer FROM documents)")
def fallback_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, spare = F.col("doc_id") % 4, F.lit(rules.FALLBACK_ANSWER)
    said = F.when(kind == 0, F.concat(F.lit("  "), F.upper(spare), F.lit("..."))).when(kind == 1, F.concat(spare, F.lit(" x"))).when(kind == 2, F.col("text")).otherwise(spare)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.is_fallback(said), F.lit(False)).alias("fallback"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN [event_type, props] WHEN 1 THEN [] ELSE CASE WHEN event_id % 2 = 0 THEN [] ELSE ['x'] END END AS list FROM events")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    held = F.when(kind == 0, F.to_json(F.array("event_type", "props"))).when(kind == 1, F.lit("[oops")).when(F.col("event_id") % 2 != 0, F.lit('["x"]'))
    return table(spark, sf_dir, "events").select("event_id", text.json_string_list(held).alias("list"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.iso_time(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT event_id, CASE WHEN event_type = 'view' OR message IS NULL THEN 'The file could not be read.' WHEN event_type = 'error' THEN 'Install the model.' ELSE message END AS message FROM (SELECT event_id, event_type, 'no reader: ' || props AS message FROM events)")
def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    message = F.when(kind == "view", F.lit(" \n")).when(kind == "error", F.concat(F.lit("model missing: "), F.coalesce(props, F.lit("?")))).otherwise(F.concat(F.lit("no reader: "), props))
    return table(spark, sf_dir, "events").select("event_id", text.ingest_error_text(message, {"model missing": "Install the model."}).alias("message"))


@query("SELECT event_id, event_type AS branch, CASE WHEN event_id % 3 < 2 THEN user_id || ': ' || event_id END AS child FROM events")
def branch_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, " ： ").when(F.col("event_id") % 3 == 1, ":").otherwise(F.lit("")), F.when(F.col("event_id") % 3 < 2, F.concat(F.col("user_id").cast("string"), F.lit(": "), F.col("event_id").cast("string"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", text.split_branch_child(said).alias("x")).select("event_id", "x.branch", "x.child")


def _flag(pattern: str, column: str = "question") -> str:
    return f"regexp_matches({column}, {quoted('(?i)(?:' + pattern + ')')})"


ASKED = ("compare the parts", "who is it", "the risk of it", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "and then")


@query(f"""WITH a AS (SELECT doc_id, text AS answer, [{', '.join(map(quoted, ASKED))}][doc_id % {len(ASKED)} + 1] AS question FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, len(list_distinct({tokens_sql('question')})) AS asked, len(list_distinct({tokens_sql('answer')})) AS said, regexp_matches(answer, '(?m)^[ \\t]*\\|.+\\|[ \\t]*\\n[ \\t]*\\|?[ \\t]*:?-{{3,}}:?[ \\t]*(\\|[ \\t]*:?-{{3,}}:?[ \\t]*)+\\|?[ \\t]*$') OR regexp_matches(answer, '(?i)```mermaid') AS drawn FROM a)
SELECT doc_id, CASE WHEN {_flag(rules.VISUAL)} THEN true WHEN {_flag(rules.SIMPLE_FACT)} THEN false WHEN drawn THEN said >= 45 ELSE ({_flag(rules.COMPLEX)} AND said >= 35) OR (asked >= 14 AND said >= 55) END AS enrich FROM s""")
def enriched_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.get(F.array(*map(F.lit, ASKED)), (F.col("doc_id") % len(ASKED)).cast("int"))
    rows = table(spark, sf_dir, "documents").where("text is not null")  # an answer that isn't there has no flag
    return rows.select("doc_id", outline.should_enrich(question, F.col("text")).alias("enrich"))


@query(f"SELECT doc_id, CASE WHEN coalesce({strip_sql('title')}, '') = '' THEN 'New chat' ELSE {strip_sql('title')} END AS title FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE ' ' || left(text, 40) END AS title FROM documents)")
def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.substring("text", 1, 40)))
    return table(spark, sf_dir, "documents").select("doc_id", text.title_or_default(title, "New chat").alias("title"))


@query("SELECT doc_id, CASE WHEN regexp_full_match(session, '[A-Za-z0-9_-]{8,64}') THEN '__guest__-' || session END AS username FROM (SELECT doc_id, left(repeat(md5(doc_id::VARCHAR), 3), (doc_id % 80)::INT) || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END AS session FROM documents)")
def guest_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.concat(F.substring(F.repeat(F.md5(F.col("doc_id").cast("string")), 3), F.lit(1), (F.col("doc_id") % 80).cast("int")), F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", workspace.guest_identity(session).alias("username"))


@query(f"SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 1 THEN 'question is empty' WHEN length(text) > 2000 THEN 'question is too long' WHEN doc_id % 25 < 1 OR doc_id % 25 > {rules.MAX_TOP_K} THEN 'top_k is out of range' END AS error FROM documents")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), (F.col("doc_id") % 25).alias("top_k"))
    return workspace.request_errors(asked).select("doc_id", "error")


CUTS = {"title": 260, "name": 300, "username": 80, "password": 150}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN least(length(coalesce(text, '')), doc_id % {CUTS[f]}) < {a} THEN '{f} is too short' WHEN least(length(coalesce(text, '')), doc_id % {CUTS[f]}) > {b} THEN '{f} is too long'" for f, (a, b) in rules.FIELD_LENGTHS.items()) + " END AS error FROM documents")
def field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = docs.select("doc_id", *[F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % n).cast("int")).alias(f) for f, n in CUTS.items()])
    return workspace.field_errors(given).select("doc_id", "error")


@query("SELECT item_id, sha256('{\"f\":' || to_json('s' || (item_id % 3)) || ',\"k\":' || (item_id % 9) || ',\"q\":' || to_json(left(text, 30)) || ',\"rq\":' || to_json(text) || '}') AS key FROM benchmark")
def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.question_key(F.col("text"), F.substring("text", 1, 30), scope, F.col("item_id") % 9).alias("key"))
