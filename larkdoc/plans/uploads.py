"""Queries of files and the vector index: extraction, ingest, scoped search, backup and restore."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.functions import text
from larkdoc.operators import vectors, workspace
from larkdoc.operators.common import scratch, shared_dir
from larkdoc.plans.tables import ORACLES, asked_questions, query, table
from larkdoc.sources import extract
from larkdoc.sources.index import ChunkIndex


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, extension, content): rows of several tables as files, one format a table, and broken ones among them."""
    documents, orders, customers, suppliers, parts = (table(spark, sf_dir, name) for name in ("documents", "orders", "customer", "supplier", "part"))
    name = lambda key: F.col(key).cast("string")

    def files(rows: DataFrame, key: str, extension: str, body) -> DataFrame:
        return rows.select(F.concat(F.lit(f"/up/{extension[1:]}-"), name(key), F.lit(extension)).alias("path"), F.lit(extension).alias("extension"), F.encode(body, "UTF-8").alias("content"))

    table_body = F.concat(F.lit("key, prio ,\r\n,,\n"), name("o_orderkey"), F.lit(',  "'), "o_orderpriority", F.lit(', x"\n'))
    object_body = F.when(F.col("c_custkey") % 9 == 0, F.lit("{")).otherwise(F.concat(F.lit('{"n": {"name": "'), "c_name", F.lit('"}, "t": ["'), "c_mktsegment", F.lit('", '), name("c_nationkey"), F.lit("]}")))
    tree_body = F.concat(F.lit("<s><k>"), name("s_suppkey"), F.lit("</k> <e/><n> "), "s_name", F.lit(" </n>tail</s>"))
    page_body = F.concat(F.lit("<html><nav>x</nav><p> "), "p_name", F.lit("</p><script>y</script><b>"), "p_type", F.lit("</b></html>"))
    old_body = F.concat(F.lit("\x01\x02\x03\r~~~~~~~~\r"), "p_name", F.lit("  of  "), "p_type", F.lit("\rab\r"))
    plain_body = F.concat(F.coalesce("text", F.lit(" ")), F.lit("\r\nend"))
    made = [files(documents, "doc_id", ".txt", plain_body), files(orders, "o_orderkey", ".csv", table_body), files(customers, "c_custkey", ".json", object_body), files(suppliers, "s_suppkey", ".xml", tree_body), files(parts, "p_partkey", ".html", page_body), files(parts, "p_partkey", ".doc", old_body)]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


@query("""SELECT '/up/txt-' || doc_id || '.txt' AS path, coalesce(text, ' ') || chr(10) || 'end' AS text, false AS rejected FROM documents UNION ALL
SELECT '/up/csv-' || o_orderkey || '.csv', 'key, prio, ' || chr(10) || o_orderkey || ', "' || o_orderpriority || ', x"', false FROM orders UNION ALL
SELECT '/up/json-' || c_custkey || '.json', CASE WHEN c_custkey % 9 <> 0 THEN 'n.name: ' || c_name || chr(10) || 't[0]: ' || c_mktsegment || chr(10) || 't[1]: ' || c_nationkey END, c_custkey % 9 = 0 FROM customer UNION ALL
SELECT '/up/xml-' || s_suppkey || '.xml', 'k: ' || s_suppkey || chr(10) || 'n: ' || s_name || chr(10) || 'tail', false FROM supplier UNION ALL
SELECT '/up/html-' || p_partkey || '.html', p_name || chr(10) || p_type, false FROM part UNION ALL
SELECT '/up/doc-' || p_partkey || '.doc', p_name || '  of  ' || p_type, false FROM part""")
def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, rejects = extract.extract_rows(_bytes(spark, sf_dir))
    return rows.select("path", "text", F.lit(False).alias("rejected")).unionByName(rejects.select("path", F.lit(None).cast("string").alias("text"), F.lit(True).alias("rejected")))


@query(ORACLES["extracted_files"])
def extracted_files_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extracted_files`` by SQL, with the table function for the formats that need Python."""
    extract.register_extractor(spark)
    files = _bytes(spark, sf_dir)
    python = files.where(F.col("extension").isin(*extract.EXTRACTORS))
    found = spark.sql("SELECT f.path, x.text, x.error FROM {files} f, LATERAL extract_file(f.extension, f.content) x", files=python)
    plain = files.where(~F.col("extension").isin(*extract.EXTRACTORS))
    body = F.when(F.col("extension") == ".doc", extract.scraped(F.col("content"))).otherwise(extract.decoded(F.col("content")))
    rows = found.unionByName(plain.select("path", body.alias("text"), F.lit(None).cast("string").alias("error")))
    return rows.where(F.col("error").isNotNull() | ~text.is_blank(F.col("text"))).select("path", "text", F.col("error").isNotNull().alias("rejected"))


@query("""WITH f AS (SELECT '/up/json-' || c_custkey || '.json' AS path, CASE WHEN c_custkey % 9 = 0 THEN '{' ELSE '{"n": {"name": "' || c_name || '"}, "t": ["' || c_mktsegment || '", ' || c_nationkey || ']}' END AS body, c_custkey % 9 = 0 AS bad FROM customer)
SELECT 'document' AS kind, path, path[5:] AS name, sha256(body) AS file_hash, strlen(body)::BIGINT AS n, 'ann' AS owner FROM f WHERE NOT bad UNION ALL SELECT 'job', path, CASE WHEN bad THEN 'failed' ELSE 'completed' END, NULL, 0, NULL FROM f UNION ALL
SELECT 'chunk', path, NULL, NULL, 0, 'ann' FROM f WHERE NOT bad UNION ALL SELECT 'files', NULL, NULL, NULL, count(*), NULL FROM f UNION ALL SELECT 'chunks', NULL, NULL, NULL, count(*) FILTER (NOT bad), NULL FROM f""")
def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bytes(spark, sf_dir).where("extension = '.json'")
    documents, chunks, jobs, result = extract.ingest(files, {"owner": "ann"}, vectors.hash_embedding)
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    def row(rows: DataFrame, kind: str, **given) -> DataFrame:
        spare = {"path": none, "name": none, "file_hash": none, "n": zero, "owner": none}
        return rows.select(F.lit(kind).alias("kind"), *[given.get(c, d).alias(c) for c, d in spare.items()])

    path, owner = F.col("path"), F.col("owner")
    made = row(documents, "document", path=path, name=F.col("name"), file_hash=F.col("file_hash"), n=F.col("file_size"), owner=owner).unionByName(row(jobs, "job", path=path, name=F.col("status")))
    made = made.unionByName(row(chunks, "chunk", path=path, n=F.col("chunk_index").cast("long"), owner=owner))
    return made.unionByName(row(result, "files", n=F.col("files_processed"))).unionByName(row(result, "chunks", n=F.col("chunks_indexed")))


def _embedded(column: str) -> str:
    return f"list_transform(range(256), lambda i: ('0x' || substr(array_to_string(list_transform(range(8), lambda c: sha256({column} || c)), ''), 2 * i + 1, 2))::INT / 255.0::DOUBLE)"


@query(f"""WITH c AS (SELECT doc_id AS vec_id, {_embedded('text')} AS e FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 1 AND lang = 'en' AND doc_id % 5 IN (0, 2, 3)), q AS (SELECT item_id AS qid, {_embedded("coalesce(text, '')")} AS e FROM benchmark),
d AS (SELECT qid, vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM q, c)
SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id)::INT AS rank FROM d QUALIFY rank <= 3""")
def scoped_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.concat(F.lit("o"), (F.col("doc_id") % 3).cast("string")).alias("owner"), F.col("lang").alias("chat_id"), F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")).alias("source"), vectors.hash_embedding(F.col("text")).alias("embedding"))
    asked = asked_questions(spark, sf_dir).select("qid", vectors.hash_embedding(F.col("question")).alias("embedding"))
    index = ChunkIndex(spark, scratch(spark, "scopes"), ("owner", "chat_id"))
    index.write(held)
    return index.search(asked, 3, workspace.scope_filter("o1", "en", ["f0", "f2", "", "f3", "f0"])).select("qid", "vec_id", "rank")


@query("SELECT doc_id, [length(coalesce(text, ''))::FLOAT, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::FLOAT] AS embedding FROM documents")
def model_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = vectors.embed_with(lambda: lambda texts: [[len(t), t.count(" ")] for t in texts])
    return table(spark, sf_dir, "documents").select("doc_id", embed("text").alias("embedding"))


@query("""WITH n AS (SELECT count(*) AS a, count(*) FILTER (vec_id % 3 = 0) AS first_part, count(*) FILTER (label IN (1, 3)) AS gone FROM embeddings)
SELECT unnest(['first', 'second', 'deleted', 'backed_up', 'cleared', 'restored', 'status', 'overwritten']) AS step, unnest([first_part, a - first_part, gone, a - gone, 0, a - gone, a - gone, first_part]) AS n FROM n""")
def backup_restore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all embeddings in the shared folder: appended in two parts, cut, backed up, cleared, restored, overwritten."""
    root = f"{shared_dir(spark)}/larkdoc-index-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    index, held = ChunkIndex(spark, f"{root}/index"), table(spark, sf_dir, "embeddings")
    steps = [("first", index.append(held.where("vec_id % 3 = 0"))), ("second", index.append(held.where("vec_id % 3 <> 0"))), ("deleted", index.delete({"label": [1, 3]}))]
    steps.append(("backed_up", index.backup(f"{root}/backups", "1").first()["document_count"]))
    index.clear()
    steps.append(("cleared", index.count()))
    steps.append(("restored", index.restore_latest(f"{root}/backups").first()["document_count"]))
    steps.append(("status", index.status(f"{root}/backups").first()["document_count"]))
    steps.append(("overwritten", index.append(held.where("vec_id % 3 = 0"), overwrite=True)))
    return spark.createDataFrame(steps, "step string, n long")
