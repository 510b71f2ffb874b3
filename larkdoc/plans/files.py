"""Queries of office files, folders of files, users' files, chunks under sparse ids and answers by a user's function."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.operators import answers, chunking, workspace
from larkdoc.operators.common import scratch, spread, written_by_key
from larkdoc.plans.tables import asked_questions, query, table
from larkdoc.sources import extract

#: Files that a task makes or reads.
FILES_A_TASK = 500


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in members.items():
            archive.writestr(name, body)
    return out.getvalue()


def _document(name: str, kind: str) -> bytes:
    cells = "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in ("type", kind))
    said = f"<w:p><w:r><w:t>{name}</w:t></w:r><w:r><w:t>!</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cells}</w:tr></w:tbl>"
    return _zipped({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{said}</w:body></w:document>'})


def _slides(name: str, kind: str) -> bytes:
    slide = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:sp><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sp></p:sld>'
    return _zipped({"ppt/slides/slide10.xml": slide.format(kind), "ppt/slides/slide2.xml": slide.format(name), "ppt/slides/slide3.xml": slide.format("")})


def _sheets(name: str, kind: str) -> bytes:
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="First" r:id="a"/><sheet name="None" r:id="b"/></sheets></workbook>'
    links = '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="worksheets/two.xml"/></Relationships>'
    rows = f'<worksheet><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row/><row><c t="inlineStr"><is><t>{kind}</t></is></c></row></worksheet>'
    return _zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "xl/sharedStrings.xml": f"<sst><si><t>{name}</t></si></sst>", "xl/worksheets/one.xml": rows, "xl/worksheets/two.xml": "<worksheet><row/></worksheet>"})


@F.pandas_udf(T.BinaryType())
def _office(extension: pd.Series, name: pd.Series, kind: pd.Series) -> pd.Series:
    makers = {".docx": _document, ".pptx": _slides, ".xlsx": _sheets}
    return pd.Series([makers[e](n, k) if n[0] > "b" else b"broken" for e, n, k in zip(extension, name, kind, strict=True)])


@query("""WITH f AS (SELECT p_partkey, p_name, p_type, left(p_name, 1) > 'b' AS good, e FROM part, (VALUES ('.docx'), ('.pptx'), ('.xlsx')) AS t(e)), g AS (SELECT '/up/' || p_partkey || e AS path, * FROM f)
SELECT path, NULL AS sheet, -1 AS slide, p_name || '!' || chr(10) || 'type | ' || p_type AS text FROM g WHERE good AND e = '.docx' UNION ALL
SELECT path, NULL, unnest([2, 10]), unnest([p_name, p_type]) FROM g WHERE good AND e = '.pptx' UNION ALL
SELECT path, 'First', -1, p_name || ' | 7' || chr(10) || p_type FROM g WHERE good AND e = '.xlsx' UNION ALL SELECT path, NULL, -1, NULL FROM g WHERE NOT good""")
def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents, slides and sheets, some of them broken, extracted."""
    files = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), 10_000).withColumn("extension", F.explode(F.array(*map(F.lit, (".docx", ".pptx", ".xlsx")))))
    files = files.select(F.concat(F.lit("/up/"), F.col("p_partkey").cast("string"), "extension").alias("path"), "extension", _office("extension", "p_name", "p_type").alias("content"))
    rows, rejects = extract.extract_rows(files)
    slide = lambda c: F.coalesce(c, F.lit(-1)).alias("slide")
    none = F.lit(None).cast("string")
    return rows.select("path", "sheet", slide(F.col("slide")), "text").unionByName(rejects.select("path", none.alias("sheet"), slide(F.lit(None).cast("int")), none.alias("text")))


@query("""SELECT 'accepted' AS kind, 's_suppkey=' || s_suppkey AS folder, strlen(s_name || chr(10))::BIGINT AS size, sha256(s_name || chr(10)) AS file_hash, NULL AS reason FROM supplier
UNION ALL SELECT 'rejected', 's_nationkey=' || s_nationkey, 0, NULL, 'unsupported: .orc' FROM (SELECT DISTINCT s_nationkey FROM supplier)""")
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of suppliers' text files, and of files by nation in a format that isn't taken."""
    root, held = scratch(spark, "folder"), table(spark, sf_dir, "supplier")
    written_by_key(held.select(F.col("s_name").alias("value"), "s_suppkey"), "s_suppkey", FILES_A_TASK, f"{root}/texts")
    held.select("s_name", "s_nationkey").repartition("s_nationkey").write.option("compression", "none").partitionBy("s_nationkey").orc(f"{root}/others")
    accepted, rejected = extract.read_files(spark, root)
    folder = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder")
    none = F.lit(None).cast("string")
    return accepted.select(F.lit("accepted").alias("kind"), folder, "size", "file_hash", none.alias("reason")).unionByName(rejected.select(F.lit("rejected").alias("kind"), folder, F.lit(0).cast("long").alias("size"), none.alias("file_hash"), "reason"))


@query("SELECT c_name AS username, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'user' END AS role, (c_custkey % 5 <> 0)::VARCHAR AS is_active FROM customer")
def users_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users in files of one JSON array each, a file for each nation; roles and flags are left out where they are the default."""
    key = F.col("c_custkey")
    user = F.struct(F.col("c_name").alias("username"), F.when(key % 3 == 0, "admin").alias("role"), F.when(key % 5 == 0, False).alias("is_active"))
    files = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(user)).alias("value"))
    root = scratch(spark, "users")
    files.repartition("c_nationkey").write.partitionBy("c_nationkey").text(root)
    return workspace.read_users(spark, root).select("username", "role", F.col("is_active").cast("string").alias("is_active"))


SPARSE = "(p_partkey * 2654435761) % 4294967296"


@query(f"SELECT {SPARSE} AS doc_id, 0 AS chunk_no, row_number() OVER (ORDER BY {SPARSE}) - 1 AS chunk_index, length(p_name)::INT AS chunk_chars FROM part")
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as documents of one chunk under sparse ids, numbered over the whole batch."""
    docs = table(spark, sf_dir, "part").select(F.expr(SPARSE).alias("doc_id"), F.col("p_name").alias("text"))
    return chunking.number_chunks(chunking.chunk_documents(docs)).select("doc_id", "chunk_no", "chunk_index", "chunk_chars")


def model_answers(spark: SparkSession, sf_dir: str, context: DataFrame) -> DataFrame:
    """Answers of a function of question and context that says nothing, blanks or the fallback now and then."""
    said = lambda question, given: F.when(F.length(question) % 4 == 0, F.lit(None)).when(F.length(question) % 4 == 1, "  ").otherwise(F.concat(F.lit("M "), question))
    rows = context.withColumns({"source": F.lit("s"), "page": F.lit(None).cast("int")})
    return answers.answer_with(said, rows, asked_questions(spark, sf_dir)).select("qid", "answer")
