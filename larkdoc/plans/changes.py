"""Queries of workspace changes: guards, audit, renames, deletes, look-ups, selected documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkdoc.operators import analytics, ranks, user_changes, workspace
from larkdoc.plans.tables import FILES, query, stored_files, table

USERS = "users AS (SELECT c_custkey, 'User' || c_custkey AS username, CASE WHEN c_custkey = 0 THEN 'admin' ELSE 'user' END AS role, c_acctbal > 0 OR c_custkey = 0 AS is_active FROM customer)"
CHANGED = "ch AS (SELECT o_orderkey AS change_no, 'user' || (o_custkey // 2) AS actor, ' USER' || (o_custkey // 2 * (o_orderkey % 4)) AS username, o_custkey // 2 * (o_orderkey % 4) AS k, ['role', 'status', 'delete'][o_orderkey % 3 + 1] AS op, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'owner' ELSE 'user' END WHEN 1 THEN 'false' END AS value, o_orderdate AS change_ts FROM orders)"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users; the first is the only admin."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key, F.concat(F.lit("User"), key.cast("string")).alias("username"), F.when(key == 0, "admin").otherwise("user").alias("role"), ((F.col("c_acctbal") > 0) | (key == 0)).alias("is_active"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of users, a quarter of them of the admin."""
    order, customer = F.col("o_orderkey"), F.expr("o_custkey div 2")
    value = F.when(order % 3 == 0, F.when(order % 5 == 0, "owner").otherwise("user")).when(order % 3 == 1, "false")
    return table(spark, sf_dir, "orders").select(order.alias("change_no"), F.concat(F.lit("user"), customer.cast("string")).alias("actor"), F.concat(F.lit(" USER"), (customer * (order % 4)).cast("string")).alias("username"), F.get(F.array(*map(F.lit, ("role", "status", "delete"))), (order % 3).cast("int")).alias("op"), value.alias("value"), F.col("o_orderdate").cast("timestamp").alias("change_ts"))


@query(f"""WITH {USERS}, {CHANGED} SELECT change_no, CASE WHEN role IS NULL THEN 'no such user' WHEN op = 'role' AND value NOT IN ('user', 'admin') THEN 'no such role' WHEN op = 'role' AND value = 'user' AND role = 'admin' THEN 'last admin'
WHEN op = 'status' AND role = 'admin' THEN 'last active admin' WHEN op = 'delete' AND actor = 'user' || k THEN 'own account' WHEN op = 'delete' AND role = 'admin' THEN 'last admin' END AS violation FROM ch LEFT JOIN users ON c_custkey = k""")
def admin_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.admin_violations(_users(spark, sf_dir), _changes(spark, sf_dir))


@query(f"WITH {CHANGED} SELECT change_no, actor, ['update_role', 'update_status', 'delete_user'][change_no % 3 + 1] AS action, username AS target, CASE WHEN value IS NULL THEN op ELSE op || '=' || value END AS detail FROM ch")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _changes(spark, sf_dir).withColumn("change_ts", F.timestamp_seconds("change_no"))
    return workspace.audit_rows(numbered).select(F.unix_timestamp("created_at").alias("change_no"), "actor", "action", "target", "detail")


@query(f"WITH {USERS} SELECT count(*) FILTER (role = 'admin') AS admins, count(*) FILTER (role = 'admin' AND is_active) AS active_admins FROM users")
def admin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.admin_counts(_users(spark, sf_dir))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 IN (1, 2) THEN 'New ' || c_mktsegment ELSE c_name END AS name, false AS refused FROM customer UNION ALL SELECT c_custkey, NULL, true FROM customer WHERE c_custkey % 5 = 0")
def renamed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    names = rows.where("c_custkey % 5 < 3").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("  New "), "segment", F.lit(" "))).alias("name"))
    at = F.lit("2024-01-01").cast("timestamp")
    log = workspace.change_rows(rows, "insert", at, F.lit(0))
    changed, refused = workspace.renamed(rows, names, "c_custkey", "title", at, F.lit(1))
    now = workspace.current_state(log.unionByName(changed), ["c_custkey"]).select("c_custkey", F.col("title").alias("name"), F.lit(False).alias("refused"))
    return now.unionByName(refused.select("c_custkey", F.lit(None).cast("string").alias("name"), F.lit(True).alias("refused")))


@query(f"""WITH {FILES}, left_over AS (SELECT * FROM files WHERE document_id % 7 <> 0), gone AS (SELECT * FROM files WHERE document_id % 7 = 0)
SELECT 'left' AS kind, username, chat_id, count(*) AS documents, 2 * count(*) AS chunks FROM left_over GROUP BY ALL UNION ALL SELECT 'gone', NULL, NULL, count(*), 2 * count(*) FROM gone""")
def deleted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored_files(spark, sf_dir).select(*workspace.WORKSPACE, "document_id")
    chunks = files.withColumn("chunk_no", F.explode(F.array(F.lit(0), F.lit(1))))
    documents, left, counts = workspace.delete_documents(files, chunks, files.where("document_id % 7 = 0"))
    n = documents.groupBy(*workspace.WORKSPACE).agg(F.count("*").alias("documents")).join(left.groupBy(*workspace.WORKSPACE).agg(F.count("*").alias("chunks")), workspace.WORKSPACE)
    none = F.lit(None).cast("string")
    return n.select(F.lit("left").alias("kind"), *workspace.WORKSPACE, "documents", "chunks").unionByName(counts.select(F.lit("gone").alias("kind"), none.alias("username"), none.alias("chat_id"), "documents", "chunks"))


@query(f"WITH {USERS} SELECT c_custkey, username, role, is_active FROM users WHERE lower(username) = 'user12'")
def found_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.find(_users(spark, sf_dir), username=" USER12 ")


@query(f"WITH {FILES}, f AS (SELECT *, row_number() OVER (PARTITION BY username, chat_id ORDER BY created_at, document_id)::INT AS upload_index FROM files) SELECT username, chat_id, document_id::VARCHAR AS document_id, upload_index FROM f WHERE document_id % 4 = 0")
def selected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored_files(spark, sf_dir)
    wanted = files.select(*workspace.WORKSPACE, F.when(F.col("document_id") % 4 == 0, F.concat(F.lit(" "), F.col("document_id").cast("string"))).when(F.col("document_id") % 4 == 1, F.lit("  ")).otherwise(F.concat(F.lit("gone"), F.col("document_id").cast("string"))).alias("document_id"))
    return workspace.resolve_selected(files, wanted.unionByName(wanted)).select(*workspace.WORKSPACE, "document_id", "upload_index")


LIVED = """u AS (SELECT 'user' || c_custkey AS username, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, true AS is_active, md5(c_name) AS password_hash FROM customer WHERE c_custkey % 2 = 0),
ch AS (SELECT o_orderkey AS change_no, 'user' || o_custkey AS username, ['insert', 'set', 'set', 'delete', 'set'][o_orderkey % 5 + 1] AS op, CASE o_orderkey % 5 WHEN 1 THEN 'admin' WHEN 4 THEN 'user' END AS role, CASE o_orderkey % 5 WHEN 2 THEN o_orderkey % 2 = 0 END AS is_active, CASE WHEN o_orderkey % 5 IN (0, 4) THEN md5(o_orderkey::VARCHAR) END AS password_hash FROM orders),
x AS (SELECT -1 AS change_no, username, 'insert' AS op, role, is_active, password_hash FROM u UNION ALL SELECT * FROM ch),
f AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'set' THEN op END IGNORE NULLS) OVER (PARTITION BY username ORDER BY change_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'delete') = 'insert' AS alive FROM x),
l AS (SELECT *, sum((op = 'insert')::INT) OVER (PARTITION BY username ORDER BY change_no) AS life FROM f WHERE (op = 'insert') <> alive),
m AS (SELECT username, max(life) AS life, arg_max(op, change_no) AS op FROM l GROUP BY username)"""


@query(f"""WITH {LIVED} SELECT 'user' AS kind, username, coalesce(arg_max(role, change_no) FILTER (role IS NOT NULL), 'user') AS role, coalesce(arg_max(is_active, change_no) FILTER (is_active IS NOT NULL), true)::VARCHAR AS is_active, arg_max(password_hash, change_no) FILTER (password_hash IS NOT NULL) AS password_hash, 0::BIGINT AS change_no, NULL::VARCHAR AS reason
FROM l JOIN (SELECT username, life FROM m WHERE op <> 'delete') USING (username, life) GROUP BY username
UNION ALL SELECT 'refused', username, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, change_no::BIGINT, CASE WHEN op = 'insert' THEN 'username exists' ELSE 'no such username' END FROM f WHERE (op = 'insert') = alive""")
def applied_user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the customers as users, and orders as inserts, field changes and deletes of all of them."""
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    users = table(spark, sf_dir, "customer").where(key % 2 == 0).select(F.concat(F.lit(" User"), key.cast("string")).alias("username"), F.when(key % 10 == 0, "admin").otherwise("user").alias("role"), F.lit(True).alias("is_active"), F.md5("c_name").alias("password_hash"))
    kind = (order % 5).cast("int")
    changes = table(spark, sf_dir, "orders").select(
        order.alias("change_no"), F.concat(F.lit("USER"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("username"), F.get(F.array(*map(F.lit, ("insert", "set", "set", "delete", "set"))), kind).alias("op"),
        F.when(kind == 1, "admin").when(kind == 4, "user").alias("role"), F.when(kind == 2, order % 2 == 0).alias("is_active"), F.when(kind.isin(0, 4), F.md5(order.cast("string"))).alias("password_hash"),
    )
    rows, refused = user_changes.apply_user_changes(users, changes)
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(F.lit("user").alias("kind"), "username", "role", F.col("is_active").cast("string").alias("is_active"), "password_hash", F.lit(0).cast("long").alias("change_no"), none("string").alias("reason")).unionByName(
        refused.select(F.lit("refused").alias("kind"), "username", none("string").alias("role"), none("string").alias("is_active"), none("string").alias("password_hash"), F.col("change_no").cast("long").alias("change_no"), "reason")
    )


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER () AS total FROM orders QUALIFY place > (SELECT count(*) // 2 FROM orders) AND place <= (SELECT count(*) // 2 FROM orders) + 50")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders from the middle of all of them by price, with their places and the total."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranks.page_with_total(orders, [F.desc("o_totalprice"), "o_orderkey"], orders.count() // 2, 50).select("o_orderkey", "place", "total")


HASHED = "(doc_id * 2654435761) % 4294967296"


@query(f"WITH t AS (SELECT {HASHED} AS doc_id, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM t")
def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under sparse ids, numbered, with the characters in front of each."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.expr(HASHED).alias("doc_id"), F.length("text").cast("long").alias("n"))
    numbered = ranks.in_ranges(rows, ["doc_id"]).numbered()
    return numbered.join(ranks.running_sums(rows, ["doc_id"], "n", "chars_before"), "doc_id").select("doc_id", "rank", "chars_before")
