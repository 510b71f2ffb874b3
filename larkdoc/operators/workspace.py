"""Workspace tables: numbers, versions, duplicates, listings, routing, and change logs with their current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkdoc.functions import rules, text
from larkdoc.operators.aliases import named_in
from larkdoc.operators.common import latest, numbered, small, top_rows, written

WORKSPACE = ["username", "chat_id"]
DUPLICATE_ACTIONS = ("cancel", "replace", "keep_both")

#: Columns of the workspace's tables.
TABLES = {
    "chats": "chat_id string, username string, title string, created_at timestamp",
    "documents": "document_id string, chat_id string, username string, original_name string, stored_path string, created_at timestamp, file_hash string, file_size long, version int, updated_at timestamp",
    "messages": "message_id string, chat_id string, username string, role string, content string, created_at timestamp",
    "users": "username string, password_hash string, role string, is_active boolean, created_at timestamp",
    "upload_jobs": "job_id string, username string, chat_id string, status string, stage string, progress int, files_total int, files_processed int, chunks_total long, chunks_indexed long, original_names array<string>, file_paths array<string>, message string, error string, retry_count int, max_retries int, created_at timestamp, updated_at timestamp",
    "admin_audit_log": "log_id string, admin_username string, action string, target string, detail string, created_at timestamp",
}


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users from files of one JSON array each; a missing role is user, a missing is_active true."""
    rows = spark.read.schema(TABLES["users"]).option("multiLine", True).json(path)
    return rows.withColumns({"role": F.coalesce("role", F.lit("user")), "is_active": F.coalesce("is_active", F.lit(True))})


def find(rows: DataFrame, **keys: object) -> DataFrame:
    """Rows with these values, as a point look-up; user names in any case and without spaces around."""
    for name, value in keys.items():
        rows = rows.where(F.lower(F.col(name)) == str(value).strip().lower()) if name == "username" else rows.where(F.col(name) == value)
    return rows


def scope_filter(owner: str, chat_id: str, sources: list[str] | None = None) -> dict[str, object]:
    """What ``vectors.metadata_filter`` takes for a workspace and the sources selected in it, if any."""
    distinct = list(dict.fromkeys(s for s in sources or [] if s))
    return {"owner": owner, "chat_id": chat_id} | ({"source": distinct if len(distinct) > 1 else distinct[0]} if distinct else {})


def list_chats(messages: DataFrame) -> DataFrame:
    """(chat_id, username, messages, last_at), the chat last written to first."""
    return messages.groupBy("chat_id").agg(F.first("username").alias("username"), F.count("*").alias("messages"), F.max("created_at").alias("last_at")).orderBy(F.desc("last_at"), "chat_id")


def list_jobs(jobs: DataFrame, limit: int = 20, active_only: bool = False) -> DataFrame:
    """The newest ``limit`` jobs (1 to 200) of each workspace, newest first."""
    rows = jobs.where(F.col("status").isin("queued", "processing")) if active_only else jobs
    return top_rows(rows, WORKSPACE, [F.desc("created_at"), F.desc("job_id")], max(1, min(200, limit)), "place")


def next_queued(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` oldest queued jobs."""
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(n)


def document_numbers(documents: DataFrame) -> DataFrame:
    """``documents`` with upload_index, 1-based by (created_at, document_id) in each workspace."""
    return numbered(documents, WORKSPACE, ["created_at", "document_id"], "upload_index")


def latest_versions(documents: DataFrame) -> DataFrame:
    """The newest row of each (workspace, file_hash): by version, then created_at, then document_id."""
    return latest(documents.where("file_hash is not null"), [*WORKSPACE, "file_hash"], [F.desc("version"), F.desc("created_at"), "document_id"])


def assign_versions(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """``uploads`` with the next versions of their hashes, counted on for uploads with one hash; a null hash has version 1."""
    key = [*WORKSPACE, "file_hash"]
    known = documents.where("file_hash is not null").groupBy(*key).agg(F.max("version").alias("_held"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("upload_no"))
    return uploads.join(known, key, "left").withColumn("version", F.when(F.col("file_hash").isNull(), 1).otherwise(F.coalesce("_held", F.lit(0)) + place)).drop("_held")


def stored_duplicates(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """(upload_no, document_id, version, pending) of the latest document with an upload's hash."""
    clean = uploads.withColumn("file_hash", F.lower(F.trim("file_hash")))
    held = latest_versions(documents).select(*WORKSPACE, "file_hash", "document_id", "version")
    return clean.join(held, [*WORKSPACE, "file_hash"]).select("upload_no", F.col("document_id").cast("string").alias("document_id"), "version", F.lit(False).alias("pending"))


def pending_duplicates(uploads: DataFrame, jobs: DataFrame, prints: DataFrame, newest: int = 200) -> DataFrame:
    """Like ``stored_duplicates``, against files of queued and processing jobs.

    ``jobs`` has the workspace, job_id, status, created_at, file_paths, original_names; ``prints``
    path and file_hash. The newest jobs of each workspace count, and each hash's first job and file.
    """
    active = top_rows(jobs.where(F.col("status").isin("queued", "processing")), WORKSPACE, [F.desc("created_at"), F.desc("job_id")], newest, "_job_no")
    files = active.select(*WORKSPACE, "job_id", "_job_no", F.posexplode("file_paths").alias("_file_no", "path"))
    held = latest(files.join(prints, "path"), [*WORKSPACE, "file_hash"], ["_job_no", "_file_no"])
    clean = uploads.withColumn("file_hash", F.lower(F.trim("file_hash")))
    return clean.join(held.select(*WORKSPACE, "file_hash", "job_id"), [*WORKSPACE, "file_hash"]).select("upload_no", F.concat(F.lit("upload-job:"), "job_id").alias("document_id"), F.lit(1).alias("version"), F.lit(True).alias("pending"))


def normalize_action(action: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    return F.when(clean.isin(*DUPLICATE_ACTIONS), clean).when(clean == "", "cancel")


def duplicate_decisions(uploads: DataFrame, duplicates: DataFrame, action: Column) -> DataFrame:
    """``uploads`` with what happens to them: insert, reject_pending, reject, replace or keep_both.

    A pending duplicate rejects its whole batch (workspace and batch_id), whatever the action.
    """
    found = duplicates.groupBy("upload_no").agg(F.max(F.when(~F.col("pending"), F.col("document_id"))).alias("old_id"), F.bool_or("pending").alias("_pending"))
    joined = uploads.join(found, "upload_no", "left")
    batch = F.coalesce(F.bool_or("_pending").over(Window.partitionBy(*WORKSPACE, "batch_id")), F.lit(False))
    decision = F.when(batch, "reject_pending").when(F.col("old_id").isNull(), "insert").when(action == "replace", "replace").when(action == "keep_both", "keep_both").otherwise("reject")
    return joined.withColumn("decision", decision).drop("_pending")


def apply_decisions(decided: DataFrame, documents: DataFrame, chunks: DataFrame, keep_both: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, refused) after uploads ``decided`` by ``duplicate_decisions``.

    A replaced document's row and chunks go, once however many uploads replace it; then accepted
    uploads (insert, replace, keep_both) become rows with the next versions of what is left. Without
    ``keep_both`` that decision is refused too. ``decided`` has the columns of ``documents`` that new
    rows need, and upload_no, which is their id; ``chunks`` has the workspace and document_id.
    """
    accepted = F.col("decision").isin("insert", "replace", *(["keep_both"] if keep_both else []))
    gone = decided.where("decision = 'replace'").select(*WORKSPACE, F.col("old_id").alias("document_id")).distinct()

    def without(rows: DataFrame) -> DataFrame:
        return rows.withColumn("document_id", F.col("document_id").cast("string")).join(small(gone), [*WORKSPACE, "document_id"], "left_anti")

    left = without(documents)
    fresh = assign_versions(decided.where(accepted), left).withColumn("document_id", F.concat(F.lit("upload-"), F.col("upload_no").cast("string")))
    return left.unionByName(fresh.select(*[c for c in left.columns if c in fresh.columns]), allowMissingColumns=True), without(chunks), decided.where(~accepted)


def resolve_selected(documents: DataFrame, selected: DataFrame) -> DataFrame:
    """Numbered documents among the selected ids (trimmed, not blank), in document order."""
    wanted = selected.select(*WORKSPACE, F.trim("document_id").alias("document_id")).where("document_id <> ''").distinct()
    numbers = document_numbers(documents).withColumn("document_id", F.col("document_id").cast("string"))  # numbered in the ids' own order
    return numbers.join(small(wanted), [*WORKSPACE, "document_id"], "left_semi")


def select_documents(questions: DataFrame, documents: DataFrame, bare_numbers: bool = False) -> DataFrame:
    """(qid, upload_index) that a question names: all, by number, or by a name in it.

    ``questions`` has qid, the workspace and question; ``documents`` the workspace, upload_index and name.
    Numbers meet by equality. Names are sought by an automaton of a workspace's aliases (``named_in``), in one pass over each question.
    Questions are folded, and names made to aliases, once: what is read more than once is written before.
    """
    asked = written(questions.select("qid", *WORKSPACE, text.fold_text("question").alias("folded")), "asked")
    documents = written(documents.select(*WORKSPACE, "upload_index", "name"), "named")
    every = asked.where(text.matches(F.col("folded"), rules.ALL_DOCUMENTS)).join(documents.select(*WORKSPACE, "upload_index"), WORKSPACE)
    # the text is folded, so any white space is one space
    numbers = F.regexp_extract_all("folded", F.lit(rules.DOCUMENT_NUMBER), 1)
    if bare_numbers:
        numbers = F.concat(numbers, F.regexp_extract_all("folded", F.lit(rules.BARE_NUMBER), 1))
    said = asked.select("qid", *WORKSPACE, F.explode(F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))).alias("upload_index"))
    by_number = said.join(documents.select(*WORKSPACE, "upload_index"), [*WORKSPACE, "upload_index"])
    names = written(documents.select(*WORKSPACE, "upload_index", F.explode(text.document_aliases(F.col("name"))).alias("alias")), "aliases")
    found = [rows.select("qid", "upload_index") for rows in (every, by_number, named_in(asked, names))]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def question_scopes(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, mode, indexes): "ask_user" where several documents could be meant, else combined or per_document."""
    chosen = select_documents(questions, documents).groupBy("qid").agg(F.array_sort(F.collect_set("upload_index")).alias("indexes"))
    held = documents.groupBy(*WORKSPACE).agg(F.count("*").alias("_n"))
    joined = questions.join(chosen, "qid", "left").join(held, WORKSPACE, "left").withColumn("_f", text.fold_text("question"))
    none = F.col("indexes").isNull()
    unclear = none & (F.coalesce("_n", F.lit(0)) > 1) & text.matches(F.col("_f"), rules.SCOPE_SENSITIVE) & ~text.matches(F.col("_f"), rules.ACROSS_DOCUMENTS)
    many = F.coalesce(F.size("indexes"), F.lit(0)) > 1
    mode = F.when(unclear, "ask_user").when(many & ~text.matches(F.col("_f"), rules.COMPARES_DOCUMENTS), "per_document").otherwise("combined")
    return joined.select("qid", mode.alias("mode"), F.coalesce("indexes", F.array().cast("array<int>")).alias("indexes"))


def route_questions(questions: DataFrame, documents: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """(qid, question, mode, indexes, clears_pending): what each question asks, of which documents, together or one by one.

    ``questions`` has qid, the workspace, question and selected_ids; ``documents`` the workspace,
    document_id, upload_index and name; ``pending`` the workspace and the question that waits there for
    a choice of documents. Selected ids that exist hold before all else. Then a reply that names
    documents, bare numbers included, answers the waiting question; any other reply ends the wait.
    Then the question itself may name documents, or be unclear ("ask_user"). Mode is "combined" for
    one document, for all of a workspace, and for questions that compare; else "per_document".
    """
    asked = questions.select("qid", *WORKSPACE, "question", "selected_ids")
    chosen = asked.select("qid", *WORKSPACE, F.explode("selected_ids").alias("document_id")).withColumn("document_id", F.trim("document_id"))
    named = documents.withColumn("document_id", F.col("document_id").cast("string"))
    by_id = chosen.join(named.select(*WORKSPACE, "document_id", "upload_index"), [*WORKSPACE, "document_id"]).groupBy("qid").agg(F.array_sort(F.collect_set("upload_index")).alias("_ids"))
    waits = (pending if pending is not None else asked.limit(0)).select(*WORKSPACE, F.col("question").alias("_waiting"))
    replies = asked.join(waits, WORKSPACE)
    by_reply = select_documents(replies.select("qid", *WORKSPACE, "question"), documents, bare_numbers=True).groupBy("qid").agg(F.array_sort(F.collect_set("upload_index")).alias("_reply"))
    own = question_scopes(asked, documents).select("qid", F.col("mode").alias("_mode"), F.col("indexes").alias("_own"))
    joined = asked.join(waits, WORKSPACE, "left").join(by_id, "qid", "left").join(by_reply, "qid", "left").join(own, "qid")
    explicit, reply = F.col("_ids").isNotNull(), F.col("_reply").isNotNull()
    asks = F.when(~explicit & reply, F.col("_waiting")).otherwise(F.col("question"))
    indexes = F.when(explicit, F.col("_ids")).when(reply, F.col("_reply")).otherwise(F.col("_own"))
    found = joined.withColumns({"_asks": asks, "indexes": indexes}).withColumn("_folded", text.fold_text("_asks"))
    several = (F.size("indexes") > 1) & ~text.matches(F.col("_folded"), rules.COMPARES_DOCUMENTS)
    mode = F.when(~explicit & ~reply & (F.col("_mode") == "ask_user"), "ask_user").when(several, "per_document").otherwise("combined")
    return found.select("qid", F.col("_asks").alias("question"), mode.alias("mode"), "indexes", (F.col("_waiting").isNotNull()).alias("clears_pending"))


def conversation_log(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages (message_id, chat_id, username, role, content, created_at) of questions and their answers.

    ``asked`` has qid, the workspace, question and created_at; ``answers`` qid, answer and sources,
    which go behind the answer in a marker (``text.attach_sources``). A question without an answer gets
    the fallback. An answer is a microsecond later than its question.
    """
    return log_of_turns(asked.join(answers, "qid", "left"))


def log_of_turns(said: DataFrame) -> DataFrame:
    """The two messages of each question (qid, workspace, question, created_at, answer, sources)."""
    reply = text.attach_sources(F.coalesce("answer", F.lit(rules.FALLBACK_ANSWER)), F.col("sources"))
    turns = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.col("created_at")),
        F.struct(F.lit("assistant").alias("role"), reply.alias("content"), F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) + 1).alias("created_at")),
    )
    return said.select("qid", *WORKSPACE, F.explode(turns).alias("x")).select(F.concat(F.col("qid").cast("string"), F.lit("-"), "x.role").alias("message_id"), "chat_id", "username", "x.role", "x.content", "x.created_at")


def first_messages(messages: DataFrame, n: int = 200, newest: bool = False) -> DataFrame:
    """The oldest ``n`` messages of each chat, or the newest."""
    return top_rows(messages, ["chat_id"], [F.desc("created_at"), F.desc("message_id")] if newest else ["created_at", "message_id"], n)


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def current_state(changes: DataFrame, key: list[str]) -> DataFrame:
    """The latest row of each key by (change_ts, change_no), without keys whose latest change is a delete."""
    return latest(changes, key, [F.desc("change_ts"), F.desc("change_no")]).where("op <> 'delete'")


def change_rows(rows: DataFrame, op: str, ts: Column, number: Column, changed: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` as changes for ``current_state``: ``op`` is insert, update or delete, ``changed`` the columns that it sets."""
    return rows.withColumns(changed or {}).withColumns({"op": F.lit(op), "change_ts": ts, "change_no": number})


def renamed(rows: DataFrame, names: DataFrame, key: str, column: str, ts: Column, number: Column) -> tuple[DataFrame, DataFrame]:
    """(changes, refused): ``column`` of the ``rows`` named in ``names`` (key, name); blank names are refused."""
    blank = text.is_blank(F.col("name"))
    joined = rows.join(names.where(~blank), key)
    return change_rows(joined, "update", ts, number, {column: text.strip(F.col("name"))}).drop("name"), names.where(blank).withColumn("error", F.lit("name is empty"))


def delete_documents(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, counts) without the documents in ``gone`` (workspace, document_id) and their chunks; counts of both."""
    keys = small(gone.select(*WORKSPACE, "document_id").distinct())
    on = [*WORKSPACE, "document_id"]
    counts = [rows.join(keys, on, "left_semi").agg(F.count("*").alias(name)) for name, rows in (("documents", documents), ("chunks", chunks))]
    return documents.join(keys, on, "left_anti"), chunks.join(keys, on, "left_anti"), counts[0].crossJoin(counts[1])  # rows of one


def recover_and_expire(jobs: DataFrame, as_of: Column, number: Column) -> DataFrame:
    """Change rows for ``current_state`` at ``as_of``: stale processing jobs are queued anew, expired ones deleted."""
    flagged = job_flags(jobs, as_of)
    keep = jobs.columns
    stale = change_rows(flagged.where("stale").select(*keep), "update", as_of, number, {"status": F.lit("queued"), "updated_at": as_of})
    return stale.unionByName(change_rows(flagged.where("expired").select(*keep), "delete", as_of, number))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the workspaces in ``gone``; doing it again changes nothing."""
    keys = gone.select(*WORKSPACE).distinct()
    return {name: table.join(small(keys), WORKSPACE, "left_anti") for name, table in tables.items()}


def merge_latest(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the right one's win."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return latest(both, [key], [F.desc("_side")]).drop("_side")


def job_flags(jobs: DataFrame, as_of: Column) -> DataFrame:
    """``jobs`` with active, can_retry, stale and expired at ``as_of``."""
    terminal = F.col("status").isin("completed", "failed")
    age = F.unix_timestamp(as_of) - F.unix_timestamp("updated_at")
    return jobs.select(
        "*",
        F.col("status").isin("queued", "processing").alias("active"),
        ((F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries"))).alias("can_retry"),
        ((F.col("status") == "processing") & (age > max(30, rules.STALE_SECONDS))).alias("stale"),
        (terminal & (age > max(300, rules.RETENTION_SECONDS))).alias("expired"),
    )


def retry_errors(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, error): why a job can't be retried, null if it can."""
    joined = wanted.select("job_id").distinct().join(jobs, "job_id", "left")
    error = F.when(F.col("status").isNull(), "not found").when(F.col("status") != "failed", "not failed").when(F.col("retry_count") >= F.col("max_retries"), "limit exceeded")
    return joined.select("job_id", error.alias("error"))


def admin_violations(users: DataFrame, changes: DataFrame) -> DataFrame:
    """(change_no, violation) for role and status changes and deletes of users; null if allowed.

    ``changes`` has change_no, actor, username, op (role, status, delete) and value. The last admin keeps
    the role, the last active admin stays active, and nobody deletes themselves.
    """
    admins = users.agg(F.count_if(F.col("role") == "admin").alias("admins"), F.count_if((F.col("role") == "admin") & F.col("is_active")).alias("active_admins"))
    held = users.select(F.lower(F.trim("username")).alias("_name"), F.col("role").alias("_role"), F.col("is_active").alias("_active"))
    joined = changes.withColumn("_name", F.lower(F.trim("username"))).join(held, "_name", "left").crossJoin(F.broadcast(admins))  # one row
    admin = F.col("_role") == "admin"
    violation = (
        F.when(F.col("_role").isNull(), "no such user")
        .when((F.col("op") == "role") & ~F.col("value").isin("user", "admin"), "no such role")
        .when((F.col("op") == "role") & (F.col("value") == "user") & admin & (F.col("admins") <= 1), "last admin")
        .when((F.col("op") == "status") & (F.col("value") == "false") & admin & F.col("_active") & (F.col("active_admins") <= 1), "last active admin")
        .when((F.col("op") == "delete") & (F.lower(F.trim("actor")) == F.col("_name")), "own account")
        .when((F.col("op") == "delete") & admin & (F.col("admins") <= 1), "last admin")
    )
    return joined.select("change_no", violation.alias("violation"))


def first_admin(users: DataFrame, username: str, ts: Column) -> tuple[DataFrame, DataFrame]:
    """(changes, audit) that make ``username`` an admin, promoted or created, if no user is one; else no rows."""
    name = username.strip().lower()
    none = users.agg(F.count_if(F.col("role") == "admin").alias("_admins")).where("_admins = 0")  # one row or none
    held = users.where(F.lower("username") == name)
    promoted = held.crossJoin(F.broadcast(none)).drop("_admins").withColumn("role", F.lit("admin"))
    made = none.join(held.select(F.lit(True).alias("_held")).limit(1), F.lit(True), "left_anti").select(F.lit(name).alias("username"), F.lit("admin").alias("role"), F.lit(True).alias("is_active"))
    rows = promoted.withColumn("_detail", F.lit("promoted_existing_user")).unionByName(made.withColumn("_detail", F.lit("created_new_admin")), allowMissingColumns=True)
    changes = change_rows(rows.drop("_detail"), "update", ts, F.lit(0))
    return changes, rows.select(F.lit(name).alias("actor"), F.lit("setup_first_admin").alias("action"), F.lit(name).alias("target"), F.col("_detail").alias("detail"), ts.alias("created_at"))


def audit_rows(changes: DataFrame) -> DataFrame:
    """(actor, action, target, detail, created_at) for applied changes of users."""
    action = F.when(F.col("op") == "role", "update_role").when(F.col("op") == "status", "update_status").when(F.col("op") == "delete", "delete_user").otherwise(F.col("op"))
    return changes.select("actor", action.alias("action"), F.col("username").alias("target"), F.coalesce(F.concat(F.col("op"), F.lit("="), F.col("value")), F.col("op")).alias("detail"), F.col("change_ts").alias("created_at"))


def guest_identity(session: Column) -> Column:
    return F.when(session.rlike(r"^[A-Za-z0-9_-]{8,64}$"), F.concat(F.lit("__guest__-"), session))


def request_errors(requests: DataFrame) -> DataFrame:
    """``requests`` (question, top_k) with why they are refused, null if they aren't."""
    n = F.length(F.coalesce("question", F.lit("")))
    return requests.withColumn("error", F.when(n < 1, "question is empty").when(n > 2000, "question is too long").when(~F.col("top_k").between(1, rules.MAX_TOP_K), "top_k is out of range"))


def field_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with why they are refused, null if they aren't: lengths of those of title, name, username, password that they have."""
    error = F.lit(None).cast("string")
    for field, (least, most) in reversed(rules.FIELD_LENGTHS.items()):
        if field in rows.columns:
            n = F.length(F.coalesce(field, F.lit("")))
            error = F.when(n < least, f"{field} is too short").when(n > most, f"{field} is too long").otherwise(error)
    return rows.withColumn("error", error)


def search_messages(messages: DataFrame, needle: str) -> DataFrame:
    """Messages of users and assistants that hold ``needle`` in any case, and how often, overlaps included."""
    found = messages.where(F.col("role").isin("user", "assistant") & (F.instr(F.lower("text"), needle.lower()) > 0))
    return found.withColumn("occurrences", text.occurrences(F.col("text"), F.lit(needle)))


def normalize_jobs(raw: DataFrame) -> DataFrame:
    """Job records of text columns (job_id, status, progress, files_total, retry_count, max_retries) as typed, clamped ones."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    known = F.when(status.isin("queued", "processing", "completed", "failed"), status).otherwise("queued")
    clean = raw.select("job_id", known.alias("status"), text.clamp(F.col("progress"), 0, 100).alias("progress"), text.clamp(F.col("files_total"), 0).alias("files_total"), text.clamp(F.col("retry_count"), 0).alias("retry_count"), F.coalesce(F.col("max_retries").try_cast("int"), F.lit(rules.MAX_RETRIES)).alias("max_retries"))
    return clean.withColumn("can_retry", (F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries")))


def payload_errors(jobs: DataFrame, files: DataFrame, named: int = 3) -> DataFrame:
    """(job_id, error) for jobs (job_id, username, chat_id, file_paths): what keeps them from running, null if nothing.

    ``files`` has the paths that exist. The first ``named`` missing paths are in the text.
    """
    wanted = jobs.select("job_id", F.posexplode_outer("file_paths").alias("_no", "path"))
    gone = wanted.where("path is not null").join(files.select("path").distinct(), "path", "left_anti").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("_no", "path"))).alias("_gone"))
    paths = F.array_join(F.transform(F.slice("_gone", 1, named), lambda x: x["path"]), ", ")
    error = F.when(F.col("username").isNull() | F.col("chat_id").isNull(), "no owner or chat").when(F.coalesce(F.size("file_paths"), F.lit(0)) <= 0, "no files").when(F.col("_gone").isNotNull(), F.concat(F.lit("missing files: "), paths))
    return jobs.join(gone, "job_id", "left").select("job_id", error.alias("error"))


def upload_listing(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """(username, chat_id, name, progress, pending): stored documents and files of running jobs, whose progress is below 100."""
    running = jobs.where(F.col("status").isin("queued", "processing")).select(*WORKSPACE, F.explode_outer("original_names").alias("name"), F.least(F.lit(99), F.coalesce("progress", F.lit(0))).alias("progress"), F.lit(True).alias("pending"))
    return documents.select(*WORKSPACE, "name", F.lit(100).alias("progress"), F.lit(False).alias("pending")).unionByName(running)
