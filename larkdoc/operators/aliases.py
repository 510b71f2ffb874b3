"""Names of a workspace's documents found in its questions, by one automaton for all of them."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Aliases of an automaton, and questions that go through one at a time, about.
ALIASES, QUESTIONS = 20_000, 20_000


def named_in(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, upload_index) of the ``names`` (username, chat_id, upload_index, alias) that stand in the text of a question (qid, username, chat_id, folded) of their workspace.

    Workspaces are dealt to groups by hash. A task builds an automaton of each workspace's aliases and reads each of its questions
    once, however many aliases there are. A group with more aliases or questions than ``ALIASES`` and ``QUESTIONS``, as one with
    a large workspace, is cut into blocks, each block of aliases meeting each of questions. Empty aliases and null workspaces find nothing.
    """
    space = ["username", "chat_id"]
    names = names.where("alias <> '' and username is not null and chat_id is not null").select(*space, F.col("upload_index").cast("long").alias("upload_index"), "alias")
    held = names.groupBy(*space).agg(F.count("*").alias("n"))
    asked = questions.where("folded <> ''").select(*[F.col(c).alias(c) for c in ("qid", *space, "folded")])  # columns of its own, where both sides come from one table
    n_groups = max(1, -(-names.count() // ALIASES))
    group = F.pmod(F.xxhash64(*space), F.lit(n_groups))
    sizes = held.groupBy(group.alias("g")).agg(F.ceil(F.sum("n") / ALIASES).alias("a"))
    counts = asked.groupBy(group.alias("g")).agg(F.ceil(F.count("*") / QUESTIONS).alias("q"))
    blocks = sizes.join(counts, "g")

    def placed(rows: DataFrame, own: str, one: str, other: str, two: str) -> DataFrame:
        cut = F.pmod(F.xxhash64(*[c for c in rows.columns]), F.col(one)).alias(own)
        return rows.withColumn("g", group).join(blocks, "g").select(*rows.columns, "g", cut, F.explode(F.sequence(F.lit(0).cast("long"), F.col(two) - 1)).alias(other))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        automata: dict[tuple, ahocorasick.Automaton] = {}
        for user, chat, index, alias in zip(*(left.column(c).to_pylist() for c in (*space, "upload_index", "alias")), strict=True):
            automaton = automata.setdefault((user, chat), ahocorasick.Automaton())
            automaton.add_word(alias, automaton.get(alias, ()) + (index,))
        for automaton in automata.values():
            automaton.make_automaton()
        rows, found = [], []
        for row, (user, chat, folded) in enumerate(zip(*(right.column(c).to_pylist() for c in (*space, "folded")), strict=True)):
            if (automaton := automata.get((user, chat))) is not None:
                hits = {index for _, indexes in automaton.iter(folded) for index in indexes}
                rows += [row] * len(hits)
                found += sorted(hits)
        return pa.table({"qid": right.column("qid").take(pa.array(rows, pa.int64())), "upload_index": pa.array(found, pa.int64())})

    kind = questions.schema["qid"].dataType.simpleString()
    left, right = placed(names, "i", "a", "j", "q"), placed(asked, "j", "q", "i", "a")
    out = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(search, f"qid {kind}, upload_index long")
    return out.select("qid", F.col("upload_index").cast("int").alias("upload_index"))
