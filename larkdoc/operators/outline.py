"""Outlines of answers and contexts, and clean-up of answers' diagrams and tables."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.functions import rules, text
from larkdoc.operators.answers import in_order
from larkdoc.operators.common import written

#: Which texts are fenced diagrams, labelled edges, two edges on a line, first and other lines of a diagram,
#: arrows that mark a line wherever they stand, list marks, table rows and rules. Results depend on these very patterns.
FENCED = r"```mermaid\s*(.*?)```"
LABEL_IN_BARS = r"(-->|==>|-\.->|---|~~>|--o|o--|--x|x--)[ \t]*\|([^|\n]+)\|[ \t]*>[ \t]*"
LABEL_BARE = r"(-->|==>|-\.->|---|~~>|--o|o--|--x|x--)[ \t]*([^|\n][^>\n]{1,120}?)[ \t]*>[ \t]*(?=[A-Za-z0-9_À-ɏ぀-ヿ一-鿿-]+[ \t]*[\[(])"
TWO_EDGES = r"([\])])[ \t]+(?=\w+[ \t]*(?:-->|==>|-\.->|---|~~>|--o|o--|--x|x--))"
DECLARES = r"\s*(?:flowchart|graph|mindmap|sequencediagram|classdiagram|erdiagram|gantt|journey|statediagram|statediagram-v2|pie|timeline|xychart|xychart-beta)\b"
EDGE_LINE = r"[A-Za-z0-9_À-ɏ぀-ヿ一-鿿-]+\s*(?:-->|==>|-\.->|---|~~>|--o|o--|--x|x--|<--|<==|<-\.->)"
NODE_LINE = r"[A-Za-z0-9_À-ɏ぀-ヿ一-鿿-]+\s*[\[(].*[\])]$"
SHORT_LINE = r"[A-Za-z0-9_]{1,4}$"
META_LINE = r"(?i:subgraph|end|%%)\b"
LOOSE_ARROWS = ("-->", "==>", "-.->", "---", "~~>", "<--", "<==", "<-.->")
LIST_MARK = r"(?:[-*•]|\d+[.)])\s+"
TABLE_ROW = r"^\s*\|.+\|\s*$"
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"

_FENCED = re.compile(FENCED, re.S | re.I)
_LABEL_IN_BARS, _LABEL_BARE, _TWO_EDGES = re.compile(LABEL_IN_BARS), re.compile(LABEL_BARE), re.compile(TWO_EDGES, re.A)
_DECLARES = re.compile(DECLARES, re.I)
_DIAGRAM_LINES = [re.compile(p) for p in (EDGE_LINE, NODE_LINE, SHORT_LINE, META_LINE)]
_LISTED = re.compile(LIST_MARK)
_TABLE_ROW, _TABLE_RULE = re.compile(TABLE_ROW), re.compile(TABLE_RULE)


def _repaired_diagram(block: str) -> str:
    """Labels between bars without a stray arrow head, an edge a line, and flowchart for graph on the first line."""
    for pattern in (_LABEL_IN_BARS, _LABEL_BARE):
        block = pattern.sub(lambda m: f"{m[1]}|{' '.join(m[2].split())}| ", block)
    return re.sub(r"^(\s*)graph(?=\s)", r"\1flowchart", _TWO_EDGES.sub(r"\1\n", block).strip(), flags=re.I)


def _fenced(block: str) -> str:
    return f"```mermaid\n{block}\n```"


def _diagram_like(line: str) -> bool:
    line = line.strip()
    return bool(line) and bool(_DECLARES.match(line) or any(p.match(line) for p in _DIAGRAM_LINES) or any(a in line for a in LOOSE_ARROWS))


def _compact(lines: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines).strip())


def _without_loose(answer: str) -> str:
    """No diagrams outside fences: from a declaration on to a list line, a heading or a line that is no diagram's."""
    out, fence, loose = [], False, False
    for line in answer.splitlines():
        mark = line.lstrip().startswith("```")
        fence ^= mark
        if mark or fence:
            loose = False
        elif _DECLARES.match(line):
            loose = True
        elif loose:
            said = line.strip()
            loose = not (_LISTED.match(said) or re.match(r"#{1,6}\s", said)) and (not said or _diagram_like(line))
        if not loose:
            out.append(line)
    return _compact(out)


def _without_diagrams(answer: str) -> str:
    """No diagrams in fences of any kind, none outside them, and no line that looks like a diagram's. A fence that isn't closed stays."""
    out: list[str] = []
    held: list[str] | None = None
    for line in _FENCED.sub("", answer).splitlines():
        mark = line.lstrip().startswith("```")
        if held is None and mark:
            held = [line]
        elif held is None:
            out.append(line)
        else:
            held.append(line)
            if mark:
                said = [x for x in held[1:-1] if x.strip()]
                drawn = held[0].strip()[3:].strip().lower().startswith("mermaid") or bool(said and _DECLARES.match(said[0])) or sum(map(_diagram_like, said)) >= 2
                out += [] if drawn else held
                held = None
    left = _without_loose("\n".join(out + (held or [])))
    return _compact([line.rstrip() for line in left.splitlines() if not _diagram_like(line)])


def _repaired_tables(answer: str) -> str:
    """A rule behind the first row of each table of two rows or more and two columns or more that has none."""
    out, rows = [], []

    def flush() -> None:
        columns = rows[0].strip().strip("|").count("|") + 1 if rows else 0
        if len(rows) >= 2 and columns >= 2 and not any(_TABLE_RULE.match(r) for r in rows):
            rows.insert(1, "|" + " --- |" * columns)
        out.extend(rows)
        rows.clear()

    for line in answer.split("\n"):
        if _TABLE_ROW.match(line) or rows and _TABLE_RULE.match(line):
            rows.append(line)
        else:
            flush()
            out.append(line)
    flush()
    return "\n".join(out)


def _own_mindmaps(answer: str) -> tuple[str | None, str | None]:
    """The first mindmap of an answer with three branches or more, and its first mindmap at all, repaired and fenced."""
    blocks = [_repaired_diagram(m[1].strip()) for m in _FENCED.finditer(answer)]
    maps = [b for b in blocks if b.lower().startswith("mindmap")]
    wide = [b for b in maps if len({line.strip().lower() for line in b.split("\n") if re.match(r" {4}\S", line)}) >= 3]
    return _fenced(wide[0]) if wide else None, _fenced(maps[0]) if maps else None


def _mapped(change: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    return lambda answers: answers.map(lambda a: None if a is None else change(a))


def _diagrams_repaired(answer: str) -> str:
    return _FENCED.sub(lambda m: _fenced(_repaired_diagram(m[1])), answer)


@F.pandas_udf(T.StringType())
def repair_diagrams(answers: pd.Series) -> pd.Series:
    """Answers with the edges of their fenced diagrams repaired."""
    return _mapped(_diagrams_repaired)(answers)


@F.pandas_udf(T.StringType())
def repair_answer(answers: pd.Series) -> pd.Series:
    """Answers with their diagrams' edges and their tables repaired."""
    return _mapped(lambda a: _repaired_tables(_diagrams_repaired(a)))(answers)


@F.pandas_udf(T.StringType())
def strip_diagrams(answers: pd.Series) -> pd.Series:
    """Answers without diagrams; a table's rule, which looks like an edge, comes back."""
    return _mapped(lambda a: _repaired_tables(_without_diagrams(a)))(answers)


@F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in ("narrative", "tidy", "wide", "any")]))
def answer_parts(answers: pd.Series) -> pd.DataFrame:
    """An answer without diagrams, one without loose ones, and its own mindmaps."""
    rows = [(_repaired_tables(_without_diagrams(a)), _without_loose(a), *_own_mindmaps(a)) if a is not None else (None,) * 4 for a in answers]
    return pd.DataFrame(rows, columns=["narrative", "tidy", "wide", "any"])


def _branches(named: DataFrame, most_branches: int, most_children: int) -> DataFrame:
    """(id, branch_no, branch, children) from (id, pos, branch, children): a branch where it first stands, with its distinct children.

    Rows move once, to their id; only the branches that are kept are looked up in it.
    """
    held = named.where("branch <> ''").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "branch", "children"))).alias("rows"))
    names = F.slice(F.array_distinct(F.transform("rows", lambda x: x["branch"])), 1, most_branches)

    def kept(branch: Column) -> Column:
        children = F.flatten(F.transform(F.filter("rows", lambda x: x["branch"] == branch), lambda x: x["children"]))
        return F.slice(F.array_distinct(F.filter(children, lambda c: c.isNotNull() & (c != "") & (c != branch))), 1, most_children)

    rows = F.transform(names, lambda n: F.struct(n.alias("branch"), kept(n).alias("children")))
    return held.select("id", F.posexplode(rows).alias("branch_no", "row")).select("id", "branch_no", "row.branch", "row.children")


def bullet_rows(answers: DataFrame, most_branches: int = 8, most_children: int = 4) -> DataFrame:
    """Like ``outline_rows``, from the list lines of (id, text) outside code fences."""
    plain = F.regexp_replace("text", r"(?s)```.*?```", "\n")
    lines = answers.select("id", F.posexplode(F.split(plain, r"\R")).alias("pos", "line")).withColumn("line", text.strip(F.col("line"))).where(F.col("line").rlike(f"^{LIST_MARK}"))
    pair = text.split_branch_child(text.clean_label(F.regexp_replace("line", f"^{LIST_MARK}", "")))
    named = lines.select("id", "pos", text.clean_label(pair["branch"]).alias("branch"), F.array(text.clean_label(pair["child"])).alias("children"))
    return _branches(named, most_branches, most_children)


def outline_rows(texts: DataFrame, most_branches: int = 8, most_children: int = 4) -> DataFrame:
    """(id, branch_no, branch, children) from the lines of (id, text): bullets, ``branch: child``, first cells of tables."""
    lines = texts.select("id", F.posexplode(F.split("text", r"\R")).alias("pos", "line")).where(F.length(text.strip(F.col("line"))).between(3, 90) & ~F.col("line").rlike(r"^\s*\|?\s*:?-{3,}"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), text.clean_label)
    pair = text.split_branch_child(F.regexp_replace(text.strip(F.col("line")), f"^{LIST_MARK}", ""))
    table = F.col("line").rlike(TABLE_ROW)
    named = lines.select("id", "pos", F.when(table, F.get(cells, F.lit(0))).otherwise(text.clean_label(pair["branch"])).alias("branch"), F.when(table, F.slice(cells, 2, 2)).otherwise(F.array(text.clean_label(pair["child"]))).alias("children")).where("branch <> ''")
    return _branches(named, most_branches, most_children)


def merge_outlines(first: DataFrame, second: DataFrame, most: int = 10, most_children: int = 4, extend: bool = True) -> DataFrame:
    """Outline rows of both by branch, the first one's before the second's, whose children are added to the first's if ``extend``."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    if not extend:
        both = both.join(first.select("id", "branch", F.lit(True).alias("_held")), ["id", "branch"], "left").where("side = 0 or _held is null")
    return _branches(both.select("id", F.struct("side", "branch_no").alias("pos"), "branch", "children"), most, most_children)


def render_outline(outline: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(id, bullets, table, flowchart, mindmap, timeline, pie, wide_mindmap) of outline rows, in order; ``roots`` has (id, root).

    Bullets are of 6 branches with 2 children, the table of 8 with 3, diagrams of 6 with 2, the wide
    mindmap of 8 with 4. A table or diagram of one branch is null, a wide mindmap of less than three.
    """
    rows = F.array_sort(F.collect_list(F.struct("branch_no", "branch", "children")))
    held = outline.groupBy("id").agg(rows.alias("x"))
    held = held.join(roots, "id", "left") if roots is not None else held.withColumn("root", F.lit(None).cast("string"))
    root = F.coalesce("root", F.lit(rules.DEFAULT_ROOT))

    def lines(branches: int, line: Callable[[Column, Column], Column]) -> Column:
        return F.array_join(F.transform(F.slice("x", 1, branches), line), "\n")

    def children(row: Column, n: int, separator: str, none: str = "") -> Column:
        return F.when(F.size(row["children"]) > 0, F.array_join(F.slice(row["children"], 1, n), separator)).otherwise(none)

    def drawn(kind: str, title: Column, body: Column, least: int = 2) -> Column:
        return F.when(F.size("x") >= least, F.concat(F.lit(f"```mermaid\n{kind}\n"), title, F.lit("\n"), body, F.lit("\n```")))

    def below(row: Column, n: int) -> Column:
        return F.concat(F.lit("    "), row["branch"], F.array_join(F.transform(F.slice(row["children"], 1, n), lambda c: F.concat(F.lit("\n      "), c)), ""))

    def boxes(row: Column, i: Column) -> Column:
        name = F.concat(F.lit("B"), (i + 1).cast("string"))
        edges = F.transform(F.slice(row["children"], 1, 2), lambda c, j: F.concat(F.lit("\n  "), name, F.lit(" --> "), name, F.lit("_"), (j + 1).cast("string"), F.lit('["'), c, F.lit('"]')))
        return F.concat(F.lit("  R --> "), name, F.lit('["'), row["branch"], F.lit('"]'), F.array_join(edges, ""))

    title, centre = F.concat(F.lit("  title "), root), F.concat(F.lit("  root(("), root, F.lit("))"))
    bullet = lambda r, i: F.concat(F.lit("- **"), r["branch"], F.lit("**"), F.when(F.size(r["children"]) > 0, F.concat(F.lit(": "), children(r, 2, ", "))).otherwise(""))
    row = lambda r, i: F.concat(F.lit("| "), r["branch"], F.lit(" | "), children(r, 3, ", ", rules.NO_DETAIL), F.lit(" |"))
    return held.select(
        "id",
        lines(6, bullet).alias("bullets"),
        F.when(F.size("x") >= 2, F.concat(F.lit(rules.TABLE_HEAD + "\n"), lines(8, row))).alias("table"),
        drawn("flowchart TD", F.concat(F.lit('  R["'), root, F.lit('"]')), lines(6, boxes)).alias("flowchart"),
        drawn("mindmap", centre, lines(6, lambda r, i: below(r, 2))).alias("mindmap"),
        drawn("timeline", title, lines(6, lambda r, i: F.concat(F.lit("  "), r["branch"], F.lit(" : "), children(r, 2, " | ", rules.NO_STAGE)))).alias("timeline"),
        drawn("pie showData", title, lines(6, lambda r, i: F.concat(F.lit('  "'), r["branch"], F.lit('" : '), F.greatest(F.lit(1), F.least(F.lit(2), F.size(r["children"]))).cast("string")))).alias("pie"),
        drawn("mindmap", centre, lines(8, lambda r, i: below(r, 4)), 3).alias("wide_mindmap"),
    )


def outline_roots(context: DataFrame, questions: DataFrame, words: str) -> DataFrame:
    """(id, root): ``words`` and the first source's name, or the question's beginning; ``context`` has qid, place, source."""
    first = context.groupBy("qid").agg(text.display_name(F.min_by("source", "place")).alias("_name"))
    named = questions.select("qid", "question").join(first, "qid", "left")
    asked = F.when(text.is_blank(F.col("question")), rules.DEFAULT_ROOT).otherwise(F.concat(F.lit(f"{words}: "), F.substring("question", 1, 60)))
    return named.select(F.col("qid").alias("id"), text.clean_label(F.when(F.coalesce("_name", F.lit("")) != "", F.concat(F.lit(f"{words} "), "_name")).otherwise(asked)).alias("root"))


def post_process_answers(answers: DataFrame, context: DataFrame) -> DataFrame:
    """(qid, answer): answers (qid, question, answer) repaired, and with visual parts where ``should_enrich`` says so.

    A mindmap is put before its answer, without other diagrams: the answer's own one if it has three
    branches, else one of the outlines of answer and context. Other answers get a short summary, a table
    and a diagram of the kind that the question asks for, those of the three that they lack. Fallback
    answers stay as they are. ``context`` has qid, place, source and text; its first four places count.
    """
    repaired = written(answers.select("qid", "question", repair_diagrams("answer").alias("answer")).withColumn("parts", answer_parts("answer")), "answers")
    near = context.where("place <= 4").select("qid", "place", "source", "text")
    said = bullet_rows(repaired.select(F.col("qid").alias("id"), F.col("answer").alias("text")))
    told = outline_rows(near.groupBy("qid").agg(in_order(["place"], "text", "\n").alias("text")).withColumnRenamed("qid", "id"))
    merged = written(merge_outlines(said, told), "outlines")
    visual = render_outline(merged, outline_roots(near, answers, rules.OVERVIEW)).drop("wide_mindmap")
    branches = merged.groupBy("id").agg(in_order(["branch_no"], "branch", " ").alias("_branches"))
    few = repaired.select(F.col("qid").alias("id")).join(said.groupBy("id").agg(F.count("*").alias("_n")).where("_n >= 4"), "id", "left_anti")
    maps = render_outline(merge_outlines(said, told.join(few, "id", "left_semi"), 8, extend=False), outline_roots(near, answers, "Mindmap")).select("id", "wide_mindmap")
    joined = repaired.join(visual, F.col("qid") == visual["id"], "left").drop("id").join(branches, F.col("qid") == branches["id"], "left").drop("id").join(maps, F.col("qid") == maps["id"], "left").drop("id")
    question, tidy, narrative = F.col("question"), F.col("parts.tidy"), F.col("parts.narrative")
    none = F.lit(None).cast("string")

    def together(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")

    kind = text.diagram_kind(question, F.col("_branches"))
    diagram = F.coalesce(F.when(kind == "timeline", F.col("timeline")).when(kind == "pie", F.col("pie")).when(kind == "mindmap", F.col("mindmap")), F.col("flowchart"))
    extra = together(
        tidy,
        F.when(~text.has_bullets(tidy) & (F.coalesce("bullets", F.lit("")) != ""), F.concat(F.lit(rules.SUMMARY_HEAD + "\n"), "bullets")),
        F.when(~text.has_table(tidy), F.concat(F.lit(rules.OVERVIEW_HEAD + "\n"), "table")),
        F.when(~tidy.rlike("(?is)```mermaid.*```"), F.concat(F.lit(rules.DIAGRAM_HEAD + "\n"), diagram)),
    )
    mapped = together(F.coalesce("parts.wide", "wide_mindmap", "parts.any", none), narrative)
    done = F.when(F.col("answer").isNull() | text.is_blank(F.col("answer")) | text.is_fallback(F.col("answer")), F.col("answer")).when(text.question_flags(question)["mindmap"], mapped).when(should_enrich(question, tidy), extra).otherwise(tidy)
    return joined.select("qid", done.alias("answer"))


def should_enrich(question: Column, answer: Column) -> Column:
    """Whether an answer should get a visual part: if asked for, or if question and answer are long enough for one."""
    flags, asked, said = text.question_flags(question), F.size(text.token_set(question)), F.size(text.token_set(answer))
    drawn = text.has_table(answer) | answer.rlike("(?i)```mermaid")
    return (
        F.when(flags["visual"], True)
        .when(flags["simple_fact"], False)
        .when(drawn, said >= 45)
        .otherwise((flags["complex"] & (said >= 35)) | ((asked >= 14) & (said >= 55)))
    )
