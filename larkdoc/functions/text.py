"""Text columns: tokens, questions, names, labels, sources. All but ``fold_text`` stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkdoc.functions import rules

WORD = r"[\p{L}\p{N}_]+"
ANY_CASE = "(?iu)"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def normalize_ws(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words in order, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.lower)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(text, F.lit(""))))


def overlap_score(question: Column, content: Column) -> Column:
    """Share of the question's token set that the content's has; 0 without content tokens."""
    return F.size(F.array_intersect(question, content)) / F.greatest(F.lit(1), F.size(question))


def guarded(pattern: str) -> str:
    """``pattern`` behind a look at the next two characters, where it is alternatives of letters, spaces and ``\\s*`` that begin with a letter; else as it is.

    The regex engine would try every alternative at every place of a text.
    """
    ways = pattern.split("|")
    if len(ways) == 1 or not all(re.fullmatch(r"[^\W\d_](?:[^\W\d_]| |\\s\*)*", way) for way in ways):
        return pattern
    two = [way for way in ways if way[1:2].isalpha()]
    pairs = ["".join(f"[{''.join(sorted({way[i] for way in two}))}]" for i in (0, 1))] if two else []
    return f"(?={'|'.join([*pairs, *sorted({way[0] for way in ways if way not in two})])})(?:{pattern})"


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(ANY_CASE + guarded(pattern)), F.lit(False))


def rewrite_question(text: Column) -> Column:
    """The canonical question of the first rule that matches at the start; else the text with plain spaces."""
    question = normalize_ws(text)
    chained = reduce(lambda when, rule: when.when(question.rlike(f"{ANY_CASE}^(?:{rule[0]})"), F.lit(rule[1])), rules.REWRITES[1:], F.when(question.rlike(f"{ANY_CASE}^(?:{rules.REWRITES[0][0]})"), F.lit(rules.REWRITES[0][1])))
    return chained.otherwise(question)


def effective_top_k(question: Column, base: Column | int = rules.TOP_K) -> Column:
    """More rows for long or complex questions, from 1 to 20."""
    base = F.lit(base) if isinstance(base, int) else base
    n = F.size(token_set(question))
    wanted = base + F.when(n >= 30, 4).when(n >= 18, 2).otherwise(0) + F.when(matches(question, rules.COMPLEX), 2).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(rules.MAX_TOP_K), wanted))


def split_question(question: Column) -> Column:
    """Up to four parts of a long question, cut at ``;`` and ``?``."""
    parts = F.transform(F.split(question, r"[;\n?]+"), lambda p: F.regexp_replace(normalize_ws(p), r"^[.,: -]+|[.,: -]+$", ""))
    kept = F.filter(parts, lambda p: (F.length(p) >= 16) & (F.size(token_set(p)) >= 3))
    return F.when(F.length(question) >= 40, F.slice(kept, 1, 4)).otherwise(F.array().cast("array<string>"))


def focus_terms(question: Column) -> Column:
    """Distinct tokens in order, longer than two characters, no stop words and no numbers."""
    stop = F.array(*map(F.lit, rules.STOP_WORDS))
    return F.filter(token_set(question), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t) & ~t.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"))


def expand_queries(raw: Column, rewritten: Column) -> Column:
    """The queries to search for, in order, without repeats in another case."""
    focus = focus_terms(raw)
    head, few = F.array(raw, rewritten), F.array_join(F.slice(focus, 1, 8), " ")
    more = F.array(F.when(F.size(focus) >= 3, few), F.when((rewritten != raw) & (F.size(focus) >= 2), F.concat(rewritten, F.lit(". "), F.array_join(F.slice(focus, 1, 6), " "))))
    found = F.filter(F.concat(head, split_question(raw), more), lambda q: q.isNotNull() & ~is_blank(q))
    return F.filter(found, lambda q, i: F.array_position(F.transform(found, F.lower), F.lower(q)) == i + 1)


def chunk_key(source: Column, page: Column, chunk_index: Column, start_index: Column, text: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (source, page, chunk_index, start_index)]
    return F.concat_ws("|", *parts, F.sha1(F.encode(F.substring(text, 1, 512), "UTF-8")))


def question_key(raw: Column, rewritten: Column, scope: Column, top_k: Column) -> Column:
    return F.sha2(F.to_json(F.struct(scope.alias("f"), top_k.alias("k"), rewritten.alias("q"), raw.alias("rq"))), 256)


def is_fallback(answer: Column, sentence: str = rules.FALLBACK_ANSWER) -> Column:
    return F.regexp_replace(F.lower(strip(answer)), r"\.+$", "") == F.lit(sentence.lower())


def display_name(path: Column) -> Column:
    """A stored path's base name without its 32-character prefix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"^[^_]{32}_", "")


def stored_name(name: Column) -> Column:
    """A unique name to store an upload under; not the same twice."""
    return F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit("_"), name)


def source_ref(path: Column, page: Column, chunk_index: Column, page_label: str = "trang", chunk_label: str = "đoạn") -> Column:
    return F.concat(display_name(path), F.coalesce(F.concat(F.lit(f" ({page_label} "), page.cast("string"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(f" [{chunk_label} "), chunk_index.cast("string"), F.lit("]")), F.lit("")))


def split_sentences(text: Column) -> Column:
    """Sentences: cut behind . ! ? with white space after them, and at line ends."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def format_context(ranked: Column) -> Column:
    """Blocks ``[i] source=... | page=...`` and text, from an array of structs (source, page, text) in order."""
    return F.array_join(F.transform(ranked, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] source="), d["source"], F.coalesce(F.concat(F.lit(" | page="), d["page"].cast("string")), F.lit("")), F.lit("\n"), d["text"])), "\n\n")


def clean_label(text: Column) -> Column:
    """A short diagram label: no markup or slashes, at most 64 characters."""
    plain = normalize_ws(F.regexp_replace(text, r"[`*_#>\[\](){}|\"\\/<]", " "))
    plain = F.regexp_replace(plain, r"^[ \-:;,._\t]+|[ \-:;,._\t]+$", "")
    return F.when(F.length(plain) > 64, F.concat(F.rtrim(F.substring(plain, 1, 61)), F.lit("..."))).otherwise(plain)


def split_branch_child(text: Column) -> Column:
    """(branch, child) of ``branch: child``; the child is null without a colon."""
    parts = F.split(text, r"\s*[:：]\s*", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("branch"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("child"))


def question_flags(question: Column) -> dict[str, Column]:
    kinds = {"mindmap": rules.MINDMAP, "visual": rules.VISUAL, "complex": rules.COMPLEX, "simple_fact": rules.SIMPLE_FACT, "timeline": rules.TIMELINE, "pie": rules.PIE, "flow": rules.FLOW, "summary": rules.SUMMARY}
    return {name: matches(question, pattern) for name, pattern in kinds.items()}


def diagram_kind(question: Column, branches: Column | None = None) -> Column:
    """Timeline, pie, mindmap or flowchart by the question's words; else by the hash of the lower-cased question, or of an outline's ``branches`` if the question is empty."""
    flags = question_flags(question)
    asked = F.lower(F.coalesce(question, F.lit("")))
    seed = asked if branches is None else F.when(asked == "", F.coalesce(branches, F.lit(""))).otherwise(asked)
    last = F.conv(F.right(F.sha1(F.encode(seed, "UTF-8")), F.lit(1)), 16, 10).cast("int") % 4
    kinds = F.array(*map(F.lit, ("flowchart", "mindmap", "timeline", "pie")))
    return F.when(flags["timeline"], "timeline").when(flags["pie"], "pie").when(flags["mindmap"], "mindmap").when(flags["flow"], "flowchart").otherwise(F.get(kinds, last))


def has_table(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?m)^[ \t]*\|.+\|[ \t]*\n[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"), F.lit(False))


def has_bullets(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?m)^[ \t]*([-*•]|\d+[.)])[ \t]+\S"), F.lit(False))


def attach_sources(answer: Column, sources: Column, marker: str = "<!--larkdoc:sources:") -> Column:
    """The answer with its distinct trimmed sources as one encoded comment behind it."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(sources, F.array().cast("array<string>")), strip), lambda s: s != ""))
    coded = F.regexp_replace(F.base64(F.encode(F.to_json(clean), "UTF-8")), r"[\r\n]", "")
    return F.when(F.size(clean) > 0, F.concat(answer, F.lit(f"\n\n{marker}"), coded, F.lit("-->"))).otherwise(answer)


def extract_sources(message: Column, marker: str = "<!--larkdoc:sources:") -> Column:
    """(text, sources) of a message: markers go, their lists are joined, bad ones count as empty."""
    coded = F.regexp_extract_all(message, F.lit(f"{marker}([A-Za-z0-9+/=_-]*)-->"), 1)
    lists = F.transform(coded, lambda c: F.coalesce(F.from_json(F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8"), "array<string>"), F.array().cast("array<string>")))
    sources = F.array_distinct(F.filter(F.transform(F.flatten(lists), strip), lambda s: s != ""))
    text = F.regexp_replace(F.regexp_replace(message, f"{marker}[^>]*-->", ""), r"\n{3,}", "\n\n")
    return F.struct(strip(text).alias("text"), sources.alias("sources"))


def occurrences(text: Column, needle: Column) -> Column:
    """How often ``needle`` stands in ``text``, in any case, overlaps included."""
    low, find = F.lower(text), F.lower(needle)
    return F.when((F.length(find) == 0) | (F.instr(low, find) == 0), 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - F.length(find) + 1)), lambda i: F.substring(low, i, F.length(find)) == find)))


def json_string_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def progress_percent(stage: Column, done: Column, total: Column) -> Column:
    """Percent of a job by its stage and what it has done."""
    share = done / F.greatest(F.lit(1), total)
    return F.when(stage == "loading", 5 + F.floor(share * 25)).when(stage == "chunking", 35).when(stage == "indexing", 40 + F.floor(share * 55)).when(stage == "saving", 98).when(stage == "completed", 100).otherwise(0).cast("int")


def truncate_answer(answer: Column, most: int = rules.MAX_ANSWER_CHARS) -> Column:
    return F.substring(answer, 1, most)


@F.pandas_udf(T.StringType())
def fold_text(texts: pd.Series) -> pd.Series:
    """Decomposed, without marks, lower case, only a-z and digits, single spaces; no SQL function decomposes characters."""

    def fold(text: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())

    return texts.map(lambda t: None if t is None else fold(t))


def document_aliases(name: Column) -> Column:
    """Folded names that a question may use: the full name, its stem, the stem's last three words."""
    full = fold_text(name)
    stem = fold_text(F.regexp_replace(name, r"\.[^.]*$", ""))
    words = F.split(stem, " ")
    last = F.when(F.size(words) >= 3, F.array_join(F.slice(words, -3, 3), " "))
    return F.array_distinct(F.filter(F.array(F.when(F.length(full) >= 3, full), F.when(F.length(stem) >= 3, stem), last), lambda a: a.isNotNull() & (a != "")))


def numbered_list(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), n)), "\n")


def annotate_question(question: Column, names: Column) -> Column:
    """The question with the numbered names of its documents behind it, if there are several."""
    return F.when(F.size(names) > 1, F.concat(question, F.lit("\n\n"), numbered_list(names))).otherwise(question)


def clarification_text(names: Column, prompt: str = "Which document do you mean?") -> Column:
    return F.concat(F.lit(prompt + "\n"), numbered_list(names))


def title_or_default(title: Column, default: str) -> Column:
    clean = strip(F.coalesce(title, F.lit("")))
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def clamp(value: Column, low: int, high: int | None = None) -> Column:
    """``value`` as an integer from ``low`` to ``high``; what is no number counts as ``low``."""
    number = F.greatest(F.lit(low), F.coalesce(value.try_cast("int"), F.lit(low)))
    return number if high is None else F.least(F.lit(high), number)


def ingest_error_text(message: Column, known: dict[str, str] | None = None, default: str = "The file could not be read.") -> Column:
    """Guidance for messages that hold a known part, else the message, else a default."""
    out = F.when(is_blank(message), F.lit(default))
    for part, guidance in (known or {}).items():
        out = out.when(F.contains(message, F.lit(part)), F.lit(guidance))
    return out.otherwise(message)
