"""Patterns behind a look at their first letters match what they match alone."""

import sys
import unicodedata

from pyspark.sql import functions as F

from larkdoc.functions import rules, text

FLAGS = (rules.MINDMAP, rules.VISUAL, rules.COMPLEX, rules.SIMPLE_FACT, rules.TIMELINE, rules.PIE, rules.FLOW, rules.SUMMARY)


def test_guards_change_no_match(spark):
    others: dict[str, set[str]] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.category(c) in ("Lu", "Ll", "Lt"):
            for x in {c.lower(), c.upper().lower(), c.lower().upper(), c.upper()} - {c}:
                others.setdefault(x, set()).add(c)
    said = {"", "w", "ở", "ở  đâu", "ở đâu", "ởđâu", "xx yy", "w hat"}
    for way in "|".join(FLAGS).split("|"):
        plain = way.replace(r"\s*", " ")
        said |= {plain, plain.replace(" ", ""), plain.upper(), f"a {plain} z", f"l{plain}", unicodedata.normalize("NFD", plain), plain[:2], plain[1:]}
        said |= {plain[:i] + c + plain[i + 1 :] for i in (0, 1) for c in others.get(plain[i], set()) | {"i", "ı", "İ", "ſ", "K"}}
    rows = spark.createDataFrame([(t,) for t in sorted(said)] + [(None,)], "t string")
    for pattern in (*FLAGS, rules.DOCUMENT_NUMBER, rules.SCOPE_SENSITIVE, "flow|b?us", "a|bc"):
        found = rows.where(text.matches(F.col("t"), pattern) != F.coalesce(F.col("t").rlike(f"{text.ANY_CASE}(?:{pattern})"), F.lit(False))).collect()
        assert not found, (pattern, found)


def test_flags_are_guarded_and_other_patterns_are_not():
    assert all(text.guarded(p).startswith("(?=[") for p in FLAGS)
    assert text.guarded("ab|c") == "(?=[a][b]|c)(?:ab|c)"
    assert [text.guarded(p) for p in (rules.DOCUMENT_NUMBER, "flow|b?us", "abc")] == [rules.DOCUMENT_NUMBER, "flow|b?us", "abc"]
