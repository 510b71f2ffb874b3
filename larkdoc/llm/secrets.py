"""Secret scanning with one deterministic automaton for all rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.automaton import Automaton
from larkdoc.llm.common import batched, id_and_text


@dataclass(frozen=True)
class Rule:
    """``head`` then ``value``; matches whose value is shorter than ``least`` bytes are dropped after matching.

    The last part of ``value`` must repeat one class of characters, so that a match ends where that run ends.
    """

    kind: str
    head: str
    value: str
    least: int = 1
    any_case: bool = False


#: The rules' patterns. Only the length of hex runs is written into the pattern, where
#: it can't change what is found, as a run is one match: so most letters don't reach an accepting state.
#: Elsewhere a count in the pattern would multiply the automaton's states.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 14),
    Rule("hex", "", "[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+"),
)
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


class Scanner:
    """Finds, for each rule, the leftmost non-overlapping matches of ``head value``.

    One forward pass over the bytes tells for all rules where matches end. Only there a rule's
    backward automaton runs to the match's start, no further than the rule's previous match.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        case = [r.any_case for r in rules]
        self.forward = Automaton([r.head + r.value for r in rules], case, anywhere=True)
        self.back = [Automaton([r.head + r.value], [r.any_case], anywhere=False, backwards=True) for r in rules]
        self.head = [Automaton([r.head], [r.any_case], anywhere=False) for r in rules]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then by the order of the rules."""
        data, found, passed = text.encode("utf-8", "replace"), [], [0] * len(self.rules)
        for end, bits in self.forward.run_ends(data):
            for k, rule in enumerate(self.rules):
                if not bits >> k & 1:
                    continue
                size = self.back[k].longest(data[passed[k] : end][::-1])
                if size < 0:
                    continue
                passed[k] = end
                if size - max(0, self.head[k].longest(data[end - size : end])) >= rule.least:
                    found.append((end - size, k, end))
        if not found:
            return []
        if len(data) != len(text):
            at, point, points = 0, 0, {}
            for byte in sorted({x for start, _, end in found for x in (start, end)}):
                point, at = point + len(data[at:byte].decode("utf-8")), byte
                points[byte] = point
            found = [(points[start], k, points[end]) for start, k, end in found]
        return [(self.rules[k].kind, start, end) for start, k, end in sorted(found)]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans), one for each row of ``docs``; spans are in code points, end exclusive.

    A null or empty text has no spans; a null id stays null; repeated rows are scanned each;
    no rows give no rows. Texts are scanned whole, however long, one at a time. Other columns are ignored.
    """

    compiled = scanner(rules)  # once, on the driver

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = compiled.spans
        schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS)])
        rows = ((doc_id, [{"kind": k, "start": s, "end": e} for k, s, e in scan(text.as_py())]) for batch in batches for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        return batched(rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(task, f"doc_id long, spans {SPANS}")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; a null text stays null, other columns stay as they are."""

    compiled = scanner(rules)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        scan = compiled.spans
        return texts.map(lambda t: None if t is None else redacted(t, scan(t), mark))

    return docs.withColumn(text_col, clean(F.col(text_col)))
