"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from larkdoc.llm.chat import INSTRUCTION_TEMPLATE
from larkdoc.llm.near_duplicates import SHINGLE, SIMILARITY
from larkdoc.llm.secrets import BASE_RULES, MORE_RULES
from larkdoc.llm.substrings import WINDOW

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS x FROM w, unnest(range(1, greatest(1, len(ws) - {SHINGLE - 1}) + 1)) AS t(i) WHERE len(ws) > 0),
c AS (SELECT doc_id, x, count(*) AS n FROM s GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
o AS (SELECT p.doc_id AS a, q.doc_id AS b, sum(least(p.n, q.n)) AS n FROM c p JOIN c q USING (x) WHERE p.doc_id < q.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE o.n / (p.n + q.n - o.n) >= {SIMILARITY}
  UNION SELECT p.doc_id, q.doc_id FROM w p JOIN w q ON len(p.ws) = 0 AND len(q.ws) = 0 AND p.doc_id < q.doc_id),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, doc_id <= coalesce(m, doc_id) AS kept FROM documents LEFT JOIN least_id ON a = doc_id"""


def _secrets() -> str:
    found = []
    for k, rule in enumerate(BASE_RULES + MORE_RULES):
        pattern = _quoted(("(?i)" if rule.any_case else "") + f"(?:{rule.head})({rule.value})")
        value = f"length(regexp_extract(x, {pattern}, {1 + rule.head.count('(')}))"
        found.append(f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, start, start + length(x) AS stop FROM (SELECT doc_id, ms[i] AS x, coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS start FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS ms, string_split_regex(t, {pattern}) AS ps FROM d) , unnest(range(1, len(ms) + 1)) AS u(i)) WHERE {value} >= {rule.least}")
    base = ", ".join(_quoted(r.kind) for r in BASE_RULES)
    joined = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(found)})
SELECT doc_id, {counts}, sha256(coalesce({joined} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({joined} FILTER (kind IS NOT NULL), '') AS spans FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"""


SECRETS = _secrets()

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN first USING (h) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM hit),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def chat(control_words: str) -> str:
    template, escaped = INSTRUCTION_TEMPLATE, "replace(x, '\\', '\\\\')"
    for c in template.controls:
        escaped = f"replace({escaped}, {_quoted(c)}, {_quoted(c[0] + template.escape + c[1:])})"
    # one more before each character from which on the end is the beginning of a control string, unless that follows a split
    sizes = range(1, len(template.controls[0]))
    ends = " + ".join(f"(length(x) >= {k} AND right(x, {k}) IN ({', '.join(_quoted(b) for b in sorted(template.beginnings) if len(b) == k)}))::INT" for k in sizes)
    spared = " + ".join(["0"] + [f"ends_with(x, {_quoted(c)})::INT" for c in template.controls if c[1:] in template.beginnings])
    chars = f"(length({escaped}) + {ends} - ({spared}))"
    marks = " ".join(f"WHEN '{role}' THEN {len(t.open + t.close)}" for role, t in template.turns.items())
    loss = ", ".join(_quoted(role) for role, t in template.turns.items() if t.loss)
    other = len(template.other.open + template.other.close)
    said = f"coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({loss})), '')"
    return f"""WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {_quoted(control_words)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(control_words)}),
t AS (SELECT *, (SELECT {chars} FROM (SELECT text AS x)) + CASE role {marks} ELSE {2 * other} + (SELECT {chars} FROM (SELECT role AS x)) END AS n FROM t0)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, length({said})::BIGINT AS loss_chars, sha256({said}) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""


EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
m AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
c AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN m ON m.a = vec_id"""


NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_dot_product(a.e, r.e)::BIGINT AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INT AS positive_rank FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
