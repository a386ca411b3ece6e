"""SQL for DuckDB of the queries that SQL can express on whole tables."""

from __future__ import annotations

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN f USING (k) WHERE doc_id > first),
r AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(js, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

DECONTAMINATE = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
s AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
b AS (SELECT DISTINCT id AS item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT id, w, least(13, len(w)) AS k FROM s WHERE side = 'b' AND len(w) > 0))),
o AS (SELECT id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s, (SELECT DISTINCT k FROM b) WHERE side = 'd')),
h AS (SELECT id, i, k, item_id FROM o JOIN b USING (k, phrase)),
c AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, unnest(range(i, i + k)) AS j FROM h) GROUP BY id),
m AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY id)
SELECT s.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM s LEFT JOIN c USING (id) LEFT JOIN m USING (id) WHERE side = 'd'
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licences() -> str:
    """The trained licence model as tables of constants, and its sums and comparisons."""
    from . import licences as scan

    model, size, step = scan.train(), 2 * scan.LONGEST, scan.LONGEST
    weights = ", ".join(f"({_text(g)}, {k}, {v})" for g, w in model.weights.items() for k, v in enumerate(w) if v)
    classes = ", ".join(f"({k}, {_text(c)}, {s})" for k, (c, s) in enumerate(zip(model.classes, model.start, strict=True)))
    notices = ", ".join(f"({_text(f)}, {_text(','.join(t))})" for f, ts in scan.templates().items() for t in ts)
    return rf"""
WITH weights(gram, k, v) AS (VALUES {weights}), classes(k, family, start) AS (VALUES {classes}), notices(family, t) AS (VALUES {notices}),
paragraphs AS (SELECT row, doc_id, generate_subscripts(p, 1) - 1 AS paragraph, unnest(p) AS p FROM (SELECT row_number() OVER () AS row, doc_id, string_split_regex(text, '{scan.BETWEEN}') AS p FROM documents)),
lines AS (SELECT row, doc_id, paragraph, unnest(string_split(p, chr(10))) AS line, true AS own FROM paragraphs UNION ALL SELECT row, doc_id, paragraph, p, false FROM paragraphs WHERE contains(p, chr(10)) OR length(p) > {size}),
split AS (SELECT * EXCLUDE (line), list_filter(string_split(regexp_replace(regexp_replace(lower(line), '[0-9]+', ' 0 ', 'g'), '[^a-z0]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM lines),
passages AS (SELECT row, doc_id, paragraph, w FROM split WHERE own AND len(w) <= {size}
    UNION SELECT row, doc_id, paragraph, w[i * {step} + 1:i * {step} + {size}] FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((len(w) - {size}) / {step}), 0) AS BIGINT) + 1)) AS i FROM split WHERE NOT own)),
w AS (SELECT row, doc_id, paragraph, row_number() OVER () AS passage, w FROM passages),
g AS (SELECT passage, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS gram FROM w),
s AS (SELECT passage, k, sum(v) AS v FROM g JOIN weights USING (gram) GROUP BY ALL),
z AS (SELECT p.passage, c.family, c.start + coalesce(s.v, 0) AS z FROM (SELECT DISTINCT passage FROM s) p CROSS JOIN classes c LEFT JOIN s ON s.passage = p.passage AND s.k = c.k),
b AS (SELECT passage, arg_max(family, z) AS family, max(z) AS top FROM z GROUP BY ALL),
p AS (SELECT b.passage, b.family, round(1 / sum(exp((z.z - top) / {model.temperature})), 4) AS probability FROM b JOIN z ON z.passage = b.passage GROUP BY ALL),
t AS (SELECT p.*, row, doc_id, paragraph, list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS triples
    FROM p JOIN w USING (passage) WHERE p.family <> '{scan.UNKNOWN}' AND probability >= {scan.LEAST}),
m AS (SELECT row, doc_id, paragraph, passage, t.family, t.probability,
    round(max(len(list_filter(string_split(n.t, ','), lambda x: list_contains(t.triples, x))) / len(string_split(n.t, ','))), 4) AS similarity
    FROM t JOIN notices n ON n.family = t.family GROUP BY ALL),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY row, paragraph, family ORDER BY similarity DESC, probability DESC) = 1)
SELECT doc_id, paragraph, family, probability, similarity, similarity >= {scan.SHARE} AS confirmed FROM o
"""
