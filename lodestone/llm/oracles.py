"""DuckDB's SQL for the operators that SQL can express: substring removal and secret scans."""

from __future__ import annotations

from .secrets import BASE, RULES

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE least < doc_id),
n AS (SELECT doc_id, list(p) AS p, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n.n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n.n IS NULL THEN w.w ELSE list_filter(w.w, lambda x, i: NOT list_contains(n.p, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id"""


def secrets() -> str:
    """A rule's matches and the texts between them add up to places."""
    each = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        each.append(f"""SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, pos, pos + length(h[i]) AS till FROM (
SELECT *, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM (
SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
SELECT doc_id, regexp_extract_all(text, '{p}') AS h, regexp_extract_all(text, '{p}', {r.group}) AS g, string_split_regex(text, '{p}') AS gaps FROM documents WHERE regexp_matches(text, '{p}'))))
WHERE length(g[i]) >= {r.least}""")
    text = "kind || ':' || pos || ':' || till"
    counts = ", ".join(f"count(*) FILTER (rule = {i}) AS n_{r.kind}" for i, r in enumerate(RULES[:BASE]))
    return f"""WITH s AS ({' UNION ALL '.join(each)}),
d AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY pos, rule) FILTER (rule < {BASE}) AS base, string_agg({text}, ',' ORDER BY pos, rule) AS spans FROM s GROUP BY doc_id)
SELECT documents.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES[:BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": SUBSTRING, "op8_secrets": secrets()}
