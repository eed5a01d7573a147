"""Queries on repeated passages: substring dedup by suffix automata and by sparse suffix arrays."""

from __future__ import annotations

from boutlens.llm import repeats, substring_dedup, suffix_dedup
from boutlens.llm.queries import query, table

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
hit AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE doc_id > least),
edge AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 50) AS nxt, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prv FROM hit),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, least(i + 50, nxt))) AS p FROM edge),
runs AS (SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone) WHERE q IS NULL OR q <> p - 1 GROUP BY doc_id),
per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
      CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS kept
      FROM d LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM k LEFT JOIN runs USING (doc_id)"""


@query("op1_substring_dedup", REPEATS_SQL)
def op1_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.digest(repeats.with_spans(docs, substring_dedup.spans(docs)))


@query("op2_suffix_dedup", REPEATS_SQL)
def op2_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.digest(repeats.with_spans(docs, suffix_dedup.spans(docs)))
