"""The query on near duplicates."""

from __future__ import annotations

import string

from boutlens.llm import ngram_join
from boutlens.llm.queries import query, table

JOIN_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL"""


@query("op5_ngram_join", JOIN_SQL)
def op5_ngram_join(spark, sf_dir):
    return ngram_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
