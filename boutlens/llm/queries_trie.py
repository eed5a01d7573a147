"""The query on beginnings of conversations."""

from __future__ import annotations

from boutlens.llm import trie
from boutlens.llm.queries import CRC_TABLE, crc_of, query, table

#: beginnings as lists of hashed turns
TRIE_SQL = f"""
WITH {CRC_TABLE},
m AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS i FROM m),
c AS (SELECT conv_id, {crc_of('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM m), crc),
r AS (SELECT c.conv_id, 0 AS part, i, id, n FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND i < h
      UNION ALL SELECT c.conv_id, 1, i, id, n FROM c JOIN o ON o.conv_id = c.conv_id AND i >= h),
p AS (SELECT c.conv_id, coalesce(list(id ORDER BY part, i) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(n ORDER BY part, i) FILTER (id IS NOT NULL), []) AS ns FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
e AS (SELECT conv_id, d, ids[:d] AS way, len(ids) = d AS ends, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM p)),
v AS (SELECT way, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY way),
k AS (SELECT way[:-2] AS up, depth - 1 AS depth, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k ON k.up = v.way AND k.depth = v.depth),
s AS (SELECT way[:a] AS top, sum((n_convs - 1) * n)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s ON s.top = w.way LEFT JOIN v AS p ON w.depth > 0 AND p.way = w.way[:-2] AND p.depth = w.depth - 1"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark, sf_dir):
    return trie.prefix_tree(table(spark, sf_dir, "conversations"))
