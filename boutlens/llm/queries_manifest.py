"""The query on the manifest of documents."""

from __future__ import annotations

from boutlens.llm import manifest
from boutlens.llm.queries import CRC_TABLE, F, crc_of, query, table


def _leaf(text: str) -> str:
    parts = (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


_UP = "sha256(string_agg(h, '' ORDER BY pos))"

#: trees level by level; a leaf of the tree of sources is a subroot.  ``way`` folds each leaf upwards
MANIFEST_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
l0 AS (SELECT doc_id, source, {_leaf('text')} AS leaf, coalesce({crc_of('doc_id')} % 5 = 0, false) AS bad,
              {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER () AS k FROM l0),
t(tree, lv, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM l
      UNION ALL SELECT tree, lv + 1, pos // 16, (any_value(n) + 15) // 16, {_UP} FROM t WHERE n > 1 GROUP BY tree, lv, pos // 16),
sub AS (SELECT tree AS pos, h, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, pos, n, h) AS (SELECT 0, pos, n, h FROM sub
      UNION ALL SELECT lv + 1, pos // 16, (any_value(n) + 15) // 16, {_UP} FROM u WHERE n > 1 GROUP BY lv, pos // 16),
nodes AS (SELECT tree, lv, pos, n, h FROM t UNION ALL SELECT -1, lv, pos, n, h FROM u),
runs AS (SELECT tree, lv, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
way(k, tree, lv, pos, n, v, proof, home) AS (
      SELECT k, tree, 0, pos, n, CASE WHEN bad THEN low ELSE leaf END, '', tree FROM l
      UNION ALL SELECT k, CASE WHEN way.n = 1 THEN -1 ELSE way.tree END, CASE WHEN way.n = 1 THEN 0 ELSE way.lv + 1 END,
             CASE WHEN way.n = 1 THEN home ELSE way.pos // 16 END, CASE WHEN way.n = 1 THEN (SELECT count(*) FROM sub) ELSE (way.n + 15) // 16 END,
             CASE WHEN way.n = 1 THEN v ELSE sha256(array_to_string(hs[:way.pos % 16] || [v] || hs[way.pos % 16 + 2:], '')) END,
             CASE WHEN way.n = 1 THEN proof ELSE proof || array_to_string(hs[:way.pos % 16] || hs[way.pos % 16 + 2:], '') END, home
      FROM way LEFT JOIN runs ON runs.tree = way.tree AND runs.lv = way.lv AND runs.run = way.pos // 16 WHERE way.n > 1 OR way.tree >= 0),
done AS (SELECT k, v, proof FROM way WHERE tree = -1 AND n = 1),
root AS (SELECT h FROM u WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = root.h AS verified
FROM l JOIN done USING (k) JOIN sub ON sub.pos = l.tree, root"""


@query("op12_merkle_manifest", MANIFEST_SQL)
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return manifest.verify(docs, manifest.tampered(), manifest.lowered(F.col("text")))
