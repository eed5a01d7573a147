"""The query on conversations."""

from __future__ import annotations

from boutlens.llm import threads
from boutlens.llm.queries import F, query, table

THREADS_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS k, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
a AS (SELECT k, conv_id, turn, role, i, length(regexp_replace(regexp_extract(ls[i], '{threads.QUOTE}'), '[^>]', '', 'g')) AS lv, regexp_replace(ls[i], '{threads.QUOTE}', '') AS s
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
b AS (SELECT *, lv = 0 AND coalesce(lead(lv) OVER (PARTITION BY k ORDER BY i), 0) > 0 AND regexp_matches(s, '{threads.WROTE}') AS wrote FROM a),
c AS (SELECT *, regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', '', 'g') AS h FROM b),
per AS (SELECT k, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(role) AS role,
        trim(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE lv = 0 AND NOT wrote), ''), ' ') AS body,
        count(*) FILTER (WHERE lv > 0 AND h <> '')::BIGINT AS quoted_lines, coalesce(max(lv) FILTER (WHERE h <> '' AND NOT wrote), 0)::BIGINT AS levels FROM c GROUP BY k),
f AS (SELECT conv_id, h, min(turn) AS author FROM c WHERE lv = 0 AND NOT wrote AND h <> '' GROUP BY ALL),
q AS (SELECT c.conv_id, c.turn, f.author, count(*) AS n FROM c JOIN f USING (conv_id, h) WHERE lv = 1 AND h <> '' AND f.author < c.turn GROUP BY ALL),
r AS (SELECT conv_id, turn, arg_max(author, n * 1000000 + author) AS reply_to FROM q GROUP BY ALL),
p(conv_id, turn, up, path) AS (SELECT conv_id, turn, reply_to, [turn] FROM (SELECT DISTINCT conv_id, turn FROM m) LEFT JOIN r USING (conv_id, turn)
      UNION ALL SELECT p.conv_id, p.turn, r.reply_to, list_prepend(p.up, p.path) FROM p LEFT JOIN r ON r.conv_id = p.conv_id AND r.turn = p.up WHERE p.up IS NOT NULL)
SELECT per.conv_id, per.turn, role, md5(body) AS body_md5, quoted_lines, levels, coalesce(reply_to, -1)::BIGINT AS reply_to, path[1] AS thread, (len(path) - 1)::BIGINT AS depth, array_to_string(path, '/') AS path
FROM per LEFT JOIN r USING (conv_id, turn) JOIN p ON p.conv_id = per.conv_id AND p.turn = per.turn AND p.up IS NULL"""


@query("op7_chat_threads", THREADS_SQL)
def op7_chat_threads(spark, sf_dir):
    rows = threads.conversations(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", F.md5(F.col("body").cast("binary")).alias("body_md5"), "quoted_lines", "levels", F.coalesce("reply_to", F.lit(-1)).alias("reply_to"), "thread", "depth", "path")
