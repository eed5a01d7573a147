"""Queries that judge each row by itself: quality rules, token counts."""

from __future__ import annotations

from boutlens.llm import quality, tokens
from boutlens.llm.queries import F, query, table

_STOPS = ", ".join("'" + w + "'" for w in dict.fromkeys(quality.STOP_WORDS))
_RULES = " AND ".join(f"({r.denominator} = 0 OR ({r.numerator} >= {r.low!r}::DOUBLE * {r.denominator} AND {r.numerator} <= {r.high!r}::DOUBLE * {r.denominator}))" for r in quality.RULES)

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM u),
p AS (SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS c FROM r WHERE n > 1),
rep AS (SELECT k, sum(c) AS c FROM p GROUP BY k),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
      length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(rep.c, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
      len(list_filter(string_split(regexp_replace(lower(t), '[\x20\x09-\x0D.,;:!?]+', ' ', 'g'), ' '), lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN rep USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_RULES} AS kept
FROM m"""


@query("op3_quality_rules", QUALITY_SQL)
def op3_quality_rules(spark, sf_dir):
    docs = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
