"""Identity and odds-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlens.catalog import query
from boutlens.catalog import sqlkit as Q
from boutlens.functions.numbers import r6
from boutlens.operators import entities as EN
from boutlens.operators import odds as OD
from boutlens.session import materialize
from boutlens.sources import tables

ALIASES = ["s_name", "CASE WHEN s_suppkey % 3 = 0 THEN 'The Боец ''' ELSE 'Боец ' END || s_suppkey", "CASE WHEN s_suppkey % 2 = 0 THEN 'Б''оец ' ELSE 'Fighter ' END || s_suppkey"]
NAMED = ("CASE c_custkey % 5 WHEN 0 THEN upper('Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR(9)), 9, '0')) WHEN 1 THEN '  боец ' || (c_custkey % 120) || ' ' "
         "WHEN 2 THEN 'Boets-' || (c_custkey % 120) WHEN 3 THEN 'nobody' || c_custkey ELSE 'x' END")
ENT_SQL = f"SELECT s_suppkey AS pos, {Q.entity_id('s_name')} AS entity_id, {Q.norm_latin('s_name')} AS normalized, [{', '.join(ALIASES)}] AS aliases FROM supplier"
Q.cte("ents", [], ENT_SQL)
Q.cte("ents_alias", ["ents"], "SELECT pos, entity_id, normalized, unnest(aliases) AS alias FROM ents")
Q.cte("ents_keys", ["ents_alias"], f"""SELECT kind, key, min(pos) AS pos FROM (SELECT 'text' AS kind, lower(trim(alias)) AS key, pos FROM ents_alias UNION ALL
  SELECT 'norm', {Q.norm_latin('alias')}, pos FROM ents_alias UNION ALL SELECT 'norm', normalized, pos FROM ents_alias UNION ALL SELECT 'id', entity_id, pos FROM ents_alias) GROUP BY 1, 2""")


def resolved_sql(src: str, key: str, name: str) -> str:
    return f"""SELECT n.{key}, e.entity_id FROM {src} n LEFT JOIN ents_keys i ON i.kind = 'id' AND i.key = {Q.entity_id('n.' + name)}
  LEFT JOIN ents_keys t ON t.kind = 'text' AND t.key = lower(trim(n.{name})) LEFT JOIN ents_keys m ON m.kind = 'norm' AND m.key = {Q.norm_latin('n.' + name)}
  LEFT JOIN ents e ON e.pos = coalesce(i.pos, least(t.pos, m.pos)) AND length(n.{name}) >= 2"""


def entities(spark, d):
    df = tables.table(spark, d, "supplier")
    from boutlens.functions.text import entity_id, norm_latin
    return df.select(F.col("s_suppkey").alias("pos"), entity_id(F.col("s_name")).alias("entity_id"), norm_latin(F.col("s_name")).alias("normalized"),
                     F.array(*[F.expr(a) for a in ALIASES]).alias("aliases"))


@query("resolve_id", Q.with_(["ents_keys"], f", named AS (SELECT c_custkey, {NAMED} AS name FROM customer) SELECT c_custkey, coalesce(entity_id, '') AS entity_id FROM ({resolved_sql('named', 'c_custkey', 'name')})").replace("\n, named", ",\nnamed"))
def resolve_id(spark, d):
    names = tables.table(spark, d, "customer").select("c_custkey", F.expr(NAMED).alias("name"))
    return EN.resolve(names, entities(spark, d)).select("c_custkey", F.coalesce("entity_id", F.lit("")).alias("entity_id"))


OTHER = NAMED.replace("c_custkey % 5", "(c_custkey + 1) % 5")


@query("same_entity", Q.with_(["ents_keys"], f""", p AS MATERIALIZED (SELECT c_custkey, {NAMED} AS name_1, CASE WHEN c_custkey % 7 = 0 THEN {NAMED} ELSE {OTHER} END AS name_2 FROM customer),
  a AS ({resolved_sql('p', 'c_custkey', 'name_1')}), b AS ({resolved_sql('p', 'c_custkey', 'name_2')})
  SELECT c_custkey, CASE WHEN a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL THEN CAST(a.entity_id = b.entity_id AS INT)
    ELSE CAST({Q.norm_latin('name_1')} = {Q.norm_latin('name_2')} AS INT) END AS same FROM p JOIN a USING (c_custkey) JOIN b USING (c_custkey)""").replace("\n, p AS", ",\np AS"))
def same_entity(spark, d):
    df = tables.table(spark, d, "customer").select("c_custkey", F.expr(NAMED).alias("name_1"),
                                                   F.expr(f"CASE WHEN c_custkey % 7 = 0 THEN {NAMED} ELSE {OTHER} END").alias("name_2"))
    return EN.same_entity(df, entities(spark, d)).select("c_custkey", "same")


_canon = ("coalesce(list_filter(al, lambda a: regexp_matches(lower(a), '[а-яё]') AND contains(a, '''') AND NOT contains(lower(a), 'no contest') AND NOT contains(lower(a), 'nc') "
          "AND NOT contains(lower(a), 'the ') AND NOT contains(lower(a), 'killer'))[1], list_filter(al, lambda a: regexp_matches(lower(a), '[а-яё]'))[1], al[1])")


@query("canonical_alias", Q.with_(["ents"], f"SELECT pos, {_canon} AS canonical FROM (SELECT pos, aliases AS al FROM ents)"))
def canonical_alias(spark, d):
    return entities(spark, d).select("pos", EN.canonical_alias(F.col("aliases")).alias("canonical"))


WINTXT = "CASE bout_id % 4 WHEN 0 THEN upper(coalesce(winner, fighter_a)) WHEN 1 THEN coalesce(winner, '') || ' ' || 'ё' WHEN 2 THEN 'боец ' || bout_id % 90 ELSE 'stranger ' || bout_id END"


@query("winner_side", Q.with_(["bouts", "ents_keys"], f""", w AS MATERIALIZED (SELECT bout_id, fighter_a, fighter_b, {WINTXT} AS t FROM bouts), r AS ({resolved_sql('w', 'bout_id', 't')}),
  n AS (SELECT *, {Q.norm_ru('t')} AS nt, {Q.norm_ru('fighter_a')} AS na, {Q.norm_ru('fighter_b')} AS nb FROM w)
  SELECT bout_id, CASE WHEN contains(nt, na) OR contains(na, nt) THEN fighter_a WHEN contains(nt, nb) OR contains(nb, nt) THEN fighter_b ELSE coalesce(c.canonical, t) END AS winner_name
  FROM n JOIN r USING (bout_id) LEFT JOIN (SELECT entity_id, {_canon} AS canonical FROM (SELECT entity_id, aliases AS al FROM ents)) c USING (entity_id)""").replace("\n, w AS", ",\nw AS"))
def winner_side(spark, d):
    df = tables.bouts(spark, d).select("bout_id", "fighter_a", "fighter_b", F.expr(WINTXT).alias("winner_text"))
    return EN.winner_side(df, entities(spark, d)).select("bout_id", "winner_name")


@query("name_variants", Q.with_(["ents_alias"], f""", nm AS (SELECT DISTINCT {NAMED} AS name FROM customer), k AS (SELECT name, {Q.norm_latin('name')} AS norm, {Q.surname('name')} AS last FROM nm),
  al AS MATERIALIZED (SELECT entity_id, {Q.norm_latin('alias')} AS norm, {Q.surname('alias')} AS last FROM ents_alias),
  hit AS (SELECT DISTINCT name, entity_id FROM k JOIN al ON al.norm = k.norm OR al.last = k.last)
  SELECT DISTINCT name, variant FROM (SELECT name, norm AS variant FROM k UNION ALL SELECT name, last FROM k UNION ALL SELECT name, al.norm FROM hit JOIN al USING (entity_id)
    UNION ALL SELECT name, al.last FROM hit JOIN al USING (entity_id)) WHERE variant <> ''""").replace("\n, nm", ",\nnm"))
def name_variants(spark, d):
    names = tables.table(spark, d, "customer").select(F.expr(NAMED).alias("name"))
    return EN.variants(names, entities(spark, d))


@query("entity_build", Q.with_(["bouts"], f"""SELECT {Q.entity_id('min(name)')} AS entity_id, norm AS normalized, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases,
  strftime(min(bout_date), '%Y-%m-%d') AS first_seen, count(*) AS fights_count FROM (SELECT name, bout_date, {Q.norm_latin('name')} AS norm FROM
  (SELECT CASE bout_id % 3 WHEN 0 THEN upper(fighter_a) WHEN 1 THEN fighter_a ELSE ' ' || fighter_a END AS name, bout_date FROM bouts UNION ALL SELECT fighter_b, bout_date FROM bouts)) GROUP BY 2"""))
def entity_build(spark, d):
    df = tables.bouts(spark, d)
    a = df.select(F.expr("CASE bout_id % 3 WHEN 0 THEN upper(fighter_a) WHEN 1 THEN fighter_a ELSE ' ' || fighter_a END").alias("name"), F.col("bout_date").alias("day"))
    b = df.select(F.col("fighter_b").alias("name"), F.col("bout_date").alias("day"))
    out = EN.build(a.unionByName(b))
    return out.select("entity_id", "normalized", F.array_join("aliases", "|").alias("aliases"), F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "fights_count")


_POOL = "SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer UNION SELECT p_name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region"


def _pool_sources(spark, d):
    return [(tables.table(spark, d, t), c) for t, c in (("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name"), ("nation", "n_name"), ("region", "r_name"))]


@query("known_names", f"SELECT name FROM ({_POOL}) WHERE length(name) > 2")
def known_names(spark, d):
    return EN.name_pool(_pool_sources(spark, d))


@query("name_pool", Q.with_(["ents_alias"], f"SELECT DISTINCT name FROM ({_POOL} UNION SELECT alias FROM ents_alias UNION SELECT {NAMED} FROM customer WHERE regexp_matches(lower({NAMED}), '[а-яё]')) WHERE length(name) > 2"))
def name_pool(spark, d):
    alias = entities(spark, d).select(F.explode("aliases").alias("alias"))
    named = tables.table(spark, d, "customer").select(F.expr(NAMED).alias("name"))
    return EN.name_pool(_pool_sources(spark, d) + [(alias, "alias")], [(named, "name")])


_LEV = "1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1)"


def full_pool(spark, d):
    """All name sources and all aliases of the dictionary."""
    alias = entities(spark, d).select(F.explode("aliases").alias("alias"))
    return EN.name_pool(_pool_sources(spark, d) + [(alias, "alias")])


@query("fuzzy_topk_lev", Q.with_(["ents_alias"], f"""SELECT input, name, {Q.r6('1.0 - s')} AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY s, name) AS rank FROM
  (SELECT input, name, levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1) AS s FROM (SELECT DISTINCT n_name AS input, {Q.norm_latin('n_name')} AS a FROM nation),
  (SELECT name, {Q.norm_latin('name')} AS b FROM (SELECT name FROM ({_POOL} UNION SELECT alias FROM ents_alias) WHERE length(name) > 2)))) WHERE rank <= 50"""))
def fuzzy_topk_lev(spark, d):
    out = EN.fuzzy_top(tables.table(spark, d, "nation").select(F.col("n_name").alias("input")), full_pool(spark, d))
    return out.select("input", "name", r6(F.col("score")).alias("score"), "rank")


@query("fuzzy_topk_ratio")
def fuzzy_topk_ratio(spark, d):
    out = EN.fuzzy_top(tables.table(spark, d, "nation").select(F.col("n_name").alias("input")), full_pool(spark, d), method="ratio")
    return out.select("input", "name", r6(F.col("score")).alias("score"), "rank")


@query("candidate_union", Q.with_(["ents_alias"], f"""SELECT pair_id, name, {Q.r6('1.0 - s')} AS score, CAST(place AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY s, name) AS place FROM (SELECT pair_id, name, min(s) AS s FROM (
    SELECT pair_id, input, name, s, row_number() OVER (PARTITION BY pair_id, input ORDER BY s, name) AS rank FROM (
      SELECT pair_id, input, name, levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1) AS s
      FROM (SELECT DISTINCT pair_id, input, {Q.norm_latin('input')} AS a FROM (SELECT n_regionkey AS pair_id, min(n_name) AS input FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, max(n_name) FROM nation GROUP BY 1)),
           (SELECT name, {Q.norm_latin('name')} AS b FROM (SELECT name FROM ({_POOL} UNION SELECT alias FROM ents_alias) WHERE length(name) > 2))))
    WHERE rank <= 50 GROUP BY 1, 2)) WHERE place <= 100"""))
def candidate_union(spark, d):
    """The two top-50 lists of a typed pair, united and cut at 100."""
    pairs = tables.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("pair_id")).agg(F.min("n_name").alias("name_a"), F.max("n_name").alias("name_b"))
    top = EN.fuzzy_top(pairs.select(F.explode(F.array("name_a", "name_b")).alias("input")), full_pool(spark, d))
    out = EN.pair_candidates(pairs, top)
    return out.select("pair_id", "name", r6(F.col("score")).alias("score"), "place")


FEED = {
    "home_team": "CASE WHEN bout_id % 2 = 0 THEN CASE WHEN bout_id % 3 = 0 THEN 'Team ' || fighter_a || ' Jr.' ELSE upper(fighter_a) END ELSE fighter_b END",
    "away_team": "CASE WHEN bout_id % 2 = 0 THEN fighter_b ELSE CASE WHEN bout_id % 4 = 1 THEN fighter_a || ' II' ELSE fighter_a END END",
    "home_odds": "CASE WHEN bout_id % 2 = 0 THEN odds_a ELSE odds_b END", "away_odds": "CASE WHEN bout_id % 2 = 0 THEN odds_b ELSE odds_a END",
}
Q.cte("feed", ["bouts"], "SELECT bout_id AS feed_pos, " + ", ".join(f"{e} AS {k}" for k, e in FEED.items()) + " FROM bouts WHERE priority <> '5-LOW'")


def feed(spark, d):
    return tables.bouts(spark, d).filter("priority <> '5-LOW'").select(F.col("bout_id").alias("feed_pos"), *[F.expr(e).alias(k) for k, e in FEED.items()])


def _odds_sql() -> str:
    """All arms at each event in turn; events of the first part of the feed settle most fights, the rest meets the whole feed."""
    alike = lambda x: f"1.0::DOUBLE - levenshtein(v, {x})::DOUBLE / greatest(length(v), length({x}), 1) >= 0.70"
    hits = lambda src, ev: " UNION ALL ".join(
        f"""SELECT b.fighter_a, b.fighter_b, feed_pos, {flag} AS reversed, {oa} AS oa, {ob} AS ob FROM {src} b JOIN m x ON x.name = b.fighter_a
        JOIN {ev} f ON f.{ta} = x.team JOIN m y ON y.name = b.fighter_b AND y.team = f.{tb}"""
        for flag, ta, tb, oa, ob in ((0, "home_team", "away_team", "home_odds", "away_odds"), (1, "away_team", "home_team", "away_odds", "home_odds")))
    best = lambda src, ev: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fighter_a, fighter_b ORDER BY feed_pos, reversed) AS rn FROM ({hits(src, ev)})) WHERE rn = 1"
    return f""", ns AS (SELECT fighter_a AS name FROM bouts UNION SELECT fighter_b FROM bouts),
  k AS (SELECT name, {Q.norm_latin('name')} AS norm, {Q.surname('name')} AS last FROM ns),
  al AS MATERIALIZED (SELECT entity_id, {Q.norm_latin('alias')} AS norm, {Q.surname('alias')} AS last FROM ents_alias),
  same AS (SELECT DISTINCT name, entity_id FROM k JOIN al ON al.norm = k.norm OR al.last = k.last),
  nm AS MATERIALIZED (SELECT DISTINCT name, v FROM (SELECT name, norm AS v FROM k UNION ALL SELECT name, last FROM k UNION ALL SELECT name, al.norm FROM same JOIN al USING (entity_id)
    UNION ALL SELECT name, al.last FROM same JOIN al USING (entity_id)) WHERE v <> ''),
  tm AS MATERIALIZED (SELECT team, {Q.norm_latin('team')} AS n, {Q.surname('team')} AS l FROM (SELECT home_team AS team FROM feed UNION SELECT away_team FROM feed)),
  m AS MATERIALIZED (SELECT DISTINCT name, team FROM nm, tm WHERE v = n OR (length(v) >= 4 AND length(l) >= 4 AND v = l) OR (length(v) >= 5 AND length(n) >= 5 AND (contains(n, v) OR contains(v, n))) OR {alike('n')} OR {alike('l')}),
  fs AS MATERIALIZED (SELECT home_team, away_team, min(feed_pos) AS feed_pos, arg_min(home_odds, feed_pos) AS home_odds, arg_min(away_odds, feed_pos) AS away_odds FROM feed GROUP BY 1, 2),
  head AS MATERIALIZED (SELECT * FROM fs ORDER BY feed_pos LIMIT 40), pairs AS MATERIALIZED (SELECT DISTINCT fighter_a, fighter_b FROM bouts),
  early AS MATERIALIZED ({best('pairs', 'head')}), late AS MATERIALIZED (SELECT * FROM pairs ANTI JOIN early USING (fighter_a, fighter_b)),
  best AS MATERIALIZED (SELECT * FROM early UNION ALL {best('late', 'fs')})
  SELECT bout_id, coalesce(feed_pos, -1) AS feed_pos, coalesce(reversed, -1) AS reversed, coalesce(best.oa, 1.85::DOUBLE) AS odds_a, coalesce(best.ob, 1.85::DOUBLE) AS odds_b
  FROM bouts b LEFT JOIN best USING (fighter_a, fighter_b)""".replace(", ns", ",\nns", 1)


def _odds(spark, d, similar: str):
    fights = tables.bouts(spark, d).select("bout_id", "fighter_a", "fighter_b")
    names = fights.select(F.col("fighter_a").alias("name")).union(fights.select("fighter_b"))
    variants = materialize(EN.variants(names, entities(spark, d)), "odds-variants")
    out = OD.match_in_order(fights, materialize(feed(spark, d), "odds-feed"), variants, similar)
    return out.select("bout_id", F.coalesce("feed_pos", F.lit(-1)).alias("feed_pos"), F.coalesce("reversed", F.lit(-1)).alias("reversed"),
                      F.coalesce("odds_a", F.lit(1.85)).alias("odds_a"), F.coalesce("odds_b", F.lit(1.85)).alias("odds_b"))


@query("odds_match", Q.with_(["feed", "ents_alias"], _odds_sql()).replace("\n,\nns", ",\nns"))
def odds_match(spark, d):
    """All arms in event order, with the edit distance as similarity, which SQL has too."""
    return _odds(spark, d, "levenshtein")


@query("odds_match_ratio")
def odds_match_ratio(spark, d):
    """The same with the ratio of matched characters."""
    return _odds(spark, d, "ratio")


_TYPED = {"fighter_a": "replace(s_name, 'pp', 'p')", "fighter_b": "CASE WHEN s_suppkey % 2 = 0 THEN 'Сапплайер ' || lpad(CAST(s_suppkey % 90 + 1 AS VARCHAR(9)), 9, '0') ELSE 'Боец ' || (s_suppkey % 90 + 1) END"}


@query("closest_events", Q.with_(["feed", "ents_alias"], f""", fights AS MATERIALIZED (SELECT s_suppkey AS fight_id, {', '.join(f'{x} AS {c}' for c, x in _TYPED.items())} FROM supplier),
  k AS (SELECT name, {Q.norm_latin('name')} AS norm, {Q.surname('name')} AS last FROM (SELECT fighter_a AS name FROM fights UNION SELECT fighter_b FROM fights)),
  al AS MATERIALIZED (SELECT entity_id, {Q.norm_latin('alias')} AS norm, {Q.surname('alias')} AS last FROM ents_alias),
  same AS (SELECT DISTINCT name, entity_id FROM k JOIN al ON al.norm = k.norm OR al.last = k.last),
  nm AS MATERIALIZED (SELECT DISTINCT name, v FROM (SELECT name, norm AS v FROM k UNION ALL SELECT name, last FROM k UNION ALL SELECT name, al.norm FROM same JOIN al USING (entity_id)
    UNION ALL SELECT name, al.last FROM same JOIN al USING (entity_id)) WHERE v <> ''),
  tm AS MATERIALIZED (SELECT team, {Q.norm_latin('team')} AS n FROM (SELECT home_team AS team FROM feed UNION SELECT away_team FROM feed)),
  sc AS MATERIALIZED (SELECT name, team, max(1.0::DOUBLE - levenshtein(v, n)::DOUBLE / greatest(length(v), length(n), 1)) AS s FROM nm, tm GROUP BY 1, 2),
  ev AS MATERIALIZED (SELECT * FROM (SELECT feed_pos, home_team, away_team, row_number() OVER (PARTITION BY home_team, away_team ORDER BY feed_pos) AS p FROM feed) WHERE p <= 5),
  e2 AS MATERIALIZED (SELECT h.name, feed_pos, greatest(h.s, a.s) AS s FROM ev JOIN sc h ON h.team = home_team JOIN sc a ON a.team = away_team AND a.name = h.name)
  SELECT fight_id, CAST(place AS INT) AS place, feed_pos, {Q.r6('sa')} AS score_a, {Q.r6('sb')} AS score_b FROM (SELECT fight_id, x.feed_pos, x.s AS sa, y.s AS sb, row_number() OVER (PARTITION BY fight_id ORDER BY x.s + y.s DESC, x.feed_pos) AS place
    FROM fights JOIN e2 x ON x.name = fighter_a JOIN e2 y ON y.name = fighter_b AND y.feed_pos = x.feed_pos) WHERE place <= 5""".replace(", fights AS", ",\nfights AS", 1)).replace("\n,\nfights", ",\nfights"))
def closest_events(spark, d):
    """Misspelt and Cyrillic names of all competitors against the feed, with their aliases."""
    fights = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("fight_id"), *[F.expr(x).alias(c) for c, x in _TYPED.items()])
    names = fights.select(F.col("fighter_a").alias("name")).union(fights.select("fighter_b"))
    out = OD.closest_events(fights, materialize(feed(spark, d), "closest-feed"), EN.variants(names, entities(spark, d)), similar="levenshtein")
    return out.select("fight_id", "place", "feed_pos", r6(F.col("score_a")).alias("score_a"), r6(F.col("score_b")).alias("score_b"))


_PAIR = {"name_a": "CASE s_suppkey % 3 WHEN 0 THEN upper(replace(s_name, 'pp', 'p')) WHEN 1 THEN 'zq' || s_suppkey ELSE s_name END",
         "name_b": "CASE WHEN s_suppkey % 4 = 0 THEN 'Q' ELSE 'Боец ' || s_suppkey END"}


@query("decided_pairs", Q.with_(["ents_alias"], f""", pairs AS MATERIALIZED (SELECT s_suppkey AS pair_id, {', '.join(f'{x} AS {c}' for c, x in _PAIR.items())} FROM supplier),
  pool AS MATERIALIZED (SELECT name, {Q.norm_latin('name')} AS b FROM (SELECT name FROM ({_POOL} UNION SELECT alias FROM ents_alias) WHERE length(name) > 2)),
  top AS MATERIALIZED (SELECT * FROM (SELECT input, name, s, row_number() OVER (PARTITION BY input ORDER BY s, name) AS rank FROM
    (SELECT input, name, levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1) - 1.0 AS s FROM (SELECT input, {Q.norm_latin('input')} AS a FROM (SELECT name_a AS input FROM pairs UNION SELECT name_b FROM pairs)), pool)) WHERE rank <= 50),
  one AS (SELECT * FROM top WHERE rank = 1),
  dec AS (SELECT pair_id, name_a, name_b, -x.s >= {EN.K.ACCEPT_FIRST} AND -y.s >= {EN.K.ACCEPT_SECOND} AS ok, x.name AS best_a, y.name AS best_b FROM pairs JOIN one x ON x.input = name_a JOIN one y ON y.input = name_b),
  li AS (SELECT pair_id, string_agg(name, '|' ORDER BY s, name) AS cand FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY s, name) AS place FROM
    (SELECT pair_id, name, min(s) AS s FROM dec JOIN top ON input IN (name_a, name_b) WHERE ok GROUP BY ALL)) WHERE place <= 100 GROUP BY 1)
  SELECT pair_id, CAST(ok AS INT) AS accepted, CASE WHEN ok THEN best_a ELSE name_a END AS decided_a, CASE WHEN ok THEN best_b ELSE name_b END AS decided_b, coalesce(cand, '') AS candidates
  FROM dec LEFT JOIN li USING (pair_id)""".replace(", pairs AS", ",\npairs AS", 1)).replace("\n,\npairs", ",\npairs"))
def decided_pairs(spark, d):
    """Typed pairs: accepted ones with their candidates, the others as typed."""
    pairs = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pair_id"), *[F.expr(x).alias(c) for c, x in _PAIR.items()])
    top = materialize(EN.fuzzy_top(pairs.select(F.explode(F.array("name_a", "name_b")).alias("input")), full_pool(spark, d)), "decided-top")
    out = EN.decide_pairs(pairs, top)
    return out.select("pair_id", F.col("accepted").cast("int").alias("accepted"), "decided_a", "decided_b", F.array_join("candidates", "|").alias("candidates"))


@query("asof_enrich", Q.with_(["sides"], """, snap AS MATERIALIZED (SELECT l_suppkey AS fid, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)
  SELECT s.bout_id, s.fid, coalesce(strftime(n.day, '%Y-%m-%d'), '') AS as_of_day, coalesce(n.value, -1.0::DOUBLE) AS value
  FROM sides s ASOF LEFT JOIN snap n ON n.fid = s.fid AND n.day <= s.bout_date - 1""").replace("\n, snap", ",\nsnap"))
def asof_enrich(spark, d):
    snap = tables.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("fid"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value"))
    sides = tables.bout_sides(tables.bout_core(spark, d)).select("bout_id", "bout_date", "fid")
    out = EN.as_of(sides, snap)
    return out.select("bout_id", "fid", F.coalesce(F.date_format("as_of_day", "yyyy-MM-dd"), F.lit("")).alias("as_of_day"), F.coalesce("value", F.lit(-1.0)).alias("value"))
