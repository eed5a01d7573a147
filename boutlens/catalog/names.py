"""Text and name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.catalog import query
from boutlens.catalog import sqlkit as Q
from boutlens.functions import text as T
from boutlens.sources import tables

# Inputs shared by both engines: plain expressions over the tables.
CYR = "translate(lower(p_name), 'abcdefghijklmnoprstuvyz', 'абцдефгхийклмнопрстувыз')"
RAW_PART = f"{CYR} || ' Ёжик-Щука ' || p_brand"
RAW_RANKED = "c_name || ' (#' || c_nationkey || ')  '"
RAW_SPACED = "'  ' || c_name || '   ' || c_mktsegment || ' (C) '"
RAW_SUFFIX = ("c_mktsegment || ' ' || c_name || CASE c_custkey % 4 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' "
              "WHEN 2 THEN '  ' ELSE '' END")
RAW_PAIR = ("fighter_a || CASE bout_id % 6 WHEN 0 THEN ' - ' WHEN 1 THEN ' — ' WHEN 2 THEN ' vs ' WHEN 3 THEN ' VS ' "
            "WHEN 4 THEN ' против ' ELSE ' ' END || fighter_b || CASE WHEN bout_id % 7 = 0 THEN repeat(' x', 6) ELSE '' END")
RAW_CAMP = ("CASE s_nationkey % 6 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'ab' WHEN 3 THEN 'КЛУБ' "
            "WHEN 4 THEN '' ELSE ' camp ' || s_nationkey || ' ' END")
RAW_SMS = ("CASE event_type WHEN 'purchase' THEN 'Поступление ' || CAST(1 + event_id % 9 AS VARCHAR(9)) || ' 000,47 руб' "
           "WHEN 'signup' THEN 'На счёт ЗАЧИСЛЕНО +' || CAST(event_id % 977 AS VARCHAR(9)) || '.5р от' "
           "WHEN 'error' THEN 'Пополнение без суммы' ELSE 'Списание ' || CAST(event_id % 977 AS VARCHAR(9)) || ' руб' END")


def _scalar(name, tab, key, raw, fn, sql_fn, out):
    """One text function over one table."""
    query(name, f"SELECT {key}, {sql_fn('raw')} AS {out} FROM (SELECT {key}, {raw} AS raw FROM {tab})")(
        lambda spark, d: tables.table(spark, d, tab).select(key, fn(F.expr(raw)).alias(out)))


def _clean_sql(x):
    return Q.strip(f"regexp_replace({x}, '\\s*\\([^)]*\\)', '', 'g')")


_scalar("clean_name", "customer", "c_custkey", RAW_RANKED, T.clean_name, _clean_sql, "cleaned")
_scalar("sanitize_name", "customer", "c_custkey", RAW_SPACED, T.sanitize_name,
        lambda x: f"trim(regexp_replace({_clean_sql(x)}, '{T.SPACE}', ' ', 'g'))", "cleaned")
_scalar("norm_ru", "part", "p_partkey", RAW_PART, T.norm_ru, Q.norm_ru, "norm")
_scalar("translit", "part", "p_partkey", RAW_PART, T.translit, Q.translit, "latin")
_scalar("norm_latin", "part", "p_partkey", RAW_PART, T.norm_latin, Q.norm_latin, "norm")
_scalar("norm_latin_cli", "part", "p_partkey", RAW_PART + " || ' (#7), Jr.'", T.norm_latin_cli, lambda x: (
    f"regexp_replace(regexp_replace(regexp_replace({Q.translit(x)}, '\\s*\\([^)]*\\)', '', 'g'), ',.*', '', 'g'), '[^a-z0-9]', '', 'g')"), "norm")
_scalar("surname", "customer", "c_custkey", RAW_SUFFIX, T.surname, Q.surname, "surname")
_scalar("entity_id", "part", "p_partkey", RAW_PART, T.entity_id, Q.entity_id, "entity_id")
_scalar("camp_clean", "supplier", "s_suppkey", RAW_CAMP, T.camp_clean, lambda x: (
    f"CASE WHEN lower(trim({x})) IN ({', '.join(repr(c) for c in K.PLACEHOLDER_CAMPS)}) OR length(trim({x})) < 3 "
    f"THEN 'Independent' ELSE trim({x}) END"), "camp")
_scalar("amount_extract", "events", "event_id", RAW_SMS, lambda c: F.coalesce(T.payment_amount(c).cast("double"), F.lit(-1.0)), lambda x: (
    "coalesce(CASE WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in K.INCOMING_WORDS)
    + f" THEN CAST(TRY_CAST(replace(regexp_replace(regexp_extract(lower({x}), '{K.AMOUNT_PATTERN}', 1), '\\s', '', 'g'), ',', '.') AS DECIMAL(12,2)) AS DOUBLE) END, -1.0::DOUBLE)"),
    "amount")


def _clean_text_sql(x):
    out = f"regexp_replace(regexp_replace({x}, '{T.DROPPED}', '', 'g'), '{T.DASHES}', '-', 'g')"
    blank = T.SPACE[:-1]
    for _ in range(2):
        out = f"regexp_replace({out}, '(?i)({T.LETTER}){blank}+({T.LETTER})({blank}|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}{T.LETTER[1:-1]}]|$)', '\\1\\2\\3', 'g')"
    return f"trim(regexp_replace({out}, '{T.SPACE}', ' ', 'g'))"


@query("clean_text", f"""SELECT src, id, part, length(t) AS n, md5(t) AS digest FROM (
  SELECT 'documents' AS src, doc_id AS id, CAST(0 AS BIGINT) AS part, {_clean_text_sql('text')} AS t FROM documents
  UNION ALL SELECT 'conversations', conv_id, turn, {_clean_text_sql('text')} FROM conversations)""")
def clean_text(spark, d):
    docs = tables.table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), "text")
    talk = tables.table(spark, d, "conversations").select(F.lit("conversations").alias("src"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    t = T.clean_text(F.col("text"))
    return docs.union(talk).select("src", "id", "part", t.alias("t")).select(
        "src", "id", "part", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("fight_key", Q.with_(["bouts"], "SELECT bout_id, fight_key FROM bouts"))
def fight_key(spark, d):
    return tables.bouts(spark, d).select("bout_id", "fight_key")


_halves = "string_split(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' ')"
_sep_arms = lambda part: " ".join(
    f"WHEN contains(raw, '{s}') THEN " + (f"substr(raw, 1, strpos(raw, '{s}') - 1)" if part == 1 else f"substr(raw, strpos(raw, '{s}') + {len(s)})")
    for s in K.PAIR_SEPARATORS)


@query("split_pair", Q.with_(["bouts"], f"""SELECT bout_id, CASE WHEN ok THEN f1 ELSE '' END AS f1, CASE WHEN ok THEN f2 ELSE '' END AS f2 FROM (
  SELECT *, length(f1) <= 40 AND length(f2) <= 40 AND length(f1) - length(replace(f1, ' ', '')) <= 5
    AND length(f2) - length(replace(f2, ' ', '')) <= 5 AS ok FROM (
  SELECT bout_id, trim(CASE {_sep_arms(1)} ELSE array_to_string({_halves}[1:len({_halves}) // 2], ' ') END) AS f1,
    trim(CASE {_sep_arms(2)} ELSE array_to_string({_halves}[len({_halves}) // 2 + 1:], ' ') END) AS f2
  FROM (SELECT bout_id, {RAW_PAIR} AS raw FROM bouts)))"""))
def split_pair(spark, d):
    df = tables.bouts(spark, d).select("bout_id", F.expr(RAW_PAIR).alias("raw"))
    df = df.withColumn("p", T.split_pair(F.col("raw")))
    return df.select("bout_id", F.coalesce("p.f1", F.lit("")).alias("f1"), F.coalesce("p.f2", F.lit("")).alias("f2"))


@query("method_map", Q.with_(["bouts"], "SELECT bout_id, CASE method " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in K.METHOD_CODES.items()) + " ELSE 'DECISION_UNANIMOUS' END AS method_type FROM bouts"))
def method_map(spark, d):
    return tables.bouts(spark, d).select("bout_id", T.method_type(F.col("method")).alias("method_type"))


@query("names_match", Q.with_(["bouts"], f"""SELECT bout_id,
  CAST(contains(nw, na) OR contains(na, nw) AS INT) AS match_a, CAST(contains(nw, nb) OR contains(nb, nw) AS INT) AS match_b,
  CAST((contains(nw, na) OR contains(na, nw)) AND nw <> '' AND na <> '' AS INT) AS strict_a
  FROM (SELECT bout_id, {Q.norm_ru("coalesce(winner, '')")} AS nw, {Q.norm_ru('fighter_a')} AS na, {Q.norm_ru('fighter_b')} AS nb FROM bouts)"""))
def names_match(spark, d):
    w, a, b = F.coalesce("winner", F.lit("")), F.col("fighter_a"), F.col("fighter_b")
    return tables.bouts(spark, d).select(
        "bout_id", T.names_match(w, a).cast("int").alias("match_a"), T.names_match(w, b).cast("int").alias("match_b"),
        T.names_match(w, a, allow_empty=False).cast("int").alias("strict_a"))
