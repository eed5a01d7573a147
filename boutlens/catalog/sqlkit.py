"""Common table expressions shared by the SQL twins."""

from __future__ import annotations

from boutlens import constants as K
from boutlens.plans.flows import FIXED_BIAS, FIXED_WEIGHTS

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_(needs: list[str], body: str) -> str:
    """``body`` preceded by the WITH list it needs, in dependency order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{body}"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


def lst(values) -> str:
    values = list(values)
    if values and isinstance(values[0], str):
        return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def translit(x: str) -> str:
    src, dst = K.TRANSLIT_ONE
    out = f"translate(lower({x}), '{src}{K.TRANSLIT_DROP}', '{dst}')"
    for a, b in K.TRANSLIT_MANY.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def norm_latin(x: str) -> str:
    return f"regexp_replace({translit(x)}, '[^a-z0-9]', '', 'g')"


def norm_ru(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), 'ёй', 'еи'), '[^a-zа-я0-9]', '', 'g')"


def surname(x: str) -> str:
    words = f"string_split(trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')), ' ')"
    sfx = ", ".join(f"'{s}'" for s in K.NAME_SUFFIXES)
    return translit(f"(CASE WHEN lower({words}[-1]) IN ({sfx}) AND len({words}) > 1 THEN {words}[-2] ELSE {words}[-1] END)")


def entity_id(x: str) -> str:
    return f"('F_' || substr(md5({norm_latin(x)}), 1, 8))"


def digit_sum(x: str) -> str:
    return (f"list_sum(list_transform(list_filter(string_split(regexp_replace({x}, '[^0-9]', '', 'g'), ''), "
            f"lambda c: c <> ''), lambda c: CAST(c AS INT)))")


def digit_root(n: str) -> str:
    return f"(CASE WHEN {n} <= 0 THEN 1 ELSE ({n} - 1) % 9 + 1 END)"


def date_number(x: str) -> str:
    n = f"length(regexp_replace({x}, '[^0-9]', '', 'g'))"
    return f"CAST(CASE WHEN {n} = 4 OR {n} >= 8 THEN {digit_root(digit_sum(x))} END AS BIGINT)"


def moon_phase(d: str) -> str:
    days = f"((({d} - DATE '{K.MOON_EPOCH}') * 86400 - {K.MOON_EPOCH_SECONDS}) / 86400.0::DOUBLE)"
    m = f"{K.SYNODIC_DAYS}::DOUBLE"
    return f"((({days} % {m}) + {m}) % {m} / {m})"


def moon_value(phase: str) -> str:
    arms = " ".join(
        f"WHEN {phase} < {(i + 1) * 0.125} THEN {K.MOON_STARTS[i]}::DOUBLE + ({phase} - {i * 0.125}::DOUBLE) / 0.125::DOUBLE * ({K.MOON_SLOPES[i]})::DOUBLE"
        for i in range(7))
    last = f"{K.MOON_STARTS[7]}::DOUBLE + ({phase} - 0.875::DOUBLE) / 0.125::DOUBLE * ({K.MOON_SLOPES[7]})::DOUBLE"
    return f"round_even(greatest(0.3::DOUBLE, least(0.9::DOUBLE, CASE {arms} ELSE {last} END)), 2)"


def round_even_exact(x: str, places: int) -> str:
    unit = 2 ** 60
    n = f"(CAST({x} * {unit}.0::DOUBLE AS HUGEINT) * {10 ** places})"
    q, r = f"({n} // {unit})", f"({n} % {unit})"
    up = f"(CASE WHEN {r} > {unit // 2} OR ({r} = {unit // 2} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"(CAST({q} + {up} AS DOUBLE) / {10 ** places}.0::DOUBLE)"


def mystic_value(birth: str, day: str, moon: str) -> str:
    b, d = f"coalesce({birth}, 5)", f"coalesce({day}, 5)"
    bv = f"coalesce(({lst(K.BIRTH_STRENGTH)})[{birth}], 0.5::DOUBLE)"
    dv = f"coalesce(({lst(K.DAY_STRENGTH)})[{day}], 0.5::DOUBLE)"
    flat = lst([v for row in K.COMPATIBILITY for v in row])
    q = "0.25::DOUBLE"
    return round_even_exact(f"({bv} * {q} + {dv} * {q} + ({flat})[({b} - 1) * 9 + {d}] * {q} + {moon} * {q})", 2)


def age_on(d: str, dob: str) -> str:
    return (f"(year({d}) - year({dob}) - CASE WHEN month({d}) < month({dob}) OR (month({d}) = month({dob}) "
            f"AND day({d}) < day({dob})) THEN 1 ELSE 0 END)")


cte("profiles", [], """SELECT l_suppkey AS fid, CAST(l_shipdate AS DATE) AS day, CAST(sum(l_linenumber) AS INT) AS exp, DATE '1960-01-01' + CAST(l_suppkey * 41 % 5000 AS INT) AS dob,
  CASE WHEN l_suppkey % 14 = 0 THEN 0 ELSE 2 END AS dob_quality, 'gym_' || max(l_linenumber) AS camp_name, CAST(min(l_linenumber) + 151 AS INT) AS reach_cm,
  CAST(max(l_linenumber) + 150 AS INT) AS height_cm FROM lineitem GROUP BY 1, 2""")


def implied(o: str) -> str:
    return f"(1.0 / greatest({o}, 1.01))"


def is_stub(a: str, b: str) -> str:
    return f"(abs({a} - 1.85) < 0.01 AND abs({b} - 1.85) < 0.01)"


cte("legs", [], """SELECT l_orderkey, l_suppkey, min(l_linenumber) AS ln,
  sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS score FROM lineitem GROUP BY 1, 2""")
cte("ranked", ["legs"], """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, l_suppkey) AS rn FROM legs""")
cte("bouts0", ["ranked"], """SELECT o.o_orderkey * 101 + (a.rn - 1) // 2 AS bout_id, CAST(o.o_orderdate AS DATE) AS bout_date,
  o.o_orderpriority AS priority, o.o_custkey, o.o_totalprice, a.l_suppkey AS a_id, b.l_suppkey AS b_id,
  a.score AS a_score, b.score AS b_score, sa.s_name AS fighter_a, sb.s_name AS fighter_b,
  sa.s_nationkey AS a_nation, sb.s_nationkey AS b_nation,
  CASE WHEN a.score > b.score THEN 'a' WHEN b.score > a.score THEN 'b' END AS winner_side,
  CASE WHEN a.score <> b.score AND greatest(a.score, b.score) >= least(a.score, b.score) * 2 THEN 1 ELSE 0 END AS finish
  FROM ranked a JOIN ranked b ON a.l_orderkey = b.l_orderkey AND a.rn % 2 = 1 AND b.rn = a.rn + 1
  JOIN orders o ON o.o_orderkey = a.l_orderkey
  JOIN supplier sa ON sa.s_suppkey = a.l_suppkey JOIN supplier sb ON sb.s_suppkey = b.l_suppkey""")
cte("bouts", ["bouts0"], """SELECT *,
  finish * CASE WHEN bout_id % 3 = 0 THEN 1 ELSE 0 END AS submission,
  CASE WHEN priority = '1-URGENT' THEN 5 ELSE 3 END AS rounds,
  CAST(1 + bout_id % CASE WHEN priority = '1-URGENT' THEN 5 ELSE 3 END AS INT) AS round,
  CASE WHEN priority = '5-LOW' THEN 1.85::DOUBLE ELSE (105 + bout_id * 31 % 400) / 100.0::DOUBLE END AS odds_a,
  CASE WHEN priority = '5-LOW' THEN 1.85::DOUBLE ELSE (105 + bout_id * 53 % 400) / 100.0::DOUBLE END AS odds_b,
  CASE WHEN bout_id % 5 <= 1 THEN 'X' WHEN bout_id % 5 <= 3 THEN 'Y' END AS blind_pick,
  CAST(50 + bout_id * 7 % 45 AS INT) AS blind_conf,
  CASE WHEN bout_id % 10 = 3 THEN 1 ELSE 0 END AS held_out,
  CASE winner_side WHEN 'a' THEN fighter_a WHEN 'b' THEN fighter_b END AS winner,
  CASE WHEN bout_id % 3 <> 0 THEN fighter_a ELSE fighter_b END AS ai_winner,
  CASE WHEN winner_side IS NULL THEN 'TBD' WHEN finish = 1 AND bout_id % 3 = 0 THEN 'SUB' WHEN finish = 1 THEN 'KO'
       WHEN bout_id % 4 = 0 THEN 'SD' WHEN bout_id % 4 = 1 THEN 'MD' ELSE 'UD' END AS method,
  fighter_a || '_' || fighter_b || '_' || strftime(bout_date, '%Y-%m-%d') AS fight_key
  FROM bouts0""")


def _side(flag: int, m: str) -> str:
    return (f"SELECT bout_id, bout_date, {flag} AS is_a, {m}_id AS fid, {m}_nation AS nation, fighter_{m} AS name, "
            f"CASE WHEN winner_side = '{m}' THEN 1 ELSE 0 END AS won, "
            f"CASE WHEN winner_side <> '{m}' THEN 1 ELSE 0 END AS lost, "
            f"CASE WHEN winner_side = '{m}' THEN finish ELSE 0 END AS fin, "
            f"CASE WHEN winner_side = '{m}' THEN submission ELSE 0 END AS sub, "
            f"bout_date - DATE '1970-01-01' AS day FROM bouts")


cte("sides", ["bouts"], _side(1, "a") + " UNION ALL " + _side(0, "b"))
cte("hist0", ["sides"], """SELECT *,
  CAST(coalesce(sum(won) OVER last5, 0) AS INT) AS recent_wins,
  coalesce(array_to_string(list(CASE WHEN won = 1 THEN 'W' WHEN lost = 1 THEN 'L' ELSE 'D' END) OVER last5, ''), '') AS form,
  CAST(coalesce(sum(won) OVER pre, 0) AS INT) AS wins, CAST(coalesce(sum(lost) OVER pre, 0) AS INT) AS losses,
  CAST(count(*) OVER pre AS INT) AS bouts_before,
  coalesce(sum(fin) OVER pre, 0) AS fins, coalesce(sum(sub) OVER pre, 0) AS subs,
  CAST(coalesce(day - lag(day) OVER (PARTITION BY fid ORDER BY bout_date, bout_id), -1) AS INT) AS days_off,
  CAST(count(*) OVER (PARTITION BY fid ORDER BY day RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS INT) AS fights_12m
  FROM sides WINDOW
  pre AS (PARTITION BY fid ORDER BY bout_date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  last5 AS (PARTITION BY fid ORDER BY bout_date, bout_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
cte("hist", ["hist0"], """SELECT *, wins + losses AS exp,
  CASE WHEN days_off < 0 THEN 0 ELSE days_off // 30 END AS months_off,
  CASE WHEN wins > 0 THEN fins::DOUBLE / wins ELSE 0.5::DOUBLE END AS fin_rate,
  CASE WHEN wins > 0 THEN subs::DOUBLE / wins ELSE 0.0::DOUBLE END AS sub_rate FROM hist0""")


def _pct(base: int, mul: int, mod: int, x: str = "fid") -> str:
    return f"({base} + {x} * {mul} % {mod}) / 100.0::DOUBLE"


cte("statics", ["hist"], f"""SELECT *, DATE '1963-01-01' + CAST(fid * 37 % 5475 AS INT) AS dob,
  CASE WHEN fid % 7 = 0 THEN 0 ELSE 1 END AS dob_quality,
  {_pct(40, 7, 50)} AS td_def, {_pct(40, 11, 50)} AS grap_def, {_pct(20, 13, 66)} AS stress_factor,
  {_pct(30, 17, 66)} AS motivation_index, {_pct(35, 19, 61)} AS biorythm_score, {_pct(30, 23, 66)} AS camp_quality,
  {_pct(30, 29, 61)} AS mystic_v2, 150 + fid % 76 AS reach_cm, 150 + fid * 3 % 61 AS height_cm,
  'camp_' || (nation % 18) AS camp_name,
  CASE WHEN nation % 18 < 16 THEN (30 + nation % 18 * 3) / 100.0::DOUBLE ELSE 0.4::DOUBLE END AS camp_score FROM hist""")
cte("stats0", ["statics"], f"""SELECT *, {age_on('bout_date', 'dob')} AS age,
  {date_number("strftime(dob, '%Y-%m-%d')")} AS birth_n, {date_number("strftime(bout_date, '%Y-%m-%d')")} AS day_n,
  {moon_phase('bout_date')} AS phase FROM statics""")
cte("stats", ["stats0"], f"""SELECT *, {mystic_value('birth_n', 'day_n', moon_value('phase'))} AS mystic_factor FROM stats0""")

_FIELDS = ["recent_wins", "fin_rate", "sub_rate", "td_def", "grap_def", "age", "exp", "fights_12m", "months_off",
           "wins", "losses", "stress_factor", "motivation_index", "biorythm_score", "camp_quality", "mystic_factor", "mystic_v2"]


def _feat(s: str, f: str) -> str:
    x = f"CAST({s}.{f} AS DOUBLE)"
    if f == "age":
        return x + " / 50.0::DOUBLE"
    if f in ("wins", "losses"):
        return x + " / 100.0::DOUBLE"
    if f.startswith("mystic"):
        return f"CASE WHEN {s}.dob_quality > 0 THEN {x} ELSE 0.5::DOUBLE END"
    return x


_EXPR = ([_feat("a", f) for f in _FIELDS] + [_feat("b", f) for f in _FIELDS]
         + ["a.fin_rate * a.td_def", "a.sub_rate * a.grap_def", "a.months_off / 12.0::DOUBLE * a.exp", "a.stress_factor * a.camp_quality"]
         + [f"CAST({s}.{f} AS DOUBLE) / 200.0::DOUBLE" for s in "ab" for f in ("reach_cm", "height_cm")]
         + ["a.camp_score", "b.camp_score", "0.3::DOUBLE", "0.3::DOUBLE"])
_KEEP = ", ".join(f"{s}.{f} AS s{s}_{f}" for s in "ab" for f in
                  ("fin_rate", "sub_rate", "td_def", "wins", "losses", "reach_cm", "camp_name", "exp", "dob_quality", "dob", "height_cm", "mystic_factor", "mystic_v2"))
cte("feats", ["stats", "bouts"], "SELECT o.*, " + _KEEP + ", " + ", ".join(f"{e} AS {n}" for e, n in zip(_EXPR, K.FEATURE_NAMES))
    + " FROM bouts o JOIN stats a ON a.bout_id = o.bout_id AND a.is_a = 1 JOIN stats b ON b.bout_id = o.bout_id AND b.is_a = 0")


def scaling_select(batch: bool = False, src: str = "feats") -> str:
    cols = []
    for i, n in enumerate(K.FEATURE_NAMES):
        if batch:
            cols.append(f"avg({n}) AS m{i}, greatest(stddev_pop({n}), 1e-8::DOUBLE) AS d{i}")
        elif i in K.UNSCALED:
            cols.append(f"0.0::DOUBLE AS m{i}, 1.0::DOUBLE AS d{i}")
        else:
            cols.append(f"avg({n}) AS m{i}, CASE WHEN var_pop({n}) > 1e-8 THEN stddev_pop({n}) ELSE 1.0::DOUBLE END AS d{i}")
    return "SELECT " + ", ".join(cols) + f" FROM {src}"


cte("scaling", ["feats"], scaling_select())


def scaled(i: int) -> str:
    n = K.FEATURE_NAMES[i]
    return n if i in K.UNSCALED else f"(({n} - m{i}) / d{i})"


Z = " + ".join(f"{scaled(i)} * ({FIXED_WEIGHTS[i]})::DOUBLE" for i in range(K.WIDTH)) + f" + {FIXED_BIAS}::DOUBLE"
cte("raw", ["feats", "scaling"], f"SELECT *, 1.0 / (1.0 + exp(-({Z}))) AS proba_a FROM feats, scaling")


def final_ctes(prefix: str, src: str, oa: str, ob: str) -> None:
    """Register the final-prediction chain under ``prefix`` with the given odds expressions."""
    damp = "(0.5 + (proba_a - 0.5) * 0.75)"
    cte(f"{prefix}1", [src], f"""SELECT *, CASE WHEN {is_stub(oa, ob)} THEN {damp}
      ELSE greatest(0.30::DOUBLE, least(0.90::DOUBLE, {damp} - ({damp} - {implied(oa)}) * 0.15)) END AS final_a FROM {src}""")
    cte(f"{prefix}2", [f"{prefix}1"], f"""SELECT *, CASE WHEN final_a > 0.5 THEN 'a' ELSE 'b' END AS pred_side,
      CASE WHEN final_a > 0.5 THEN fighter_a ELSE fighter_b END AS pred_winner,
      CASE WHEN final_a > 0.5 THEN final_a ELSE 1.0 - final_a END AS prob,
      CASE WHEN final_a > 0.5 THEN sa_sub_rate ELSE sb_sub_rate END AS w_sub,
      CASE WHEN final_a > 0.5 THEN sa_fin_rate ELSE sb_fin_rate END AS w_fin,
      CASE WHEN final_a > 0.5 THEN sb_td_def ELSE sa_td_def END AS l_td,
      CASE WHEN final_a > 0.5 THEN {oa} ELSE {ob} END AS pred_odds FROM {prefix}1""")
    cte(f"{prefix}3", [f"{prefix}2"], f"""SELECT *, CASE WHEN w_sub > 0.35 AND l_td < 0.65 THEN 'SUBMISSION'
      WHEN w_fin > 0.75 AND prob > 0.65 THEN 'KO' WHEN w_fin > 0.60 AND prob > 0.55 THEN 'TKO'
      WHEN prob <= 0.58 THEN 'DECISION_SPLIT' ELSE 'DECISION_UNANIMOUS' END AS pred_method FROM {prefix}2""")
    cte(prefix, [f"{prefix}3"], f"""SELECT *, CASE WHEN pred_method LIKE 'DECISION%' THEN rounds
      ELSE least(CASE WHEN prob > 0.65 THEN 3 ELSE 2 END, rounds) END AS pred_round,
      greatest(0.0, prob - 0.15) AS ci_lo, least(1.0, prob + 0.15) AS ci_hi,
      CASE WHEN prob BETWEEN 0.45 AND 0.55 THEN 1 ELSE 0 END AS high_dispersion FROM {prefix}3""")


final_ctes("scored", "raw", "odds_a", "odds_b")
final_ctes("blindscored", "raw", "1.85::DOUBLE", "1.85::DOUBLE")
