"""Competitor identity: dictionary, resolution, variants, fuzzy candidates, as-of attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions import text as T
from boutlens.operators import similar as SIM

CYRILLIC = "(?iu)[а-яё]"


def canonical_alias(aliases: Column) -> Column:
    """First clean Cyrillic alias with an apostrophe, else first Cyrillic one, else the first."""
    def cyrillic(a: Column) -> Column:
        return F.regexp_like(a, F.lit(CYRILLIC))

    def clean(a: Column) -> Column:
        ok = cyrillic(a) & F.contains(a, F.lit("'"))
        for word in K.JUNK_ALIAS_WORDS:
            ok = ok & ~F.contains(F.lower(a), F.lit(word))
        return ok

    one = F.lit(1)
    return F.coalesce(F.try_element_at(F.filter(aliases, clean), one), F.try_element_at(F.filter(aliases, cyrillic), one),
                      F.try_element_at(aliases, one))


def build(appearances: DataFrame) -> DataFrame:
    """Dictionary from (name, day) rows: id, normalised form, aliases, first day, bout count.

    Names are counted before they are grouped into entities, so the alias list of an
    entity only ever sees one row per distinct spelling.
    """
    spelled = appearances.groupBy("name").agg(F.count("*").alias("n"), F.min("day").alias("first_seen"))
    keyed = spelled.withColumns({"entity_id": T.entity_id(F.col("name")), "normalized": T.norm_latin(F.col("name"))})
    return keyed.groupBy("entity_id", "normalized").agg(
        F.array_sort(F.collect_list("name")).alias("aliases"), F.min("first_seen").alias("first_seen"), F.sum("n").alias("fights_count"))


def lookup_keys(entities: DataFrame) -> DataFrame:
    """(kind, key) -> first entity in dictionary order.  One row per key, so joins never multiply."""
    alias = entities.select("entity_id", "pos", F.explode("aliases").alias("alias"))
    keys = (alias.select("entity_id", "pos", F.lit("text").alias("kind"), F.lower(F.trim("alias")).alias("key"))
            .unionByName(alias.select("entity_id", "pos", F.lit("norm").alias("kind"), T.norm_latin(F.col("alias")).alias("key")))
            .unionByName(entities.select("entity_id", "pos", F.lit("norm").alias("kind"), F.col("normalized").alias("key")))
            .unionByName(entities.select("entity_id", "pos", F.lit("id").alias("kind"), F.col("entity_id").alias("key"))))
    return keys.groupBy("kind", "key").agg(F.min(F.struct("pos", "entity_id")).alias("hit"))


def resolve(names: DataFrame, entities: DataFrame, name: str = "name", out: str = "entity_id") -> DataFrame:
    """Name to id: by its own id, else the first entity that matches by text or normalised form."""
    keys = lookup_keys(entities)

    def side(kind: str) -> DataFrame:
        return keys.filter(F.col("kind") == kind).select(F.col("key").alias(f"_k_{kind}"), F.col("hit").alias(f"_h_{kind}"))

    n = F.col(name)
    df = names.withColumns({"_k_id": T.entity_id(n), "_k_text": F.lower(F.trim(n)), "_k_norm": T.norm_latin(n)})
    for kind in ("id", "text", "norm"):
        df = df.join(side(kind), f"_k_{kind}", "left")
    found = F.coalesce(F.col("_h_id.entity_id"), F.least("_h_text", "_h_norm")["entity_id"])
    usable = n.isNotNull() & (F.length(n) >= 2)
    return df.withColumn(out, F.when(usable, found)).drop(*[f"_{x}_{k}" for x in "kh" for k in ("id", "text", "norm")])


def same_entity(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Equal ids when both names resolve, else equal normalised names; empty names never match."""
    df = resolve(resolve(pairs, entities, "name_1", "id_1"), entities, "name_2", "id_2")
    a, b = F.col("name_1"), F.col("name_2")
    both = F.col("id_1").isNotNull() & F.col("id_2").isNotNull()
    same = F.when(both, F.col("id_1") == F.col("id_2")).otherwise(T.norm_latin(a) == T.norm_latin(b))
    filled = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return df.withColumn("same", (same & filled).cast("int"))


def winner_side(bouts: DataFrame, entities: DataFrame, winner: str = "winner_text") -> DataFrame:
    """Winner text to a side's name by loose match, else its canonical alias, else as it is."""
    def fits(side: str) -> Column:
        name = F.col(side)
        too_long = (F.length(name) > 40) | (F.length(name) - F.length(F.replace(name, F.lit(" "), F.lit(""))) > 5)
        return ~too_long & T.names_match(F.col(winner), name)

    df = bouts.withColumns({"_a": fits("fighter_a"), "_b": fits("fighter_b")})
    canon = entities.select(F.col("entity_id").alias("_id"), canonical_alias(F.col("aliases")).alias("_canonical"))
    df = resolve(df, entities, winner, "_id").join(canon, "_id", "left")
    given = F.coalesce(F.col(winner), F.lit("")) != ""
    return df.withColumn("winner_name", F.when(~given, F.col(winner)).when(F.col("_a"), F.col("fighter_a")).when(
        F.col("_b"), F.col("fighter_b")).otherwise(F.coalesce("_canonical", F.col(winner)))).drop("_id", "_a", "_b", "_canonical")


def variants(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, variant): own normalised form and surname, and those of every alias of entities that share either."""
    names = names.select("name").distinct()
    own = names.select("name", F.explode(F.array(T.norm_latin(F.col("name")), T.surname(F.col("name")))).alias("variant"))
    alias = entities.select("entity_id", F.explode("aliases").alias("alias")).select(
        "entity_id", T.norm_latin(F.col("alias")).alias("norm"), T.surname(F.col("alias")).alias("last"))
    keyed = names.select("name", T.norm_latin(F.col("name")).alias("norm"), T.surname(F.col("name")).alias("last"))
    hit = (keyed.join(alias.select("norm", "entity_id").distinct(), "norm").select("name", "entity_id")
           .unionByName(keyed.join(alias.select("last", "entity_id").distinct(), "last").select("name", "entity_id"))).distinct()
    theirs = alias.select("entity_id", F.explode(F.array("norm", "last")).alias("variant")).distinct()
    return own.unionByName(hit.join(theirs, "entity_id").select("name", "variant")).filter("variant <> ''").distinct()


def name_pool(sources: list[tuple[DataFrame, str]], cyrillic_only: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """Distinct names longer than two characters from several columns; some sources only give Cyrillic names."""
    parts = [df.select(F.col(c).alias("name")) for df, c in sources]
    parts += [df.select(F.col(c).alias("name")).filter(F.regexp_like("name", F.lit(CYRILLIC))) for df, c in cyrillic_only]
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    return pool.filter(F.length("name") > 2).distinct()


def fuzzy_top(inputs: DataFrame, pool: DataFrame, k: int = 50, method: str = "levenshtein") -> DataFrame:
    """The ``k`` most similar pool names of each input name, exactly, by their normal forms (`similar.nearest`).

    Names with equal forms share a place in the search; each of them is a name of its own in the result.  Names without a letter
    or digit are like nothing.
    """
    pool = pool.select("name").distinct().withColumn("norm", T.norm_latin(F.col("name")))
    asked = inputs.select("input").distinct().withColumn("target", T.norm_latin(F.col("input")))
    near = SIM.nearest(asked.select("target"), pool.select("norm", "name"), k, method)
    found = asked.join(near, F.col("target") == F.col("l")).join(pool, F.col("r") == F.col("norm")).select("input", "name", "score")
    rank = F.row_number().over(Window.partitionBy("input").orderBy(F.desc("score"), "name"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def pair_candidates(pairs: DataFrame, top: DataFrame, limit: int = 100) -> DataFrame:
    """(pair_id, name, score, place): the candidates of both names of a pair, each once, the best ``limit`` first.

    ``pairs``: pair_id, name_a, name_b; ``top``: result of `fuzzy_top` for these names.
    """
    sides = pairs.select("pair_id", F.explode(F.array("name_a", "name_b")).alias("input")).distinct()
    both = sides.join(top.select("input", "name", "score"), "input").groupBy("pair_id", "name").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("score"), "name"))
    return both.withColumn("place", place).filter(F.col("place") <= limit)


def decide_pairs(pairs: DataFrame, top: DataFrame, first_least: float = K.ACCEPT_FIRST, second_least: float = K.ACCEPT_SECOND, limit: int = 100) -> DataFrame:
    """Each typed pair as a whole (pair_id, name_a, name_b): the best known name of both, or both names as typed.

    A pair is accepted when the best score of its first name and of its second reach their thresholds; the second one's is nearly
    nothing, so in practice the first name decides.  ``candidates``: the united lists of an accepted pair, best first, at most ``limit``; empty otherwise.
    """
    best = top.groupBy("input").agg(F.min(F.struct((-F.col("score")).alias("neg"), "name")).alias("best"))
    out = pairs
    for c in ("a", "b"):
        out = out.join(best.select(F.col("input").alias(f"name_{c}"), F.col("best").alias(f"_{c}")), f"name_{c}", "left")
    score = {c: F.coalesce(-F.col(f"_{c}.neg"), F.lit(0.0)) for c in ("a", "b")}
    out = out.withColumn("accepted", (score["a"] >= first_least) & (score["b"] >= second_least))
    out = out.select("pair_id", "accepted", *[F.when(F.col("accepted"), F.col(f"_{c}.name")).otherwise(F.col(f"name_{c}")).alias(f"decided_{c}") for c in ("a", "b")], "name_a", "name_b")
    listed = pair_candidates(out.filter("accepted"), top, limit).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("place", "name")))["name"].alias("candidates"))
    return out.join(listed, "pair_id", "left").select("pair_id", "accepted", "decided_a", "decided_b", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def as_of(left: DataFrame, snapshots: DataFrame, lag_days: int = 1) -> DataFrame:
    """Latest snapshot at or before ``bout_date - lag_days`` for each (fid, bout_date).

    Both sides are first reduced to one row per (fid, day), so the window of one
    competitor holds at most two rows per calendar day, however many bouts it has.
    ``snapshots``: fid, day, value with one row per (fid, day).
    """
    want = left.select("fid", F.date_sub("bout_date", lag_days).alias("day")).distinct()
    marks = snapshots.select("fid", "day", F.struct(F.col("day").alias("as_of_day"), "value").alias("_snap"), F.lit(False).alias("_ask"))
    asked = want.select("fid", "day", F.lit(None).cast(marks.schema["_snap"].dataType).alias("_snap"), F.lit(True).alias("_ask"))
    seen = Window.partitionBy("fid").orderBy("day", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("_last", F.last("_snap", ignorenulls=True).over(seen)).filter("_ask")
    found = found.select("fid", F.date_add("day", lag_days).alias("bout_date"), "_last.as_of_day", "_last.value")
    return left.join(found, ["fid", "bout_date"], "left")
