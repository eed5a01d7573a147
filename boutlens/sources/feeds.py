"""Landed feeds: scoreboard, odds, progress lines, answer cache, stored bout records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens import schemas
from boutlens.functions.text import method_code, method_type
from boutlens.sources.datasets import as_struct


def local_date(ts: Column, zone: str) -> Column:
    """Calendar date of a UTC instant in another zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def card_for(bouts: DataFrame, ts: str, zone: str, day: str) -> DataFrame:
    """Bouts whose local date is ``day``.  The plain range of one day either side can be pushed to the scan."""
    target = F.lit(day).cast("date")
    near = F.to_date(ts).between(F.date_sub(target, 1), F.date_add(target, 1))
    return bouts.filter(near).filter(local_date(F.col(ts), zone) == target)


def scoreboard_bouts(feed: DataFrame) -> DataFrame:
    """Nested scoreboard events to one row per bout; entries with fewer than two competitors fall away.

    Winner, method and final round are read only from finished bouts.
    """
    events = feed.select(F.explode("events").alias("e"))
    comps = events.select(F.coalesce("e.name", F.lit("Event")).alias("event_name"), F.try_to_timestamp("e.date").alias("ts"),
                          F.explode("e.competitions").alias("c")).filter(F.size("c.competitors") >= 2)
    c = F.col("c")
    one, two = F.element_at(c["competitors"], 1), F.element_at(c["competitors"], 2)
    final = F.coalesce((c["status"]["type"]["state"] == "post") & (c["status"]["type"]["name"] == "STATUS_FINAL"), F.lit(False))
    winner = F.try_element_at(F.filter(c["competitors"], lambda x: x["winner"]), F.lit(1))["athlete"]["fullName"]
    cards = F.filter(F.coalesce(c["competitors"]["linescores"], F.array()), lambda s: F.size(s) > 0)

    def judged(i: int) -> Column:
        side = F.when(F.size(cards) == 2, F.get(cards, F.lit(i)))
        return F.flatten(F.transform(F.filter(side, lambda r: r["linescores"].isNotNull()), lambda r: r["linescores"]["displayValue"]))

    texts = F.coalesce(F.transform(c["details"], lambda x: F.coalesce(x["type"]["text"], F.lit(""))), F.array().cast("array<string>"))
    periods = F.coalesce(c["format"]["regulation"]["periods"], F.lit(3))
    return comps.select(
        "event_name", "ts", F.coalesce(one["athlete"]["fullName"], F.lit("Unknown")).alias("fighter_a"),
        F.coalesce(two["athlete"]["fullName"], F.lit("Unknown")).alias("fighter_b"),
        F.coalesce(one["athlete"]["dateOfBirth"], F.lit("")).alias("dob_a"), F.coalesce(two["athlete"]["dateOfBirth"], F.lit("")).alias("dob_b"),
        periods.alias("rounds"), F.coalesce(c["featured"], F.lit(False)).alias("is_main_event"),
        F.coalesce(c["type"]["abbreviation"], F.lit("")).alias("weight_class"),
        F.when(final, winner).alias("winner"),
        F.when(final, method_code(texts, judged(0), judged(1))).otherwise("TBD").alias("method"),
        F.when(final, F.coalesce(c["status"]["period"], periods)).otherwise(periods).alias("round"))


def odds_rows(feed: DataFrame) -> DataFrame:
    """First bookmaker, first market: prices of home and away, 1.85 where a level is missing."""
    book = F.try_element_at("bookmakers", F.lit(1))
    outcomes = F.try_element_at(book["markets"], F.lit(1))["outcomes"]

    def price(team: str) -> Column:
        # Later outcomes of one name win, as in a map that is filled in order.
        named = F.filter(outcomes, lambda o: o["name"] == F.col(team))
        return F.coalesce(F.try_element_at(named, F.lit(-1))["price"], F.lit(K.STUB_ODDS))

    return feed.select(
        "feed_pos", "home_team", "away_team", "commence_time", F.coalesce("description", F.lit("event")).alias("event"),
        F.when(F.size(F.coalesce("bookmakers", F.array())) == 0, "no data").otherwise(F.coalesce(book["title"], F.lit("unknown"))).alias("bookmaker"),
        price("home_team").alias("home_odds"), price("away_team").alias("away_odds"))


def read_odds_feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed odds files (a JSON array each) with their feed position: files by name, then places in the array."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    order = raw.select("file").distinct().withColumn("_no", F.row_number().over(Window.orderBy("file")) - 1)
    event = schemas.ODDS_EVENT.replace("\n", " ")
    rows = raw.join(order, "file").select("_no", F.posexplode(F.from_json("value", f"array<struct<{as_struct(event)}>>")).alias("pos", "e"))
    return rows.select("e.*", (F.shiftleft(F.col("_no").cast("bigint"), 32) + F.col("pos")).alias("feed_pos"))


def read_scoreboard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SCOREBOARD).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def progress_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Stage and final rows of a newline-JSON progress log; blanks and plain log lines fall away.

    Works the same on a stream.
    """
    text = F.trim(F.col(line))
    parsed = F.from_json(F.when(F.startswith(text, F.lit("{")), text), schemas.PROGRESS)
    df = lines.withColumn("_p", parsed)
    p = F.col("_p")
    stage = p["type"] == "stage"
    kind = F.when(stage, "stage").when(p["status"].isNotNull(), "final_result")
    title = F.when(stage, F.concat(F.lit("bout "), F.coalesce(p["current"], F.lit(0)).cast("string"), F.lit("/"),
                                   F.coalesce(p["total"], F.lit(0)).cast("string"))).otherwise(p["status"])
    return df.withColumns({"kind": kind, "title": title, "current": p["current"], "message": p["message"]}).filter(
        F.col("kind").isNotNull()).drop("_p")


def cache_key(system: str, prompt: str) -> Column:
    return F.md5(F.concat(F.col(system), F.lit("_"), F.col(prompt)))


def cache_keys(answered: DataFrame, system: str, prompt: str) -> DataFrame:
    return answered.select(cache_key(system, prompt).alias("cache_key")).distinct()


def split_by_cache(asked: DataFrame, cache: DataFrame, system: str, prompt: str) -> tuple[DataFrame, DataFrame]:
    """Questions with a cached answer, and the work list of those without."""
    keyed = asked.withColumn("cache_key", cache_key(system, prompt))
    keys = cache.select("cache_key")
    return keyed.join(keys, "cache_key", "left_semi"), keyed.join(keys, "cache_key", "left_anti")


def bout_record(df: DataFrame) -> DataFrame:
    """The stored form of a bout: event name up to the first bracket, method type, nested stats."""
    def stats(s: str) -> Column:
        src = F.col(s)
        return F.struct(*[(F.date_format(src[k], "yyyy-MM-dd") if k == "dob" else src[k]).alias(k) for k in K.STAT_KEYS])

    return df.select(
        "bout_id", F.trim(F.substring_index("location", "(", 1)).alias("event"), F.date_format("bout_date", "yyyy-MM-dd").alias("date"),
        "fighter_a", "fighter_b", "winner", "round", method_type(F.col("method")).alias("method"), "odds_a", "odds_b", "blind_conf",
        stats("stats_a").alias("stats_a"), stats("stats_b").alias("stats_b"))
