"""Quality rules: a table of thresholds compiled into one native projection.

Every measure is a built-in expression over the whole text; no user function runs.  Words are runs of
characters other than a space and ``\\x09-\\x0D``.  A null text has no words; a text without words fails the base rule.
Rows are judged one by one, so repeated rows and ties change nothing; a very long text is judged whole, in arrays of its words within its row;
an empty table gives no rows.  Columns named like the results are replaced, all others, whatever their names, come back as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm.columns import set_aside

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
RESULT = ("m", "base_failed", "kept")

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "a", "to", "in", "is", "that", "it", "on", "for", "are", "as", "with", "this", "be", "by", "from", "or",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "du", "un", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "avec",
    "el", "en", "y", "los", "se", "del", "las", "no", "con", "para", "por", "es", "al", "lo", "su",
)


@dataclass(frozen=True)
class Rule:
    """A ratio that must lie between two bounds.  Without a denominator (0) the rule passes."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: length, symbol, stop-word and line ratios
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.5),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.3),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.0, 0.3),
)


def _covered(places: Column) -> Column:
    """Words covered by windows at the given sorted places."""
    ahead = F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(2**31 - 1)))
    return F.aggregate(F.zip_with(places, ahead, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``m`` of counts.  Stages keep each large array computed once.

    The repeated windows of a document are found inside its row: hashes of eight words are counted in a hash set,
    and only a row with a repeated hash sorts them.  Nothing is shuffled, so no key can be hot.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_w", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("_w")
    rows = rows.withColumn("_win", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_twice", F.size(F.array_distinct("_win")) < F.size("_win"))
    order = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_order", F.when(F.col("_twice"), order))
    # a window is repeated if a neighbour in the sorted order has its hash; get() is null beyond the ends
    same = F.filter("_order", lambda x, i: F.coalesce(F.get("_order", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_order", i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("_places", F.when(F.col("_twice"), F.array_sort(F.transform(same, lambda x: x["i"]))))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    plain = F.split(F.regexp_replace(F.lower(t), r"[\x20\x09-\x0D.,;:!?]+", " "), " ", -1)
    return rows.withColumn(
        "m",
        F.struct(
            count(n).alias("n_words"),
            count(F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
            count(F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
            count(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
            count(F.when(F.col("_twice"), _covered(F.col("_places")))).alias("n_repeat_words"),
            count(F.size("_lines")).alias("n_lines"),
            count(F.size(F.filter(plain, lambda x: F.array_contains(stop, x)))).alias("n_stop_words"),
        ),
    ).drop("_w", "_lines", "_win", "_twice", "_order", "_places")


def verdict(rules: tuple[Rule, ...] = RULES, m: str = "m") -> Column:
    """All rules as one boolean expression over the counts."""
    out = F.lit(True)
    for r in rules:
        part, whole = F.col(f"{m}.{r.numerator}"), F.col(f"{m}.{r.denominator}")
        out = out & ((whole == 0) | ((part >= r.low * whole) & (part <= r.high * whole)))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``m``, ``base_failed`` and ``kept``."""
    docs, own = set_aside(docs, (text,), RESULT)
    rows = measures(docs, text)
    base = (F.col("m.n_words") < 20) | (100 * F.col("m.n_repeat_words") > 30 * F.col("m.n_words"))
    return rows.select(*own, "m", base.alias("base_failed"), (~base & verdict(rules)).alias("kept"))
