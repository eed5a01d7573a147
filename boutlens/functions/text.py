"""Name and text functions.  All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutlens import constants as K

SPACE = r"[\s\p{Z}\x{85}]+"
# Characters removed from typed text (control, zero-width, NBSP, BOM, bidi marks, hyphen).
DROPPED = "[\\x{00}-\\x{1F}\\x{200B}-\\x{200F}\\x{A0}\\x{FEFF}\\x{202A}\\x{202E}-]"
DASHES = "[\\x{2014}\\x{2013}\\x{2212}]"
LETTER = "[а-яёa-zA-Z]"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def clean_name(name: Column) -> Column:
    """Drop parenthesised remarks such as a rank, and trim."""
    return strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\([^)]*\)", ""))


def sanitize_name(name: Column) -> Column:
    """`clean_name` with runs of white space collapsed."""
    return F.trim(F.regexp_replace(clean_name(name), SPACE, " "))


def strip_marks(text: Column) -> Column:
    """Remove control and invisible characters, unify dashes, collapse white space."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), DROPPED, "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, DASHES, "-"), SPACE, " "))


def join_spaced(text: Column) -> Column:
    """Words spelt with blanks, put together: a lone letter joins the word before it, again and again until nothing changes.

    Two sweeps reach that end for words of any length.  One sweep takes lone letters in pairs, since a letter that has just
    been joined cannot be joined to as well: of the letters after a word, the first joins the word and the others each
    other, two by two.  If their number is even, one is left alone, and the second sweep joins it to the pair before.
    """
    for _ in range(2):
        text = F.regexp_replace(text, rf"(?iuU)({LETTER})\s+({LETTER})(\s|[^\w{LETTER[1:-1]}]|$)", "$1$2$3")
    return text


def clean_text(text: Column) -> Column:
    """`strip_marks` that also rejoins letter-spaced words."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), DROPPED, "")
    return F.trim(F.regexp_replace(join_spaced(F.regexp_replace(kept, DASHES, "-")), SPACE, " "))


def norm_ru(name: Column) -> Column:
    """Lower case, fold two letters, keep Latin, Cyrillic and digits."""
    folded = F.translate(F.lower(F.coalesce(name, F.lit("None"))), "ёй", "еи")
    return F.regexp_replace(folded, "[^a-zа-я0-9]", "")


def translit(text: Column) -> Column:
    """Cyrillic to Latin.  One translate for the 1:1 part, then the long ones."""
    source, target = K.TRANSLIT_ONE
    lowered = F.translate(F.lower(F.coalesce(text, F.lit(""))), source + K.TRANSLIT_DROP, target)
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), K.TRANSLIT_MANY.items(), lowered)


def norm_latin(name: Column) -> Column:
    return F.regexp_replace(translit(name), "[^a-z0-9]", "")


def norm_latin_cli(name: Column) -> Column:
    """`norm_latin` that first drops remarks in parentheses and all after a comma."""
    bare = F.regexp_replace(F.regexp_replace(translit(name), r"\s*\([^)]*\)", ""), ",.*", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def surname(name: Column) -> Column:
    """Last word, or the one before it when the last is a generation suffix."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), SPACE, " ")), " ")
    last = F.element_at(words, -1)
    suffixed = F.lower(last).isin(K.NAME_SUFFIXES) & (F.size(words) > 1)
    return translit(F.when(suffixed, F.try_element_at(words, F.lit(-2))).otherwise(last))


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("F_"), F.substring(F.md5(norm_latin(name)), 1, 8))


def fight_key(a: Column, b: Column, day: Column) -> Column:
    """Directional key: swapping the sides gives another key."""
    return F.concat(a, F.lit("_"), b, F.lit("_"), F.date_format(day, "yyyy-MM-dd"))


def names_match(x: Column, y: Column, allow_empty: bool = True) -> Column:
    """Loose match: equal, or one contains the other, after `norm_ru`.

    An empty name is contained in every name; ``allow_empty=False`` turns that off.
    """
    nx, ny = norm_ru(x), norm_ru(y)
    hit = F.contains(nx, ny) | F.contains(ny, nx)
    return hit if allow_empty else hit & (nx != "") & (ny != "")


def split_pair(raw: Column) -> Column:
    """Struct(f1, f2) from 'X vs Y'; without a separator the words are halved.

    Null when there are fewer than two words, or a side is too long to be a name.
    """
    by_separator = F.coalesce(*[
        F.when(F.contains(raw, F.lit(s)), F.struct(
            F.substring_index(raw, s, 1).alias("f1"),
            F.substring(raw, F.instr(raw, s) + len(s), F.length(raw)).alias("f2"),
        ))
        for s in K.PAIR_SEPARATORS
    ])
    words = F.split(F.trim(F.regexp_replace(raw, SPACE, " ")), " ")
    half = F.floor(F.size(words) / 2).cast("int")
    halved = F.when(F.size(words) >= 2, F.struct(
        F.array_join(F.slice(words, F.lit(1), F.greatest(half, F.lit(1))), " ").alias("f1"),
        F.array_join(F.slice(words, half + 1, F.size(words)), " ").alias("f2"),
    ))
    pair = F.coalesce(by_separator, halved)
    f1, f2 = F.trim(pair["f1"]), F.trim(pair["f2"])

    def too_long(c: Column) -> Column:
        return (F.length(c) > 40) | (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) > 5)

    return F.when(~too_long(f1) & ~too_long(f2), F.struct(f1.alias("f1"), f2.alias("f2")))


def camp_clean(camp: Column) -> Column:
    trimmed = F.trim(F.coalesce(camp, F.lit("")))
    blank = F.lower(trimmed).isin(K.PLACEHOLDER_CAMPS) | (F.length(trimmed) < 3)
    return F.when(blank, F.lit("Independent")).otherwise(trimmed)


def method_code(details: Column, scores_a: Column, scores_b: Column) -> Column:
    """Method text to code.  The first detail that names a method decides.

    Decisions are split when both sides carry three score cards and side A's differ.
    """
    known = F.filter(details, lambda t: F.contains(t, F.lit("Submission")) | F.contains(t, F.lit("KO"))
                     | F.contains(t, F.lit("Kotko")) | F.contains(t, F.lit("Decision")))
    first = F.try_element_at(known, F.lit(1))
    split = (F.size(scores_a) == 3) & (F.size(scores_b) == 3) & (F.size(F.array_distinct(scores_a)) > 1)
    return (F.when(F.contains(first, F.lit("Submission")), "SUB")
            .when(F.contains(first, F.lit("KO")) | F.contains(first, F.lit("Kotko")), "KO")
            .when(first.isNotNull(), F.when(split, "SD").otherwise("UD"))
            .otherwise("TBD"))


def method_type(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.METHOD_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit("DECISION_UNANIMOUS"))


def payment_amount(text: Column) -> Column:
    """Amount of an incoming-transfer text as DECIMAL(12,2), else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    incoming = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in K.INCOMING_WORDS])
    digits = F.regexp_replace(F.regexp_extract(low, K.AMOUNT_PATTERN, 1), r"\s", "")
    return F.when(incoming & (digits != ""), F.replace(digits, F.lit(","), F.lit(".")).try_cast("decimal(12,2)"))


def strip_map(m: Column) -> Column:
    """Trim the keys and values of a string map."""
    return F.transform_values(F.transform_keys(m, lambda k, _: F.trim(k)), lambda _, v: F.trim(v))
