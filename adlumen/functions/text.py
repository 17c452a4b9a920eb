"""Text features as column expressions.

Everything is built from native string and regex functions without lambdas, so that a projection with
all features stays one code-generated stage. Words are runs of non-whitespace; whole-word matches use
letter/number/underscore neighbours, which holds for Turkish terms too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions.fixed_values import CTA_PHRASES, EMOJI_CLASS, URGENCY_TERMS
from adlumen.functions.rounding import round_binary

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1C-\x1F]"
# Characters beyond ASCII that count as a digit, decimal digits plus superscripts, circled
# ones etc. ASCII is tested first, as nearly all characters are ASCII.
DIGIT = (
    r"[0-9[\x{80}-\x{10FFFF}&&[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]]]"
)
# All emoji lie in this one range, which is found faster than they are.
ABOVE_LETTERS = r"[\x{2600}-\x{10FFFF}]"

TEXT_FEATURES = [
    "char_count", "word_count", "has_question", "has_exclamation", "urgency_count", "has_urgency",
    "emoji_count", "hashtag_count", "has_hashtag", "has_mention", "has_cta", "avg_word_len",
    "word_diversity", "all_caps_ratio", "numeric_ratio",
]


def clean_string(text: Column) -> Column:
    """Any value as a string; null becomes the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def any_term(terms: Sequence[str]) -> str:
    """Regex alternation of literal terms, in the given order."""
    if not terms:
        return "(?!)"
    return "(?:" + "|".join(r"\Q" + t + r"\E" for t in terms) + ")"


def whole_words(terms: Sequence[str], any_case: bool = True) -> str:
    """Regex for whole-word occurrences of the terms, by default case-insensitive."""
    return ("(?iu)" if any_case else "") + f"(?<!{WORD}){any_term(terms)}(?!{WORD})"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_ascii(text: Column) -> Column:
    """Whether the text has ASCII characters only (as many bytes as characters)."""
    return F.octet_length(text) == F.length(text)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def split_words(text: Column) -> Column:
    """Words between Unicode whitespace; the empty text has none."""
    return F.array_remove(F.split(text, f"(?U){SPACE}+"), "")


def urgency_count(text: Column, terms: Sequence[str] = URGENCY_TERMS) -> Column:
    return count_matches(text, whole_words(terms))


def has_phrase(text: Column, phrases: Sequence[str] = CTA_PHRASES) -> Column:
    return flag(text.rlike(whole_words(phrases)))


def with_text_features(
    df: DataFrame,
    text_col: str = "text_content",
    urgency_terms: Sequence[str] = URGENCY_TERMS,
    cta_phrases: Sequence[str] = CTA_PHRASES,
    phrases: str | None = None,
) -> DataFrame:
    """``df`` plus the 15 text features, computed in the rows' own partitions.

    ``phrases`` names a column that holds the passages of the texts with these terms and phrases (``passages``).
    """
    text, lowered = F.col("_text"), F.col("_lowered")
    near = clean_string(F.col(phrases)) if phrases else text

    # Each step is a projection of its own: what is used several times is computed only once.
    base = df.withColumn("_text", clean_string(F.col(text_col)))
    base = base.withColumn("_lowered", split_words(F.lower(text)))
    counted = base.withColumns({
        "char_count": F.length(text),
        "word_count": F.size(lowered),
        "has_question": flag(F.contains(text, F.lit("?"))),
        "has_exclamation": flag(F.contains(text, F.lit("!"))),
        "urgency_count": urgency_count(near, urgency_terms),
        "emoji_count": F.when(is_ascii(text) | ~text.rlike(ABOVE_LETTERS), F.lit(0)).otherwise(count_matches(text, EMOJI_CLASS)),
        "hashtag_count": F.when(F.contains(text, F.lit("#")), count_matches(text, f"#{WORD}+")).otherwise(F.lit(0)),
        "has_mention": flag(F.contains(text, F.lit("@")) & text.rlike(f"@{WORD}")),
        "has_cta": has_phrase(near, cta_phrases),
        "_distinct": F.size(F.array_distinct(lowered)),
        # A word counts when its first character is upper-case / when it holds a digit.
        "_caps": count_matches(text, rf"(?U)\p{{IsUppercase}}(?<![^\s\x1C-\x1F]\p{{IsUppercase}})"),
        "_digits": count_matches(text, rf"(?U){DIGIT}[^\s\x1C-\x1F]*"),
    })
    total = F.greatest(F.col("word_count"), F.lit(1))
    ratios = counted.withColumns({
        "has_urgency": flag(F.col("urgency_count") > 0),
        "has_hashtag": flag(F.col("hashtag_count") > 0),
        "_avg": F.col("char_count") / total,
        "_diversity": F.col("_distinct") / total,
        "_caps_ratio": F.col("_caps") / total,
        "_digit_ratio": F.col("_digits") / total,
    })
    rounded = ratios.withColumns({
        "avg_word_len": round_binary(F.col("_avg"), 2),
        "word_diversity": round_binary(F.col("_diversity"), 3),
        "all_caps_ratio": round_binary(F.col("_caps_ratio"), 3),
        "numeric_ratio": round_binary(F.col("_digit_ratio"), 3),
    })
    return rounded.select(*df.columns, *TEXT_FEATURES)


def stripped(text: Column) -> Column:
    """Without whitespace at either end."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    """Whitespace runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def exclaimed(text: Column) -> Column:
    """A final ``.`` or ``!`` becomes ``!``; an otherwise empty result becomes ``!`` appended."""
    replaced = F.regexp_replace(text, r"[!.]$", "!")
    return F.when(replaced == "", F.concat(text, F.lit("!"))).otherwise(replaced)


def normalize_text(text: Column, limit: int, exclaim: Column | None = None) -> Column:
    """Collapse whitespace, exclaim on request, cut texts above ``limit`` and re-append the ``!``."""
    wish = F.lit(False) if exclaim is None else exclaim
    tidy = collapse_spaces(clean_string(text))
    tidy = F.when(wish, exclaimed(tidy)).otherwise(tidy)
    cut = F.concat(F.rtrim(F.substring(tidy, 1, limit)), F.when(wish, F.lit("!")).otherwise(F.lit("")))
    return F.when(F.length(tidy) > limit, cut).otherwise(tidy)
