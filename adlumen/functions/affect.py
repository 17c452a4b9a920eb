"""Language routing, sentiment and toxicity.

Both lexicon scorers are means of +1/-1 word hits with negation. Instead of folding over token arrays,
a text is reduced to the passages around its relevant words, these to the words by one regex pass, and the mean is taken from match counts
on that short string: hits of either sign and how many of each are flipped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.functions.passages import passages
from adlumen.functions.text import any_term, clean_string, count_matches, flag, is_ascii, split_words, whole_words


def grouped_terms(words: Sequence[str]) -> str:
    """Alternation of the words with common first letters factored out, so that fewer are tried."""
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word[1:])
    if not groups:
        return any_term([])
    return "(?:" + "|".join(re.escape(first) + any_term(rests) for first, rests in groups.items()) + ")"


@dataclass(frozen=True)
class SentimentLexicon:
    """Word lists and how negators act; texts are lower-cased first.

    A token is a run of ``letters``. With ``negator_follows`` a negator as the very next token flips a
    hit; otherwise a negator flips the next hit, however far away it is.
    """

    positive: Sequence[str]
    negative: Sequence[str]
    negators: Sequence[str]
    letters: str = "a-z'"
    negator_follows: bool = False

    def scored(self) -> tuple[list[str], list[str], list[str]]:
        """Positive, negative and negating words that a single token can equal, without overlap."""
        token = re.compile(f"[{self.letters}]+")
        negators = [w for w in self.negators if token.fullmatch(w)]
        positive = [w for w in self.positive if token.fullmatch(w) and w not in negators]
        negative = [w for w in self.negative
                    if token.fullmatch(w) and w not in negators and w not in positive]
        return positive, negative, negators

    def tokens(self, words: Sequence[str], after: str = "") -> str:
        """Regex for tokens equal to one of the words (directly after the regex ``after``)."""
        return f"(?<![{self.letters}]){after}{grouped_terms(words)}(?![{self.letters}])"

    def _then_negator(self) -> str:
        return f"[^{self.letters}]+{grouped_terms(self.scored()[2])}(?![{self.letters}])"

    def near(self, lowered: Column) -> Column:
        """The passages of the text that hold its deciding words; ``relevant`` finds the same words in them."""
        return passages(lowered, [word for words in self.scored() for word in words], self.letters)

    def relevant(self, lowered: Column) -> Column:
        """The words of the text that decide, in order, joined by blanks."""
        positive, negative, negators = self.scored()
        if self.negator_follows:
            pattern = self.tokens([*positive, *negative]) + f"(?:{self._then_negator()})?"
        else:
            pattern = self.tokens([*positive, *negative, *negators])
        return F.array_join(F.regexp_extract_all(lowered, F.lit(pattern), 0), " ")

    def compound(self, relevant: Column) -> Column:
        """Mean of the hits in a reduced text; 0 without hits."""
        positive, negative, negators = self.scored()

        def hits(words: Sequence[str]) -> Column:
            return count_matches(relevant, self.tokens(words))

        def flipped(words: Sequence[str]) -> Column:
            if self.negator_follows:
                return count_matches(relevant, self.tokens(words) + f"(?={self._then_negator()})")
            return count_matches(relevant, self.tokens(words, after=grouped_terms(negators) + " "))

        n = hits(positive) + hits(negative)
        total = hits(positive) - hits(negative) - flipped(positive) * 2 + flipped(negative) * 2
        return F.when(relevant == "", F.lit(0.0)).when(n > 0, total / n).otherwise(F.lit(0.0))

    def any_word(self, relevant: Column) -> Column:
        """Whether a word of either list occurs, negators that are listed included."""
        return relevant.rlike(self.tokens([*self.positive, *self.negative]))


ENGLISH = SentimentLexicon(fixed.POSITIVE_EN, fixed.NEGATIVE_EN, fixed.NEGATORS_EN)
TURKISH = SentimentLexicon(
    fixed.POSITIVE_TR, fixed.NEGATIVE_TR, fixed.NEGATORS_TR,
    letters="a-z" + fixed.TURKISH_LETTERS + "'", negator_follows=True,
)


def is_turkish(text: Column, lowered: Column | None = None) -> Column:
    """A Turkish letter anywhere, or one of the function words as a whole word."""
    lowered = F.lower(text) if lowered is None else lowered
    letter = F.when(is_ascii(text), F.lit(False)).otherwise(text.rlike(f"[{fixed.TURKISH_LETTERS}]"))
    return letter | lowered.rlike(whole_words(fixed.TURKISH_FUNCTION_WORDS, any_case=False))


def with_compound(df: DataFrame, lexicon: SentimentLexicon, text_col: str = "text_content", name: str = "compound") -> DataFrame:
    """``df`` plus the lexicon mean of every text, whatever its language."""
    near = df.withColumn("_near", lexicon.near(F.lower(clean_string(F.col(text_col)))))
    reduced = near.withColumn("_relevant", lexicon.relevant(F.col("_near")))
    return reduced.withColumn(name, lexicon.compound(F.col("_relevant"))).drop("_near", "_relevant")


def with_affect(
    df: DataFrame,
    text_col: str = "text_content",
    words: str | None = None,
    english: SentimentLexicon = ENGLISH,
    turkish: SentimentLexicon = TURKISH,
    toxic_terms: Sequence[str] = tuple(fixed.TOXIC_EN),
    turkish_toxic_terms: Sequence[str] = tuple(fixed.TOXIC_TR),
) -> DataFrame:
    """``df`` plus ``sentiment_score`` in [-1, 1] and ``toxicity_score`` in [0, 1] of the text.

    Sentiment: Turkish lexicon for Turkish texts, otherwise the English lexicon; an exclamation mark adds a bonus (in English only next to a lexicon word).
    Toxicity: distinct terms found as substrings, per word of a text of up to ten words.
    ``words`` names a column that already holds the word count.
    """
    text, lowered, relevant, n_words = F.col("_text"), F.col("_lowered"), F.col("_relevant"), F.col("_n_words")
    blank, in_turkish = n_words == 0, F.col("_turkish")

    # Lower-casing, language and reduction are steps of their own: each is used many times below.
    base = df.withColumn("_text", clean_string(F.col(text_col))).withColumn("_lowered", F.lower(text))
    base = base.withColumns({
        "_n_words": F.col(words) if words else F.size(split_words(text)),
        "_function_words": passages(lowered, fixed.TURKISH_FUNCTION_WORDS),
        "_near_turkish": turkish.near(lowered),
        "_near_english": english.near(lowered),
    })
    base = base.withColumn("_turkish", is_turkish(text, F.col("_function_words")))
    relevant_of = F.when(in_turkish, turkish.relevant(F.col("_near_turkish"))).otherwise(english.relevant(F.col("_near_english")))
    base = base.withColumn("_relevant", relevant_of)

    shouted = F.contains(text, F.lit("!"))
    turkish_score = turkish.compound(relevant) + F.when(shouted, F.lit(fixed.EXCLAMATION_BONUS)).otherwise(0.0)
    english_score = english.compound(relevant) + F.when(
        shouted & english.any_word(relevant), F.lit(fixed.EXCLAMATION_BONUS)
    ).otherwise(0.0)
    score = F.when(in_turkish, turkish_score).otherwise(english_score)

    def found(terms: Sequence[str]) -> Column:
        total = F.lit(0)
        for term in terms:
            total = total + flag(F.contains(lowered, F.lit(term)))
        return total

    extra = [t for t in turkish_toxic_terms if t not in toxic_terms]
    hits = found(list(dict.fromkeys(toxic_terms))) + F.when(in_turkish, found(extra)).otherwise(0)
    per_word = hits / F.least(F.greatest(n_words, F.lit(1)), F.lit(10)) * F.lit(3.0)
    scored = base.withColumns({
        "sentiment_score": F.when(blank, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))),
        "toxicity_score": F.when(blank, F.lit(0.0)).otherwise(F.least(F.lit(1.0), per_word)),
    })
    kept = [c for c in df.columns if c not in ("sentiment_score", "toxicity_score")]
    return scored.select(*kept, "sentiment_score", "toxicity_score")
