"""DuckDB counterparts of the text, affect and score functions, as common table expressions.

They are written independently of the column expressions: words by array functions, whole-word terms by
doubling every separator, and sentiment by unnesting tokens and windows over them.
"""

from __future__ import annotations

from adlumen.functions import fixed_values as fixed

BLANKS = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
LETTER = r"[\p{L}\p{N}_]"
GAP = r"[^\p{L}\p{N}_]"


def quoted(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def words_list(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{BLANKS}+'), lambda w: w <> '')"


def doubled(text: str) -> str:
    """Every separator twice, so that neighbouring whole-word matches do not share one."""
    return f"regexp_replace({text}, '({GAP})', '\\1\\1', 'g')"


def term_pattern(terms) -> str:
    import re

    inner = "|".join(re.sub(r"(\W)", r"\1\1", t) for t in terms)
    return f"(?i)(?:^|{GAP})(?:{inner})(?:$|{GAP})"


def term_count(text: str, terms) -> str:
    return f"len(regexp_extract_all({doubled(text)}, '{term_pattern(terms)}'))"


def rounded(x: str, digits: int) -> str:
    """Round the stored binary value, ties to even (see the rounding function of the library)."""
    scale = f"{10**digits}e0"
    low = f"floor({x} * {scale})"
    head = f"cast(cast({x} as float) as double)"
    side = f"(({head} * 2e0 * {scale} - ({low} * 2e0 + 1e0)) + ({x} - {head}) * 2e0 * {scale})"
    return f"((case when {side} > 0 or ({side} = 0 and abs({low} % 2) = 1) then {low} + 1e0 else {low} end) / {scale})"


def feature_ctes(source: str, key: str, text: str, urgency=None, cta=None, out: str = "feats") -> list[tuple[str, str]]:
    """CTE ``out``: key plus the 15 features."""
    urgency, cta = urgency or fixed.URGENCY_TERMS, cta or fixed.CTA_PHRASES
    return [
        (f"{out}_words", f"""
            select {key}, t, {words_list('t')} as w from
            (select {key}, coalesce({text}, '') as t from {source}) s"""),
        (f"{out}_counts", f"""
            select {key},
              cast(length(t) as integer) as char_count,
              cast(len(w) as integer) as word_count,
              cast(contains(t, '?') as integer) as has_question,
              cast(contains(t, '!') as integer) as has_exclamation,
              cast({term_count('t', urgency)} as integer) as urgency_count,
              cast(len(regexp_extract_all(t, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{2B50}}\\x{{2764}}\\x{{FE0F}}]')) as integer) as emoji_count,
              cast(len(regexp_extract_all(t, '#{LETTER}+')) as integer) as hashtag_count,
              cast(regexp_matches(t, '@{LETTER}') as integer) as has_mention,
              cast({term_count('t', cta)} > 0 as integer) as has_cta,
              len(list_distinct(list_transform(w, lambda x: lower(x)))) as n_distinct,
              len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) as n_caps,
              len(list_filter(w, lambda x: regexp_matches(x, '\\p{{Nd}}'))) as n_digits,
              greatest(len(w), 1) as total
            from {out}_words"""),
        (f"{out}_ratios", f"""
            select *, cast(char_count as double) / total as r1, cast(n_distinct as double) / total as r2,
                   cast(n_caps as double) / total as r3, cast(n_digits as double) / total as r4
            from {out}_counts"""),
        (out, f"""
            select {key}, char_count, word_count, has_question, has_exclamation, urgency_count,
              cast(urgency_count > 0 as integer) as has_urgency, emoji_count, hashtag_count,
              cast(hashtag_count > 0 as integer) as has_hashtag, has_mention, has_cta,
              {rounded('r1', 2)} as avg_word_len, {rounded('r2', 3)} as word_diversity,
              {rounded('r3', 3)} as all_caps_ratio, {rounded('r4', 3)} as numeric_ratio
            from {out}_ratios"""),
    ]


def turkish(text: str) -> str:
    words = ", ".join(f"'{w}'" for w in fixed.TURKISH_FUNCTION_WORDS)
    return (f"(regexp_matches({text}, '[{fixed.TURKISH_LETTERS}]') or "
            f"list_has_any(regexp_extract_all(lower({text}), '{LETTER}+'), [{words}]))")


def compound_ctes(source: str, key: str, text: str, english=None, turkish_lexicon=None, out: str = "affect"):
    """CTEs ``<out>_en`` and ``<out>_tr``: key and lexicon compound for keys with any hit."""
    pos, neg, nots = english or (fixed.POSITIVE_EN, fixed.NEGATIVE_EN, fixed.NEGATORS_EN)
    tpos, tneg, tnots = turkish_lexicon or (fixed.POSITIVE_TR, fixed.NEGATIVE_TR, fixed.NEGATORS_TR)

    def tokens(pattern: str) -> str:
        return (f"select {key}, unnest(toks) as w, unnest(range(1, len(toks) + 1)) as i from "
                f"(select {key}, regexp_extract_all(lower(coalesce({text}, '')), '{pattern}') as toks from {source}) s")

    return [
        (f"{out}_en_tokens", tokens("[a-z'']+")),
        (f"{out}_en_marks", f"""
            select {key}, i,
              case when w in {quoted(nots)} then 0 when w in {quoted(pos)} then 1 when w in {quoted(neg)} then -1 end as mark
            from {out}_en_tokens"""),
        (f"{out}_en_hits", f"""
            select {key}, mark, lag(mark) over (partition by {key} order by i) as previous
            from {out}_en_marks where mark is not null"""),
        (f"{out}_en", f"""
            select {key}, cast(sum(case when previous = 0 then -mark else mark end) as double) / count(*) as compound
            from {out}_en_hits where mark <> 0 group by {key}"""),
        (f"{out}_tr_tokens", tokens(f"[a-zA-Z{fixed.TURKISH_LETTERS}'']+")),
        (f"{out}_tr_next", f"""
            select {key}, w, lead(w) over (partition by {key} order by i) as following from {out}_tr_tokens"""),
        (f"{out}_tr", f"""
            select {key}, cast(sum(case when following in {quoted(tnots)} then -mark else mark end) as double) / count(*) as compound
            from (select {key}, following,
                    case when w in {quoted(tpos)} then 1 when w in {quoted(tneg)} then -1 end as mark
                  from {out}_tr_next) m
            where mark is not null group by {key}"""),
    ]


def affect_ctes(source: str, key: str, text: str, out: str = "affect"):
    """CTE ``out``: key, sentiment_score and toxicity_score."""
    both = fixed.POSITIVE_EN + fixed.NEGATIVE_EN

    def found(terms) -> str:
        return " + ".join(f"cast(contains(lower(t), '{w}') as integer)" for w in terms)

    return compound_ctes(source, key, text, out=out) + [
        (f"{out}_words", f"""
            select distinct {key} from {out}_en_tokens where w in {quoted(both)}"""),
        (f"{out}_base", f"""
            select s.{key}, coalesce({text}, '') as t, coalesce(e.compound, 0e0) as en, coalesce(k.compound, 0e0) as tr,
                   h.{key} is not null as any_word, len({words_list(f"coalesce({text}, '')")}) as n_words
            from {source} s left join {out}_en e on e.{key} = s.{key} left join {out}_tr k on k.{key} = s.{key}
            left join {out}_words h on h.{key} = s.{key}"""),
        (out, f"""
            select {key},
              case when n_words = 0 then 0e0
                   when {turkish('t')} then greatest(-1e0, least(1e0, tr + case when contains(t, '!') then 0.1e0 else 0e0 end))
                   else greatest(-1e0, least(1e0, en + case when contains(t, '!') and any_word then 0.1e0 else 0e0 end))
              end as sentiment_score,
              case when n_words = 0 then 0e0
                   else least(1e0, ({found(fixed.TOXIC_EN)} +
                     case when {turkish('t')} then {found(fixed.TOXIC_TR)} else 0 end) / cast(least(greatest(n_words, 1), 10) as double) * 3e0)
              end as toxicity_score
            from {out}_base"""),
    ]


def benchmark(ctr: str) -> str:
    return (f"least({fixed.BENCHMARK_CEILING}e0, greatest({fixed.BENCHMARK_FLOOR}e0, "
            f"ln(1e0 + greatest(0e0, {ctr})) / ln(1e0 + {fixed.BENCHMARK_REFERENCE}e0) * 100e0))")


def brand_score(similarity: str, baseline: float) -> str:
    scaled = f"({similarity} - {baseline}e0) / (1e0 - {baseline}e0) * 100e0"
    return f"greatest({fixed.BRAND_SCORE_FLOOR}e0, least(100e0, greatest(0e0, {scaled})))"


def rule_rate() -> str:
    """Known-rule rate from feature columns."""
    low, high = fixed.RULE_LENGTH_RANGE
    weights = " + ".join(f"({w}e0) * {name}" for name, w in fixed.RULE_WEIGHTS.items())
    outside = f"(greatest(0, {low} - char_count) / {low}e0 + greatest(0, char_count - {high}) / {high}e0)"
    least, most = fixed.RULE_CTR_RANGE
    return (f"least({most}e0, greatest({least}e0, exp({fixed.RULE_INTERCEPT}e0 + {weights} + "
            f"({fixed.RULE_LENGTH_WEIGHT}e0) * {outside})))")


CLEAN = [
    ("shown", """
        select *, cast(likes_count + shares_count + comments_count as double) / impressions * 100 as ctr
        from {posts} where language in ('en') and impressions > 0"""),
    ("cut", "select quantile_cont(ctr, 0.99) as p99 from shown"),
    ("clean", """
        select shown.* exclude (ctr), least(ctr, p99) as ctr_proxy from shown, cut
        where sentiment_score is not null and toxicity_score is not null"""),
]
