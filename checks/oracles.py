"""DuckDB SQL with the expected result of each registered query."""

from __future__ import annotations

from adlumen.functions import fixed_values as fixed
from checks import sql_features as sf
from checks.queries import (
    AUC_SCORE, BRANDS, CUSTOM_TERMS, FALLBACK_PRIMARIES, TEXT_LIMIT,
)
from checks.views import duck

POST_FEATURES = sf.feature_ctes("{posts}", "post_id", "text_content")
CLEAN_FEATURES = [*sf.CLEAN, *sf.feature_ctes("clean", "post_id", "text_content"),
                  ("rows", """select c.*, f.* exclude (post_id) from clean c join feats f on f.post_id = c.post_id""")]
SIMILARITY = "list_cosine_similarity(cast(t.text_vec as double[]), cast(r.ref_vec as double[]))"
BEST = ("best", f"""
    select t.text_id, t.source_brand, r.brand_id, max({SIMILARITY}) as similarity
    from {{text_vecs}} t, {{brand_refs}} r group by all""")
SCORES = [BEST, ("scores", f"select *, {sf.brand_score('similarity', 0.0)} as score from best")]
PREDICTED = [*SCORES, ("predicted", """
    select text_id, source_brand, brand_id as predicted_brand from
    (select *, row_number() over (partition by text_id order by score desc, brand_id) as rn from scores) x where rn = 1""")]
OUTCOME = [*PREDICTED, ("judged", """
    select p.text_id, p.predicted_brand, l.human_label,
           lower(trim(case when (select bool_or(trim(human_label) <> '') from {eval_labels}) then l.human_label
                           else p.source_brand end)) as truth
    from predicted p join {eval_labels} l on l.text_id = p.text_id"""),
    ("outcome", """
    select j.text_id, s.score as own_score, cast(j.predicted_brand = j.truth as integer) as is_correct
    from judged j join scores s on s.text_id = j.text_id and s.brand_id = j.truth""")]


def auc_ctes(source: str, score: str, label: str):
    return [
        ("auc_counts", f"""select {score} as score, count(*) filter (where {label} = 1) as pos,
            count(*) filter (where {label} <> 1) as neg from {source} group by 1"""),
        ("auc_running", "select *, sum(neg) over (order by score) - neg as below from auc_counts"),
        ("auc", """select cast(sum(pos * (below + neg / 2e0)) as double) / (sum(pos) * sum(neg)) as auc from auc_running"""),
    ]


COMPOSITE = f"""
    select *, {sf.benchmark('ctr_score')} as ctr_normalized, least(100e0, greatest(0e0, brand_score)) as brand_normalized
    from {{variants}}"""
SHOWN_SCORES = [
    ("normed", COMPOSITE),
    ("shown_parts", f"select *, {sf.rounded('ctr_normalized', 1)} as ctr_benchmark, {sf.rounded('brand_score', 1)} as brand_scaled from normed"),
    ("blends", "select *, 0.6e0 * ctr_benchmark + (1e0 - 0.6e0) * brand_scaled as blend from shown_parts"),
    ("batch", f"select *, {sf.rounded('blend', 1)} as composite_score from blends"),
]
MEDIANS = ("medians", "select request_id, median(ctr_score) as ctr_median, count(*) as n from {variants} group by request_id")
GATED = [MEDIANS, ("gated", """
    select v.*, m.ctr_median, (v.brand_score < 70 and v.ctr_score > m.ctr_median) as is_candidate
    from {variants} v join medians m on m.request_id = v.request_id""")]


def rounds_ctes(source: str, rewrites: str = "{rewrites}"):
    """CTE ``state``: best text and score per candidate after two rounds."""
    ctes = [("state0", f"""select variant_id, text as best_text, brand_score as best_score, 0 as attempts, false as stopped
                           from {source} where is_candidate""")]
    for i in (1, 2):
        ctes.append((f"state{i}", f"""
            select s.variant_id,
              case when not s.stopped and r.error is null and r.brand_score > s.best_score then r.text else s.best_text end as best_text,
              case when not s.stopped and r.error is null and r.brand_score > s.best_score then r.brand_score else s.best_score end as best_score,
              s.attempts + case when s.stopped then 0 else 1 end as attempts,
              s.stopped or r.error is not null or r.brand_score is null or
                (case when r.error is null and r.brand_score > s.best_score then r.brand_score else s.best_score end) >= 70 as stopped
            from state{i - 1} s left join {rewrites} r on r.variant_id = s.variant_id and r.attempt = {i}"""))
    return ctes


def md5_bucket(key: str, n: int, seed: int = 42) -> str:
    return f"cast({md5_number(key, seed)} % {n} as integer)"


def md5_number(key: str, seed: int = 42) -> str:
    return f"cast('0x' || substr(md5(cast({key} as varchar) || '|{seed}'), 1, 8) as bigint)"


def error_case(message: str, out: str, otherwise: str) -> str:
    arms = []
    for name, marks, text in fixed.ERROR_CLASSES:
        test = " or ".join(f"contains(lower({message}), '{m}')" for m in marks)
        arms.append(f"when {test} then '" + (name if out == "class" else text.replace("'", "''")) + "'")
    return f"case {' '.join(arms)} else {otherwise} end"


TRANSIENT = "(" + " or ".join(f"contains(lower(message), '{m}')" for m in fixed.TRANSIENT_MARKS) + " or starts_with(message, '5'))"

# Brand forms parsed as the catalog does it.
FORMS = ("forms", f"""
    select form_ord, trim(brand_id) as brand_id, trim(brand_name) as brand_name,
      case when trim(tone_category) = '' then '{fixed.DEFAULT_TONE}' else trim(tone_category) end as tone_category,
      trim(brand_voice_summary) as brand_voice_summary,
      case when trim(style_rules) = '' then ['{fixed.DEFAULT_STYLE_RULES[0]}']
           else list_filter(list_transform(string_split(style_rules, chr(10)), lambda x: trim(x)), lambda x: x <> '') end as style_rules,
      list_filter(list_transform(string_split(preferred_vocabulary, ','), lambda x: trim(x)), lambda x: x <> '') as preferred_vocabulary,
      list_filter(list_transform(string_split(forbidden_vocabulary, ','), lambda x: trim(x)), lambda x: x <> '') as forbidden_vocabulary,
      list_filter(list_transform(string_split(reference_ad_copies, chr(10)), lambda x: trim(x)), lambda x: x <> '') as reference_ad_copies
    from {{brand_forms}}""")
ACCEPTED = ("accepted", "select * from forms where brand_id <> '' and len(reference_ad_copies) > 0")
RULE_PARTS = [FORMS, ("checked", """
    select v.variant_id, f.preferred_vocabulary as pref,
      list_filter(f.preferred_vocabulary, lambda x: contains(lower(v.text), x)) as pref_hits,
      list_filter(f.forbidden_vocabulary, lambda x: contains(lower(v.text), x)) as bad_hits
    from {variants} v join forms f on f.brand_id = v.brand_id""")]
MISSING = "(len(pref) > 0 and len(pref_hits) = 0)"
VIOLATIONS = (f"list_filter([case when {MISSING} then 'Missing preferred vocabulary: ' || array_to_string(pref, ', ') end, "
              "case when len(bad_hits) > 0 then 'Contains forbidden language: ' || array_to_string(bad_hits, ', ') end], "
              "lambda x: x is not null)")


def bullet_refs(n: int):
    return (f"refs{n}", f"""select brand_id, string_agg('- ' || ref_text, chr(10) order by ref_ord) as refs
                            from {{ref_texts}} where ref_ord <= {n} group by brand_id""")


def template(text: str, values: dict[str, str]) -> str:
    """SQL concatenation for a prompt template."""
    out, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [_lit(before), f"coalesce({values[name]}, '')"]
    return " || ".join([*out, _lit(rest)])


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def style_case(texts: dict[str, str]) -> str:
    return "case style " + " ".join(f"when '{k}' then {_lit(v)}" for k, v in texts.items()) + " end"


STYLED = ("styled", "select q.*, s.style, cast(s.style_ord as integer) as style_ord from {requests} q, (values "
          + ", ".join(f"('{s}', {i})" for i, s in enumerate(fixed.STYLES)) + ") s(style, style_ord)")
RULE_LINES = "list_aggregate(list_transform(f.style_rules, lambda x: '- ' || x), 'string_agg', chr(10))"

# Campaign: generated variants scored by the known rule and by vectors, corrected, rescored and ranked.
VECTOR_SCORES = ("vec_scores", f"""
    select e.vec_id, r.brand_id, {sf.brand_score('max(list_cosine_similarity(cast(e.embedding as double[]), cast(r.ref_vec as double[])))', 0.0)} as score
    from {{embeddings}} e, {{brand_refs}} r group by all""")


def rule_ctes(source: str, key: str, text: str, out: str):
    return [
        *sf.feature_ctes(source, key, text, out=f"{out}_f"),
        *sf.affect_ctes(source, key, text, out=f"{out}_a"),
        (out, f"""select f.{key}, {sf.rule_rate()} as rate from {out}_f f join {out}_a a on a.{key} = f.{key}"""),
    ]


CAMPAIGN = [
    ("usable", "select * from {generated} where text is not null and text <> ''"),
    *rule_ctes("usable", "variant_id", "text", "first_rate"),
    VECTOR_SCORES,
    ("scored", """
        select u.*, fr.rate as ctr_score, vs.score as brand_score
        from usable u join first_rate fr on fr.variant_id = u.variant_id
        left join vec_scores vs on vs.brand_id = u.brand_id
          and vs.vec_id = u.variant_id % (select count(*) from {embeddings})"""),
    ("medians", "select request_id, median(ctr_score) as ctr_median from scored group by request_id"),
    ("gated", """select s.*, (s.brand_score < 70 and s.ctr_score > m.ctr_median) as is_candidate
                 from scored s join medians m on m.request_id = s.request_id"""),
    *rounds_ctes("gated"),
    *rule_ctes("state2", "variant_id", "best_text", "final_rate"),
    ("results", """
        select g.request_id, g.variant_id, g.variant_ord, g.brand_id, g.style, g.text as original_text,
          coalesce(s.best_text, g.text) as final_text, g.brand_score as original_brand_score,
          coalesce(s.best_score, g.brand_score) as final_brand_score, coalesce(fr.rate, g.ctr_score) as ctr_score,
          s.variant_id is not null as corrected, coalesce(s.attempts, 0) as attempts,
          s.variant_id is not null and s.best_score < 70 as needs_human_review,
          coalesce(s.best_score, g.brand_score) - g.brand_score as alignment_uplift,
          coalesce(fr.rate, g.ctr_score) - g.ctr_score as ctr_delta
        from gated g left join state2 s on s.variant_id = g.variant_id
        left join final_rate fr on fr.variant_id = g.variant_id"""),
    ("c_norm", f"select *, {sf.benchmark('ctr_score')} as ctr_normalized from results"),
    ("c_parts", f"""select *, {sf.rounded('ctr_normalized', 1)} as ctr_benchmark,
                    {sf.rounded('final_brand_score', 1)} as brand_scaled from c_norm"""),
    ("c_blend", "select *, 0.6e0 * ctr_benchmark + (1e0 - 0.6e0) * brand_scaled as blend from c_parts"),
    ("c_score", f"select *, {sf.rounded('blend', 1)} as composite_score from c_blend"),
]

_PAIRS = [(a, b) for a in fixed.CORRELATION_COLUMNS for b in fixed.CORRELATION_COLUMNS]


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}

    # --- cleaning ---------------------------------------------------------------------------
    o["clean_posts"] = duck("""select post_id, language, impressions, sentiment_score, toxicity_score,
        round(ctr_proxy, 6) as ctr_proxy from clean""", *sf.CLEAN)
    o["ctr_proxy"] = duck("""select post_id, round(case when impressions = 0 then null
        else cast(likes_count + shares_count + comments_count as double) / impressions * 100 end, 6) as ctr_proxy from {posts}""")
    o["winsorize_p99"] = duck("select post_id, round(least(ctr, p99), 6) as ctr_proxy from shown, cut", *sf.CLEAN[:2])
    o["trim_p99"] = duck("select post_id, round(ctr, 6) as ctr_proxy from shown, cut where ctr <= p99", *sf.CLEAN[:2])
    o["clean_funnel"] = duck("""
        select count(*) as n_total, count(*) filter (where language = 'en') as n_language,
          count(*) filter (where language = 'en' and impressions > 0) as n_shown,
          round((select p99 from cut), 6) as clip_value,
          (select count(*) from shown, cut where ctr >= p99) as n_at_limit,
          count(*) filter (where language = 'en' and impressions > 0 and sentiment_score is not null
                           and toxicity_score is not null) as n_final
        from {posts}""", *sf.CLEAN[:2])
    o["log_features"] = duck("""select post_id, round(ln(1e0 + impressions), 6) as log_impressions,
        round(ln(1e0 + ctr_proxy), 6) as log_ctr, round(exp(ln(1e0 + ctr_proxy)) - 1, 6) as ctr_back from clean""", *sf.CLEAN)

    # --- text and affect --------------------------------------------------------------------
    o["text_features"] = duck("select * from feats", *POST_FEATURES)
    o["urgency_custom"] = duck(f"""select post_id, cast({sf.term_count('text_content', CUSTOM_TERMS)} as integer) as urgency_count,
        cast({sf.term_count('text_content', CUSTOM_TERMS)} > 0 as integer) as has_cta from {{posts}}""")
    o["normalize_text"] = duck(f"""
        select post_id, case when length(t) > {TEXT_LIMIT}
                             then rtrim(substr(t, 1, {TEXT_LIMIT})) || case when wish then '!' else '' end else t end as text
        from (select post_id, wish, case when not wish then t when regexp_replace(t, '[!.]$', '!') = '' then t || '!'
                                         else regexp_replace(t, '[!.]$', '!') end as t
              from (select post_id, contains(text_content, '!') as wish,
                           trim(regexp_replace(text_content, '{sf.BLANKS}+', ' ', 'g')) as t from {{posts}}) a) b""")
    o["is_turkish"] = duck(f"select post_id, {sf.turkish('text_content')} as is_turkish from {{posts}}")
    compounds = sf.compound_ctes("{posts}", "post_id", "text_content")
    o["sentiment_en"] = duck("""select p.post_id, round(coalesce(c.compound, 0e0), 6) as compound from {posts} p
        left join affect_en c on c.post_id = p.post_id""", *compounds)
    o["sentiment_tr"] = duck("""select p.post_id, round(coalesce(c.compound, 0e0), 6) as compound from {posts} p
        left join affect_tr c on c.post_id = p.post_id""", *compounds)
    custom = sf.compound_ctes(
        "{documents}", "doc_id", "text", (["the", "de"], ["of", "der"], ["is", "la"]), (["der", "le"], ["die"], ["und", "la"]))
    o["sentiment_custom"] = duck("""select d.doc_id, round(coalesce(e.compound, 0e0), 6) as english,
        round(coalesce(t.compound, 0e0), 6) as turkish from {documents} d
        left join affect_en e on e.doc_id = d.doc_id left join affect_tr t on t.doc_id = d.doc_id""", *custom)
    sums = ", ".join(f"cast(coalesce(sum(case when event_type = '{kind}' then floor(coalesce(value, 0)) end), 0) as bigint) as {name}"
                     for name, kind in (("likes", "click"), ("shares", "signup"), ("comments", "purchase")))
    o["engagement_windows"] = duck(
        """select strftime(start, '%Y-%m-%d %H:%M') as window_start, impressions, likes, shares, comments, n_events,
        round((likes + shares + comments) * 100e0 / nullif(impressions, 0), 6) as engagement_rate from sums""",
        ("sums", f"""select time_bucket(interval '10 minutes', ts, timestamp '2000-01-01') as start, {sums}, count(*) as n_events,
            cast(count(*) filter (where event_type = 'view') * 100 as bigint) as impressions
            from {{events}} where ts is not null group by 1"""))
    words = "select distinct term from (select unnest(regexp_extract_all(lower(text), '[a-z'']+')) as term from {benchmark}) b"
    o["lexicon_sentiment"] = duck("""select d.doc_id, round(coalesce(c.compound, 0e0), 6) as compound from {documents} d
        left join (select doc_id, cast(sum(case when previous = 0 then -mark else mark end) as double) / count(*) as compound
                   from hits where mark <> 0 group by doc_id) c on c.doc_id = d.doc_id""",
        ("marks", f"select term, case length(term) % 3 when 2 then 0 when 0 then 1 else -1 end as mark from ({words}) w"),
        ("tokens", """select doc_id, unnest(toks) as term, unnest(range(1, len(toks) + 1)) as i
            from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') as toks from {documents}) s"""),
        ("hits", """select doc_id, mark, lag(mark) over (partition by doc_id order by i) as previous
            from tokens join marks using (term)"""))
    o["lexicon_hits"] = duck(f"""select d.doc_id, cast(count(w.term) as integer) as n_terms from {{documents}} d
        left join ({words}) w on length(w.term) >= 4 and contains(lower(d.text), w.term) group by d.doc_id""")
    affect = sf.affect_ctes("{posts}", "post_id", "text_content")
    o["sentiment_score"] = duck("select post_id, round(sentiment_score, 6) as sentiment_score from affect", *affect)
    o["toxicity_score"] = duck("select post_id, round(toxicity_score, 6) as toxicity_score from affect", *affect)

    # --- engagement statistics --------------------------------------------------------------
    o["ctr_by_feature"] = duck("""
        select feature, v.value, round(coalesce(avg(ctr_proxy), 0e0), 6) as mean_ctr, count(ctr_proxy) as n
        from (values ('has_question', 0), ('has_question', 1), ('has_urgency', 0), ('has_urgency', 1)) v(feature, value)
        left join rows on v.value = case v.feature when 'has_question' then has_question else has_urgency end
        group by feature, v.value""", *CLEAN_FEATURES)
    o["ols_trend"] = duck("""select round(regr_slope(ctr_proxy, word_count), 6) as slope,
        round(regr_intercept(ctr_proxy, word_count), 6) as intercept from rows""", *CLEAN_FEATURES)
    o["ols_trend_line"] = duck("""
        select cast(step as integer) as step, round(x, 6) as x, round(slope * x + intercept, 6) as y from
        (select step, slope, intercept, low + step * ((high - low) / 99e0) as x from
          (select regr_slope(ctr_proxy, word_count) as slope, regr_intercept(ctr_proxy, word_count) as intercept,
                  min(word_count) as low, max(word_count) as high from rows) f, (select unnest(range(0, 100)) as step) s) p""",
        *CLEAN_FEATURES)
    o["corr_matrix"] = duck(" union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, round(case when isnan(c{i}) then null else c{i} end, 6) as r from corrs"
        for i, (a, b) in enumerate(_PAIRS)), *CLEAN_FEATURES,
        ("corrs", "select " + ", ".join(f"corr({a}, {b}) as c{i}" for i, (a, b) in enumerate(_PAIRS)) + " from rows"))
    o["summary_stats"] = duck("""select count(*) as n, round(avg(ctr_proxy), 6) as mean_ctr, round(avg(word_count), 6) as mean_words,
        round(median(ctr_proxy), 6) as median_ctr from rows""", *CLEAN_FEATURES)
    o["union_langs"] = duck("""select language, count(*) as n, sum(length(text_content))::bigint as n_chars from {posts}
        where language in ('en', 'fr', 'de', 'es') group by language""")

    # --- brand alignment --------------------------------------------------------------------
    o["cosine_sim"] = duck(f"""select t.text_id, r.brand_id, round({SIMILARITY}, 4) as similarity
        from {{text_vecs}} t join {{brand_refs}} r on r.brand_id = t.source_brand where r.ref_ord = 1""")
    o["brand_score"] = duck("select text_id, source_brand, round(score, 4) as brand_score from scores where brand_id = source_brand", *SCORES)
    o["brand_score_default"] = duck(f"""select text_id, source_brand, round({sf.brand_score('similarity', fixed.OFFBRAND_BASELINE)}, 4) as brand_score
        from best where brand_id = source_brand""", BEST)
    o["brand_score_matrix"] = duck("select text_id, brand_id, round(score, 4) as score from scores", *SCORES)
    o["predict_brand"] = duck("select text_id, predicted_brand, predicted_brand = source_brand as correct from predicted", *PREDICTED)
    own_cross = [*SCORES, ("proof", """
        select text_id, source_brand, max(case when brand_id = source_brand then score end) as own_score,
               max(case when brand_id <> source_brand then score end) as max_cross_score,
               bool_and(score > 0) as positive from scores group by all""")]
    pivot = ", ".join(f"max(case when s.brand_id = '{b}' then {sf.rounded('s.score', 2)} end) as score_{b}" for b in BRANDS)
    o["brand_proof"] = duck(f"""
        select p.text_id, p.source_brand, {pivot}, max({sf.rounded('p.own_score', 2)}) as own_score,
               max({sf.rounded('p.max_cross_score', 2)}) as max_cross_score,
               bool_or(p.own_score > p.max_cross_score) as own_higher_than_cross
        from proof p join scores s on s.text_id = p.text_id group by p.text_id, p.source_brand""", *own_cross)
    o["brand_proof_failures"] = duck("""
        select text_id, 'own_score <= 0' as reason from proof where own_score <= 0
        union all select text_id, 'own not higher than cross' from proof where not own_score > max_cross_score""", *own_cross)
    o["brand_proof_summary"] = duck("""select count(*) as n, count(*) filter (where own_score > max_cross_score) as n_own_higher,
        bool_and(positive) as all_positive from proof""", *own_cross)
    ref_best = ("ref_best", """
        select a.brand_id as own_brand, a.ref_ord, b.brand_id,
               max(list_cosine_similarity(cast(a.ref_vec as double[]), cast(b.ref_vec as double[]))) as similarity
        from {brand_refs} a, {brand_refs} b group by all""")
    o["validate_alignment"] = duck(f"""
        select brand_id, round(own_mean, 4) as own_mean, round(cross_mean, 4) as cross_mean, own_mean > cross_mean as own_higher from
        (select own_brand as brand_id, avg(case when own_brand = brand_id and ref_ord <= 3 then score end) as own_mean,
                avg(case when own_brand <> brand_id and ref_ord <= 2 then score end) as cross_mean
         from (select *, {sf.brand_score('similarity', 0.0)} as score from ref_best) x group by own_brand) y""", ref_best)
    o["offbrand_baseline"] = duck("select round(avg(similarity), 6) as baseline from ref_best where brand_id <> own_brand", ref_best)

    # --- rules ------------------------------------------------------------------------------
    o["rule_check"] = duck(f"""
        select variant_id, array_to_string(violations, ' | ') as violations, len(violations) = 0 as passed,
               cast(len(violations) * 5 as integer) as rule_penalty
        from (select variant_id, {VIOLATIONS} as violations from checked) c""", *RULE_PARTS)
    o["rule_ctr"] = duck(f"""select f.post_id, round({sf.rule_rate()}, 6) as rule_ctr from feats f
        join affect a on a.post_id = f.post_id""", *POST_FEATURES, *affect)
    o["engagement_split"] = duck("""
        select post_id, greatest(impressions, 100) as impressions,
          cast(round_even(0.55e0 * total, 0) as bigint) as likes_count, cast(round_even(0.25e0 * total, 0) as bigint) as shares_count,
          cast(round_even(0.2e0 * total, 0) as bigint) as comments_count
        from (select post_id, impressions, ctr_proxy / 100e0 * greatest(impressions, 100) as total from clean) c""", *sf.CLEAN)

    # --- composite and ranking --------------------------------------------------------------
    o["ctr_benchmark"] = duck(f"select variant_id, round({sf.benchmark('ctr_score')}, 6) as ctr_benchmark from {{variants}}")
    o["composite_basic"] = duck("""select variant_id, round(ctr_normalized, 6) as ctr_normalized, brand_normalized,
        round(0.6e0 * ctr_normalized + (1e0 - 0.6e0) * brand_normalized, 6) as composite_score from normed""", ("normed", COMPOSITE))
    o["composite_given"] = duck(f"""
        select variant_id, round(b, 6) as ctr_normalized, n as brand_normalized, round(0.2e0 * b + (1e0 - 0.2e0) * n, 6) as composite_score
        from (select variant_id, {sf.benchmark('coalesce(g, ctr_score)')} as b, least(100e0, greatest(0e0, brand_score)) as n
              from (select *, case when impressions = 0 then 12e0 end as g from {{variants}}) v) x""")
    o["score_batch"] = duck("""select variant_id, style, false as needs_human_review, ctr_benchmark, ctr_benchmark as ctr_scaled,
        brand_scaled, composite_score from batch""", *SHOWN_SCORES)
    o["rank_variants"] = duck("""select request_id, variant_id, composite_score, cast(row_number() over
        (partition by request_id order by composite_score desc, variant_ord) as integer) as rank from batch""", *SHOWN_SCORES)
    o["rank_by_source"] = duck("""select post_id, rank from (select d.doc_id as post_id, cast(row_number() over
        (partition by d.source order by p.impressions desc, d.doc_id) as integer) as rank
        from {documents} d join {posts} p on p.post_id = d.doc_id) x""")
    o["soft_scale"] = duck("""
        select variant_id, round(case when hi - lo < 1e-9 then 52.5e0
               else floor_ + (ctr_score - lo) / (hi - lo) * (ceil_ - floor_) end, 6) as soft_score
        from (select *, min(ctr_score) over w as lo, max(ctr_score) over w as hi,
                case when count(*) over w <= 2 then 20e0 when count(*) over w = 3 then 15e0 else 10e0 end as floor_,
                case when count(*) over w <= 2 then 85e0 when count(*) over w = 3 then 90e0 else 95e0 end as ceil_
              from made window w as (partition by request_id)) x""",
        ("made", "select v.* from {variants} v join {generated} g on g.variant_id = v.variant_id where g.text is not null"))
    o["request_median"] = duck("select request_id, round(ctr_median, 6) as ctr_median, n from medians", MEDIANS)
    o["correction_candidates"] = duck("select variant_id, round(ctr_median, 6) as ctr_median, is_candidate from gated", *GATED)

    # --- evaluation -------------------------------------------------------------------------
    o["eval_truth"] = duck("select text_id, truth from judged", *OUTCOME)
    o["human_eval_metrics"] = duck("""
        select count(*) as n, (select count(*) from judged) - count(*) as n_unjudged, round(avg(cast(is_correct as double)), 6) as accuracy, round(corr(own_score, is_correct), 6) as correlation,
          round(avg(case when is_correct = 1 then own_score end), 6) as mean_correct,
          round(avg(case when is_correct = 0 then own_score end), 6) as mean_wrong, round((select auc from auc), 6) as auc
        from outcome""", *OUTCOME, *auc_ctes("outcome", "own_score", "is_correct"))
    o["roc_auc"] = duck("select round(auc, 6) as auc from auc", *sf.CLEAN,
                        *auc_ctes("(select * from clean) c", AUC_SCORE, "cast(toxicity_score as integer)"))
    fit = [*sf.CLEAN, ("logs", """select post_id, ctr_proxy, ln(1e0 + impressions) as x, ln(1e0 + ctr_proxy) as y from clean"""),
           ("line", "select regr_slope(y, x) as a, regr_intercept(y, x) as b from logs")]
    o["regression_metrics"] = duck("""
        select round(1 - sum((ctr_proxy - p) * (ctr_proxy - p)) / regr_syy(ctr_proxy, ctr_proxy), 6) as r2,
               round(sqrt(avg((ctr_proxy - p) * (ctr_proxy - p))), 6) as rmse, round(avg(abs(ctr_proxy - p)), 6) as mae
        from (select ctr_proxy, exp(a * x + b) - 1 as p from logs, line) z""", *fit)
    folds = [*fit[:-1], ("folded", f"select *, {md5_bucket('post_id', 5, 7)} as fold from logs"),
             ("lines", """select k.fold, regr_slope(r.y, r.x) as a, regr_intercept(r.y, r.x) as b
                          from (select distinct fold from folded) k join folded r on r.fold <> k.fold group by k.fold"""),
             ("fold_r2", """select f.fold, 1 - sum((y - a * x - b) * (y - a * x - b)) / regr_syy(y, y) as r2
                            from folded f join lines l on l.fold = f.fold group by f.fold""")]
    o["cv_r2"] = duck("select round(avg(r2), 6) as cv_mean, round(stddev_pop(r2), 6) as cv_std from fold_r2", *folds)
    o["best_subset"] = duck("""select fold, round(r2, 6) as r2 from fold_r2 order by r2 desc, fold limit 1""", *folds)
    o["train_test_split"] = duck(f"""select post_id, {md5_bucket('post_id', 100)} < 20 as is_test,
        {md5_bucket('post_id', 5, 7)} as fold from {{posts}}""")
    o["seeded_sample"] = duck(f"select post_id, language from {{posts}} order by {md5_number('post_id')}, post_id limit 4")

    # --- catalog ----------------------------------------------------------------------------
    listed = "array_to_string({0}, '|') as {0}".format
    lists = ", ".join(listed(c) for c in ("style_rules", "preferred_vocabulary", "forbidden_vocabulary", "reference_ad_copies"))
    o["brand_catalog"] = duck("""
        select 'n' || cast(s_nationkey as varchar) as brand_id, max_by(s_name, s_suppkey) as brand_name, max(s_suppkey) as position
        from {supplier} group by s_nationkey""")
    o["brand_refs_topn"] = duck("select brand_id, string_agg(ref_text, ' || ' order by ref_ord) as texts from {ref_texts} where ref_ord <= 2 group by brand_id")
    o["brand_lookup"] = duck("""select v.variant_id, f.brand_name, f.tone_category from {variants} v join accepted f on f.brand_id = v.brand_id""", FORMS, ACCEPTED)
    o["unknown_brands"] = duck("""select v.brand_id, count(*) as n from {variants} v where not exists
        (select 1 from accepted f where f.brand_id = v.brand_id) group by v.brand_id""", FORMS, ACCEPTED)
    base_catalog = ("old", """select 'b' || cast(n_nationkey as varchar) as brand_id, n_name as brand_name, 'Old' as tone_category,
        '' as brand_voice_summary, ['old'] as style_rules, ['a'] as preferred_vocabulary, cast([] as varchar[]) as forbidden_vocabulary,
        [n_name] as reference_ad_copies from {nation}""")
    names = "brand_id, brand_name, tone_category, brand_voice_summary, style_rules, preferred_vocabulary, forbidden_vocabulary, reference_ad_copies"
    o["upsert_brands"] = duck(f"""select brand_id, brand_name, tone_category, brand_voice_summary, {lists} from
        (select {names} from accepted union all select {names} from old where brand_id not in (select brand_id from accepted)) m""",
        FORMS, ACCEPTED, base_catalog)
    o["rejected_brands"] = duck("""select form_ord, case when brand_id = '' or brand_name = '' then 'id and name are required'
        else 'references are required' end as reject_reason from forms
        where brand_id = '' or brand_name = '' or len(reference_ad_copies) = 0""", FORMS)
    chain = "[" + ", ".join(f"'{m}'" for m in fixed.FALLBACK_MODELS) + "]"
    prim = f"(['{FALLBACK_PRIMARIES[0]}', '{FALLBACK_PRIMARIES[1]}', '{FALLBACK_PRIMARIES[2]}'])[cast(request_id % 3 as integer) + 1]"
    o["fallback_chain"] = duck(f"""select request_id, array_to_string([p] || list_filter({chain}, lambda x: x <> p), ',') as models
        from (select request_id, {prim} as p from {{requests}}) r""")
    labels = "case style " + " ".join(f"when '{k}' then '{v}'" for k, v in list(fixed.STYLE_LABELS.items())[:3]) + " else style end"
    o["label_lookup"] = duck(f"select variant_id, {labels} as label from {{variants}}")

    # --- generation -------------------------------------------------------------------------
    o["expand_styles"] = duck("select request_id, brand_id, style, style_ord from styled", STYLED)
    o["build_prompts"] = duck(f"""
        select s.request_id, s.style, case when f.brand_id is not null then {template(fixed.GENERATION_TEMPLATE, {
            'system': _lit(fixed.GENERATION_SYSTEM), 'brand_name': 'f.brand_name', 'tone_category': 'f.tone_category',
            'brand_voice_summary': 'f.brand_voice_summary', 'style_rules': RULE_LINES, 'references': 'r.refs',
            'never_write': _lit(chr(10).join('- ' + n for n in fixed.NEVER_WRITE)), 'product': 's.product', 'audience': 's.audience',
            'style': 's.style', 'style_task': style_case(fixed.STYLE_TASKS), 'style_hint': style_case(fixed.STYLE_HINTS)})} end as prompt
        from styled s left join accepted f on f.brand_id = s.brand_id left join refs5 r on r.brand_id = s.brand_id""",
        STYLED, FORMS, ACCEPTED, bullet_refs(5))
    o["build_rewrite_prompts"] = duck(f"""
        select g.variant_id, {template(fixed.REWRITE_TEMPLATE, {
            'system': _lit(fixed.REWRITE_SYSTEM), 'brand_name': 'f.brand_name', 'tone_category': 'f.tone_category',
            'brand_voice_summary': 'f.brand_voice_summary', 'style_rules': RULE_LINES, 'references': 'r.refs', 'text': 'g.text',
            'score': f"printf('%.1f', {sf.rounded('g.brand_score', 1)})", 'threshold': "'70'",
            'violation_note': f"(case when len(v.violations) > 0 then 'Specific violations: ' || array_to_string(v.violations, '; ') else {_lit(fixed.SEMANTIC_NOTE)} end)"})} as prompt
        from gated g join (select variant_id, {VIOLATIONS} as violations from checked) v on v.variant_id = g.variant_id
        join accepted f on f.brand_id = g.brand_id left join refs3 r on r.brand_id = g.brand_id where g.is_candidate""",
        *GATED, *RULE_PARTS, ACCEPTED, bullet_refs(3))
    o["cache_key"] = duck("select variant_id, sha256('model-a' || chr(10) || text) as cache_key from {variants}")
    key = "sha256(model || chr(10) || prompt)"
    cached = ("cached", f"select {key} as cache_key, max_by(text, struct_pack(a := created_at, b := text)) as text from {{cache_rows}} group by 1")
    o["cache_hits"] = duck("""select variant_id from {variants} v where sha256('model-a' || chr(10) || v.text) in (select cache_key from cached)""", cached)
    o["cache_misses"] = duck("""select variant_id from {variants} v where sha256('model-a' || chr(10) || v.text) not in (select cache_key from cached)""", cached)
    o["cache_upsert"] = duck(f"""select cache_key, text from fresh union all
        select cache_key, text from cached where cache_key not in (select cache_key from fresh)""", cached,
        ("fresh", f"""select {key} as cache_key, arg_max(text, (coalesce(created_at, timestamp '1900-01-01'), text)) as text from {{fresh_rows}} group by 1"""))
    o["split_generation_errors"] = duck("""
        select request_id, count(*) filter (where text is not null) as n_ok, count(*) filter (where error is not null) as n_failed,
          min_by(error, variant_ord) filter (where error is not null) as first_error,
          count(*) filter (where text is not null) = 0 as all_failed from {generated} group by request_id""")
    o["classify_errors"] = duck(f"""
        select variant_id, {error_case('message', 'class', "'other'")} as error_class, {error_case('message', 'text', 'message')} as error_text,
          {error_case('detail', 'text', 'detail')} as detail_text
        from (select *, case when contains(message, ':') then substr(message, instr(message, ':') + 1) else message end as detail
              from {{gen_errors}}) g""")
    o["is_transient"] = duck(f"select variant_id, {TRANSIENT} as is_transient from {{gen_errors}}")
    o["retry_schedule"] = duck(f"""select variant_id, cast(attempt as integer) as attempt,
        cast(case when {TRANSIENT} then 2 * pow(2, attempt) else 0 end as integer) as wait_seconds
        from {{gen_errors}}, (select unnest([0, 1, 2]) as attempt) a""")

    # --- corrections and campaign -----------------------------------------------------------
    o["apply_rewrites"] = duck("""
        select g.variant_id, coalesce(s.best_text, g.text) as final_text, coalesce(s.best_score, g.brand_score) as final_brand_score,
          s.variant_id is not null as corrected, coalesce(s.attempts, 0) as attempts,
          s.variant_id is not null and s.best_score < 70 as needs_human_review,
          round(coalesce(s.best_score, g.brand_score) - g.brand_score, 6) as alignment_uplift
        from gated g left join state2 s on s.variant_id = g.variant_id""", *GATED, *rounds_ctes("gated"))
    o["attach_corrections"] = duck("""
        select b.variant_id, b.composite_score, s.variant_id is not null as corrected, coalesce(s.attempts, 0) as attempts,
          round(coalesce(s.best_score - g.brand_score, 0e0), 6) as alignment_uplift, g.brand_score as original_brand_score,
          g.text as original_text
        from batch b join gated g on g.variant_id = b.variant_id left join state2 s on s.variant_id = b.variant_id""",
        *GATED, *rounds_ctes("gated"), *SHOWN_SCORES)
    o["campaign_run"] = duck("""
        select request_id, variant_id, style, final_text as text, ctr_benchmark, brand_scaled, composite_score, needs_human_review,
          corrected, attempts, round(alignment_uplift, 4) as alignment_uplift, round(ctr_delta, 6) as ctr_delta,
          cast(row_number() over (partition by request_id order by composite_score desc, variant_ord) as integer) as rank
        from c_score""", *CAMPAIGN)
    return o
