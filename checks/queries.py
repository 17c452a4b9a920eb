"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adlumen.functions import affect, errors, fixed_values as fixed, hashing, scoring, text as tx
from adlumen.functions.passages import passages
from adlumen.operators import (
    brand, catalog, clean, correct, eda, embed, evaluate, generate, lexicon, model, rank, rules,
)
from adlumen.operators.joins import lookup_join
from adlumen.plans import campaign, reports, training
from adlumen.session import checkpointed, set_local_shared_dir, shared_dir, ship_package
from adlumen.sources import cache
from adlumen.streaming import engagement
from checks.views import Inputs

BRANDS = [f"b{i}" for i in range(10)]
CUSTOM_TERMS = ["the", "de", "product", "great product"]
TEXT_LIMIT = 400
FALLBACK_PRIMARIES = [fixed.FALLBACK_MODELS[2], fixed.FALLBACK_MODELS[0], "other-model"]
AUC_SCORE = "ctr_proxy"
EN_WORDS = affect.SentimentLexicon(["the", "de"], ["of", "der"], ["is", "la"])
TR_WORDS = affect.SentimentLexicon(["der", "le"], ["die"], ["und", "la"], letters=affect.TURKISH.letters, negator_follows=True)
PUBLISHED = model.ModelSizes()
# Fewer and smaller trees than the published ones, for predict_ctr and model_roundtrip: see the README.
SMALL = model.ModelSizes(boosting_rounds=5, step=0.3, depth=3, forest_trees=5, parallelism=4)


def r(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    rounded = F.round(col, digits)
    return rounded.alias(name or column) if isinstance(name or column, str) else rounded


# --- cleaning -----------------------------------------------------------------------------------


def clean_posts(i: Inputs) -> DataFrame:
    return clean.clean_posts(i.posts).select(
        "post_id", "language", "impressions", "sentiment_score", "toxicity_score", r("ctr_proxy"))


def ctr_proxy(i: Inputs) -> DataFrame:
    return clean.with_ctr_proxy(i.posts).select("post_id", r("ctr_proxy"))


def winsorize_p99(i: Inputs) -> DataFrame:
    return clean.winsorized(clean.shown_posts(i.posts)).select("post_id", r("ctr_proxy"))


def trim_p99(i: Inputs) -> DataFrame:
    return clean.trimmed(clean.shown_posts(i.posts)).select("post_id", r("ctr_proxy"))


def clean_funnel(i: Inputs) -> DataFrame:
    return clean.clean_funnel(i.posts).withColumn("clip_value", r("clip_value"))


def log_features(i: Inputs) -> DataFrame:
    logs = clean.with_log_columns(clean.clean_posts(i.posts))
    return logs.select("post_id", r("log_impressions"), r("log_ctr"), r(F.expm1("log_ctr"), name="ctr_back"))


# --- text and affect ----------------------------------------------------------------------------


def text_features(i: Inputs) -> DataFrame:
    return tx.with_text_features(i.posts).select("post_id", *tx.TEXT_FEATURES)


def urgency_custom(i: Inputs) -> DataFrame:
    text = F.col("text_content")
    return i.posts.select(
        "post_id", tx.urgency_count(text, CUSTOM_TERMS).alias("urgency_count"), tx.has_phrase(text, CUSTOM_TERMS).alias("has_cta"))


def normalize_text(i: Inputs) -> DataFrame:
    text = F.col("text_content")
    return i.posts.select("post_id", tx.normalize_text(text, TEXT_LIMIT, F.contains(text, F.lit("!"))).alias("text"))


def is_turkish(i: Inputs) -> DataFrame:
    return i.posts.select("post_id", affect.is_turkish(F.col("text_content")).alias("is_turkish"))


def _compound(i: Inputs, lexicon: affect.SentimentLexicon) -> DataFrame:
    return affect.with_compound(i.posts.select("post_id", "text_content"), lexicon).select("post_id", r("compound"))


def sentiment_en(i: Inputs) -> DataFrame:
    return _compound(i, affect.ENGLISH)


def sentiment_tr(i: Inputs) -> DataFrame:
    return _compound(i, affect.TURKISH)


def sentiment_custom(i: Inputs) -> DataFrame:
    english = affect.with_compound(i.documents.select("doc_id", "text"), EN_WORDS, "text", "english")
    both = affect.with_compound(english, TR_WORDS, "text", "turkish")
    return both.select("doc_id", r("english"), r("turkish"))


def _benchmark_words(i: Inputs, least: int) -> DataFrame:
    words = i.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), 0)).alias("term")).distinct()
    return words.where(F.length("term") >= least)


def lexicon_sentiment(i: Inputs) -> DataFrame:
    """The words of the benchmark as a lexicon: their length says what they are."""
    mark = F.when(F.length("term") % 3 == 2, 0).when(F.length("term") % 3 == 0, 1).otherwise(-1)
    table = _benchmark_words(i, 1).withColumn("mark", mark)
    return lexicon.with_lexicon_compound(i.documents.select("doc_id", "text"), table, "text").select("doc_id", r("compound"))


def lexicon_hits(i: Inputs) -> DataFrame:
    texts = i.documents.select("doc_id", "text")
    return lexicon.with_term_hits(texts, _benchmark_words(i, 4), "text").select("doc_id", "n_terms")


def _affect(i: Inputs) -> DataFrame:
    return affect.with_affect(i.posts.select("post_id", "text_content"))


def sentiment_score(i: Inputs) -> DataFrame:
    return _affect(i).select("post_id", r("sentiment_score"))


def toxicity_score(i: Inputs) -> DataFrame:
    return _affect(i).select("post_id", r("toxicity_score"))


# --- engagement statistics ----------------------------------------------------------------------


def featured(i: Inputs) -> DataFrame:
    return training.featured_posts(i.posts)


def ctr_by_feature(i: Inputs) -> DataFrame:
    return eda.ctr_by_feature(featured(i)).withColumn("mean_ctr", r("mean_ctr"))


def engagement_windows(i: Inputs) -> DataFrame:
    windows = engagement.engagement_windows(i.events)
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start")
    return windows.select(start, "impressions", "likes", "shares", "comments", "n_events", r("engagement_rate"))


def ols_trend(i: Inputs) -> DataFrame:
    return eda.ols_trend(featured(i), "word_count", "ctr_proxy").select(r("slope"), r("intercept"))


def ols_trend_line(i: Inputs) -> DataFrame:
    return eda.ols_trend_line(featured(i), "word_count", "ctr_proxy").select("step", r("x"), r("y"))


def corr_matrix(i: Inputs) -> DataFrame:
    return eda.corr_matrix(featured(i)).withColumn("r", r("r"))


def summary_stats(i: Inputs) -> DataFrame:
    return eda.summary_stats(featured(i)).select("n", r("mean_ctr"), r("mean_words"), r("median_ctr"))


def union_langs(i: Inputs) -> DataFrame:
    parts = [i.posts.where(clean.in_languages([lang])) for lang in ("en", "fr", "de", "es")]
    return eda.union_all(parts).groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text_content")).alias("n_chars"))


# --- brand alignment ----------------------------------------------------------------------------


def all_scores(i: Inputs) -> DataFrame:
    return brand.with_all_scores(i.text_vecs, i.brand_refs, baseline=0.0)


def cosine_sim(i: Inputs) -> DataFrame:
    first = catalog.first_references(i.brand_refs, 1).withColumnRenamed("brand_id", "source_brand")
    pairs = lookup_join(i.text_vecs, first.select("source_brand", "ref_vec"), "source_brand", "inner")
    return pairs.select(
        "text_id", F.col("source_brand").alias("brand_id"),
        r(brand.cosine_similarity(F.col("text_vec"), F.col("ref_vec")), 4, "similarity"))


def _own_score(i: Inputs, baseline: float) -> DataFrame:
    scored = brand.with_brand_score(i.text_vecs, i.brand_refs, brand="source_brand", baseline=baseline)
    return scored.select("text_id", "source_brand", r("brand_score", 4))


def brand_score(i: Inputs) -> DataFrame:
    return _own_score(i, 0.0)


def brand_score_default(i: Inputs) -> DataFrame:
    return _own_score(i, fixed.OFFBRAND_BASELINE)


def brand_score_matrix(i: Inputs) -> DataFrame:
    return brand.score_matrix(all_scores(i), "text_id").select("text_id", "brand_id", r("score", 4))


def predict_brand(i: Inputs) -> DataFrame:
    return evaluate.human_eval_rows(all_scores(i), "text_id").select("text_id", "predicted_brand", "correct")


def brand_proof(i: Inputs) -> DataFrame:
    return reports.brand_proof_report(i.text_vecs, i.brand_refs, BRANDS, ["text_id", "source_brand"], baseline=0.0)


def brand_proof_failures(i: Inputs) -> DataFrame:
    return brand.proof_failures(brand.brand_proof(all_scores(i)), "text_id")


def brand_proof_summary(i: Inputs) -> DataFrame:
    return brand.proof_summary(brand.brand_proof(all_scores(i)))


def validate_alignment(i: Inputs) -> DataFrame:
    checked = brand.validate_alignment(i.brand_refs, baseline=0.0)
    return checked.withColumns({"own_mean": r("own_mean", 4), "cross_mean": r("cross_mean", 4)})


def offbrand_baseline(i: Inputs) -> DataFrame:
    return brand.offbrand_baseline(i.brand_refs).select(r("baseline"))


# --- rules --------------------------------------------------------------------------------------


def parsed_catalog(i: Inputs) -> DataFrame:
    return catalog.parsed_forms(i.brand_forms).drop("reject_reason")


def accepted_catalog(i: Inputs) -> DataFrame:
    forms = catalog.parsed_forms(i.brand_forms)
    return forms.where(F.col("reject_reason").isNull()).drop("reject_reason", "form_ord")


def rule_check(i: Inputs) -> DataFrame:
    vocabulary = parsed_catalog(i).select("brand_id", "preferred_vocabulary", "forbidden_vocabulary")
    joined = catalog.with_brand(i.variants, vocabulary)
    return rules.with_rule_check(joined).select(
        "variant_id", F.array_join("violations", " | ").alias("violations"), "passed", "rule_penalty")


def with_rule_rate(df: DataFrame, text: str = "text") -> DataFrame:
    """Click rate of the known rule for a text column, as ``ctr_score``."""
    near = df.withColumn("_near", passages(F.col(text), [*fixed.URGENCY_TERMS, *fixed.CTA_PHRASES]))
    featured_rows = affect.with_affect(tx.with_text_features(near, text, phrases="_near"), text, words="word_count")
    return featured_rows.withColumn("_rate", scoring.rule_ctr()).select(
        *[c for c in df.columns if c != "ctr_score"], F.col("_rate").alias("ctr_score"))


def rule_ctr(i: Inputs) -> DataFrame:
    rated = with_rule_rate(i.posts.select("post_id", "text_content"), "text_content")
    return rated.select("post_id", r("ctr_score", name="rule_ctr"))


def engagement_split(i: Inputs) -> DataFrame:
    parts = scoring.engagement_parts(F.col("ctr_proxy"), F.col("impressions"))
    return clean.clean_posts(i.posts).select("post_id", *[c.alias(n) for n, c in parts.items()])


# --- composite and ranking ----------------------------------------------------------------------


def ctr_benchmark(i: Inputs) -> DataFrame:
    return i.variants.select("variant_id", r(scoring.ctr_benchmark(F.col("ctr_score")), name="ctr_benchmark"))


def _composite(df: DataFrame) -> DataFrame:
    return df.select("variant_id", r("ctr_normalized"), "brand_normalized", r("composite_score"))


def composite_basic(i: Inputs) -> DataFrame:
    return _composite(rank.with_composite(i.variants))


def composite_given(i: Inputs) -> DataFrame:
    given = i.variants.withColumn("given", F.when(F.col("impressions") == 0, F.lit(12.0)))
    return _composite(rank.with_composite(given, ctr_weight=0.2, given_ctr="given"))


def score_batch(i: Inputs) -> DataFrame:
    return rank.score_batch(i.variants).select(
        "variant_id", "style", "needs_human_review", "ctr_benchmark", "ctr_scaled", "brand_scaled", "composite_score")


def rank_variants(i: Inputs) -> DataFrame:
    return rank.rank_variants(i.variants).select("request_id", "variant_id", "composite_score", "rank")


def rank_by_source(i: Inputs) -> DataFrame:
    """Ranking within few, large groups."""
    rows = i.posts.join(i.documents.select(F.col("doc_id").alias("post_id"), "source"), "post_id")
    return rank.ranked(rows.select("post_id", "source", "impressions"), "source", "impressions", "post_id").select("post_id", "rank")


def made_variants(i: Inputs) -> DataFrame:
    made = generate.usable_variants(i.generated).select("variant_id")
    return i.variants.join(made, "variant_id", "left_semi")


def soft_scale(i: Inputs) -> DataFrame:
    return rank.soft_scaled(made_variants(i), "ctr_score").select("variant_id", r("soft_score"))


def request_median(i: Inputs) -> DataFrame:
    return rank.request_median(i.variants).select("request_id", r("ctr_median"), "n")


def correction_candidates(i: Inputs) -> DataFrame:
    return correct.with_gate(i.variants).select("variant_id", r("ctr_median"), "is_candidate")


# --- evaluation ---------------------------------------------------------------------------------


def labelled(i: Inputs) -> DataFrame:
    rows = evaluate.human_eval_rows(all_scores(i), "text_id")
    return rows.join(i.eval_labels, "text_id")


def eval_truth(i: Inputs) -> DataFrame:
    return evaluate.with_truth(labelled(i)).select("text_id", "truth")


def human_eval_metrics(i: Inputs) -> DataFrame:
    report = reports.human_eval_report(labelled(i))
    return report.select("n", "n_unjudged", *[r(c) for c in ("accuracy", "correlation", "mean_correct", "mean_wrong", "auc")])


def roc_auc(i: Inputs) -> DataFrame:
    return evaluate.roc_auc(clean.clean_posts(i.posts), AUC_SCORE, "toxicity_score").select(r("auc"))


def log_rows(i: Inputs) -> DataFrame:
    return clean.with_log_columns(clean.clean_posts(i.posts)).select("post_id", "ctr_proxy", "log_impressions", "log_ctr")


def regression_metrics(i: Inputs) -> DataFrame:
    rows = log_rows(i)
    line = eda.ols_trend(rows, "log_impressions", "log_ctr")
    fit = line.select(F.struct("slope", "intercept").alias("fit")).scalar()
    fitted = rows.withColumn("_fit", fit)
    rate = F.expm1(F.col("_fit.slope") * F.col("log_impressions") + F.col("_fit.intercept"))
    metrics = evaluate.regression_metrics(fitted.withColumn("p", rate), "ctr_proxy", "p")
    return metrics.select(r("r2"), r("rmse"), r("mae"))


def fold_scores(i: Inputs) -> DataFrame:
    rows = log_rows(i).withColumn("fold", hashing.hash_bucket(F.col("post_id"), 5, seed=7))
    return evaluate.univariate_cv(rows, "log_impressions", "log_ctr", "fold")


def cv_r2(i: Inputs) -> DataFrame:
    return evaluate.cv_scores(fold_scores(i)).select(r("cv_mean"), r("cv_std"))


def best_subset(i: Inputs) -> DataFrame:
    return evaluate.best_row(fold_scores(i).select("fold", "r2"), "r2", "fold").select("fold", r("r2"))


def train_test_split(i: Inputs) -> DataFrame:
    key = F.col("post_id")
    return i.posts.select("post_id", (hashing.hash_bucket(key, 100) < 20).alias("is_test"), hashing.hash_bucket(key, 5, 7).alias("fold"))


def seeded_sample(i: Inputs) -> DataFrame:
    return evaluate.hash_sample(i.posts.select("post_id", "language"), "post_id", 4)


# --- catalog ------------------------------------------------------------------------------------


def brand_catalog(i: Inputs) -> DataFrame:
    entries = i.supplier.select(
        F.concat(F.lit("n"), "s_nationkey").alias("brand_id"), F.col("s_name").alias("brand_name"), F.col("s_suppkey").alias("position"))
    return catalog.last_per_brand(entries.withColumn("pos", F.col("position")), "pos")


def brand_refs_topn(i: Inputs) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("ref_ord", "ref_text")))
    top = catalog.first_references(i.ref_texts, 2).groupBy("brand_id").agg(lines.alias("l"))
    return top.select("brand_id", F.array_join("l.ref_text", " || ").alias("texts"))


def brand_lookup(i: Inputs) -> DataFrame:
    return catalog.with_brand(i.variants, accepted_catalog(i)).select("variant_id", "brand_name", "tone_category")


def unknown_brands(i: Inputs) -> DataFrame:
    return catalog.unknown_brands(i.variants, accepted_catalog(i))


LISTS = ["style_rules", "preferred_vocabulary", "forbidden_vocabulary", "reference_ad_copies"]


def nation_catalog(i: Inputs) -> DataFrame:
    name = F.col("n_name")
    return i.nation.select(
        F.concat(F.lit("b"), "n_nationkey").alias("brand_id"), name.alias("brand_name"), F.lit("Old").alias("tone_category"),
        F.lit("").alias("brand_voice_summary"), F.array(F.lit("old")).alias("style_rules"),
        F.array(F.lit("a")).alias("preferred_vocabulary"), F.array().cast("array<string>").alias("forbidden_vocabulary"),
        F.array(name).alias("reference_ad_copies"))


def upsert_brands(i: Inputs) -> DataFrame:
    merged, _ = catalog.upsert_brands(nation_catalog(i), i.brand_forms)
    return merged.withColumns({c: F.array_join(c, "|") for c in LISTS})


def rejected_brands(i: Inputs) -> DataFrame:
    _, rejected = catalog.upsert_brands(nation_catalog(i), i.brand_forms)
    return rejected.select("form_ord", "reject_reason")


def fallback_chain(i: Inputs) -> DataFrame:
    primary = F.element_at(F.array(*[F.lit(p) for p in FALLBACK_PRIMARIES]), (F.col("request_id") % 3 + 1).cast("int"))
    return i.requests.select("request_id", F.array_join(catalog.fallback_chain(primary), ",").alias("models"))


def label_lookup(i: Inputs) -> DataFrame:
    known = dict(list(fixed.STYLE_LABELS.items())[:3])
    return i.variants.select("variant_id", catalog.label_of(F.col("style"), known).alias("label"))


# --- generation ---------------------------------------------------------------------------------


def expand_styles(i: Inputs) -> DataFrame:
    return generate.expand_styles(i.requests).select("request_id", "brand_id", "style", "style_ord")


def prompts(i: Inputs) -> DataFrame:
    return generate.build_prompts(generate.expand_styles(i.requests), accepted_catalog(i), i.ref_texts)


def build_prompts(i: Inputs) -> DataFrame:
    return prompts(i).select("request_id", "style", "prompt")


def build_rewrite_prompts(i: Inputs) -> DataFrame:
    candidates = correct.with_gate(i.variants).where("is_candidate")
    state = correct.rewrite_state(candidates)
    return correct.build_rewrite_prompts(state, accepted_catalog(i), i.ref_texts).select("variant_id", "prompt")


def keyed_variants(i: Inputs) -> DataFrame:
    return i.variants.select("variant_id", cache.cache_key(F.lit("model-a"), F.col("text")).alias("cache_key"))


def cache_key(i: Inputs) -> DataFrame:
    return keyed_variants(i)


def _entries(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cache_key", cache.cache_key(F.col("model"), F.col("prompt")))


def cache_hits(i: Inputs) -> DataFrame:
    return cache.hits(keyed_variants(i), cache.newest(_entries(i.cache_rows))).select("variant_id")


def cache_misses(i: Inputs) -> DataFrame:
    return cache.misses(keyed_variants(i), cache.newest(_entries(i.cache_rows))).select("variant_id")


def cache_upsert(i: Inputs) -> DataFrame:
    return cache.upserted(cache.newest(_entries(i.cache_rows)), _entries(i.fresh_rows)).select("cache_key", "text")


def split_generation_errors(i: Inputs) -> DataFrame:
    return generate.request_outcome(i.generated)


def classify_errors(i: Inputs) -> DataFrame:
    message = F.col("message")
    return i.gen_errors.select(
        "variant_id", errors.error_class(message).alias("error_class"), errors.error_text(message).alias("error_text"),
        errors.error_text(errors.error_detail(message)).alias("detail_text"))


def is_transient(i: Inputs) -> DataFrame:
    return i.gen_errors.select("variant_id", errors.is_transient(F.col("message")).alias("is_transient"))


def retry_schedule(i: Inputs) -> DataFrame:
    tries = i.gen_errors.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    waits = F.when(errors.is_transient(F.col("message")), errors.wait_seconds(F.col("attempt"))).otherwise(0)
    return tries.select("variant_id", "attempt", waits.alias("wait_seconds"))


def generate_batch(i: Inputs) -> DataFrame:
    spark = i.requests.sparkSession
    store = cache.GenerationCache(spark, f"{shared_dir(spark)}/generated/{spark.sparkContext.applicationId}")
    made = generate.generate_texts(prompts(i), generate.TemplateProvider(), store, fixed.FALLBACK_MODELS)
    return made.select("request_id", "style", "generated", "model", "error")


# --- corrections and campaign -------------------------------------------------------------------


def corrected(i: Inputs) -> DataFrame:
    gated = correct.with_gate(i.variants)
    state = correct.rewrite_rounds(gated.where("is_candidate"), correct.table_rewriter(i.rewrites))
    return correct.correction_results(gated, state)


def apply_rewrites(i: Inputs) -> DataFrame:
    return corrected(i).select(
        "variant_id", "final_text", "final_brand_score", "corrected", "attempts", "needs_human_review", r("alignment_uplift"))


def attach_corrections(i: Inputs) -> DataFrame:
    with_info = correct.attach_corrections(rank.score_batch(i.variants), corrected(i).where("corrected"))
    info = "correction_info."
    return with_info.select(
        "variant_id", "composite_score", F.col(info + "corrected"), F.col(info + "attempts"),
        r(F.col(info + "alignment_uplift"), name="alignment_uplift"), F.col(info + "original_brand_score"), F.col(info + "original_text"))


def campaign_run(i: Inputs) -> DataFrame:
    n_vectors = i.embeddings.agg(F.count(F.lit(1)).alias("n")).scalar()
    vectors = i.embeddings.select(F.col("vec_id").alias("_vec_id"), F.col("embedding").alias("text_vec"))

    def with_brand(df: DataFrame, text: str) -> DataFrame:
        at = df.withColumn("_vec_id", F.col("variant_id") % n_vectors).join(vectors, "_vec_id")
        return brand.with_brand_score(at, i.brand_refs, baseline=0.0).drop("_vec_id", "text_vec")

    made = campaign.run_campaign(i.generated, with_rule_rate, with_brand, correct.table_rewriter(i.rewrites))
    return made.ranked.select(
        "request_id", "variant_id", "style", "text", "ctr_benchmark", "brand_scaled", "composite_score", "needs_human_review",
        "correction_info.corrected", "correction_info.attempts", r(F.col("correction_info.alignment_uplift"), 4, "alignment_uplift"),
        r(F.col("correction_info.ctr_delta"), name="ctr_delta"), "rank")


def campaign_provider(i: Inputs) -> DataFrame:
    """From requests to ranked variants with texts and rewrites of a provider and n-gram vectors."""
    spark = i.requests.sparkSession
    store = cache.GenerationCache(spark, f"{shared_dir(spark)}/campaign/{spark.sparkContext.applicationId}")
    # Both are read for the texts and for each round of rewrites.
    brands, models = checkpointed(accepted_catalog(i)), fixed.FALLBACK_MODELS
    encoder = embed.fit_embedder(i.ref_texts, "ref_text")
    refs = brand.stored_references(embed.embed_text(i.ref_texts, encoder, "ref_text", "ref_vec"))

    def with_brand(df: DataFrame, text: str) -> DataFrame:
        vectors = embed.embed_text(df, encoder, text)
        return brand.with_brand_score(vectors, refs, baseline=0.0).drop("text_vec")

    variants = campaign.generate_variants(i.requests, brands, i.ref_texts, generate.TemplateProvider(), store, models)
    rewriter = correct.provider_rewriter(brands, i.ref_texts, generate.TemplateProvider(), store, models, with_brand)
    made = campaign.run_campaign(variants, with_rule_rate, with_brand, rewriter)
    return made.ranked.select("request_id", "variant_id", "style", "text", "composite_score", "needs_human_review", "rank")


# --- models -------------------------------------------------------------------------------------


def training_table(i: Inputs, least_rows: int = 0) -> DataFrame:
    return model.kept_rows(model.training_rows(training.featured_posts(i.posts, languages=None)), least_rows=least_rows)


def _fit_metrics(i: Inputs, columns: list[str], learner) -> DataFrame:
    train_rows, test_rows = model.split_rows(training_table(i, model.LEAST_ROWS))
    return model.test_metrics(model.assembled(columns, learner).fit(train_rows), test_rows)


def train_full_gbt(i: Inputs) -> DataFrame:
    return _fit_metrics(i, fixed.FULL_COLUMNS, model.boosted_trees(PUBLISHED))


def train_linear(i: Inputs) -> DataFrame:
    return _fit_metrics(i, fixed.FULL_COLUMNS, model.linear(SMALL))


def train_content_gbt(i: Inputs) -> DataFrame:
    return _fit_metrics(i, fixed.CONTENT_COLUMNS, model.boosted_trees(PUBLISHED))


def cv_gbt(i: Inputs) -> DataFrame:
    train_rows, _ = model.split_rows(training_table(i, model.LEAST_ROWS))
    return model.cv_boosted(train_rows, fixed.CONTENT_COLUMNS, "content", PUBLISHED)


def _importances(i: Inputs) -> DataFrame:
    train_rows, _ = model.split_rows(training_table(i, model.LEAST_ROWS))
    fitted = model.assembled(fixed.FULL_COLUMNS, model.boosted_trees(PUBLISHED)).fit(train_rows)
    return model.feature_importances(train_rows.sparkSession, fitted)


def feature_importances(i: Inputs) -> DataFrame:
    return _importances(i)


def importances_positive(i: Inputs) -> DataFrame:
    return model.positive_importances(_importances(i))


def importances_top8(i: Inputs) -> DataFrame:
    return model.top_importances(_importances(i))


def ablation(i: Inputs) -> DataFrame:
    return model.ablation(training_table(i, model.LEAST_ROWS), PUBLISHED)


def _models_root(i: Inputs) -> str:
    spark = i.documents.sparkSession
    return f"{shared_dir(spark)}/models/{spark.sparkContext.applicationId}"


def predict_ctr(i: Inputs) -> DataFrame:
    train_rows, _ = model.split_rows(training_table(i))
    fitted = model.assembled(fixed.CONTENT_COLUMNS, model.boosted_trees(SMALL)).fit(train_rows)
    return model.predict_ctr(i.variants.select("variant_id", "text"), (fitted, fixed.CONTENT_COLUMNS))


def model_roundtrip(i: Inputs) -> DataFrame:
    """Largest difference between predictions of a model before and after storing it."""
    train_rows, test_rows = model.split_rows(training_table(i))
    fitted = model.assembled(fixed.FULL_COLUMNS, model.boosted_trees(SMALL)).fit(train_rows)
    model.save_model(fitted, _models_root(i), "full", prefix="roundtrip_")
    loaded, columns = model.load_scorer(train_rows.sparkSession, _models_root(i), prefix="roundtrip_")
    before = model.with_prediction(fitted, test_rows, "before")
    both = model.with_prediction(loaded, before, "after")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("difference"))


def train_report(i: Inputs) -> DataFrame:
    return training.train(i.posts, PUBLISHED, root=_models_root(i), prefix="report_", languages=None).metrics


def embed_text(i: Inputs) -> DataFrame:
    """Similarity of a text to itself without its last word, and to the text reversed."""
    fitted = embed.fit_embedder(i.documents, "text")
    texts = i.documents.select("doc_id", "text", F.regexp_replace("text", r"\s+\S+\s*$", "").alias("shorter"), F.reverse("text").alias("backwards"))
    for name in ("text", "shorter", "backwards"):
        texts = embed.embed_text(texts, fitted, name, f"{name}_vec")
    alike = lambda other: r(brand.cosine_similarity(F.col("text_vec"), F.col(f"{other}_vec")), 4, f"{other}_similarity")
    return texts.select("doc_id", F.size("text_vec").alias("dimensions"), alike("shorter"), alike("backwards"))


QUERIES: list[Callable[[Inputs], DataFrame]] = [
    clean_posts, ctr_proxy, winsorize_p99, trim_p99, clean_funnel, log_features,
    text_features, urgency_custom, normalize_text, is_turkish, sentiment_en, sentiment_tr, sentiment_custom, lexicon_sentiment, lexicon_hits,
    sentiment_score, toxicity_score,
    ctr_by_feature, engagement_windows, ols_trend, ols_trend_line, corr_matrix, summary_stats, union_langs,
    cosine_sim, brand_score, brand_score_default, brand_score_matrix, predict_brand, brand_proof, brand_proof_failures,
    brand_proof_summary, validate_alignment, offbrand_baseline,
    rule_check, rule_ctr, engagement_split,
    ctr_benchmark, composite_basic, composite_given, score_batch, rank_variants, rank_by_source, soft_scale,
    request_median, correction_candidates,
    eval_truth, human_eval_metrics, roc_auc, regression_metrics, cv_r2, best_subset, train_test_split, seeded_sample,
    brand_catalog, brand_refs_topn, brand_lookup, unknown_brands, upsert_brands, rejected_brands, fallback_chain, label_lookup,
    expand_styles, build_prompts, build_rewrite_prompts, cache_key, cache_hits, cache_misses, cache_upsert,
    split_generation_errors, classify_errors, is_transient, retry_schedule, generate_batch,
    apply_rewrites, attach_corrections, campaign_run, campaign_provider,
    train_full_gbt, train_linear, train_content_gbt, cv_gbt, feature_importances, importances_positive, importances_top8,
    ablation, predict_ctr, model_roundtrip, train_report, embed_text,
]


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(query: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            set_local_shared_dir(spark)
            ship_package(spark)
            return query(Inputs(spark, folder))

        return run

    return {query.__name__: bound(query) for query in QUERIES}
