"""Brand corrections: which variants are rewritten, the rewrite rounds, and their outcome."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.functions.rounding import round_binary
from adlumen.operators.catalog import bullets, reference_bullets
from adlumen.operators.calls import TextProvider, rewrite_rule
from adlumen.operators.generate import filled, generate_texts
from adlumen.operators.joins import Lookup, asked_join, lookup_join
from adlumen.operators.rank import with_request_median
from adlumen.operators.rules import violations
from adlumen.session import checkpointed
from adlumen.sources.cache import GenerationCache

CORRECTION_INFO = ["corrected", "attempts", "alignment_uplift", "ctr_delta", "original_brand_score", "original_text"]


def with_gate(variants: DataFrame, threshold: float = fixed.ALIGNMENT_THRESHOLD) -> DataFrame:
    """Add ``ctr_median`` and ``is_candidate``: below the brand threshold and above the median click rate."""
    low_brand = F.col("brand_score") < F.lit(float(threshold))
    above = F.col("ctr_score") > F.col("ctr_median")
    return with_request_median(variants).withColumn("is_candidate", F.coalesce(low_brand & above, F.lit(False)))


def rewrite_state(candidates: DataFrame) -> DataFrame:
    """Start of the rounds: the given text is the best one so far."""
    return candidates.select(
        "variant_id", "brand_id",
        F.col("text").alias("best_text"), F.col("brand_score").cast("double").alias("best_score"),
        F.lit(0).alias("attempts"), F.lit(False).alias("stopped"),
    )


def build_rewrite_prompts(
    state: DataFrame, catalog: DataFrame, refs: DataFrame, threshold: float = fixed.ALIGNMENT_THRESHOLD,
    lookup: Lookup = lookup_join,
) -> DataFrame:
    """Prompts for the best texts so far: ``(variant_id, brand_id, prompt)``."""
    facts = catalog.select(
        "brand_id", "brand_name", "tone_category", "brand_voice_summary", "preferred_vocabulary",
        "forbidden_vocabulary", bullets(F.col("style_rules")).alias("_rules"),
    ).join(reference_bullets(refs, fixed.REFERENCES_IN_REWRITE, "_references"), "brand_id", "left")
    found = violations(F.col("best_text"), F.col("preferred_vocabulary"), F.col("forbidden_vocabulary"))
    joined = lookup(state, facts, "brand_id", "inner").withColumns(
        {"_violations": found, "_rounded": round_binary(F.col("best_score"), 1)}
    )
    note = F.when(
        F.size("_violations") > 0, F.concat(F.lit("Specific violations: "), F.array_join("_violations", "; "))
    ).otherwise(F.lit(fixed.SEMANTIC_NOTE))
    values = {
        "system": F.lit(fixed.REWRITE_SYSTEM),
        "brand_name": F.col("brand_name"), "tone_category": F.col("tone_category"),
        "brand_voice_summary": F.col("brand_voice_summary"),
        "style_rules": F.col("_rules"), "references": F.col("_references"), "text": F.col("best_text"),
        "score": F.format_string("%.1f", F.col("_rounded")), "threshold": F.lit(f"{threshold:g}"),
        "violation_note": note,
    }
    return joined.select("variant_id", "brand_id", filled(fixed.REWRITE_TEMPLATE, values).alias("prompt"))


def apply_round(
    state: DataFrame, answers: DataFrame, attempt: int, threshold: float = fixed.ALIGNMENT_THRESHOLD
) -> DataFrame:
    """State after one round with answers ``(variant_id, new_score, new_error)``.

    An answer is taken iff its score is strictly better. Reaching the threshold or an error stops a variant. Ids,
    scores and the number of the chosen answer travel, no text.
    """
    pending = ~F.col("stopped")
    failed = F.col("new_error").isNotNull() | F.col("new_score").isNull()
    better = pending & ~failed & F.coalesce(F.col("new_score") > F.col("best_score"), F.lit(False))
    scores = answers.select("variant_id", "new_score", "new_error")
    joined = state.join(scores, "variant_id", "left").withColumns({"_better": better, "_failed": failed, "_pending": pending})
    updated = joined.withColumns({
        "best_attempt": F.when(F.col("_better"), F.lit(attempt)).otherwise(F.col("best_attempt")),
        "best_score": F.when(F.col("_better"), F.col("new_score")).otherwise(F.col("best_score")),
        "attempts": F.col("attempts") + F.col("_pending").cast("int"),
    })
    reached = F.col("best_score") >= F.lit(float(threshold))
    stopped = F.col("stopped") | F.col("_failed") | reached
    return updated.withColumn("stopped", stopped).select(*state.columns)


def with_best_text(state: DataFrame, texts: DataFrame) -> DataFrame:
    """State with the text of the chosen answer, out of ``texts (variant_id, best_attempt, best_text)``."""
    return state.join(texts, ["variant_id", "best_attempt"], "left")


Rewriter = Callable[[DataFrame, int], DataFrame]


def table_rewriter(rewrites: DataFrame) -> Rewriter:
    """Answers out of a table ``(variant_id, attempt, text, brand_score, error)``."""

    def answers(pending: DataFrame, attempt: int) -> DataFrame:
        return rewrites.where(F.col("attempt") == attempt).select(
            "variant_id", F.col("text").alias("new_text"), F.col("brand_score").alias("new_score"),
            F.col("error").alias("new_error"),
        )

    return answers


def provider_rewriter(
    catalog: DataFrame, refs: DataFrame, provider: TextProvider, cache: GenerationCache, models: Sequence[str],
    with_brand: Callable[[DataFrame, str], DataFrame], threshold: float = fixed.ALIGNMENT_THRESHOLD,
    concurrency: int | None = None,
) -> Rewriter:
    """Answers of a text provider; ``with_brand(df, text_column)`` scores them as ``brand_score``.

    The pending rows are checkpointed, because the catalog, the calls and the answers each read them. The scored answers
    are as well: each round joins them to a state they came from, and without the cut the plan would double with every
    round.
    """

    def answers(pending: DataFrame, attempt: int) -> DataFrame:
        prompts = build_rewrite_prompts(checkpointed(pending), catalog, refs, threshold, asked_join)
        made = generate_texts(prompts, provider, cache, models, rule=rewrite_rule, concurrency=concurrency)
        scored = with_brand(made.withColumnRenamed("generated", "new_text"), "new_text")
        return checkpointed(scored.select(
            "variant_id", "new_text", F.col("brand_score").alias("new_score"), F.col("error").alias("new_error")
        ))

    return answers


def rewrite_rounds(
    candidates: DataFrame, rewriter: Rewriter, threshold: float = fixed.ALIGNMENT_THRESHOLD,
    max_attempts: int = fixed.MAX_REWRITES,
) -> DataFrame:
    """Best text and score per candidate after at most ``max_attempts`` rounds (a fixed, small number).

    The answers of a round, one per variant, are read for their scores and again for the chosen texts, so a rewriter
    returns a table or a checkpoint. Texts meet the state once after the last round; a rewriter that reads
    ``best_text`` of the pending rows has them joined for its prompts.
    """
    state = rewrite_state(candidates).drop("best_text").withColumn("best_attempt", F.lit(0))
    texts = candidates.select("variant_id", F.lit(0).alias("best_attempt"), F.col("text").alias("best_text"))
    for attempt in range(1, max_attempts + 1):
        pending = state.where(~F.col("stopped"))
        answers = rewriter(with_best_text(pending, texts), attempt)
        state = apply_round(state, answers, attempt, threshold)
        made = answers.select("variant_id", F.lit(attempt).alias("best_attempt"), F.col("new_text").alias("best_text"))
        texts = texts.unionByName(made)
    return with_best_text(state, texts)


def correction_results(
    variants: DataFrame, state: DataFrame, threshold: float = fixed.ALIGNMENT_THRESHOLD,
    with_ctr: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Gated variants with the outcome of the rounds.

    ``with_ctr(df, text_column)`` adds ``ctr_score``, the click rate predicted for a text; only texts that
    went through the rounds are predicted again. Without it the given rate is kept. Variants that were
    not candidates pass unchanged.
    """
    rounds = state.select("variant_id", "best_text", "best_score", F.col("attempts").alias("_attempts"))
    if with_ctr is not None:
        rounds = with_ctr(rounds, "best_text").withColumnRenamed("ctr_score", "_final_ctr")
    else:
        rounds = rounds.withColumn("_final_ctr", F.lit(None).cast("double"))
    joined = variants.join(rounds, "variant_id", "left").withColumns({
        "corrected": F.col("_attempts").isNotNull(),
        "attempts": F.coalesce("_attempts", F.lit(0)),
        "original_text": F.col("text"),
        "final_text": F.coalesce("best_text", "text"),
        "original_brand_score": F.col("brand_score"),
        "final_brand_score": F.coalesce("best_score", "brand_score"),
        "original_ctr": F.col("ctr_score"),
    })
    joined = joined.withColumn("ctr_score", F.coalesce("_final_ctr", "ctr_score"))
    outcome = joined.withColumns({
        "needs_human_review": F.col("corrected") & (F.col("final_brand_score") < F.lit(float(threshold))),
        "alignment_uplift": F.col("final_brand_score") - F.col("original_brand_score"),
        "ctr_delta": F.col("ctr_score") - F.col("original_ctr"),
    })
    return outcome.select(
        *[c for c in variants.columns if c not in ("text", "brand_score", "ctr_score", "ctr_median", "is_candidate",
                                                    "needs_human_review")],
        "original_text", "final_text", "original_brand_score", "final_brand_score", "ctr_score", "corrected",
        "attempts", "needs_human_review", "alignment_uplift", "ctr_delta",
    )


def without_provider(gated: DataFrame, threshold: float = fixed.ALIGNMENT_THRESHOLD) -> DataFrame:
    """Outcome when no provider can be reached: candidates stay as they are and need a review."""
    state = rewrite_state(gated.where("is_candidate"))
    results = correction_results(gated, state, threshold)
    return results.withColumns({"needs_human_review": F.col("corrected"), "corrected": F.lit(False)})


def attach_corrections(ranked: DataFrame, corrections: DataFrame) -> DataFrame:
    """Ranked variants with a ``correction_info`` struct; a variant without a result gets the neutral one.

    Joined on the variant id: two variants rewritten to the same text keep their own results.
    """
    found = F.struct(*CORRECTION_INFO)
    neutral = F.struct(
        F.lit(False).alias("corrected"), F.lit(0).alias("attempts"), F.lit(0.0).alias("alignment_uplift"),
        F.lit(0.0).alias("ctr_delta"), F.col("brand_score").cast("double").alias("original_brand_score"),
        F.col("text").alias("original_text"),
    )
    info = corrections.select("variant_id", found.alias("_info"))
    return ranked.join(info, "variant_id", "left").withColumn(
        "correction_info", F.when(F.col("_info").isNotNull(), F.col("_info")).otherwise(neutral)
    ).drop("_info")
