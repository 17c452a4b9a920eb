"""A batch of requests from generated texts to ranked, corrected variants."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.operators import correct, generate
from adlumen.operators.joins import asked_join
from adlumen.operators.rank import ranked, score_batch
from adlumen.session import checkpointed
from adlumen.sources.cache import GenerationCache

Scorer = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class CampaignResult:
    """Ranked variants with their correction info, all correction results, failures per variant and per request.

    ``timings`` holds the seconds that each stage took to run and their ``total``, ``rows`` the rows that the stages
    wrote. The gate drops no row and is not counted.
    """

    ranked: DataFrame
    corrections: DataFrame
    errors: DataFrame
    outcome: DataFrame
    timings: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)


class StageClock:
    """Seconds per stage, and rows of the stages that are written."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.rows: dict[str, int] = {}
        self.start = time.monotonic()

    def planned(self, stage: str, work: Callable[[], DataFrame]) -> DataFrame:
        """``work`` with the jobs that it starts itself."""
        begin = time.monotonic()
        result = work()
        self.seconds[stage] = time.monotonic() - begin
        return result

    def written(self, stage: str, work: Callable[[], DataFrame]) -> DataFrame:
        """The checkpoint of ``work``; the job that writes it counts its rows."""
        seen = Observation(stage)
        result = self.planned(stage, lambda: checkpointed(work().observe(seen, F.count(F.lit(1)).alias("rows"))))
        self.rows[stage] = seen.get["rows"]
        return result

    def timings(self) -> dict[str, float]:
        return {**self.seconds, "total": time.monotonic() - self.start}


def generate_variants(
    requests: DataFrame, catalog: DataFrame, refs: DataFrame, provider: generate.TextProvider,
    cache: GenerationCache, models: Sequence[str], styles: Sequence[str] = tuple(fixed.STYLES),
    concurrency: int | None = None,
) -> DataFrame:
    """One variant per request and style from a text provider, with the text or the error.

    ``requests`` holds request_id, brand_id, product, audience; the variants of a request of an unknown brand have an error.
    """
    # Read for the brands asked for, for the prompts and for the answers.
    requests = checkpointed(requests)
    prompts = generate.build_prompts(generate.expand_styles(requests, styles), catalog, refs, asked_join)
    made = generate.generate_texts(prompts, provider, cache, models, concurrency=concurrency)
    return made.select(
        (F.col("request_id") * len(styles) + F.col("style_ord")).alias("variant_id"), "request_id",
        F.col("style_ord").alias("variant_ord"), "brand_id", "style", F.col("generated").alias("text"), "error",
    )


def run_campaign(
    variants: DataFrame,
    with_ctr: Scorer,
    with_brand: Scorer,
    rewriter: correct.Rewriter,
    ctr_weight: float = fixed.CTR_WEIGHT,
    threshold: float = fixed.ALIGNMENT_THRESHOLD,
    max_attempts: int = fixed.MAX_REWRITES,
) -> CampaignResult:
    """Score, gate, rewrite, rescore and rank.

    ``variants`` holds request_id, variant_id, variant_ord, brand_id, style, text, error. ``with_ctr``
    and ``with_brand`` add the score of a text column to any table with it. Requests whose styles all
    failed have no ranked rows; ``outcome`` names them.
    """
    clock = StageClock()
    usable = generate.usable_variants(variants).drop("error")
    columns = [*usable.columns, "ctr_score", "brand_score"]
    # The scores feed the median, the gate and the rounds. The checkpoint keeps the texts from being
    # scored again, also after a lost executor, and keeps the later plans small.
    scored = clock.written(
        "scoring", lambda: score_batch(with_brand(with_ctr(usable, "text"), "text"), ctr_weight).select(*columns))
    # Every round reads the candidates and the results all rows: the medians are found once.
    gated = clock.planned("gate", lambda: checkpointed(correct.with_gate(scored, threshold)))

    def corrections() -> DataFrame:
        state = correct.rewrite_rounds(gated.where("is_candidate"), rewriter, threshold, max_attempts)
        return correct.correction_results(gated, state, threshold, with_ctr)

    # The ranking reads the results twice, for the counts and for the rows.
    corrected = clock.written("correction", corrections)

    def final_ranking() -> DataFrame:
        # Scores of the final texts are already known per variant, changed or not.
        final = corrected.select(
            "request_id", "variant_id", "variant_ord", "brand_id", "style", F.col("final_text").alias("text"),
            "ctr_score", F.col("final_brand_score").alias("brand_score"), "needs_human_review",
            F.struct(*correct.CORRECTION_INFO).alias("correction_info"),
        )
        return ranked(score_batch(final, ctr_weight))

    final = clock.written("final_scoring", final_ranking)
    return CampaignResult(
        final, corrected, generate.generation_errors(variants), generate.request_outcome(variants), clock.timings(), clock.rows)
