"""Batch generation: requests times styles, prompts, cached texts and calls to a text provider."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.functions.text import clean_string
from adlumen.operators.calls import Answer, CallWindow, Rule, TextProvider, retry_rule, rewrite_rule
from adlumen.operators.catalog import bullets, reference_bullets, with_brand
from adlumen.operators.joins import Lookup, lookup_join
from adlumen.sources.cache import GenerationCache
from adlumen.session import checkpointed


UNKNOWN_BRAND = "unknown brand"


def expand_styles(requests: DataFrame, styles: Sequence[str] = tuple(fixed.STYLES)) -> DataFrame:
    """One row per request and style, with the style's ordinal."""
    listed = F.array(*[F.struct(F.lit(i).alias("style_ord"), F.lit(s).alias("style")) for i, s in enumerate(styles)])
    return requests.select("*", F.inline(listed))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template text with its ``{names}`` replaced by columns; null counts as empty."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), clean_string(values[name])]
    return F.concat(*parts, F.lit(rest))


def _choice(style: Column, texts: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), style)


def build_prompts(styled: DataFrame, catalog: DataFrame, refs: DataFrame, lookup: Lookup = lookup_join) -> DataFrame:
    """Add ``prompt`` to rows with brand_id, style, product and audience; null where the catalog lacks the brand."""
    facts = catalog.select(
        "brand_id", "brand_name", "tone_category", "brand_voice_summary", bullets(F.col("style_rules")).alias("_rules")
    ).join(reference_bullets(refs, fixed.REFERENCES_IN_PROMPT, "_references"), "brand_id", "left")
    joined = lookup(styled, facts.withColumn("_known", F.lit(True)), "brand_id", "left")
    values = {
        "system": F.lit(fixed.GENERATION_SYSTEM),
        "brand_name": F.col("brand_name"), "tone_category": F.col("tone_category"),
        "brand_voice_summary": F.col("brand_voice_summary"),
        "style_rules": F.col("_rules"), "references": F.col("_references"),
        "never_write": F.lit("\n".join(f"- {line}" for line in fixed.NEVER_WRITE)),
        "product": F.col("product"), "audience": F.col("audience"), "style": F.col("style"),
        "style_task": _choice(F.col("style"), fixed.STYLE_TASKS),
        "style_hint": _choice(F.col("style"), fixed.STYLE_HINTS),
    }
    prompt = F.when(F.col("_known"), filled(fixed.GENERATION_TEMPLATE, values))
    return joined.select(*styled.columns, prompt.alias("prompt"))


# --- provider calls -----------------------------------------------------------------------------


def attempt_models(
    provider: TextProvider, prompt: str, models: Sequence[str], attempts: int, wait: Callable[[float], None]
) -> tuple[str | None, str | None, int, str | None]:
    """``(text, model, calls, error)`` of one prompt after retries and fallbacks by ``retry_rule``."""
    return _one(provider, prompt, models, attempts, wait, retry_rule)


def rewrite_models(
    provider: TextProvider, prompt: str, models: Sequence[str], attempts: int, wait: Callable[[float], None]
) -> tuple[str | None, str | None, int, str | None]:
    """The same by ``rewrite_rule``."""
    return _one(provider, prompt, models, attempts, wait, rewrite_rule)


def _one(provider: TextProvider, prompt: str, models: Sequence[str], attempts: int, wait: Callable[[float], None], rule: Rule) -> Answer:
    still = CallWindow(provider, list(models), attempts, rule, in_flight=1, clock=lambda: 0.0, sleep=wait)
    return still.answers([(prompt, {})])[0]


ANSWERS = "prompt_key string, prompt string, text string, model string, calls int, error string"


def call_provider(
    prompts: DataFrame, provider: TextProvider, models: Sequence[str], attempts: int = 2, rule: Rule = retry_rule,
    concurrency: int | None = None, wait: Callable[[float], None] = time.sleep, in_flight: int = 4, per_second: float | None = None,
) -> DataFrame:
    """Call the provider for every row of ``(prompt_key, prompt, stored)``.

    ``stored`` is a JSON object of texts known per model. ``concurrency`` partitions call at the same time, each with
    ``in_flight`` calls at most, ``per_second`` of them started in a second. A task holds one batch of prompts at a time
    however many it has.
    """
    models = list(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = CallWindow(provider, models, attempts, rule, in_flight, per_second, sleep=wait)
        for batch in batches:
            asked = [(prompt, json.loads(stored or "{}")) for prompt, stored in zip(batch["prompt"], batch["stored"])]
            rows = [(key, prompt, *answer) for key, (prompt, _), answer in zip(batch["prompt_key"], asked, window.answers(asked))]
            yield pd.DataFrame(rows, columns=["prompt_key", "prompt", "text", "model", "calls", "error"])

    spread = prompts.repartition(concurrency, "prompt_key") if concurrency else prompts
    return spread.mapInPandas(run, ANSWERS)


def generate_texts(
    prompts: DataFrame, provider: TextProvider, cache: GenerationCache, models: Sequence[str], attempts: int = 2,
    rule: Rule = retry_rule, concurrency: int | None = None, wait: Callable[[float], None] = time.sleep, in_flight: int = 4,
    per_second: float | None = None,
) -> DataFrame:
    """Add ``generated``, ``model``, ``calls`` and ``error`` to rows with ``prompt``.

    A prompt that the first model has answered before is not sent; equal prompts are asked once. Answers
    are checkpointed and stored before anything reads them, because asking again could give another text.
    A row without prompt, that is of an unknown brand, gets the error ``UNKNOWN_BRAND``.
    """
    prompts, unknown = prompts.where("prompt is not null"), prompts.where("prompt is null")
    key = F.sha2("prompt", 256).alias("prompt_key")
    # The lookup, the calls and the hits read the distinct prompts, which are made once for all of them.
    distinct = checkpointed(prompts.select(key, "prompt").distinct())
    looked_up = cache.texts_of(distinct, models)
    first = F.try_element_at("stored", F.lit(models[0]))
    missing = looked_up.where(first.isNull()).select("prompt_key", "prompt", F.to_json("stored").alias("stored"))
    answers = checkpointed(call_provider(missing, provider, models, attempts, rule, concurrency, wait, in_flight, per_second))
    cache.put(answers)
    hits = looked_up.where(first.isNotNull()).select(
        "prompt_key", first.alias("text"), F.lit(models[0]).alias("model"), F.lit(0).alias("calls"),
        F.lit(None).cast("string").alias("error"),
    )
    known = answers.drop("prompt").unionByName(hits).withColumnRenamed("text", "generated")
    made = prompts.select("*", key).join(known, "prompt_key", "left").drop("prompt_key")
    failed = unknown.withColumns({
        "generated": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "calls": F.lit(0), "error": F.lit(UNKNOWN_BRAND)})
    return made.unionByName(failed)


#: What the offline provider adds for a style, so that the texts of a request differ.
STYLE_LINES = {
    "emotional": "Love it!", "informative": "Compare the facts.", "urgency": "Limited time, order today!", "humorous": "No hamsters were harmed."}


class TemplateProvider:
    """Deterministic provider without a network: echoes product, audience and style of the prompt."""

    def generate(self, prompt: str, model: str) -> str:
        lines = prompt.splitlines()
        facts = {key: line[len(key):].strip() for line in lines for key in ("Product:", "Target audience:", "Brand:")
                 if line.startswith(key)}
        style = next((word for line in lines if " style (" in line for word in [line.split(" style (")[0].split()[-1]]), "")
        return f"{facts.get('Brand:', '')} {facts.get('Product:', '')} for {facts.get('Target audience:', '')}. {STYLE_LINES.get(style, '')}".strip()


# --- results ------------------------------------------------------------------------------------


def usable_variants(variants: DataFrame) -> DataFrame:
    """Variants with a text."""
    return variants.where(F.coalesce(F.col("text"), F.lit("")) != "")


def generation_errors(variants: DataFrame) -> DataFrame:
    """Failed variants with their error."""
    return variants.where(F.coalesce(F.col("error"), F.lit("")) != "")


def request_outcome(variants: DataFrame, ordinal: str = "variant_ord") -> DataFrame:
    """Per request: texts made, failures, the first error, and whether every style failed."""
    made = F.coalesce(F.col("text"), F.lit("")) != ""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return variants.groupBy("request_id").agg(
        F.count_if(made).alias("n_ok"),
        F.count_if(failed).alias("n_failed"),
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col(ordinal))).alias("first_error"),
    ).withColumn("all_failed", F.col("n_ok") == 0)
