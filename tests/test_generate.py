import threading
import time

import pytest
from pyspark.sql import functions as F

from adlumen.functions import fixed_values as fixed
from adlumen.operators import correct, generate
from adlumen.operators.calls import CallWindow
from adlumen.plans.campaign import generate_variants, run_campaign
from adlumen.session import checkpointed
from adlumen.sources.cache import GenerationCache, cache_key, upserted


class Flaky:
    """Fails with the given messages in turn, then answers."""

    def __init__(self, *messages):
        self.messages, self.calls = list(messages), []

    def generate(self, prompt, model):
        self.calls.append(model)
        if self.messages:
            raise RuntimeError(self.messages.pop(0))
        return " ok text "


def attempt(provider, models=("m1",), attempts=4, policy=generate.attempt_models):
    waits = []
    return policy(provider, "p", models, attempts, waits.append), waits


def test_transient_errors_wait_longer_each_time():
    provider = Flaky("503 Unavailable", "503 Unavailable")
    assert attempt(provider) == (("ok text", "m1", 3, None), [2.0, 4.0])


def test_quota_moves_on_at_once():
    provider = Flaky("429 RESOURCE_EXHAUSTED")
    assert attempt(provider, ("m1", "m2")) == (("ok text", "m2", 2, None), [])


def test_permanent_errors_are_tried_again_without_waiting():
    assert attempt(Flaky(*["bad input"] * 4), ("m1", "m2"), 2) == ((None, None, 4, "bad input"), [])


def test_rewrites_fall_through_on_quota_only():
    assert attempt(Flaky("429"), ("m1", "m2"), policy=generate.rewrite_models)[0] == ("ok text", "m2", 2, None)
    assert attempt(Flaky("503"), ("m1", "m2"), policy=generate.rewrite_models)[0] == (None, None, 1, "503")


class Slow:
    """Answers after a while and notes how many calls ran at once; fails first where the prompt says so."""

    def __init__(self, seconds, failures=()):
        self.seconds, self.failures, self.lock = seconds, dict(failures), threading.Lock()
        self.running, self.most, self.starts = 0, 0, []

    def generate(self, prompt, model):
        with self.lock:
            self.running += 1
            self.most = max(self.most, self.running)
            self.starts.append((time.monotonic(), prompt))
            failing = self.failures.pop(prompt, None)
        time.sleep(self.seconds)
        with self.lock:
            self.running -= 1
        if failing:
            raise RuntimeError(failing)
        return f"{model}:{prompt}"


def test_four_calls_in_flight_take_a_quarter():
    prompts = [(f"p{i}", {}) for i in range(16)]
    spent = {}
    for in_flight in (1, 4):
        provider, start = Slow(0.1), time.monotonic()
        answers = CallWindow(provider, ["m"], in_flight=in_flight).answers(prompts)
        spent[in_flight] = time.monotonic() - start
        assert answers == [(f"m:p{i}", "m", 1, None) for i in range(16)] and provider.most == in_flight
    assert spent[4] < 0.35 * spent[1]


def test_a_waiting_prompt_holds_no_other():
    provider, start = Slow(0.02, {"p0": "503 Unavailable"}), time.monotonic()
    answers = CallWindow(provider, ["m"], in_flight=1).answers([(f"p{i}", {}) for i in range(5)])
    assert answers == [("m:p0", "m", 2, None)] + [(f"m:p{i}", "m", 1, None) for i in range(1, 5)]
    assert [p for _, p in provider.starts] == ["p0", "p1", "p2", "p3", "p4", "p0"]
    assert provider.starts[-2][0] - start < 1 and provider.starts[-1][0] - start >= 2


def test_calls_are_started_at_the_rate():
    provider = Slow(0.0)
    CallWindow(provider, ["m"], in_flight=8, per_second=50).answers([(str(i), {}) for i in range(11)])
    times = [t for t, _ in provider.starts]
    assert times[-1] - times[0] >= 0.19
    assert CallWindow(provider, []).answers([("p", {})]) == [(None, None, 0, "no model")]


def test_window_follows_the_rules(spark):
    class Failing:
        """Fails once for two prompts."""

        seen = set()

        def generate(self, prompt, model):
            if prompt in "ab" and prompt not in self.seen:
                self.seen.add(prompt)
                raise RuntimeError("429 RESOURCE_EXHAUSTED" if prompt == "a" else "bad input")
            return f"{model}:{prompt}"

    provider = Slow(0.0, {"a": "429 RESOURCE_EXHAUSTED", "b": "bad input"})
    rows = spark.createDataFrame([(p, p, None) for p in "abc"] + [("d", "d", '{"m1": "kept"}')], "prompt_key string, prompt string, stored string")
    got = {r.prompt_key: (r.text, r.model, r.calls) for r in generate.call_provider(rows.coalesce(1), Failing(), ["m1", "m2"]).collect()}
    assert got == {"a": ("m2:a", "m2", 2), "b": ("m1:b", "m1", 2), "c": ("m1:c", "m1", 1), "d": ("kept", "m1", 1)}
    assert CallWindow(provider, ["m1", "m2"]).answers([("a", {}), ("b", {})]) == [("m2:a", "m2", 2, None), ("m1:b", "m1", 2, None)]


def test_texts_are_generated_once_and_stored(spark, tmp_path):
    class PerModel:
        """Fails for prompts that ask for it; other texts name the model."""

        def generate(self, prompt, model):
            if "fail" in prompt:
                raise RuntimeError("500 broken")
            return f"{model}:{prompt}"

    store = GenerationCache(spark, str(tmp_path / "cache"))
    prompts = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", "fail"])], "id int, prompt string")
    args = (PerModel(), store, ["m1", "m2"])
    made = {r.id: r for r in generate.generate_texts(prompts, *args, wait=lambda s: None).collect()}
    assert made[0].generated == made[2].generated == "m1:a" and made[0].calls == 1
    assert made[3].generated is None and made[3].error == "500 broken" and made[3].calls == 4
    assert store.entries().count() == 2
    again = {r.id: r for r in generate.generate_texts(prompts, *args, wait=lambda s: None).collect()}
    assert again[1].generated == "m1:b" and again[1].calls == 0
    # Another first model has its own entries; the stored text of the second model is not asked for again.
    store.put(spark.createDataFrame([("m2", "fail", "kept")], "model string, prompt string, text string"))
    late = {r.id: r for r in generate.generate_texts(prompts, *args, wait=lambda s: None).collect()}
    assert (late[3].generated, late[3].model) == ("kept", "m2")
    assert store.clear() == 3 and store.entries().count() == 0


def test_newest_entry_counts(spark, tmp_path):
    store = GenerationCache(spark, str(tmp_path / "cache"))
    assert store.entries().count() == 0 and store.clear() == 0
    for text in ("old", "new"):
        store.put(spark.createDataFrame([("m1", "p", text)], "model string, prompt string, text string"))
    store.put(spark.createDataFrame([("m2", "p", "other")], "model string, prompt string, text string"))
    assert {(r.model, r.text) for r in store.entries().collect()} == {("m1", "new"), ("m2", "other")}
    entry = store.entries().where("model = 'm1'")
    merged = upserted(store.entries(), entry.withColumn("text", F.lit("fresh")))
    assert {r.text for r in merged.collect()} == {"fresh", "other"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def inputs_of_exchanges(spark, df):
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").splitlines()
    return [text[i + 1] for i, line in enumerate(text) if line.endswith(") Exchange")]


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    store = GenerationCache(spark, str(tmp_path / "cache"))
    texts = spark.range(400).select(F.lit("m1").alias("model"), F.concat(F.lit("p"), "id").alias("prompt"), F.concat(F.lit("t"), "id").alias("text"))
    store.put(texts)
    asked = spark.createDataFrame([("k1", "p7"), ("k2", "p8"), ("k3", "new")], "prompt_key string, prompt string")
    found = store.texts_of(asked, ["m1"])
    buckets = {r[0] for r in asked.select(F.substring(cache_key(F.lit("m1"), F.col("prompt")), 1, 2)).collect()}
    assert {r.prompt_key: r.stored for r in found.collect()} == {"k1": {"m1": "t7"}, "k2": {"m1": "t8"}, "k3": None}
    scans = [line for line in plan_of(found).splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [" in line for line in scans)
    assert all(f"{b}" in line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for b in buckets for line in scans)
    stored = {f.parent.name for f in (tmp_path / "cache").rglob("*.parquet")}
    assert len(stored) > 100 and all(name.startswith("bucket=") for name in stored)
    assert store.entries().count() == 400


def test_compaction_keeps_the_newest_entry(spark, tmp_path):
    store = GenerationCache(spark, str(tmp_path / "cache"))
    for text in ("old", "new"):
        store.put(spark.createDataFrame([("m1", "p", text), ("m2", "q", text)], "model string, prompt string, text string"))
    before = sorted(map(tuple, store.entries().collect()))
    store.compact()
    assert sorted(map(tuple, store.entries().collect())) == before and store._written().count() == 2
    store.put(spark.createDataFrame([("m1", "p", "newest")], "model string, prompt string, text string"))
    assert {(r.model, r.text) for r in store.entries().collect()} == {("m1", "newest"), ("m2", "new")}
    store.compact()
    store.compact()
    assert {(r.model, r.text) for r in store.entries().collect()} == {("m1", "newest"), ("m2", "new")}
    assert sorted(f.name for f in (tmp_path / "cache").iterdir()) == ["base-2", "base-3", "log-2", "log-3"]


def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    store = GenerationCache(spark, str(tmp_path / "cache"))
    row = "model string, prompt string, text string"
    store.put(spark.createDataFrame([("m1", "p", "a"), ("m1", "q", "b")], row))
    half = store.entries().limit(1)
    write = store._write

    def dies(entries, folder, mode):
        write(half, folder, mode)
        (tmp_path / "cache" / folder / "_SUCCESS").unlink()
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_write", dies)
    with pytest.raises(RuntimeError, match="lost"):
        store.compact()
    monkeypatch.undo()
    texts = lambda: {r.text for r in store.entries().collect()}
    assert texts() == {"a", "b"}
    store.put(spark.createDataFrame([("m1", "r", "c")], row))  # goes to the log that the lost run opened
    assert texts() == {"a", "b", "c"}
    store.compact()
    assert texts() == {"a", "b", "c"}


def test_cache_key(table):
    import hashlib

    key = table([("m", "pü")], "m string, p string").select(cache_key(F.col("m"), F.col("p"))).first()[0]
    assert key == hashlib.sha256("m\npü".encode()).hexdigest()


@pytest.fixture
def brands(spark):
    catalog = spark.createDataFrame(
        [("b", "Brand", "Bold", "Loud.", ["Short", "Clear"], ["speed"], ["maybe"])],
        "brand_id string, brand_name string, tone_category string, brand_voice_summary string, style_rules array<string>, "
        "preferred_vocabulary array<string>, forbidden_vocabulary array<string>")
    refs = spark.createDataFrame([("b", i, f"ref {i}") for i in (3, 1, 2, 4, 6, 5)], "brand_id string, ref_ord int, ref_text string")
    return catalog, refs


def test_prompts(spark, brands):
    requests = spark.createDataFrame([(1, "b", "Shoe", "runners")], "request_id long, brand_id string, product string, audience string")
    rows = generate.build_prompts(generate.expand_styles(requests), *brands).orderBy("style_ord").collect()
    assert [r.style for r in rows] == fixed.STYLES
    prompt = rows[2].prompt
    assert prompt.startswith(fixed.GENERATION_SYSTEM + "\n\nBrand: Brand\nTone: Bold\nBrand voice: Loud.\n\nStyle rules:\n- Short\n- Clear\n")
    assert "- ref 1\n- ref 2\n- ref 3\n- ref 4\n- ref 5\n\nExamples" in prompt and "ref 6" not in prompt
    assert "Product: Shoe\nTarget audience: runners\n" in prompt and "in the urgency style" in prompt


def test_rewrite_prompts(spark, brands):
    variants = spark.createDataFrame([(1, "b", "maybe fast", 12.25), (2, "b", "pure speed", 69.96)], "variant_id long, brand_id string, text string, brand_score double")
    rows = {r.variant_id: r.prompt for r in correct.build_rewrite_prompts(correct.rewrite_state(variants), *brands).collect()}
    assert "Current brand alignment score: 12.2/100 (threshold: 70)\nSpecific violations: Missing preferred vocabulary: speed; Contains forbidden language: maybe\n" in rows[1]
    assert "70.0/100 (threshold: 70)\nSemantic alignment is too low.\n" in rows[2]
    assert "- ref 3\n\nOriginal ad copy:\npure speed\n" in rows[2]


VARIANTS = "variant_id long, request_id long, variant_ord int, brand_id string, style string, text string, error string"
REWRITES = "variant_id long, attempt int, text string, brand_score double, error string"


def gated(spark, *rows):
    df = spark.createDataFrame([(i, 1, "b", f"t{i}", *r) for i, r in enumerate(rows)],
                               "variant_id long, request_id long, brand_id string, text string, ctr_score double, brand_score double")
    return correct.with_gate(df)


def test_gate(spark):
    rows = gated(spark, (5.0, 80.0), (9.0, 70.0), (9.0, 69.9), (5.0, 10.0)).orderBy("variant_id").collect()
    assert [r.is_candidate for r in rows] == [False, False, True, False] and rows[0].ctr_median == 7.0
    assert not gated(spark, (9.0, 1.0)).first().is_candidate  # alone, the rate equals the median


def test_rounds(spark):
    table = gated(spark, *[(1.0, 90.0)] * 6, *[(9.0, 50.0)] * 5)
    rewrites = spark.createDataFrame([
        (6, 1, "x1", 75.0, None), (6, 2, "x2", 99.0, None),      # reaches the threshold at once
        (7, 1, "x1", 40.0, None), (7, 2, "x2", 60.0, None),      # worse, then better
        (8, 1, None, None, "429"), (8, 2, "x2", 99.0, None),     # an error stops
        (9, 1, "x1", 50.0, None), (9, 2, "x2", 50.0, None),      # never strictly better
    ], REWRITES)
    state = correct.rewrite_rounds(table.where("is_candidate"), correct.table_rewriter(rewrites))
    got = {r.variant_id: r for r in correct.correction_results(table, state).collect()}
    view = {i: (got[i].final_text, got[i].final_brand_score, got[i].attempts, got[i].needs_human_review) for i in range(5, 11)}
    assert view == {5: ("t5", 90.0, 0, False), 6: ("x1", 75.0, 1, False), 7: ("x2", 60.0, 2, True),
                    8: ("t8", 50.0, 1, True), 9: ("t9", 50.0, 2, True), 10: ("t10", 50.0, 1, True)}
    assert got[9].corrected and not got[5].corrected and got[7].alignment_uplift == 10.0
    alone = {r.variant_id: r for r in correct.without_provider(table).collect()}
    assert (alone[7].corrected, alone[7].needs_human_review, alone[7].attempts) == (False, True, 0)
    assert not alone[5].needs_human_review


def test_rounds_shuffle_no_texts(spark):
    table = gated(spark, *[(1.0, 90.0)] * 6, *[(9.0, 50.0)] * 5)
    rewrites = spark.createDataFrame([(i, a, f"x{a}", 40.0 + 15 * a, None) for i in range(6, 11) for a in (1, 2)], REWRITES)
    candidates = checkpointed(table.where("is_candidate"))
    rewriter = correct.table_rewriter(rewrites)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # so that every join of the rounds is an exchange
    try:
        rounds = correct.rewrite_state(candidates).drop("best_text").withColumn("best_attempt", F.lit(0))
        for attempt in (1, 2):
            rounds = correct.apply_round(rounds, rewriter(rounds, attempt), attempt, 99.0)
        shuffled = inputs_of_exchanges(spark, rounds)
        assert len(shuffled) >= 3 and not any("text" in line for line in shuffled)
        state = correct.rewrite_rounds(candidates, rewriter, threshold=99.0)
        with_text = [line for line in inputs_of_exchanges(spark, state) if "text" in line]
        assert len(with_text) == 1  # the texts to choose from, in the last join
        assert {r.variant_id: (r.best_text, r.best_score, r.attempts) for r in state.collect()} == {
            i: ("x2", 70.0, 2) for i in range(6, 11)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_campaign(spark):
    rows = [(i, 1, i, "b", s, f"{s} text", None) for i, s in enumerate(fixed.STYLES)]
    rows += [(4 + i, 2, i, "b", s, None, "503") for i, s in enumerate(fixed.STYLES)]
    variants = spark.createDataFrame(rows, VARIANTS)
    rewrites = spark.createDataFrame([(i, 1, "rewritten", 90.0, None) for i in range(4)], REWRITES)

    def with_ctr(df, text):
        return df.withColumn("ctr_score", F.when(F.col(text) == "rewritten", 30.0).otherwise(F.length(text).cast("double")))

    def with_brand(df, text):
        return df.withColumn("brand_score", F.lit(20.0))

    result = run_campaign(variants, with_ctr, with_brand, correct.table_rewriter(rewrites))
    ranked = result.ranked.orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4] and ranked[0].text == "rewritten"
    assert [r.correction_info.corrected for r in ranked] == [True, True, False, False]
    assert ranked[0].composite_score >= ranked[1].composite_score >= ranked[2].composite_score
    outcome = {r.request_id: (r.n_ok, r.n_failed, r.first_error, r.all_failed) for r in result.outcome.collect()}
    assert outcome == {1: (4, 0, None, False), 2: (0, 4, "503", True)}
    assert result.errors.count() == 4 and set(result.timings) == {"scoring", "gate", "correction", "final_scoring", "total"}
    stages = sum(result.timings[stage] for stage in ("scoring", "gate", "correction", "final_scoring"))
    assert abs(stages - result.timings["total"]) <= 0.1 * result.timings["total"]
    assert result.rows == {"scoring": 4, "correction": 4, "final_scoring": 4}
    info = correct.attach_corrections(result.ranked.drop("correction_info"), result.corrections.where("corrected"))
    assert {r.correction_info.corrected for r in info.collect()} == {True, False}


def test_campaign_with_a_provider(spark, brands, tmp_path):
    class Echo:
        """Answers with the style, and rewrites by adding the brand's word."""

        def generate(self, prompt, model):
            if "Original ad copy" in prompt:
                return prompt.split("Original ad copy:\n")[1].split("\n")[0] + " speed"
            if "humorous style" in prompt:
                raise RuntimeError("quota exceeded")
            return prompt.split("in the ")[1].split(" style")[0] + " copy"

    def with_ctr(df, text):
        return df.withColumn("ctr_score", F.length(text).cast("double"))

    def with_brand(df, text):
        return df.withColumn("brand_score", F.when(F.contains(text, F.lit("speed")), 85.0).otherwise(30.0))

    store = GenerationCache(spark, str(tmp_path / "texts"))
    requests = spark.createDataFrame([(1, "b", "Shoe", "all"), (2, "zz", "Hat", "all")], "request_id long, brand_id string, product string, audience string")
    variants = generate_variants(requests, *brands, Echo(), store, ["m1", "m2"])
    rewriter = correct.provider_rewriter(*brands, Echo(), store, ["m1"], with_brand)
    result = run_campaign(variants, with_ctr, with_brand, rewriter)
    ranked = result.ranked.orderBy("rank").collect()
    assert [r.text for r in ranked] == ["informative copy speed", "emotional copy", "urgency copy"]
    assert [r.needs_human_review for r in ranked] == [False, False, False]
    errors = sorted((r.request_id, r.error) for r in result.errors.select("request_id", "error").collect())
    assert errors == [(1, "quota exceeded")] + [(2, "unknown brand")] * 4


def test_ngram_brand_scores_make_no_array_of_characters(spark):
    from adlumen.operators import brand, embed

    refs = spark.createDataFrame([("b", "red running shoe"), ("c", "blue sky at night")], "brand_id string, ref_text string")
    texts = spark.createDataFrame([(1, "b", "red running shoe"), (2, "c", "Blue  sky"), (3, "zz", "blue sky"), (4, "b", None)], "id int, brand_id string, text string")
    encoder = embed.fit_embedder(refs, "ref_text")
    scored = brand.with_brand_score(embed.embed_text(texts, encoder, "text"), embed.embed_text(refs, encoder, "ref_text", "ref_vec"), baseline=0.0)
    assert "split(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    scores = {r.id: r.brand_score for r in scored.collect()}
    assert scores[1] == pytest.approx(100.0, abs=1e-4) and 20 < scores[2] < 100 and scores[3] is None and scores[4] < scores[2]


def test_prompts_are_not_shuffled_where_nothing_reads_them(spark):
    from datetime import datetime

    from adlumen.sources.cache import newest

    day = [datetime(2024, 1, d) for d in (1, 2)]
    rows = [("k", "m1", "p1", "new", day[1]), ("k", "m2", "p2", "old", day[0]), (None, None, "p3", "b", None), (None, "m3", None, "a", None),
            ("n", "m4", "p4", None, None)]
    entries = spark.createDataFrame(rows, "cache_key string, model string, prompt string, text string, created_at timestamp")
    assert sorted(map(str, newest(entries).collect())) == sorted(str(r) for r in entries.collect() if (r.model, r.text) in (("m1", "new"), (None, "b"), ("m4", None)))
    assert newest(entries).columns == entries.columns
    plan = newest(entries).select("cache_key", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan


def test_a_campaign_computes_requests_once_and_the_catalog_once_per_round(spark, brands, tmp_path):
    class Echo:
        def generate(self, prompt, model):
            return prompt.split("Original ad copy:\n")[1].split("\n")[0] + " more" if "Original ad copy" in prompt else prompt[-40:]

    def counted(df, seen):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    def with_ctr(df, text):
        return df.withColumn("ctr_score", F.when(F.col("style") == fixed.STYLES[0], 9.0).otherwise(1.0) if "style" in df.columns else F.lit(9.0))

    def with_brand(df, text):
        return df.withColumn("brand_score", F.length(text) * 0.1)

    asked, known = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    requests = counted(spark.createDataFrame([(i, "b", f"Shoe {i}", "all") for i in range(6)], "request_id long, brand_id string, product string, audience string"), asked)
    catalog = counted(brands[0], known)
    store = GenerationCache(spark, str(tmp_path / "texts"))
    variants = generate_variants(requests, catalog, brands[1], Echo(), store, ["m1"])
    rewriter = correct.provider_rewriter(catalog, brands[1], Echo(), store, ["m1"], with_brand)
    result = run_campaign(variants, with_ctr, with_brand, rewriter)
    attempts = {(r.style, r.correction_info.attempts) for r in result.ranked.collect()}
    assert attempts == {(s, 2 if s == fixed.STYLES[0] else 0) for s in fixed.STYLES}
    assert asked.value == 6 and known.value == 3  # for the texts and for two rounds


def test_asked_join_moves_no_rows_to_a_few_keys(spark, monkeypatch):
    from adlumen.operators import joins

    rows = spark.createDataFrame([(i, None if i == 0 else "zz" if i == 1 else f"b{i % 2}") for i in range(50)], "id int, brand_id string")
    table = spark.range(5000).select(F.concat(F.lit("b"), F.col("id")).alias("brand_id"), F.repeat(F.lit("x"), 300).alias("facts"))
    table = table.unionByName(spark.createDataFrame([("b1", "second"), (None, "none")], "brand_id string, facts string"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a table that is too large as a whole
    try:
        for how in ("left", "inner"):
            wanted = sorted(joins.lookup_join(rows, table, "brand_id", how).collect(), key=str)
            small = joins.asked_join(rows, table, "brand_id", how)
            assert "Exchange hashpartitioning" not in plan_of(small) and sorted(small.collect(), key=str) == wanted
            with monkeypatch.context() as patched:
                patched.setattr(joins, "ASKED_BYTES", 0)
                large = joins.asked_join(rows, table, "brand_id", how)
                assert "BroadcastExchange" not in plan_of(large) and sorted(large.collect(), key=str) == wanted
        assert joins.asked_join(rows.where("false"), table, "brand_id", "left").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
