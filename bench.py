"""Headline queries, timed: one JSON line.

Each query is planned and run in full into the noop sink, once as a warm-up and then ``BENCH_RUNS``
times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from adlumen.session import local_session, set_local_shared_dir  # noqa: E402
from checks.queries import registered  # noqa: E402

HEADLINE = [
    "clean_posts", "clean_funnel", "text_features", "sentiment_score", "rule_ctr", "ctr_by_feature", "corr_matrix",
    "summary_stats", "brand_score", "brand_proof", "human_eval_metrics", "rule_check", "score_batch", "rank_variants",
    "request_median", "correction_candidates", "build_prompts", "apply_rewrites", "cache_misses", "roc_auc",
    "campaign_run", "train_linear",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="12g")
    set_local_shared_dir(spark)
    queries = registered()

    def seconds(name: str) -> float:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent = time.time() - start
        spark.catalog.clearCache()  # no query may profit from what another one kept
        return spent

    times = {}
    for name in names:
        seconds(name)
        times[name] = round(statistics.median(seconds(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
