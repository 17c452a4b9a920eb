"""The benchmark in blocks in the shared folder."""

import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

from adlumen.llm import decontaminate

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402


def test_blocks_hold_every_item_once(spark):
    rng = random.Random(1)
    items = [(i % 50, " ".join(str(rng.randint(0, 99)) for _ in range(40))) for i in range(400)]
    items += items[:30] + [(None, "x y z"), (7, None), (8, "")]
    files = decontaminate.stored_benchmark(spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000)
    assert files.n_blocks > 10
    found = [item for block in range(files.n_blocks) for item in files.items(block)]
    assert sorted(found) == sorted({(str(i), t) for i, t in items if i is not None and t is not None})
    sizes = [sum(len(t) for _, t in files.items(block)) for block in range(files.n_blocks)]
    assert max(sizes) < 8000  # one frequent id does not make a block large
    assert decontaminate.stored_benchmark(spark.createDataFrame([], "item_id long, text string")).n_blocks == 0


def test_results_do_not_depend_on_blocks(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    items = [(i % 9, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 13, 20])))) for i in range(60)]
    texts = [(i, " ".join([rng.choice(words) for _ in range(40)] + rng.choice(items)[1].split())) for i in range(40)] + [(40, None), (None, ""), (1, "W1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted([(d, *brute.contamination(t, items)[:3]) for d, t in texts], key=repr)
    for block_bytes in (10**6, 300):
        got = decontaminate.occurrences(docs, bench, "text", ["doc_id"], block_bytes=block_bytes)
        assert sorted([(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got.collect()], key=repr) == expected
