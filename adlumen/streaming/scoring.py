"""The same scoring on a stream of texts.

Features, affect and scores are projections of single rows and run on a stream as they are. Ranking
needs all variants of a request, so it runs per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from adlumen.functions.affect import with_affect
from adlumen.functions.text import with_text_features
from adlumen.operators.rank import rank_variants


def scored_stream(texts: DataFrame, text: str = "text_content") -> DataFrame:
    """Text features, sentiment and toxicity of every row."""
    return with_affect(with_text_features(texts, text), text, words="word_count")


def ranked_batches(variants: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Rank the variants of each micro-batch (a request must arrive in one) and hand them to ``sink``."""
    return (
        variants.writeStream.foreachBatch(lambda batch, number: sink(rank_variants(batch), number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
