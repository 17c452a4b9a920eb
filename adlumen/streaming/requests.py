"""Requests put together from a stream of variants, so that each is ranked once and as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from adlumen.functions import fixed_values as fixed
from adlumen.operators.rank import rank_variants

OUTPUT = "row string, on_time boolean"
STATE = "ranked boolean, rows array<string>"


def whole_requests(
    variants: DataFrame, time: str, expected: int = len(fixed.STYLES), wait: str = "10 minutes", group: str = "request_id",
) -> DataFrame:
    """The variants of a request together in one micro-batch, plus ``on_time``.

    A request is given out when ``expected`` variants are there, or when the watermark, ``wait`` behind the newest
    ``time``, passes its last one; a variant that comes after that but within the watermark is given out with
    ``on_time`` false. The state of a request holds less than ``expected`` rows, and goes with the watermark. Rows
    older than the watermark are left out, as in any windowed job. All columns of ``variants`` are kept.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ranked, rows = state.get if state.exists else (False, [])
        rows = list(rows)
        if state.hasTimedOut:
            state.remove()
            if rows:
                yield pd.DataFrame({"row": rows, "on_time": True})
            return
        last = state.getCurrentWatermarkMs()
        for frame in frames:
            last = max(last, int(frame["at"].max()))
            if ranked:
                yield pd.DataFrame({"row": frame["row"], "on_time": False})
            else:
                rows += frame["row"].tolist()
        if len(rows) >= expected:
            yield pd.DataFrame({"row": rows, "on_time": True})
            ranked, rows = True, []
        state.update((ranked, rows))
        state.setTimeoutTimestamp(last + 1)

    schema = variants.schema
    timed = variants.where(F.col(time).isNotNull()).withWatermark(time, wait)
    packed = timed.select(
        F.col(group).alias("key"), F.to_json(F.struct(*variants.columns)).alias("row"), time,
        F.unix_millis(F.col(time).cast("timestamp")).alias("at"))
    found = packed.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("row", schema).alias("_row"), "on_time").select("_row.*", "on_time")


def ranked_requests(
    variants: DataFrame, time: str, sink: Callable[[DataFrame, int], None], checkpoint: str,
    expected: int = len(fixed.STYLES), wait: str = "10 minutes",
) -> StreamingQuery:
    """Hand every request to ``sink`` once, ranked over all its variants; variants that came too late have no rank.

    ``variants`` holds what :func:`rank_variants` needs and ``time``. The sink gets the number of the micro-batch, by
    which it can leave out one that is run again after a failure.
    """

    def ranked(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            late = rows.where("not on_time").drop("on_time")
            sink(rank_variants(rows.where("on_time").drop("on_time")).unionByName(late, allowMissingColumns=True), number)
        finally:
            rows.unpersist()

    whole = whole_requests(variants, time, expected, wait)
    return whole.writeStream.foreachBatch(ranked).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
