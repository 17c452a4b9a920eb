import datetime as dt

from pyspark.sql import functions as F

from adlumen.operators.rank import rank_variants
from adlumen.streaming.engagement import engagement_windows
from adlumen.streaming.requests import ranked_requests

EVENT = "event_id long, ts timestamp, event_type string, value double"
VARIANT = "request_id long, variant_ord int, style string, ctr_score double, brand_score double, ts timestamp, note string"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 8, 0, 0) + dt.timedelta(minutes=minute, seconds=second)


def in_order(spark, folder, batches, schema):
    """A stream of one file per micro-batch."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stream_gives_the_windows_of_the_table(spark, tmp_path):
    kinds = ["view", "click", "signup", "purchase", "error", None]
    batches = [[(b * 100 + i, at(b * 7 + i % 6, i), kinds[i % 6], None if i % 11 == 0 else i / 3) for i in range(40)] for b in range(6)]
    late = [(900, at(1), "click", 50.0), (901, at(33), "click", 5.0), (902, None, "view", 1.0)]  # one behind the watermark
    end = [(999, at(300), "error", 0.0)]
    stream = in_order(spark, str(tmp_path / "events"), [*batches, late, end], EVENT)
    query = engagement_windows(stream).writeStream.format("memory").queryName("windows").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    counted = spark.createDataFrame([r for b in batches for r in b] + late[1:2], EVENT)
    expected = sorted(map(tuple, engagement_windows(counted).collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == expected and len(expected) == 5
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in map(dict, query.recentProgress) if p["stateOperators"]) == 1
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the last event's window


def test_no_impressions_and_no_events(spark):
    df = spark.createDataFrame([(1, at(0), "click", 2.9)], EVENT)
    row = engagement_windows(df).first()
    assert (row.impressions, row.likes, row.n_events, row.engagement_rate) == (0, 2, 1, None)
    assert engagement_windows(df.limit(0)).count() == 0


def test_a_request_split_over_batches_is_ranked_once(spark, tmp_path):
    def variant(request, ordinal, ctr, minute):
        return (request, ordinal, f"s{ordinal}", ctr, 50.0 + ordinal, at(minute), f"n{request}-{ordinal}")

    first = [variant(1, 0, 5.0, 0), variant(1, 1, 9.0, 0), variant(2, 0, 4.0, 0), variant(3, 0, 1.0, 0)]
    second = [variant(1, 2, 7.0, 1), variant(1, 3, 1.0, 1), variant(2, 1, 6.0, 1)]
    late = [variant(1, 4, 99.0, 2)]  # after request 1 was ranked
    end = [variant(9, i, float(i), 200) for i in range(4)]
    stream = in_order(spark, str(tmp_path / "variants"), [first, second, late, end], VARIANT)
    seen = []
    query = ranked_requests(stream, "ts", lambda batch, number: seen.extend((number, r) for r in batch.collect()), str(tmp_path / "state"))
    query.awaitTermination()
    ranks = {(r.request_id, r.variant_ord): r["rank"] for _, r in seen}
    assert len(seen) == len(ranks) == 12 and ranks.pop((1, 4)) is None
    whole = rank_variants(spark.createDataFrame([*first, *second, *end], VARIANT))
    assert ranks == {(r.request_id, r.variant_ord): r["rank"] for r in whole.collect()}
    for request in (1, 2, 3, 9):
        assert len({number for number, r in seen if r.request_id == request and r["rank"]}) == 1
        assert sum(r["rank"] == 1 for _, r in seen if r.request_id == request) == 1
    assert all(r.note == f"n{r.request_id}-{r.variant_ord}" for _, r in seen)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # requests behind the watermark are forgotten
