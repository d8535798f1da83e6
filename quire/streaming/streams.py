"""The call log and the answers as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import archive, knowledge
from quire.sources import stores


def stream_call_rate(calls: DataFrame, late: str = "1 minute") -> DataFrame:
    """Calls for each key in sliding minutes, ten seconds apart; rows later than ``late`` are left out, and where calls have a call_id one that comes again within that time counts once. The watermark is an addition of ours: it bounds the state."""
    timed = calls.withWatermark("started_at", late)
    timed = timed.dropDuplicatesWithinWatermark(["call_id"]) if "call_id" in calls.columns else timed
    return timed.groupBy("key", F.window("started_at", "1 minute", "10 seconds")).agg(F.count("*").alias("n_calls")).select("key", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_calls")


def stream_responses(responses: DataFrame, spark: SparkSession, chapters_path: str, checkpoint: str, buckets: int = stores.BUCKETS) -> StreamingQuery:
    """Applies answers (book_id, chapter_index, raw) to the chapters that stores.write_versions() put below chapters_path in ``buckets``, batch by batch.

    A chapter that is processed is never done again; of several answers of one batch that of the last ``attempt`` holds (without attempts two answers of a chapter are an error). A
    batch reads and writes the buckets of its own books alone: version batch + 1 from those before it, so that running it again gives the same.
    """

    def batch(df: DataFrame, n: int) -> None:
        touched = [r.b for r in df.select(stores.bucket_of("book_id", buckets).alias("b")).distinct().collect()]
        if not touched:
            return
        held = stores.latest(spark, chapters_path, n, touched)
        todo = held.where("not ai_processed").join(df.select("book_id", F.col("chapter_index").alias("index")), ["book_id", "index"], "left_semi")
        done = knowledge.apply_responses(todo, df).select(*held.columns)
        stores.write_versions(archive.upsert(held, done, "id"), "book_id", chapters_path, buckets, n + 1)

    return responses.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
