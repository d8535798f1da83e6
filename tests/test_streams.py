"""The two streams, run to their end over files."""

from quire.operators import archive
from quire.sources import stores
from quire.streaming import streams


def test_call_rate(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}") for s in (1, 2, 30)] + [("b", "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "key string, t string").selectExpr("key", "cast(t as timestamp) as started_at")
    df.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streams.stream_call_rate(s).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("select max(n_calls) from rates where key = 'a'").first()[0]
    assert got == 3


def test_responses(spark, tmp_path):
    ch = spark.createDataFrame([("b-ch-0", "b", 0, False, None), ("b-ch-1", "b", 1, True, "kept")], "id string, book_id string, index int, ai_processed boolean, summary string")
    ch = ch.unionByName(spark.createDataFrame([(f"x{k}-ch-0", f"x{k}", 0, False, None) for k in range(30)], ch.schema))
    stores.write_versions(ch, "book_id", f"{tmp_path}/ch", 8)
    r = spark.createDataFrame([("b", 0, 'x {"summary": " s "} y'), ("b", 1, '{"summary": "new"}')], "book_id string, chapter_index int, raw string")
    r.write.parquet(f"{tmp_path}/in")
    q = streams.stream_responses(spark.readStream.schema(r.schema).parquet(f"{tmp_path}/in"), spark, f"{tmp_path}/ch", f"{tmp_path}/cp", 8)
    q.awaitTermination(60)
    got = {x.id: (x.ai_processed, x.summary) for x in stores.latest(spark, f"{tmp_path}/ch").collect()}
    assert got == {"b-ch-0": (True, "s"), "b-ch-1": (True, "kept")} | {f"x{k}-ch-0": (False, None) for k in range(30)}
    assert len(list((tmp_path / "ch").glob("bucket=*/v=1"))) == 1 < len(list((tmp_path / "ch").glob("bucket=*/v=0")))
    assert archive.STATUS[0] == "processing"
