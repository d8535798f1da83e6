"""Blocks of ordered rows against windows over whole keys; the call log's runs against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import calls, spans

START = datetime(2024, 1, 1)


def rows_of(spark, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), n, rng.choice([None, None, "x", "y"]), rng.random() < 0.2) for n in range(400)] + [("one", 5, None, False), ("a", None, "null first", True)]
    return spark.createDataFrame(rows, "key string, n int, v string, begins boolean").repartition(5).persist()


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_blocks_are_windows(spark, size):
    df = rows_of(spark)
    w, key = Window.partitionBy("key").orderBy("n"), Window.partitionBy("key")
    block = spans.block_of("n", size)
    got = spans.numbered(df, ["key"], block, ["n"], lags={"before": "n", "before_v": "v"}, leads={"after": "n"}, whole={"low": ("min", "n"), "high": ("max", "n")})
    want = df.select("*", F.row_number().over(w).cast("long").alias("pos"), F.count("*").over(key).alias("of"), F.lag("n").over(w).alias("before"), F.lag("v").over(w).alias("before_v"), F.lead("n").over(w).alias("after"), F.min("n").over(key).alias("low"), F.max("n").over(key).alias("high"))
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got, want = spans.carried(df, ["key"], block, ["n"], "v"), df.withColumn("v", F.last("v", ignorenulls=True).over(upto))
    assert got.select(*want.columns).exceptAll(want).count() == want.exceptAll(got.select(*want.columns)).count() == 0
    want = df.withColumn("run", F.count_if("begins").over(upto)).withColumn("place", F.row_number().over(Window.partitionBy("key", "run").orderBy("n")).cast("long"))
    got = spans.runs(df, ["key"], block, ["n"], F.col("begins")).select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def log_of(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows, at = [], START
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 4, 30, 60, 61, 500]))
        rows.append((k, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["c1", "c2"]), "openai", at, at + timedelta(seconds=rng.choice([0, 3, 20])), rng.choice([200, 429, 500, 500, None]), "m"))
    return rows, spark.createDataFrame(rows, "call_id long, key string, label string, provider string, started_at timestamp, ended_at timestamp, http_status int, message string").repartition(4).persist()


@pytest.mark.parametrize("minutes", [1, 2, 60])
def test_rolling_counts_and_gaps(spark, minutes):
    rows, df = log_of(spark)
    w = Window.partitionBy("key").orderBy(F.unix_micros("started_at")).rangeBetween(-calls.WINDOW_US + 1, 0)
    want = df.select("call_id", F.count("*").over(w).alias("n_calls"))
    got = calls.rolling_call_counts(df, block_us=minutes * 60_000_000)
    assert got.count() == len(rows) and got.select("call_id", "n_calls").exceptAll(want).count() == 0
    # blocks shorter than the window need several copies of a call
    assert calls.rolling_call_counts(df, block_us=7_000_000).select("call_id", "n_calls").exceptAll(want).count() == 0
    before = F.lag("ended_at").over(Window.partitionBy("key").orderBy("started_at", "call_id"))
    want = df.withColumn("gap", F.unix_micros("started_at") - F.unix_micros(before)).where("gap < 5000000").select("call_id", ((5_000_000 - F.col("gap")) / 1e6).alias("missing_s"))
    got = calls.min_gap_violations(df, block_us=minutes * 60_000_000).select("call_id", "missing_s")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_a_hot_key_is_many_tasks(spark):
    """A key's hours lie in many partitions."""
    df = spark.range(3000).select(F.col("id").alias("call_id"), F.lit("hot").alias("key"), F.lit("c").alias("label"), F.lit("openai").alias("provider"), F.timestamp_seconds(F.col("id") * 90).alias("started_at"), F.timestamp_seconds(F.col("id") * 90 + 88).alias("ended_at"), F.lit(500).alias("http_status"), F.lit("m").alias("message"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (calls.rolling_call_counts(df), calls.min_gap_violations(df), calls.call_runs(df)):
            sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
            assert sum(sizes) in (3000, 2999) and max(sizes) < 1500 and len(sizes) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_runs(rows, attempts, within):
    """call_id to (run, attempt), and each run's outcome, by walking a key's calls."""
    out, ends = {}, {}
    by = {}
    for r in rows:
        by.setdefault((r[1], r[2]), []).append(r)
    for k, log in by.items():
        log.sort(key=lambda r: (r[4], r[0]))
        run, attempt, done, last = 0, 0, True, None
        for r in log:
            if done or (r[4] - last).total_seconds() > within:
                run, attempt = run + 1, 0
            attempt, last = attempt + 1, r[5]
            done = r[6] in (200, 429) or attempt == attempts
            out[r[0]] = (run, attempt)
            ends[k, run] = ("ok" if r[6] == 200 else "rate-limited" if r[6] == 429 else "exhausted" if attempt == attempts else "unfinished", attempt)
    return out, ends


@pytest.mark.parametrize(("attempts", "within", "minutes"), [(2, 120.0, 60), (3, 40.0, 1), (2, 1e9, 2)])
def test_runs_of_calls(spark, attempts, within, minutes):
    """Every call belongs to exactly one run, and none is dropped."""
    rows, df = log_of(spark)
    want, ends = plain_runs(rows, attempts, within)
    got = calls.call_runs(df, attempts, within, minutes * 60_000_000).collect()
    assert len(got) == len(rows) and {r.call_id: (r.run, r.attempt) for r in got} == want
    got = calls.call_outcomes(df, attempts, within, minutes * 60_000_000).collect()
    assert {((r.key, r.label), r.run): (r.outcome, r.attempts) for r in got} == ends
    assert sum(r.attempts for r in got) == len(rows) and all(r.backoff_s == sum(3 * a for a in range(1, r.attempts)) for r in got)
