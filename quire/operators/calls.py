"""Call log analytics in batch, for keys of any size: calls are dealt to blocks of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as tx
from quire.operators import spans

#: Calls a minute, least gap, attempts, back-off.
PER_MINUTE, WINDOW_US, GAP_S, ATTEMPTS, BACKOFF_S = 12, 60_000_000, 5.0, 2, 3
#: Length of a block of time, and how long after a failure's end a call is still its retry: a full window of the limiter and its waits.
BLOCK_US, RETRY_WITHIN_S = 3_600_000_000, 120.0


def _us(c) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def rolling_call_counts(calls: DataFrame, limit: int = PER_MINUTE, window_us: int = WINDOW_US, block_us: int = BLOCK_US) -> DataFrame:
    """call_id, key, started_at, n_calls in the trailing window (one exactly that old is out), remaining.

    A call is in its block and, as a copy that is counted but gives no row, in each later one that its window reaches. Calls without a time count one another.
    """
    at = lambda c: F.floor(c / F.lit(block_us))
    x = calls.select("call_id", "key", "started_at", _us("started_at").alias("_us")).withColumn("_own", at(F.col("_us")))
    x = x.withColumn("_block", F.explode_outer(F.sequence("_own", at(F.col("_us") + (window_us - 1)))))
    n = F.count("*").over(Window.partitionBy("key", "_block").orderBy("_us").rangeBetween(-window_us + 1, 0))
    return x.withColumn("n_calls", n).where(F.col("_block").eqNullSafe(F.col("_own"))).select("call_id", "key", "started_at", "n_calls", F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("n_calls")).alias("remaining"))


def min_gap_violations(calls: DataFrame, gap_s: float = GAP_S, block_us: int = BLOCK_US) -> DataFrame:
    """Calls that start under ``gap_s`` seconds after the one before ended, with the seconds that were missing."""
    x = calls.select("call_id", "key", "started_at", "ended_at", _us("started_at").alias("_us"))
    x = spans.numbered(x, ["key"], spans.block_of("_us", block_us), ["started_at", "call_id"], lags={"_before": "ended_at"}).withColumn("_gap", F.col("_us") - _us("_before"))
    return x.where(F.col("_gap") < int(gap_s * 1e6)).select("call_id", "key", ((F.lit(int(gap_s * 1e6)) - F.col("_gap")) / 1e6).alias("missing_s"))


def call_runs(calls: DataFrame, attempts: int = ATTEMPTS, within_s: float = RETRY_WITHIN_S, block_us: int = BLOCK_US) -> DataFrame:
    """Every call with the run that it belongs to: call_id, key, label, started_at, run (from 1 in key and label), attempt (from 1), ok, limited.

    A run is a first call and its retries: it ends with a success, a rate limit or the last of ``attempts``; a call that
    starts over ``within_s`` seconds after the failure before it ended is no retry and begins a run.
    """
    order = ["started_at", "call_id"]
    ok = F.coalesce(F.col("http_status") == 200, F.lit(False))
    limited = F.coalesce(tx.is_rate_limit_error(F.col("provider"), F.col("http_status"), F.col("message")), F.lit(False)) & ~ok
    x = calls.select("call_id", "key", "label", "started_at", "ended_at", ok.alias("ok"), limited.alias("limited"), _us("started_at").alias("_us")).withColumn("_ended", F.struct((F.col("ok") | F.col("limited")).alias("run"), F.col("ended_at").alias("at")))
    keys, block = ["key", "label"], spans.block_of("_us", block_us)
    x = spans.numbered(x, keys, block, order, lags={"_prev_call": "_ended"})
    late = F.coalesce(F.col("_us") - _us(F.col("_prev_call.at")) > int(within_s * 1e6), F.lit(False))
    # what lies between two such calls are failures that follow one another closely: as many as a run may have are one
    x = spans.runs(x, keys, block, order, F.col("_prev_call").isNull() | F.col("_prev_call.run") | late)
    x = x.withColumn("attempt", (F.pmod(F.col("place") - 1, F.lit(attempts)) + 1).cast("int")).drop("run", "place")
    return spans.runs(x, keys, block, order, F.col("attempt") == 1).select("call_id", "key", "label", "started_at", "run", "attempt", "ok", "limited")


def call_outcomes(calls: DataFrame, attempts: int = ATTEMPTS, within_s: float = RETRY_WITHIN_S, block_us: int = BLOCK_US) -> DataFrame:
    """One row a run: key, label, run, first_call_id, started_at, attempts, outcome (ok, rate-limited, exhausted, or unfinished if no retry came), backoff_s (3 s times the attempt after each failure but the last)."""
    x = call_runs(calls, attempts, within_s, block_us)
    g = x.groupBy("key", "label", "run").agg(F.min_by("call_id", "attempt").alias("first_call_id"), F.min_by("started_at", "attempt").alias("started_at"), F.count("*").cast("int").alias("attempts"), F.max_by(F.struct("ok", "limited"), "attempt").alias("l"))
    n = F.col("attempts")
    return g.select("key", "label", "run", "first_call_id", "started_at", "attempts", F.when(F.col("l.ok"), "ok").when(F.col("l.limited"), "rate-limited").when(n >= attempts, "exhausted").otherwise("unfinished").alias("outcome"), (F.lit(BACKOFF_S) * n * (n - 1) / 2).cast("int").alias("backoff_s"))
