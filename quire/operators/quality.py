"""Quality scores of whole runs against expected counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a chapter should give and the caps; weights of the score; pass mark and drop.
PER_CHAPTER = {"concept": (3, 20), "principle": (2, 15), "actionable": (2, 15), "vocabulary": (2, 20), "quote": (1, 10)}
WEIGHTS = {"chapter_score": 0.40, "concept_score": 0.15, "principle_score": 0.15, "vocab_score": 0.15, "quote_score": 0.10, "ai_call_score": 0.05}
PASS, DROP = 0.80, 0.05


def expected_counts(books: DataFrame) -> DataFrame:
    """slug, expected_chapter_count and the counts that follow from it."""
    n = F.col("chapter_count")
    return books.select("slug", n.alias("expected_chapter_count"), *(F.least(n * k, F.lit(cap)).alias(f"expected_{name}_count") for name, (k, cap) in PER_CHAPTER.items()), (n + F.when(n > 1, 1).otherwise(0)).alias("expected_ai_calls"))


def _ratio(a: Column, e: Column) -> Column:
    return F.when((a == 0) & (e == 0), 1.0).when((a == 0) | (e == 0), 0.0).otherwise(F.least(a, e) / F.greatest(a, e))


def score_books(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """slug, six scores, overall_score, passed; a book without an actual row counts as one that found nothing, by the same formulas."""
    x = expected.join(actual, "slug", "left")
    a = lambda c: F.coalesce(F.col(c), F.lit(0))
    e = a("expected_chapter_count")
    scores = {
        "chapter_score": F.when(e == 0, F.when(a("chapter_count") > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), a("chapter_count") / F.nullif(e, F.lit(0)))),
        "concept_score": _ratio(a("concept_count"), a("expected_concept_count")),
        "principle_score": _ratio(a("principle_count"), a("expected_principle_count")),
        "vocab_score": _ratio(a("vocab_count"), a("expected_vocabulary_count")),
        "quote_score": _ratio(a("quote_count"), a("expected_quote_count")),
        "ai_call_score": F.when(a("ai_calls") == a("expected_ai_calls"), 1.0).otherwise(0.5),
    }
    x = x.select("slug", *(c.alias(n) for n, c in scores.items()))
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    return x.withColumn("overall_score", total).withColumn("passed", F.col("overall_score") >= PASS)


def qa_summary(scores: DataFrame) -> DataFrame:
    """mean_score_pct, n_passed, n_total."""
    return scores.agg((F.avg("overall_score") * 100).alias("mean_score_pct"), F.count_if("passed").alias("n_passed"), F.count("*").alias("n_total"))


def detect_regressions(current: DataFrame, history: DataFrame, drop: float = DROP) -> DataFrame:
    """slug, previous, current, delta where the score fell by more than ``drop`` since the latest earlier run (git_hash, timestamp, slug, overall_score)."""
    last = history.agg(F.max_by(F.struct("git_hash", "timestamp"), F.struct("timestamp", "git_hash")).alias("l")).select("l.*")
    before = history.join(F.broadcast(last), ["git_hash", "timestamp"]).select("slug", F.col("overall_score").alias("previous"))
    x = current.select("slug", F.col("overall_score").alias("current")).join(before, "slug")
    return x.withColumn("delta", F.col("previous") - F.col("current")).where(F.col("delta") > drop)
