"""Lines of plain texts become rows without structs, and an audit chooses candidates once."""

from pyspark.sql import functions as F

from quire.operators import audit, profile, scoring
from quire.plans import book_queries

LONG = "a line of plain prose that is no heading " * 4
TEXTS = ["", None, "one", "CHAPTER\n7\nThe End\n" + LONG, f"{LONG}\n　Prologue﻿ \r\n" + "w " * 300, "\n".join(f" line {i}" for i in range(40)), " \n\nTHE PART"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def book(spark):
    return spark.createDataFrame([(b, i, t) for b in ("a", "b", None) for i, t in enumerate(TEXTS)], "book_id string, page_num int, text string")


def test_plain_lines_are_those_of_pages_that_might_be_rich(spark):
    pages = book(spark)
    rich = pages.withColumn("lines", F.expr(f"cast(array() as array<{scoring.LINE}>)")).withColumn("width", F.lit(None).cast("double")).withColumn("height", F.lit(None).cast("double"))
    for size in (12.0, 9.5, 30.0, 0.0):
        context = profile.book_context(pages).withColumn("median_font_size", F.lit(size))
        for use in (None, scoring.may_be_chosen):
            a, b = scoring.page_lines(profile.page_digest(pages, use), context), scoring.page_lines(profile.page_digest(rich, use), context)
            assert a.dtypes == b.dtypes and rows(a) == rows(b) != []
        for most in (None, 3, 14):
            a, b = scoring.page_lines(pages, context, most), scoring.page_lines(rich, context, most)
            assert a.dtypes == b.dtypes and rows(a) == rows(b) != []


def test_plain_lines_are_rows_before_they_are_told_of(spark):
    plan = scoring.page_lines(spark.createDataFrame([], profile.page_digest(book(spark)).schema))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(" in plan and "transform(" not in plan


def test_books_contexts_are_written(spark, monkeypatch):
    names, plain = [], scoring.stored
    monkeypatch.setattr(scoring, "stored", lambda df, what: names.append(what) or plain(df, what))
    scoring.scored_lines(profile.page_digest(book(spark)))
    assert sorted(names) == ["contexts", "headers"]


def test_audit_chooses_once_for_candidates_and_stages(spark, sf, monkeypatch):
    calls, plain = [], scoring.score_pages_at
    monkeypatch.setattr(scoring, "score_pages_at", lambda *a: calls.append(a[1]) or plain(*a))
    got = book_queries.audited(spark, sf)
    assert calls == [scoring.BOTH]
    assert rows(got["cands"]) == rows(audit.candidates(got["scored"]).select(got["cands"].columns)) != []
