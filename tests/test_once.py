"""Texts are read once, and the functions that read them say what their patterns say."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import scoring, segment

ODD = ["", " ", None, "　a b﻿", "\t\x0b x\xa0 ", "​z​", "a b ", "\U0001f600 \U0001f600 ", "\x85q\x85", "\x1c r", " w  ", "\r\n v \r"]


def test_trim_and_word_count_by_their_patterns(spark):
    c = F.col("t")
    trim = F.regexp_replace(c, rf"^{tx.WS}+|{tx.WS}+\z", "")
    count = F.regexp_count(c, F.lit(tx.WS.replace("[", "[^", 1) + "+"))
    rows = spark.createDataFrame([(t,) for t in ODD] + [(f"x{chr(i)}y{chr(i)}",) for i in range(1, 0x3100)], "t string")
    assert rows.where(~tx.trim(c).eqNullSafe(trim) | ~tx.word_count(c).eqNullSafe(count)).collect() == []


def test_headings_by_patterns_read_texts_once(spark):
    pages = spark.createDataFrame([("b", i, f"Chapter {i}: Start\nwords of page {i}") for i in range(1, 6)], "book_id string, page_num int, text string")
    for found in (scoring.find_heading(pages), segment.segment_by_patterns(pages)):
        # the text itself is read where the digest is made, and no more
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan
        assert found.count() == 5


def test_audit_scores_lines_and_finds_stages_once(spark, sf, monkeypatch):
    from quire.plans import book_queries

    calls = []
    for module, name in ((scoring, "scored_lines"), (segment, "stage_chapters")):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _f=plain, _n=name, **k: calls.append(_n) or _f(*a, **k))
    book_queries.s7_audit_report(spark, sf)
    assert sorted(calls) == ["scored_lines", "stage_chapters"]


def test_median_font_size_reads_lines_once(spark):
    from quire.operators import profile

    rows = [("a", [10.0, 12.0, 0.0]), ("a", [14.0, 14.0]), ("b", []), ("c", None), ("d", [None, -1.0]), (None, [9.0])]
    pages = spark.createDataFrame([(b, i, None if s is None else [(x,) for x in s]) for i, (b, s) in enumerate(rows)], "book_id string, page_num int, lines array<struct<font_size:double>>")
    got = profile.median_font_size(pages)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 13.0), ("b", 12.0), ("c", 12.0), ("d", 12.0), (None, 9.0)], key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + got._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_headings_put_only_labelled_pages_in_order(spark):
    rows = [("b", 1, "CHAPTER\nTwo\nThe title\nwords"), ("b", 2, "plain words\nof a page"), ("b", 3, "INTERLUDE\nwords"), (None, 1, "Part\n3\nmore words"), (None, 2, "Chapter 4: Start\nwords")]
    pages = spark.createDataFrame(rows, "book_id string, page_num int, text string")
    found = scoring.find_heading(pages)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("b", 1, "CHAPTER Two — The title"), ("b", 3, "INTERLUDE"), (None, 1, "Part 3 — more words"), (None, 2, "Chapter 4: Start")], key=repr)
    # pages are told by their lines before lines are ordered
    assert "exists(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_meet_only_lines_that_may_be_chosen(spark):
    pages = spark.createDataFrame([("b", 1, "CHAPTER\n7\nThe End"), ("b", 2, "a line of prose, far too plain for a heading, " * 9), ("b", 3, "Chapter 8: More\nwords")], "book_id string, page_num int, text string")
    got = scoring.score_pages(scoring.scored_lines(pages))
    assert sorted((r.book_id, r.page_num, r.title, r["pass"]) for r in got.collect()) == [("b", 1, "CHAPTER 7 — The End", 0), ("b", 3, "Chapter 8: More", 1)]
    assert "Filter (_best" in got._jdf.queryExecution().analyzed().toString()


def test_capitals_core_and_heading_starts_by_their_rules(spark):
    from quire.operators import compact

    c = F.col("t")
    letters, capitals = F.length(F.regexp_replace(c, "[^a-zA-Z]+", "")), F.length(F.regexp_replace(c, "[^A-Z]+", ""))
    caps = (letters >= 2) & (capitals / F.nullif(letters, F.lit(0)) >= 0.7)
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\\z", ""), "\r\n", "\n"), "[ \t]+", " ")
    core = F.regexp_replace(F.regexp_replace(one, "\n{3,}", "\n\n"), "^\n+|\n+\\z", "")
    name = F.coalesce(*(F.when(tx.matches(c, p), F.lit(n)) for n, p in tx.HEADINGS))
    texts = ["A" * (7 * k + i) + "b" * (3 * k + j) for k in range(40) for i in (0, 1) for j in (0, 1)] + ["a" * 70 + "B" * 400, "\t\t a  b \t\r\r\n\n\r\n\n", "\n\n\n", " \n\r", "a\r", "A", ""]
    heads = [f"{w}{tail}" for w in ("chapter 1", "Ch.2", "CHAPTER two", "12. A", "part iv", "\u017fection 3", "XI. a", "v. a", "prologue", "Epilogue", "introduction", "preface", "foreword", "conclusion", "afterword", "appendix", "acknowledgement", "bibliography", "interlude") for tail in ("", ":", " Ab", "x")]
    rows = spark.createDataFrame([(t,) for t in [*texts, *heads, *ODD]], "t string")
    assert rows.where(~tx.is_mostly_caps(c).eqNullSafe(caps) | ~compact._core(c).eqNullSafe(core) | ~tx.heading_pattern(c).eqNullSafe(name)).collect() == []
    # one pass over letters of both cases took most of the time
    assert "a-zA-Z" not in str(tx.is_mostly_caps(c)._jc)
