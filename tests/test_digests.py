"""Digests made before pages are numbered, and without lines that nothing chooses, lead to the same headings."""

from pyspark.sql import functions as F

from quire.operators import profile, scoring, segment
from quire.plans import views

LONG, CAPS = "a line of plain prose that is no heading " * 4, "CAPITALS OF A LINE " * 8
TEXTS = [
    "", " \n\n", "one\ntwo", "CHAPTER\n7\nThe End\n" + LONG, f"CHAPTER\n{LONG}\n7\nThe End", f"Part\nThree\n{LONG}\nlast", f"CHAPTER\n8\n{LONG * 3}\nThe End " + "w " * 300, CAPS, CAPS + "\n" + "word " * 300, f"{LONG}\nChapter 3: Here\n" + "word " * 260,
    "\n".join(f"line {i}" for i in range(40)), "\n".join(["INTERLUDE", *[LONG] * 20]), "　Prologue﻿\r\n" + LONG, f"{LONG * 9}\n12. Apples\n{'x' * 121}\n{'y' * 120}",
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def book(spark):
    return spark.createDataFrame([(b, i, t) for b in ("a", None) for i, t in enumerate([*TEXTS, None])], "book_id string, page_num int, text string")


def test_first_lines_of_digests(spark):
    for use in (None, lambda t, n: F.length(t) <= 120):
        for line in ("", "Chapter 3: EN\n", " \n", "x" * 119 + "\n", "I\n", None):
            body = book(spark)
            own = profile.with_first_line(profile.page_digest(body, use), F.lit(line).cast("string"))
            whole = profile.page_digest(body.withColumn("text", F.concat(F.lit(line).cast("string"), "text")), use)
            assert own.columns == whole.columns and rows(own) == rows(whole)


def test_books_are_numbered_by_digests_and_no_text_is_shuffled(spark, sf):
    own, whole = views.book_digests(spark, sf), profile.page_digest(views.book_pages(spark, sf), scoring.may_be_chosen)
    assert own.columns == whole.columns and rows(own) == rows(whole) and own.count() > 50
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    # the digest stands below the window, on what is read
    assert plan.index("Window [") < plan.index("regexp_extract_all(text")


def test_lines_that_nothing_chooses_are_no_rows(spark):
    pages = book(spark)
    whole, short = profile.page_digest(pages), profile.page_digest(pages, scoring.may_be_chosen)
    assert rows(scoring.find_heading(short)) == rows(scoring.find_heading(whole)) != []
    a, b = scoring.scored_lines(whole), scoring.scored_lines(short)
    assert rows(b) == rows(a.where(scoring.may_be_chosen(F.col("text"), F.col("n_words")))) and b.count() < a.count()
    some = lambda x: rows(scoring.score_pages_at(x, (40, 25)))
    assert some(a) == some(b) and any(r[4] > 0 and len(r[3]) > 120 for r in some(b))
    assert rows(segment.stage_chapters(short)) == rows(segment.stage_chapters(whole))


def test_rich_lines_that_nothing_chooses(spark):
    line = "struct<text:string,y:double,x:double,line_width:double,font_size:double,bold:boolean,italic:boolean>"
    made = lambda t, i: None if t == "none" else (t, 792.0 - 20 * i, 72.0, 468.0, 12.0 + i % 3, False, False)
    texts = [["CHAPTER", "7", None, "x"], ["CHAPTER", "7", "none", "x"], ["CHAPTER", "7", LONG, "x"], ["CHAPTER", LONG, "7"], [CAPS, LONG], [" " * 130 + "Chapter 9: Deep"], []]
    pages = spark.createDataFrame([("a", 2 * k + j, " ".join(["word"] * n), 612.0, 792.0, [made(t, i) for i, t in enumerate(ts)]) for k, ts in enumerate(texts) for j, n in enumerate((10, 300))], f"book_id string, page_num int, text string, width double, height double, lines array<{line}>")
    context = profile.book_context(pages)
    plain = scoring.score_lines(scoring.page_lines(pages, context), profile.header_lines(pages))
    short = scoring.scored_lines(profile.page_digest(pages, scoring.may_be_chosen), context)
    assert rows(short) == rows(plain.where(scoring.may_be_chosen(F.col("text"), F.col("n_words"))).select(short.columns)) and short.count() < plain.count()
    some = lambda x: rows(scoring.score_pages_at(x, (40, 25)))
    assert some(short) == some(plain)
