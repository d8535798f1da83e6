"""Chapters compressed by ranks and running sums against the column function over whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import compact, segment

PIECES = ["", " ", "\n", "\n\n", "\n\n\n", "\r\n", "\r", "\t", " ", "12345678901234567890123456789012", "short", "a paragraph that is long enough to count", "another one, somewhat longer than the first of them all", "x" * 70, "\n \n", "é" * 40, "  lead and trail by spaces, also long enough  "]


def books(spark, seed, n=40):
    rng = random.Random(seed)
    pages, member = [], []
    for b in range(n):
        for p in range(rng.randrange(1, 12)):
            text = rng.choice([None, "", "\n\n", " \n "]) if rng.random() < 0.25 else "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14)))
            pages.append((f"b{b}", p * 3, text))
            if rng.random() < 0.9:
                member.append((f"b{b}", p * 3, p // 5))
    return spark.createDataFrame(pages, "book_id string, page_num int, text string"), spark.createDataFrame(member, "book_id string, page_num int, chapter_index int")


@pytest.mark.parametrize(("seed", "target"), [(1, 60), (2, 150), (3, 400), (4, 15000)])
def test_same_as_whole_texts(spark, monkeypatch, seed, target):
    monkeypatch.setattr(compact, "PACK", 4)
    pages, member = books(spark, seed)
    want = {(r.book_id, r.chapter_index): r.t for r in compact.chapter_text(member, pages).select("book_id", "chapter_index", compact.compress_text(F.col("text"), target).alias("t")).collect()}
    got = {(r.book_id, r.chapter_index): r.text for r in compact.compress_chapters(member, pages, target).collect()}
    assert got == want


def test_repeats_and_long_pages(spark):
    """Repeated paragraphs do not fill the sample; a page of one long line gives its beginning; one paragraph gives its own."""
    line = "this very paragraph stands on each of the pages of the book"
    pages = [("rep", p, f"{line}\n\nand page {p} says something of its own, long enough") for p in range(900)]
    pages += [("long", 0, "  \n"), ("long", 1, "w " * 40000), ("long", 2, "w " * 9000 + "\n\n" + "v " * 9000), ("one", 0, "z" * 50000), ("digits", 1, ("1" * 50 + "\n\n") * 900)]
    df = spark.createDataFrame(pages, "book_id string, page_num int, text string")
    member = df.select("book_id", "page_num", F.lit(0).alias("chapter_index"))
    want = {r.book_id: r.t for r in compact.chapter_text(member, df).select("book_id", compact.compress_text(F.col("text")).alias("t")).collect()}
    got = {r.book_id: r.text for r in compact.compress_chapters(member, df).collect()}
    assert got == want and got["rep"].count(line) == 1 and len(got["rep"]) > 14000


def test_positions_in_blocks(spark, monkeypatch):
    """Chapters, sections and pages of them are the same however small the blocks of a book are."""
    pages = spark.createDataFrame([(f"b{b}", p, f"Chapter {p // 4}: X\nbody" if p % 4 == 0 else "text " * 90) for b in range(3) for p in range(1, 60 + b)], "book_id string, page_num int, text string")
    outline = spark.createDataFrame([(f"b{b}", s, f"T{s}", 1 + 7 * s) for b in range(2) for s in range(6)], "book_id string, seq int, title string, page_num int")

    def all_of():
        index = segment.page_index(pages)
        starts = pages.where("page_num % 5 = 2").select("book_id", "page_num", F.lit("t").alias("title"))
        ch = segment.segment_by_candidates(index, starts)
        out = [index, ch, segment.segment_by_outline(index, outline), segment.structural_breaks(pages), segment.page_chapter(pages, ch), segment.segment_by_patterns(pages)]
        return [sorted(map(tuple, df.collect())) for df in out]

    want = all_of()
    real = segment.spans.block_of
    monkeypatch.setattr(segment.spans, "block_of", lambda c, size=4096: real(c, 3))
    assert all_of() == want and len(want[1]) == 3 * 12
