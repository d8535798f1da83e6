"""Chapters cut in blocks against the plain loop over whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, compact
from tests.test_compress import books


@pytest.mark.parametrize("seed", range(6))
def test_blocks_of_characters(seed):
    """Cuts of a text are those of the plain loop, whatever the blocks' length: with many blank lines, with few and with none."""
    rng = random.Random(seed)
    for _ in range(60):
        size, rate = rng.randrange(1, 4000), rng.choice([0, 0.001, 0.02, 0.3])
        text = "".join("\n" if rng.random() < rate**0.5 else "x" for _ in range(size))
        target = rng.randrange(1, 300)
        overlap = rng.choice([0, 1, target // 10, target // 2, target, 2 * target])
        length = rng.choice([50, 333, 1000, 5000])
        blanks = [m.start() for m in chunking.BLANK.finditer(text)]

        def reached(block):
            return np.array([x for x in blanks if x > block * length and x <= (block + 1) * length + target], dtype=np.int64)

        last = (size - 1) // length
        passages = [(b, chunking.passage(b, reached(b), size, target, overlap, length)) for b in range(last)]
        got = [c for b, e in chunking.entries(passages, length) for c in chunking.cuts_within(e, b, reached(b), size, target, overlap, length)]
        assert got == compact.cuts(text, target, overlap)


def test_passage_is_short():
    """Entries that meet at a blank line go on alike; without blank lines the passage is one shift."""
    n = 1 << 20
    assert len(chunking.passage(3, np.array([], dtype=np.int64), 5 * n, 14000, 150, n)) <= 3
    assert len(chunking.passage(3, np.arange(3 * n, 4 * n + 14000, 700), 5 * n, 14000, 150, n)) <= 60


@pytest.mark.parametrize(("seed", "target", "overlap", "length"), [(1, 40, 5, 64), (2, 120, 150, 100), (3, 90, 0, 1000), (4, 14000, 150, 1 << 20)])
def test_same_as_whole_texts(spark, monkeypatch, seed, target, overlap, length):
    """Null, empty and blank pages, pages that begin or end with line ends, chapters without pages, small cells and blocks."""
    monkeypatch.setattr(chunking, "CELL", 50)
    pages, member = books(spark, seed)
    chapters = member.select("book_id", "chapter_index").distinct().union(spark.createDataFrame([("b0", 99), ("none", 0)], "book_id string, chapter_index int")).withColumns({"title": F.concat(F.lit("T"), F.col("chapter_index").cast("string")), "page_start": F.lit(1), "page_end": F.lit(2)})
    whole = chapters.join(compact.chapter_text(member, pages), ["book_id", "chapter_index"], "left")
    want = sorted(map(tuple, compact.chunk_chapters(whole, target, overlap).drop("summary").collect()))
    got = chunking.chunk_pages(chapters, member, pages, target, overlap, length)
    assert sorted(map(tuple, got.drop("summary").collect())) == want and got.columns == compact.chunk_chapters(whole).columns


def test_long_chapter_meets_many_tasks(spark):
    """A chapter of four blocks and one long page; no row of the cuts' plan is longer than a block."""
    rng = random.Random(7)
    pages = [("b", p, "".join(rng.choice(["word ", "a longer bit of text. ", "\n", "\n\n"]) for _ in range(1500))) for p in range(150)] + [("b", 150, "w " * 700_000 + "\n\n" + "é" * 90_000)]
    df = spark.createDataFrame(pages, "book_id string, page_num int, text string")
    member = df.select("book_id", "page_num", F.lit(0).alias("chapter_index"))
    text = "\n\n".join(t for _, _, t in pages)
    cuts = [tuple(r) for r in chunking.chapter_cuts(chunking.placed_pages(member, df)).select("a", "b").orderBy("a").collect()]
    assert cuts == compact.cuts(text) and len(text) > 3 << 20


def test_no_pages(spark):
    none = spark.createDataFrame([], "book_id string, page_num int, text string")
    chapters = spark.createDataFrame([("b", 0, "T", 1, 1)], "book_id string, chapter_index int, title string, page_start int, page_end int")
    got = chunking.chunk_pages(chapters, none.select("book_id", "page_num", F.lit(0).alias("chapter_index")), none).collect()
    assert [(r.id, r.text) for r in got] == [("b-0-0", "")]


def test_blank_places_by_their_pattern():
    for text in ("", "\n", "\n\n", "\n\n\n", "a\n\nb\n\n\n\nc\n", "x" * 50 + "\n\n"):
        assert chunking.blank_places(text) == [m.start() for m in chunking.BLANK.finditer(text)]
