"""Chapters, text and helpers on literal books; SQL agreement is in test_oracles."""

import pytest

from quire.functions import text as tx
from quire.operators import compact, layout, segment

SPARSE = "This page has a short paragraph of plain prose under it, well below any limit."
DENSE = "The quick brown fox jumps over the lazy dog near the river bank today. " * 16


def book(spark, pages):
    return spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(pages)], "book_id string, page_num int, text string")


def chapters(spark, pages, outline=None):
    rows = segment.detect_chapters(book(spark, pages), outline).orderBy("chapter_index").collect()
    return rows[0].strategy, [(r.title, r.page_start, r.page_end) for r in rows]


def test_numbered_chapters_and_front_matter(spark):
    strategy, got = chapters(spark, ["Title page", "Chapter 1: One\n" + SPARSE, SPARSE, "Chapter 2: Two\n" + SPARSE, SPARSE, SPARSE])
    assert strategy == "numbered-sequence" and got == [("Chapter 1: One", 1, 3), ("Chapter 2: Two", 4, 6)]


def test_no_headings(spark):
    assert chapters(spark, ["just some lower case prose. " + SPARSE.lower()] * 4)[0] == "single-section"
    strategy, got = chapters(spark, [DENSE.lower()] * 50)
    assert strategy == "n-page-sections" and len(got) == 5 and got[0] == ("Section 1 (pp. 1–10)", 1, 10)


def test_outline_wins(spark):
    marks = spark.createDataFrame([("b", 0, "A", 2), ("b", 1, "B", 5), ("b", 2, "C", 5)], "book_id string, seq int, title string, page_num int")
    assert chapters(spark, [DENSE] * 8, marks) == ("pdf-outline", [("A", 2, 4), ("C", 5, 8)])


@pytest.mark.parametrize(("counts", "most", "want"), [([3, 2, 5], 2, [0, 0, 1]), ([3, 4, 2], 1, [0, 0, 0]), ([1, 1, 1, 1], 3, [0, 0, 1, 2]), ([], 3, []), ([5], 1, [0])])
def test_merge_groups(counts, most, want):
    assert compact.merge_groups(counts, most) == want


def test_merge_groups_is_the_plain_loop():
    import random

    rng = random.Random(4)
    for _ in range(200):
        counts, most = [rng.randint(1, 6) for _ in range(rng.randint(1, 25))], rng.randint(1, 8)
        groups = [[i] for i in range(len(counts))]
        size = list(counts)
        while len(groups) > most:
            i = min(range(len(groups) - 1), key=lambda k: (size[k] + size[k + 1], k))
            groups[i : i + 2] = [groups[i] + groups[i + 1]]
            size[i : i + 2] = [size[i] + size[i + 1]]
        assert compact.merge_groups(counts, most) == [g for g, members in enumerate(groups) for _ in members]


def test_cuts():
    assert compact.cuts("") == [] and compact.cuts("x" * 100) == [(0, 100)]
    assert compact.cuts("x" * 151) == [(0, 151), (1, 151)]
    assert [e for _, e in compact.cuts("a" * 9000 + "\n\n" + "b" * 9000)][0] == 9000
    assert compact.cuts("a" * 100 + "\n\n" + "b" * 20000)[0] == (0, 14000)


def test_leader_buckets():
    assert layout.leader_buckets([10, 13, 16, 12.9, 700, 703, 703.1], 3.0) == [0, 0, 1, 0, 2, 2, 3]


def test_titles_and_numbers(spark):
    rows = ["my-first_book.pdf", "élan vital.PDF", "a b"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    assert [r[0] for r in df.select(tx.infer_title(df.s)).collect()] == ["My First Book", "éLan Vital", "A B"]
    nums = ["Chapter Seven", "CHAPTER XII — End", "Part Three: x", "IV. Title", "7. Title", "Chapter of", "part IIX"]
    df = spark.createDataFrame([(r,) for r in nums], "s string")
    got = [r[0] and tuple(r[0]) for r in df.select(tx.extract_chapter_num(df.s)).collect()]
    assert got == [(7, "chapter"), (12, "chapter"), (3, "part"), (4, "roman"), (7, "arabic-bare"), None, (8, "part")]
