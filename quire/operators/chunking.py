"""Chapters to chunks, without a chapter's text ever being one value.

Where a chunk ends depends on where it starts, and where it starts on the chunk before it. So blocks of a chapter's characters are worked out
apart from one another: each tells, for every place at which a chunk may enter it, where the first chunk behind it starts. These tables are short, as
chunks that end at the same blank line go on alike; following them from block to block tells where each block is entered, and all blocks
are then cut at once. Chunks meet their pages by cells of characters, and only a chunk's own characters are joined.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.operators import segment, spans
from quire.operators.compact import BREAK_SHARE, CHUNK, OVERLAP
from quire.sources.shared import stored

#: Characters of one block, and of one cell in which chunks meet pages.
BLOCK, CELL = 1 << 20, 1 << 14
KEY = ["book_id", "chapter_index"]
#: What blank_places() finds, as a pattern.
BLANK = re.compile("(?=\n\n)")
STEPS = "array<struct<at:bigint,to:bigint,slope:int>>"


def steps(at: np.ndarray, blanks: np.ndarray, size: int, target: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For chunks that start at ``at``: where they end, and where the next ones start. ``blanks`` are sorted."""
    end = np.minimum(at + target, size)
    i = np.searchsorted(blanks, end, side="right") - 1
    blank = np.where(i >= 0, blanks[np.maximum(i, 0)], -1) if len(blanks) else np.full(len(at), -1)
    stop = np.where((end < size) & (blank > at + target * BREAK_SHARE), blank, end)
    return stop, np.where(stop - overlap > at, stop - overlap, stop)


def passage(block: int, blanks: np.ndarray, size: int, target: int, overlap: int, length: int) -> list[tuple[int, int, int]]:
    """Where chunks that enter a block leave it, as pieces (at, to, slope): an entry at ``at`` or up to the next piece leaves at ``to``, plus its distance from ``at`` if slope is 1."""
    begin = block * length
    entry = np.arange(begin, min(begin + target, size), dtype=np.int64)
    to = entry.copy()
    while (inside := to < min(begin + length, size)).any():
        # entries that have come together go on as one
        some, back = np.unique(to[inside], return_inverse=True)
        to[inside] = steps(some, blanks, size, target, overlap)[1][back]
    d = np.diff(to)
    flat = (d == 0) | (d == 1)
    starts = np.ones(len(to), dtype=bool)
    starts[1:] = ~flat
    starts[1:-1] |= flat[1:] & (d[:-1] != d[1:])
    slope = np.append(np.where(flat, d, 0), 0)
    return [(int(entry[i]), int(to[i]), int(slope[i])) for i in np.flatnonzero(starts)]


def entries(passages: list[tuple[int, list[tuple[int, int, int]]]], length: int) -> list[tuple[int, int]]:
    """(block, first chunk's start) of the blocks that are entered, from the passages of all blocks but the last."""
    table = {block: ([p[0] for p in pieces], pieces) for block, pieces in passages}
    out, at, block = [(0, 0)], 0, 0
    while block in table:
        starts, pieces = table[block]
        start, to, slope = pieces[bisect_right(starts, at) - 1]
        at = to + slope * (at - start)
        block = at // length
        out.append((block, at))
    return out


def cuts_within(at: int, block: int, blanks: np.ndarray, size: int, target: int, overlap: int, length: int) -> list[tuple[int, int]]:
    """Start and end of the chunks that start in a block, the first of them at ``at``."""
    out = []
    while at < min((block + 1) * length, size):
        stop, after = (int(x[0]) for x in steps(np.array([at], dtype=np.int64), blanks, size, target, overlap))
        out.append((at, stop))
        at = after
    return out


def blank_places(text: str) -> list[int]:
    """Where two line ends follow one another: a search from place to place, not a test at each character."""
    out, at = [], text.find("\n\n")
    while at >= 0:
        out.append(at)
        at = text.find("\n\n", at + 1)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _blank_lines(texts: pd.Series) -> pd.Series:
    return texts.map(blank_places)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(texts: pd.Series, asked: pd.Series) -> pd.Series:
    return pd.Series([[t[x["lo"] : x["hi"]] for x in some] for t, some in zip(texts, asked, strict=True)], dtype=object)


def _page_part(text: Column) -> Column:
    """A page as it stands in its chapter, with the blank line to the next one."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n"))


def placed_pages(page_chapter: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, chapter_index, page_num, off (characters of the chapter before the page), len (its own, with the blank line behind it unless it is the last), size (of the chapter), blanks (places in the chapter where two line ends follow one another)."""
    part = _page_part(F.col("text"))
    facts = pages.select("book_id", "page_num", F.length(part).alias("len"), _blank_lines(part).alias("at"), part.startswith("\n").alias("begins"))
    facts = page_chapter.select(*KEY, "page_num").join(facts, ["book_id", "page_num"])
    x = spans.summed(facts, KEY, spans.block_of("page_num"), ["page_num"], "len", "off", "size").withColumn("size", F.col("size") - 2)
    x = x.withColumn("len", F.least("len", F.col("size") - F.col("off")))
    # a line end that begins a page follows the one before it
    first = F.when(F.col("begins") & (F.col("off") > 0) & (F.col("len") > 0), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    blanks = F.transform(F.concat(first, F.filter("at", lambda i: i + 2 <= F.col("len"))), lambda i: F.col("off") + i)
    return stored(x.select(*KEY, "page_num", "off", "len", "size", blanks.alias("blanks")), "chunk-pages")


def chapter_cuts(placed: DataFrame, target: int = CHUNK, overlap: int = OVERLAP, length: int = BLOCK) -> DataFrame:
    """book_id, chapter_index, a, b: start and end of each chunk in its chapter: cut at the target, or at the last blank line before it if that is beyond three fifths; the next chunk goes back by the overlap."""
    number = lambda x: np.asarray(x, dtype=np.int64)

    @F.pandas_udf(STEPS)
    def passages(block: pd.Series, blanks: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([[{"at": a, "to": t, "slope": s} for a, t, s in passage(b, number(x), n, target, overlap, length)] for b, x, n in zip(block, blanks, size, strict=True)], dtype=object)

    @F.pandas_udf("array<struct<block:bigint,entry:bigint>>")
    def entered(all_of: pd.Series) -> pd.Series:
        return all_of.map(lambda rows: [{"block": b, "entry": e} for b, e in entries([(r["block"], [(p["at"], p["to"], p["slope"]) for p in r["pieces"]]) for r in rows], length)])

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def cut(entry: pd.Series, block: pd.Series, blanks: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": z} for a, z in cuts_within(e, b, number(x), n, target, overlap, length)] for e, b, x, n in zip(entry, block, blanks, size, strict=True)], dtype=object)

    last = F.floor((F.col("size") - 1) / length)
    at = placed.select(*KEY, F.explode("blanks").alias("at"))
    # chunks that start in a block may end at a blank line behind it
    reach = F.sequence(F.greatest(F.floor((F.col("at") - target) / length), F.lit(0).cast("long")), F.floor(F.col("at") / length))
    held = at.select(*KEY, "at", F.explode(reach).alias("block")).groupBy(*KEY, "block").agg(F.array_sort(F.collect_list("at")).alias("blanks"))
    blocks = placed.where("size > 0").groupBy(*KEY).agg(F.first("size").alias("size")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = stored(blocks.join(held, [*KEY, "block"], "left").withColumn("blanks", F.coalesce("blanks", F.array().cast("array<bigint>"))), "chunk-blocks")
    through = blocks.where(F.col("block") < last).select(*KEY, F.struct("block", passages("block", "blanks", "size").alias("pieces")).alias("p"))
    met = through.groupBy(*KEY).agg(F.collect_list("p").alias("ps")).select(*KEY, F.explode(entered("ps")).alias("e")).select(*KEY, "e.block", "e.entry")
    found = blocks.where(last == 0).withColumn("entry", F.lit(0).cast("long")).unionByName(blocks.where(last > 0).join(met, [*KEY, "block"]))
    return found.select(*KEY, F.explode(cut("entry", "block", "blanks", "size")).alias("c")).select(*KEY, "c.a", "c.b")


def chunk_pages(chapters: DataFrame, page_chapter: DataFrame, pages: DataFrame, target: int = CHUNK, overlap: int = OVERLAP, length: int = BLOCK) -> DataFrame:
    """What compact.chunk_chapters() makes of the chapters' whole texts: trimmed chunks that are not empty, numbered from 0; a blank chapter, or one without pages, has one empty chunk.

    No value is longer than a page or a chunk, and a chapter is cut by as many tasks as it has blocks of ``length`` characters.
    """
    placed = placed_pages(page_chapter, pages)
    cuts = chapter_cuts(placed, target, overlap, length)
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL)))
    p = placed.where("len > 0").select(*KEY, "page_num", "off", (F.col("off") + F.col("len")).alias("end")).withColumn("cell", cells("off", "end"))
    c = cuts.withColumn("cell", cells("a", "b"))
    both = p.join(c, [*KEY, "cell"]).where((F.col("a") < F.col("end")) & (F.col("b") > F.col("off")) & (F.col("cell") == F.floor(F.greatest("a", "off") / CELL)))
    part = F.struct("a", (F.greatest("a", "off") - F.col("off")).cast("int").alias("lo"), (F.least("b", "end") - F.col("off")).cast("int").alias("hi"))
    asked = both.groupBy(*KEY, "page_num").agg(F.collect_list(part).alias("asked"))
    got = pages.select("book_id", "page_num", _page_part(F.col("text")).alias("t")).join(asked, ["book_id", "page_num"])
    got = got.select(*KEY, "page_num", F.explode(F.arrays_zip(F.col("asked.a").alias("a"), _pieces("t", "asked").alias("t"))).alias("x")).select(*KEY, "x.a", F.struct("page_num", "x.t").alias("x"))
    joined = got.groupBy(*KEY, "a").agg(tx.trim(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "")).alias("text")).where("text <> ''")
    numbered = spans.numbered(stored(joined, "chunk-texts"), KEY, spans.block_of("a", length), ["a"]).select(*KEY, (F.col("pos") - 1).cast("int").alias("n"), "text")
    x = chapters.select(*KEY, F.col("title").alias("chapter_title"), "page_start", "page_end").join(numbered, KEY, "left").withColumn("chunk_index", F.coalesce("n", F.lit(0)))
    return x.select(F.concat_ws("-", "book_id", F.col("chapter_index").cast("string"), F.col("chunk_index").cast("string")).alias("id"), *KEY, "chunk_index", "chapter_title", "page_start", "page_end", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast(T.StringType()).alias("summary"))


def build_chunks(pages: DataFrame) -> DataFrame:
    chapters = stored(segment.detect_chapters(pages), "chapters")
    return chunk_pages(chapters, segment.page_chapter(pages, chapters), pages)
