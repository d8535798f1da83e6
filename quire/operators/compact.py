"""Chapters to text: grouping, sampling to a budget, chunking."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.functions import text as tx
from quire.operators import segment, spans
from quire.sources.shared import stored

#: Budgets and shares of the sample.
MAX_GROUPS, COMPRESSED, CHUNK, OVERLAP, LEAST_PARAGRAPH, BREAK_SHARE = 30, 15000, 14000, 150, 30, 0.6


def chapter_text(page_chapter: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, chapter_index, text: the pages' texts in page order with a blank line between."""
    x = page_chapter.join(pages.select("book_id", "page_num", "text"), ["book_id", "page_num"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n\n")
    return x.groupBy("book_id", "chapter_index").agg(joined.alias("text"))


def merge_groups(counts: list[int], most: int) -> list[int]:
    """Group of each chapter: while there are too many, the adjacent pair with the fewest pages (the first such) becomes one."""
    n = len(counts)
    after, before, size, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(counts), [True] * n
    heap = [(size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    left = n
    while left > most and heap:
        total, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or total != size[i] + size[j]:
            continue
        size[i], alive[j], after[i], left = total, False, after[j], left - 1
        if after[j] < n:
            before[after[j]] = i
            heapq.heappush(heap, (total + size[after[j]], i, after[j]))
        if before[i] >= 0:
            heapq.heappush(heap, (size[before[i]] + total, before[i], i))
    out, group = [], -1
    for a in alive:
        group += a
        out.append(group)
    return out


def group_chapters(chapters: DataFrame, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Chapters merged to at most max_groups a book: chapter_index, title of the left one, page range, n_pages, merged, merged_originals, first and last position."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def groups(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: merge_groups(list(c), max(1, max_groups)))

    row = F.struct("chapter_index", "title", "page_start", "page_end", "n_pages", "start_pos", "end_pos")
    book = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(row)).alias("c")).withColumn("g", groups(F.col("c.n_pages")))
    x = book.select("book_id", F.explode(F.arrays_zip("c", "g")).alias("z")).select("book_id", F.col("z.g").alias("chapter_index"), F.col("z.c").alias("c"))
    return x.groupBy("book_id", "chapter_index").agg(
        F.min_by("c.title", "c.chapter_index").alias("title"), F.min_by("c.page_start", "c.chapter_index").alias("page_start"), F.max_by("c.page_end", "c.chapter_index").alias("page_end"), F.sum("c.n_pages").cast("int").alias("n_pages"),
        (F.count("*") > 1).alias("merged"), F.transform(F.array_sort(F.collect_list("c")), lambda c: c["title"]).alias("merged_originals"), F.min("c.start_pos").alias("start_pos"), F.max("c.end_pos").alias("end_pos"), F.min("c.chapter_index").alias("first_index"), F.max("c.chapter_index").alias("last_index"),
    )


def compress_text(c: Column, target: int = COMPRESSED) -> Column:
    """The text within ``target`` characters: whole paragraphs from front, middle and back, each once, up to the first that does not fit."""

    def paragraphs(clean: Column) -> Column:
        return F.filter(F.transform(F.split(clean, "\n\n", -1), tx.trim), lambda p: (F.length(p) >= LEAST_PARAGRAPH) & ~p.rlike(tx.DIGITS))

    def sample(p: Column) -> Column:
        n = F.size(p)
        m = F.least(F.lit(6), F.ceil(n * 0.1).cast("int"))
        mid = (F.floor(n / 2) - F.floor(m / 2)).cast("int")
        back = F.ceil(n * 0.2).cast("int")
        some = F.array_distinct(F.concat(F.slice(p, F.lit(1), F.ceil(n * 0.5).cast("int")), F.slice(p, F.greatest(mid, F.lit(0)) + 1, m), F.slice(p, n - back + 1, back)))
        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def add(acc: Column, x: Column) -> Column:
            size = acc["size"] + F.when(acc["n"] == 0, 0).otherwise(2) + F.length(x)
            full = acc["full"] | (size > target)
            return F.struct(F.when(full, acc["size"]).otherwise(size).alias("size"), (acc["n"] + (~full).cast("int")).alias("n"), full.alias("full"))

        # how many fit is told by their lengths; they are joined once
        return tx.let(some, lambda s: F.array_join(F.slice(s, F.lit(1), F.aggregate(s, zero, add, lambda acc: acc["n"])), "\n\n"))

    def cut(clean: Column) -> Column:
        got = tx.let(paragraphs(clean), lambda p: F.when(F.size(p) == 0, F.lit("")).when(F.size(p) == 1, F.substring(F.get(p, F.lit(0)), 1, target)).otherwise(sample(p)))
        return F.when(F.length(clean) <= target, clean).otherwise(F.coalesce(F.nullif(got, F.lit("")), F.substring(clean, 1, target)))

    return tx.let(tx.normalize_text(c), cut)


def _paragraphs(core: Column) -> Column:
    """All paragraphs of a page as they are compared, good or not."""
    return F.transform(F.split(core, "\n\n", -1), tx.trim)


def _good(p: Column) -> Column:
    return (F.length(p) >= LEAST_PARAGRAPH) & ~p.rlike(tx.DIGITS)


def _where(has, pattern: str, by: str):
    """Replaces a pattern in the texts that ``has`` tells to hold it; most do not, and are not searched."""
    return lambda t: F.when(has(t), F.regexp_replace(t, pattern, by)).otherwise(t)


def _core(text: Column) -> Column:
    """A page's part of its chapter's clean text: pages are joined by a blank line, so line ends at its ends say nothing, nor does a carriage return that would meet one."""
    steps = (
        _where(lambda t: t.endswith("\r"), "\r\\z", ""),
        lambda t: F.replace(t, F.lit("\r\n"), F.lit("\n")),
        _where(lambda t: t.contains("\t") | t.contains("  "), "\t[ \t]*| [ \t]+", " "),
        _where(lambda t: t.contains("\n\n\n"), "\n{3,}", "\n\n"),
        _where(lambda t: t.startswith("\n") | t.endswith("\n"), "^\n+|\n+\\z", ""),
    )
    return reduce(tx.let, steps, F.coalesce(text, F.lit("")))


#: Ranks of one block of packing.
PACK = 512


def compress_chapters(page_chapter: DataFrame, pages: DataFrame, target: int = COMPRESSED) -> DataFrame:
    """book_id, chapter_index, text: what compress_text() makes of each chapter's text, without a chapter's text ever being one value.

    A paragraph never crosses pages. Pages give lengths and paragraphs' digests; front, middle and back are ranks in the chapter, repeats go by
    digest (128 bits), what fits is a running sum of lengths in two levels, and only what was chosen is read again: ``target`` characters a chapter, about.
    """
    key = ["book_id", "chapter_index"]
    core = _core(F.col("text"))
    digest = lambda p: F.struct(F.length(p).alias("n"), F.xxhash64(p).alias("h"), F.xxhash64(p, F.lit(1)).alias("g"), _good(p).alias("good"))
    facts = pages.select("book_id", "page_num", core.alias("core"))
    trimmed = tx.trim(F.col("core"))
    lead = F.length("core") - F.length(F.regexp_replace("core", rf"^{tx.WS}+", ""))
    facts = facts.select("book_id", "page_num", F.length("core").alias("n"), (trimmed == "").alias("blank"), lead.alias("lead"), (F.length("core") - lead - F.length(trimmed)).alias("trail"), F.filter(F.transform(_paragraphs(F.col("core")), lambda p, i: F.struct(i.alias("k"), digest(p).alias("p"))), lambda x: x["p"]["good"]).alias("ps"))
    facts = stored(page_chapter.select(*key, "page_num").join(facts, ["book_id", "page_num"]), "page-facts")

    # the clean text runs from the first page that says something to the last one
    ends = facts.where("not blank").groupBy(*key).agg(F.min("page_num").alias("first"), F.max("page_num").alias("last"), F.min_by("lead", "page_num").alias("lead0"), F.max_by("trail", "page_num").alias("trail0"))
    inside = facts.where("n > 0").join(ends, key).where("page_num between first and last")
    size = stored(inside.groupBy(*key, "first", "last", "lead0", "trail0").agg(F.sum(F.col("n") + 2).alias("size")).withColumn("size", F.col("size") - 2 - F.col("lead0") - F.col("trail0")), "chapter-sizes")
    fits = size.where(F.col("size") <= target)
    long = size.where(F.col("size") > target).select(*key, "first", "last", "lead0")

    # paragraphs of long chapters by rank
    p = facts.join(long.select(*key), key).select(*key, "page_num", F.explode("ps").alias("x")).select(*key, "page_num", "x.k", "x.p.n", "x.p.h", "x.p.g")
    p = spans.numbered(p, key, spans.block_of("page_num", 256), ["page_num", "k"]).withColumn("r", F.col("pos") - 1)
    n = F.col("of")
    m = F.least(F.lit(6), F.ceil(n * 0.1))
    mid = F.greatest(F.floor(n / 2) - F.floor(m / 2), F.lit(0))
    chosen = p.where((F.col("r") < F.ceil(n * 0.5)) | ((F.col("r") >= mid) & (F.col("r") < mid + m)) | (F.col("r") >= n - F.ceil(n * 0.2)))
    once = stored(chosen.groupBy(*key, "n", "h", "g").agg(F.min("r").alias("r"), F.min_by(F.struct("page_num", "k"), "r").alias("at"), F.first("of").alias("of")).withColumn("b", F.col("r").bitwiseAND(~(PACK - 1))), "paragraphs")
    blocks = once.groupBy(*key, "b").agg(F.sum(F.col("n") + 2).alias("s")).withColumn("before", F.sum("s").over(Window.partitionBy(*key).orderBy("b")) - F.col("s")).where(F.col("before") <= target)
    packed = once.join(blocks, [*key, "b"]).withColumn("upto", F.col("before") + F.sum(F.col("n") + 2).over(Window.partitionBy(*key, "b").orderBy("r")) - 2)
    take = stored(packed.where((F.col("upto") <= target) | (F.col("of") == 1)).select(*key, "r", "at.page_num", "at.k"), "packed")
    asked = take.groupBy("book_id", "page_num", "chapter_index").agg(F.collect_list(F.struct("r", "k")).alias("ks"))
    got = pages.select("book_id", "page_num", "text").join(asked, ["book_id", "page_num"]).withColumn("core", core).withColumn("ps", _paragraphs(F.col("core"))).select(*key, F.explode(F.transform("ks", lambda x: F.struct(x["r"].alias("r"), F.get(F.col("ps"), x["k"]).alias("t")))).alias("x"))
    sampled = got.groupBy(*key).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n"), 1, target).alias("text"))

    # short chapters whole, and the beginning of long ones of which no paragraph fits
    bare = long.join(take.select(*key).distinct(), key, "left_anti")
    at = inside.select(*key, "page_num", "n").join(bare, key).withColumn("b", spans.block_of("page_num"))
    by = at.groupBy(*key, "b").agg(F.sum(F.col("n") + 2).alias("s")).withColumn("before", F.sum("s").over(Window.partitionBy(*key).orderBy("b")) - F.col("s"))
    most = F.col("lead0") + target
    begun = at.join(by, [*key, "b"]).where(F.col("before") < most).withColumn("off", F.col("before") + F.sum(F.col("n") + 2).over(Window.partitionBy(*key, "b").orderBy("page_num")) - F.col("n") - 2).where(F.col("off") < most)
    whole = inside.select(*key, "page_num").join(fits.select(*key), key).withColumn("most", F.lit(None).cast("int")).unionByName(begun.select(*key, "page_num", most.cast("int").alias("most")))
    texts = pages.select("book_id", "page_num", "text").join(whole, ["book_id", "page_num"]).withColumn("core", core).withColumn("core", F.when(F.col("most").isNull(), F.col("core")).otherwise(F.substr("core", F.lit(1), F.col("most"))))
    plain = texts.groupBy(*key, "most").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "core"))), lambda x: x["core"]), "\n\n").alias("t"))
    plain = plain.select(*key, F.when(F.col("most").isNull(), tx.trim(F.col("t"))).otherwise(F.substring(F.regexp_replace("t", rf"^{tx.WS}+", ""), 1, target)).alias("text"))
    every = page_chapter.select(*key).distinct()
    return every.join(sampled.unionByName(plain), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def cuts(text: str, target: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece: cut at the target, or at the last blank line before it if that is beyond three fifths; the next piece goes back by the overlap."""
    out, at, size = [], 0, len(text)
    while at < size:
        end = stop = min(at + target, size)
        if end < size:
            blank = text.rfind("\n\n", 0, end + 2)
            if blank > at + target * BREAK_SHARE:
                stop = blank
        out.append((at, stop))
        at = stop - overlap if stop - overlap > at else stop
    return out


def chunk_chapters(chapters: DataFrame, target: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of (book_id, chapter_index, title, page_start, page_end, text): trimmed and not empty, numbered from 0; a blank chapter has one empty chunk."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"a": a, "b": b} for a, b in cuts(t or "", target, overlap)])

    text = F.coalesce("text", F.lit(""))
    pieces = F.filter(F.transform(cut(text), lambda s: tx.trim(F.substr(text, s["a"] + 1, s["b"] - s["a"]))), lambda t: t != "")
    pieces = F.when(tx.trim(text) == "", F.array(F.lit(""))).otherwise(pieces)
    x = chapters.select("book_id", "chapter_index", F.col("title").alias("chapter_title"), "page_start", "page_end", F.posexplode(pieces).alias("chunk_index", "text"))
    return x.select(F.concat_ws("-", "book_id", F.col("chapter_index").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "book_id", "chapter_index", "chunk_index", "chapter_title", "page_start", "page_end", "text", F.lit(None).cast("string").alias("summary"))


def with_text(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters with their text; a chapter without pages has an empty one."""
    t = chapter_text(segment.page_chapter(pages, chapters), pages)
    return chapters.join(t, ["book_id", "chapter_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def prepare_books(pages: DataFrame, outline: DataFrame | None = None, filenames: DataFrame | None = None, prior: DataFrame | None = None, now_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """(books, chapters) ready for the model: grouped, sampled, status ``extracted``; a prior title and created_at stay.

    filenames: book_id, filename (the id, where none is given); prior: id, title, created_at.
    """
    raw = stored(segment.detect_chapters(pages, outline), "chapters")
    grouped = group_chapters(raw)
    member = segment.page_chapter(pages, raw).join(grouped.select("book_id", F.col("chapter_index").alias("g"), F.explode(F.sequence("first_index", "last_index")).alias("chapter_index")), ["book_id", "chapter_index"]).select("book_id", "page_num", F.col("g").alias("chapter_index"))
    texts = compress_chapters(member, pages).withColumnRenamed("text", "compressed_text")
    ch = grouped.join(texts, ["book_id", "chapter_index"], "left").select(
        F.concat_ws("-ch-", "book_id", F.col("chapter_index").cast("string")).alias("id"), "book_id", F.col("chapter_index").alias("index"), "title", "page_start", "page_end", F.coalesce("compressed_text", F.lit("")).alias("compressed_text"), F.lit(False).alias("ai_processed"), F.lit(None).cast("string").alias("summary"),
    )
    n = grouped.groupBy("book_id").agg(F.count("*").cast("int").alias("chapters")).join(pages.groupBy("book_id").agg(F.count("*").cast("int").alias("pages")), "book_id")
    names = filenames if filenames is not None else pages.select("book_id").distinct().withColumn("filename", F.col("book_id"))
    b = n.join(names, "book_id", "left")
    if prior is not None:
        b = b.join(prior.select(F.col("id").alias("book_id"), F.col("title").alias("_t"), F.col("created_at").alias("_c")), "book_id", "left")
    else:
        b = b.withColumn("_t", F.lit(None).cast("string")).withColumn("_c", F.lit(None).cast("long"))
    return b.select(
        F.col("book_id").alias("id"), F.coalesce(F.nullif("_t", F.lit("")), tx.infer_title(F.col("filename"))).alias("title"), "filename", F.col("pages").alias("page_count"), F.col("chapters").alias("chapter_count"), F.lit(None).cast("string").alias("summary"), F.lit("extracted").alias("status"),
        F.coalesce(F.nullif("_c", F.lit(0)), F.lit(now_ms)).cast("long").alias("created_at"), F.struct("pages", "chapters", (F.col("chapters") + 1).alias("ai_calls_total"), F.lit(0).alias("ai_calls_done")).alias("pipeline_metrics"),
    ), ch
