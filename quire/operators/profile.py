"""Per-book profile: font median, page size, repeated edge lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.sources.shared import stored

#: Fixed values of the profile.
DEFAULT_FONT, DEFAULT_WIDTH, DEFAULT_HEIGHT = 12.0, 612.0, 792.0
RUNNING_SHARE, RUNNING_LEAST, EVERY_SHARE = 0.20, 3, 0.60


def _has(pages: DataFrame, name: str) -> bool:
    return name in pages.columns


#: Lines from a page's top that any operator looks at, with the one after them, and edge lines at top and end.
TOP, EDGE_HEAD, EDGE_TAIL = 15, 12, 3


#: Whether a line is of use, by the line and its page's number of words.
Use = Callable[[Column, Column], Column]


def page_digest(pages: DataFrame, use: Use | None = None) -> DataFrame:
    """What the cascade needs of each page, without its text: n_words, n_lines, top (first lines), head and tail (first and last edge lines); of rich pages width, height, the first lines and n_rich.

    Every operator that takes pages takes this as well. A text is split and trimmed once. ``use`` tells which of the first lines the caller looks at: of others the place and the look stay, and the text is null.
    """
    return text_digest(pages, ["book_id", "page_num", *(c for c in ("width", "height") if _has(pages, c))], use)


def text_digest(texts: DataFrame, keep: list[str], use: Use | None = None) -> DataFrame:
    """The columns ``keep`` and the digest of rows that need not be pages yet, as where page numbers are given to digests in place of texts."""
    # a rich line without a text has an empty one, so that only what is of no use is null
    said = lambda l: F.coalesce(l["text"], F.lit(""))
    rich = [F.slice("lines", 1, TOP).alias("lines"), F.size("lines").alias("n_rich")] if _has(texts, "lines") else []
    lines = texts.select(*keep, tx.word_count(F.col("text")).alias("n_words"), tx.split_lines(F.col("text")).alias("_l"), *rich)
    edges = lines.withColumn("_e", F.filter("_l", edge_length))
    top, rest = F.slice("_l", 1, TOP), [c for c in lines.columns if c != "_l"]
    if use:
        top = F.transform(top, lambda t: F.when(use(t, F.col("n_words")), t))
    if rich:
        kept = lambda l: F.when(use(tx.trim(said(l)), F.col("n_words")), said(l)) if use else said(l)
        rest = [F.transform("lines", lambda l: l.withField("text", kept(l))).alias(c) if c == "lines" else F.col(c) for c in rest]
    return edges.select(*rest, F.size("_l").alias("n_lines"), top.alias("top"), F.slice("_e", 1, EDGE_HEAD).alias("head"), _last(F.col("_e"), EDGE_TAIL).alias("tail"))


def with_first_line(digests: DataFrame, line: Column) -> DataFrame:
    """The digests of the same texts with ``line`` and a line end before them: a blank line adds none, and null makes a text null."""
    own = {"n_words", "n_lines", "top", "head", "tail"}
    x = digests.withColumn("_f", tx.split_lines(line)).withColumn("_fe", F.filter("_f", edge_length))
    n = F.when(F.col("_f").isNull(), F.size("_f")).otherwise(F.col("n_lines") + F.size("_f"))
    return x.select(*(c for c in digests.columns if c not in own), (F.col("n_words") + tx.word_count(line)).alias("n_words"), n.alias("n_lines"), F.slice(F.concat("_f", "top"), 1, TOP).alias("top"), F.slice(F.concat("_fe", "head"), 1, EDGE_HEAD).alias("head"), _last(F.concat("_fe", "tail"), EDGE_TAIL).alias("tail"))


def digested(pages: DataFrame, use: Use | None = None) -> DataFrame:
    """The pages' digest, written once if they are none yet: what reads them more than once reads no text again."""
    return pages if _has(pages, "top") else stored(page_digest(pages, use), "digests")


def edge_length(line: Column) -> Column:
    return (F.length(line) > 1) & (F.length(line) < 120)


def _last(lines: Column, n: int) -> Column:
    return F.when(F.size(lines) > 0, F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), n)).otherwise(lines)


def words(pages: DataFrame) -> Column:
    return F.col("n_words") if _has(pages, "n_words") else tx.word_count(F.col("text"))


def top_lines(pages: DataFrame, n: int) -> Column:
    """The first n (TOP at most) lines of the text that are not blank."""
    return F.slice(F.col("top") if _has(pages, "top") else tx.split_lines(F.col("text")), 1, n)


def median_font_size(pages: DataFrame) -> DataFrame:
    """book_id, median_font_size: exact median of positive line sizes, 12 where there is none.

    Sizes are counted first, so that a book's lines meet as a few (size, count) rows; pages without sizes count as one that is null, so that they are read once.
    """
    if not _has(pages, "lines"):
        return pages.select("book_id").distinct().withColumn("median_font_size", F.lit(DEFAULT_FONT))
    sizes = pages.select("book_id", F.explode_outer("lines.font_size").alias("size")).withColumn("size", F.when(F.col("size") > 0, F.col("size"))).groupBy("book_id", "size").count()
    med = F.percentile(F.col("size"), F.lit(0.5), F.col("count"))
    return sizes.groupBy("book_id").agg(F.coalesce(med, F.lit(DEFAULT_FONT)).alias("median_font_size"))


def page_dimensions(pages: DataFrame) -> DataFrame:
    """book_id, page_width, page_height of the first page that has both."""
    if not _has(pages, "width"):
        return pages.select("book_id").distinct().select("book_id", F.lit(DEFAULT_WIDTH).alias("page_width"), F.lit(DEFAULT_HEIGHT).alias("page_height"))
    size = F.when((F.col("width") != 0) & (F.col("height") != 0), F.struct("width", "height"))
    first = pages.groupBy("book_id").agg(F.min_by(size, F.when(size.isNotNull(), F.col("page_num"))).alias("d"))
    return first.select("book_id", F.coalesce("d.width", F.lit(DEFAULT_WIDTH)).alias("page_width"), F.coalesce("d.height", F.lit(DEFAULT_HEIGHT)).alias("page_height"))


def edge_line_frequency(pages: DataFrame, head: int = 3, tail: int = 2) -> DataFrame:
    """book_id, line, n_pages_seen: how many pages carry a line among their first ``head`` or last ``tail`` lines of 2 to 119 characters."""
    if not _has(pages, "head"):
        pages = pages.select("book_id", F.filter(tx.split_lines(F.col("text")), edge_length).alias("head")).withColumn("tail", F.col("head"))
    edge = F.array_distinct(F.concat(F.slice("head", 1, head), _last(F.col("tail"), tail)))
    return pages.select("book_id", F.explode(edge).alias("line")).groupBy("book_id", "line").agg(F.count("*").alias("n_pages_seen"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg(F.count("*").alias("n_pages"))


def running_headers(freq: DataFrame, counts: DataFrame) -> DataFrame:
    """Lines on at least three pages and a fifth of the book."""
    return freq.join(counts, "book_id").where(F.col("n_pages_seen") >= F.greatest(F.lit(float(RUNNING_LEAST)), F.col("n_pages") * RUNNING_SHARE)).select("book_id", "line", "n_pages_seen")


def every_page_lines(freq: DataFrame, counts: DataFrame) -> DataFrame:
    """Lines on three fifths of the pages; no least number, so a book of one page has all its edge lines here."""
    return freq.join(counts, "book_id").where(F.col("n_pages_seen") >= F.col("n_pages") * EVERY_SHARE).select("book_id", "line", "n_pages_seen")


def header_lines(pages: DataFrame, head: int = 3, tail: int = 2) -> DataFrame:
    """book_id, line, is_running, is_every: only lines that are one of the two."""
    both = edge_line_frequency(pages, head, tail).join(page_counts(pages), "book_id")
    running = F.col("n_pages_seen") >= F.greatest(F.lit(float(RUNNING_LEAST)), F.col("n_pages") * RUNNING_SHARE)
    every = F.col("n_pages_seen") >= F.col("n_pages") * EVERY_SHARE
    return both.select("book_id", "line", running.alias("is_running"), every.alias("is_every")).where("is_running or is_every")


def book_context(pages: DataFrame) -> DataFrame:
    """One row a book: median_font_size, page_width, page_height, has_rich, n_pages."""
    rich = F.coalesce(F.bool_or(F.size("lines") > 0), F.lit(False)) if _has(pages, "lines") else F.lit(False)
    base = pages.groupBy("book_id").agg(rich.alias("has_rich"), F.count("*").alias("n_pages"))
    return base.join(median_font_size(pages), "book_id").join(page_dimensions(pages), "book_id").select("book_id", "median_font_size", "page_width", "page_height", "has_rich", "n_pages")
