"""Heading scores of lines, and the best candidate of each page.

At most fourteen lines of a page become rows; the text itself is dropped there.
Repeated-line flags come by a join on (book, line); the rest of a page's work
is done on its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as tx
from quire.operators import profile
from quire.sources.shared import stored

#: Lines looked at, thresholds, rule weights.
SCAN, CAPS_SCAN, SPARSE, SPARSE_PATTERN = 12, 8, 200, 250
THRESHOLD, RELAXED = 40, 25
BOTH = (THRESHOLD, RELAXED)
MEANINGFUL = ("CHAPTER_KEYWORD", "LARGE_FONT", "LARGE_FONT_BIG", "BOLD", "ALL_CAPS", "ROMAN_NUMERAL", "MULTI_LINE_HEADING")
WEIGHTS = {
    "CHAPTER_KEYWORD": 50, "LARGE_FONT_BIG": 25, "LARGE_FONT": 20, "LARGE_FONT_SMALL": 8, "BOLD": 12, "CENTERED": 15, "TOP_QUARTER": 15,
    "WHITESPACE_ABOVE": 10, "WHITESPACE_BELOW": 10, "SHORT_LINE": 8, "ALL_CAPS": 10, "STARTS_PAGE": 10, "SPARSE_PAGE": 15, "ROMAN_NUMERAL": 12,
    "WORD_NUMBER": 8, "ISOLATED": 8, "RUNNING_HEADER": -40, "EVERY_PAGE": -60, "LOWERCASE_START": -30, "PROSE_LENGTH": -25, "BOTTOM_QUARTER": -20,
}
LINE = "struct<text:string,y:double,x:double,line_width:double,font_size:double,bold:boolean,italic:boolean>"


def may_be_chosen(line: Column, n_words: Column) -> Column:
    """Lines that some pass may choose, by their length: 120 characters at most, or (as capitals) any on a sparse page. No pass looks at the text of others."""
    return (F.length(line) <= 120) | (n_words < SPARSE)


def page_lines(pages: DataFrame, context: DataFrame | None = None, most: int | None = SCAN + 2) -> DataFrame:
    """book_id, page_num, line_index, text (trimmed), raw_length, geometry, gaps, n_lines, n_words and the book's context, one row a line.

    Pages with lines use them as they are, blank ones included; others get lines of their text at 12 points from the top. Lines whose text a digest left out are no rows.
    """
    context = profile.book_context(pages) if context is None else context
    p = pages.join(context, "book_id")
    short = "top" in pages.columns  # a digest has the first lines only, and their number
    if "lines" not in pages.columns:
        return _plain_lines(p, short, most)
    plain = F.transform(F.col("top") if short else tx.split_lines(F.col("text")), lambda t, i: F.struct(t.alias("text"), (F.lit(792.0) - i * 12).alias("y"), F.lit(0.0).alias("x"), F.lit(0.0).alias("line_width"), F.col("median_font_size").cast("double").alias("font_size"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))
    lines = F.when(F.size("lines") > 0, F.col("lines").cast(f"array<{LINE}>")).otherwise(plain)
    n = F.when(F.col("n_rich") > 0, F.col("n_rich")).otherwise(F.col("n_lines")) if short else F.size("_l")
    kept = [c for c in ("n_lines", "n_rich") if c in pages.columns]
    p = p.select("book_id", "page_num", "median_font_size", "page_width", "page_height", "n_pages", profile.words(pages).alias("n_words"), lines.alias("_l"), *kept).withColumn("n_lines", n)

    def size(l: Column) -> Column:
        return F.when(F.coalesce(l["font_size"], F.lit(0.0)) == 0, F.lit(12.0)).otherwise(l["font_size"])

    def gap(i: Column, other: Column, there: Column) -> Column:
        l = F.get("_l", i)
        return F.when(there, F.greatest(F.lit(0.0), F.abs(F.get("_l", other)["y"] - l["y"]) - size(l))).otherwise(F.lit(30.0))

    rows = F.transform(F.slice("_l", 1, most) if most else F.col("_l"), lambda l, i: F.struct(
        i.alias("line_index"), tx.trim(F.coalesce(l["text"], F.lit(""))).alias("text"), F.length(F.coalesce(l["text"], F.lit(""))).alias("raw_length"), F.coalesce(l["y"], F.lit(0.0)).alias("y"), F.coalesce(l["x"], F.lit(0.0)).alias("x"), F.coalesce(l["line_width"], F.lit(0.0)).alias("line_width"),
        F.when(F.coalesce(l["font_size"], F.lit(0.0)) == 0, F.col("median_font_size")).otherwise(l["font_size"]).alias("font_size"), F.coalesce(l["bold"], F.lit(False)).alias("bold"),
        gap(i, i - 1, i > 0).alias("gap_above"), gap(i, i + 1, i < F.col("n_lines") - 1).alias("gap_below")))
    if short:
        rows = F.filter(rows, lambda r: (lambda l: l.isNull() | l["text"].isNotNull())(F.get("_l", r["line_index"])))
    return p.select("book_id", "page_num", "n_lines", "n_words", "median_font_size", "page_width", "page_height", F.explode(rows).alias("r")).select("book_id", "page_num", "n_lines", "n_words", "median_font_size", "page_width", "page_height", "r.*")


def _plain_lines(p: DataFrame, short: bool, most: int | None) -> DataFrame:
    """page_lines() of pages that have no lines but those of their text: these lie where their number tells, so that they are rows first, without those that a digest left out, and no line is made a struct."""
    size, page = F.col("median_font_size").cast("double"), ("book_id", "page_num", "n_lines", "n_words", "median_font_size", "page_width", "page_height")
    x = p.withColumn("_l", F.col("top") if short else tx.split_lines(F.col("text"))).withColumn("n_words", profile.words(p))
    x = (x if short else x.withColumn("n_lines", F.size("_l"))).select(*page, F.posexplode(F.slice("_l", 1, most) if most else F.col("_l")).alias("line_index", "text")).where("text is not null")
    gap = F.greatest(F.lit(0.0), F.lit(12.0) - F.when(F.coalesce(size, F.lit(0.0)) == 0, F.lit(12.0)).otherwise(size))
    above, below = F.col("line_index") > 0, F.col("line_index") < F.col("n_lines") - 1
    return x.select(*page, "line_index", "text", F.length("text").alias("raw_length"), (F.lit(792.0) - F.col("line_index") * 12).alias("y"), F.lit(0.0).alias("x"), F.lit(0.0).alias("line_width"), size.alias("font_size"), F.lit(False).alias("bold"), F.when(above, gap).otherwise(F.lit(30.0)).alias("gap_above"), F.when(below, gap).otherwise(F.lit(30.0)).alias("gap_below"))


def line_gaps(lines: DataFrame) -> DataFrame:
    """book_id, page_num, line_index, gap_above, gap_below of page_lines()."""
    return lines.select("book_id", "page_num", "line_index", "gap_above", "gap_below")


def rule_conditions() -> dict[str, Column]:
    """Rule name to the condition under which it counts, over a row of page_lines() with is_running and is_every."""
    t, size, ratio = F.col("text"), F.length("text"), F.col("font_size") / F.nullif(F.col("median_font_size"), F.lit(0.0))
    above, below, short, caps = F.col("gap_above") >= 18, F.col("gap_below") >= 18, F.length("text") < 60, tx.is_mostly_caps(F.col("text"))
    font = (F.col("font_size") > 0) & (F.col("median_font_size") > 0)
    middle = F.abs(F.col("x") + F.col("line_width") / 2 - F.col("page_width") / 2) < 60
    return {
        "CHAPTER_KEYWORD": tx.heading_pattern(t).isNotNull(),
        "LARGE_FONT_BIG": font & (ratio >= 1.5),
        "LARGE_FONT": font & (ratio >= 1.25) & (ratio < 1.5),
        "LARGE_FONT_SMALL": font & (ratio >= 1.1) & (ratio < 1.25),
        "BOLD": F.col("bold"),
        "CENTERED": (F.col("line_width") > 0) & (F.col("line_width") < F.col("page_width") * 0.70) & middle,
        "TOP_QUARTER": F.col("y") >= F.col("page_height") * 0.75,
        "WHITESPACE_ABOVE": above,
        "WHITESPACE_BELOW": below,
        "SHORT_LINE": short,
        "ALL_CAPS": caps,
        "STARTS_PAGE": F.col("line_index") == 0,
        "SPARSE_PAGE": (F.col("n_words") < SPARSE) & (caps | short),
        "ROMAN_NUMERAL": tx.matches(t, tx.ROMAN_HEADING),
        "WORD_NUMBER": tx.matches(t, tx.NUMBER_PREFIX),
        "ISOLATED": above & below & short,
        "RUNNING_HEADER": F.col("is_running"),
        "EVERY_PAGE": F.col("is_every"),
        "LOWERCASE_START": t.rlike("^[a-z]"),
        "PROSE_LENGTH": size > 120,
        "BOTTOM_QUARTER": F.col("y") < F.col("page_height") * 0.25,
    }


def score_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """page_lines() rows with is_running, is_every, breakdown (rule, delta), reasons and score 0 to 100."""
    h = headers.select(F.col("book_id"), F.col("line").alias("text"), "is_running", "is_every")
    flagged = lines.join(h, ["book_id", "text"], "left").withColumn("is_running", F.coalesce("is_running", F.lit(False))).withColumn("is_every", F.coalesce("is_every", F.lit(False)))
    parts = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(name).alias("rule"), F.lit(WEIGHTS[name]).alias("delta"))) for name, c in rule_conditions().items())))
    out = flagged.withColumn("breakdown", parts)
    total = F.aggregate("breakdown", F.lit(0), lambda a, b: a + b["delta"])
    return out.withColumn("reasons", F.col("breakdown.rule")).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)))


def _join_title(label: Column, number: Column, title: Column) -> Column:
    return F.concat(label, F.lit(" "), number, F.when(title.isNotNull(), F.concat(F.lit(" — "), title)).otherwise(F.lit("")))


def multi_line_headings(scored: DataFrame) -> DataFrame:
    """book_id, page_num, title, score, reasons: the first label line whose next line is a number; a usable third line joins the title."""
    w = Window.partitionBy("book_id", "page_num").orderBy("line_index")
    # a line that is no row is no line to join either
    nxt = {n: {c: F.when(F.lead("line_index", n).over(w) == F.col("line_index") + n, F.lead(c, n).over(w)) for c in ("text", "is_running", "raw_length")} for n in (1, 2)}
    x = scored.select("book_id", "page_num", "line_index", "text", "is_running", *(v.alias(f"{c}{n}") for n, cols in nxt.items() for c, v in cols.items()))
    usable = F.col("text2").isNotNull() & ~F.col("is_running2") & ~tx.matches(F.col("text2"), tx.NUMBER_LINE) & (F.col("raw_length2") < 80)
    hit = (F.col("line_index") < SCAN) & ~F.col("is_running") & tx.matches(F.col("text"), tx.LABEL) & F.col("text1").isNotNull() & ~F.col("is_running1") & tx.matches(F.col("text1"), tx.NUMBER_LINE)
    first = x.where(hit).withColumn("title", _join_title(F.col("text"), F.col("text1"), F.when(usable, F.col("text2")))).groupBy("book_id", "page_num").agg(F.min_by("title", "line_index").alias("title"))
    return first.select("book_id", "page_num", "title", F.lit(85).alias("score"), F.array(F.lit("MULTI_LINE_HEADING")).alias("reasons"))


def _labelled(scored: DataFrame) -> DataFrame:
    """The lines of pages with a label line: only these need be put in order for multi_line_headings()."""
    # a struct of nulls is no null, so that pages without a book stay
    flat = scored.select("book_id", "page_num", "line_index", "text", "is_running", "raw_length", F.struct("book_id", "page_num").alias("_p"))
    labels = stored(flat.where((F.col("line_index") < SCAN) & tx.matches(F.col("text"), tx.LABEL)).select("_p").distinct(), "label-pages")
    return flat.join(labels, "_p", "left_semi")


def best_line_per_page(scored: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The highest score of the first twelve lines, the earliest on a tie: book_id, page_num, title, score, reasons, breakdown, line_index, n_words."""
    ok = scored.where((F.col("line_index") < SCAN) & F.length("text").between(2, 120) & ~F.col("text").rlike(tx.DIGITS) & (F.col("score") >= threshold))
    top = ok.groupBy("book_id", "page_num").agg(F.max_by(F.struct("text", "score", "reasons", "breakdown", "line_index", "n_words"), F.struct("score", -F.col("line_index"))).alias("b"))
    return top.select("book_id", "page_num", F.col("b.text").alias("title"), "b.score", "b.reasons", "b.breakdown", "b.line_index", "b.n_words")


def meaningful_signal_gate(candidates: DataFrame) -> DataFrame:
    """Candidates of pages under 200 words, or with a reason that is more than a place on the page."""
    return candidates.where((F.col("n_words") < SPARSE) | F.arrays_overlap("reasons", F.array(*map(F.lit, MEANINGFUL))))


def sparse_caps_candidates(scored: DataFrame) -> DataFrame:
    """Of pages under 200 words the first of the first eight lines in capitals, no repeated line, with a score of 25 at least."""
    ok = scored.where((F.col("n_words") < SPARSE) & (F.col("line_index") < CAPS_SCAN) & (F.col("text") != "") & ~F.col("text").rlike(tx.DIGITS) & tx.is_mostly_caps(F.col("text")) & ~F.col("is_running") & ~F.col("is_every") & (F.col("score") >= RELAXED))
    first = ok.groupBy("book_id", "page_num").agg(F.min_by(F.struct("text", "score", "reasons"), "line_index").alias("b"))
    return first.select("book_id", "page_num", F.col("b.text").alias("title"), "b.score", "b.reasons")


def score_pages(scored: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """At most one candidate a page: a multi-line heading, else the best line through the gate, else (no best line) capitals of a sparse page."""
    return score_pages_at(scored, (threshold,)).drop("threshold")


def score_pages_at(scored: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """score_pages() for several thresholds, named in ``threshold``, in one grouping by page."""
    text, usable = F.col("text"), ~F.col("text").rlike(tx.DIGITS)
    best_ok = (F.col("line_index") < SCAN) & (F.col("score") >= min(thresholds)) & F.length("text").between(2, 120) & usable
    caps_ok = (F.col("n_words") < SPARSE) & (F.col("line_index") < CAPS_SCAN) & (F.col("score") >= RELAXED) & ~F.col("is_running") & ~F.col("is_every") & (text != "") & usable & tx.is_mostly_caps(text)
    line = F.struct(text.alias("title"), "score", "reasons")
    # lines that can be chosen by no pass meet nothing
    flat = scored.select("book_id", "page_num", "n_words", "score", "line_index", line.alias("_line"), F.coalesce(best_ok, F.lit(False)).alias("_best"), F.coalesce(caps_ok, F.lit(False)).alias("_caps")).where("_best or _caps").withColumn("_m", F.lit(False))
    multi = multi_line_headings(_labelled(scored)).select("book_id", "page_num", F.struct("title", "score", "reasons").alias("_line"), F.lit(True).alias("_m"))
    out = flat.unionByName(multi, allowMissingColumns=True).groupBy("book_id", "page_num").agg(
        F.max_by("_line", F.when(F.col("_best"), F.struct("score", -F.col("line_index")))).alias("b"), F.min_by("_line", F.when(F.col("_caps"), F.col("line_index"))).alias("c"), F.min_by("_line", F.when(F.col("_m"), F.lit(0))).alias("m"), F.max("n_words").alias("n_words")
    )
    gate = (F.col("n_words") < SPARSE) | F.arrays_overlap("b.reasons", F.array(*map(F.lit, MEANINGFUL)))

    def chosen(t: int) -> Column:
        # the page's best line is the same at every threshold that it reaches
        good = F.coalesce(F.col("b.score") >= t, F.lit(False))
        x = F.when(F.col("m").isNotNull(), F.struct("m.*", F.lit(0).alias("pass"))).when(good, F.when(gate, F.struct("b.*", F.lit(1).alias("pass")))).when(F.col("c").isNotNull(), F.struct("c.*", F.lit(2).alias("pass")))
        return F.struct(F.lit(t).alias("threshold"), x.alias("x"))

    rows = out.select("book_id", "page_num", F.explode(F.array(*map(chosen, thresholds))).alias("r"))
    return rows.where("r.x is not null").select("book_id", "page_num", "r.threshold", "r.x.*")


def scored_lines(pages: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """page_lines() and score_lines() with the book's own context (if none is given) and repeated lines. Texts are read once, for the pages' digest."""
    if "top" not in pages.columns:
        context = stored(profile.book_context(pages), "contexts") if context is None and "lines" in pages.columns else context
        pages = profile.digested(pages)
    # a row a book: written, it is known to be small, and digests are not shuffled to meet it
    context = stored(profile.book_context(pages), "contexts") if context is None else context
    return score_lines(page_lines(pages, context), stored(profile.header_lines(pages), "headers"))


def find_heading(pages: DataFrame) -> DataFrame:
    """book_id, page_num, title by patterns: multi-line, else the first line with a heading pattern, else capitals on a page under 250 words. Texts are read once, for the pages' digest."""
    pages = profile.digested(pages, may_be_chosen)
    h = stored(profile.header_lines(pages, 12, 3).where("is_running").select("book_id", F.col("line").alias("text"), "is_running"), "headers")
    top = pages.select("book_id", "page_num", profile.words(pages).alias("n_words"), profile.top_lines(pages, SCAN + 2).alias("_t"))

    def told(some: DataFrame) -> DataFrame:
        return some.select("book_id", "page_num", "n_words", F.posexplode("_t").alias("line_index", "text"))

    # only pages with a label line need their lines in order
    labelled = told(top.where(F.exists("_t", lambda t: tx.matches(t, tx.LABEL)))).join(h, ["book_id", "text"], "left").withColumn("is_running", F.coalesce("is_running", F.lit(False)))
    multi = multi_line_headings(labelled.withColumn("raw_length", F.length("text"))).select("book_id", "page_num", F.col("title").alias("m"))
    word = ~F.col("text").rlike(tx.DIGITS)
    strict = F.when(word & (F.col("line_index") < SCAN) & F.length("text").between(2, 120) & tx.heading_pattern(F.col("text")).isNotNull(), F.col("line_index"))
    caps = F.when(word & (F.col("line_index") < CAPS_SCAN) & (F.col("n_words") < SPARSE_PATTERN) & tx.is_all_caps_heading(F.col("text")), F.col("line_index"))
    # repeated lines are taken out of those that look like headings, not of all lines
    like = told(top).select("book_id", "page_num", "text", strict.alias("_s"), caps.alias("_c")).where("_s is not null or _c is not null")
    flat = like.join(h.select("book_id", "text"), ["book_id", "text"], "left_anti").unionByName(multi, allowMissingColumns=True)
    pick = flat.groupBy("book_id", "page_num").agg(F.min_by("text", "_s").alias("s"), F.min_by("text", "_c").alias("c"), F.max("m").alias("m"))
    return pick.select("book_id", "page_num", F.coalesce("m", "s", "c").alias("title")).where("title is not null")
