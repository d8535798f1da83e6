"""Pages to chapters: every strategy set-wise on skinny rows, then one choice a book.

Chapters are intervals of page positions, so nothing is assigned page by page
until a strategy is chosen, and pages meet chapters by a running value, not a
range join. Pages, starts and chapters of a book are dealt to blocks (see ``spans``),
so a book of any size is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import profile, scoring, spans
from quire.sources.shared import stored

#: Fixed values of the cascade.
COVERAGE, CONTINUITY = 0.60, 0.75
SEQUENCE_QUALITY, PLAIN_QUALITY = 0.35, 0.25
KINDS = {"chapter": 4, "part": 3, "roman": 2, "arabic-bare": 1}
#: Stage number to the strategy it reports, in the order of preference.
STAGES = {0: "pdf-outline", 1: "numbered-sequence", 2: "scoring", 3: "scoring", 4: "numbered-sequence", 5: "patterns", 6: "structural-fallback", 7: "n-page-sections", 8: "single-section"}
#: What pages, starts and chapters are numbered within.
BOOK = ("book_id",)
CHAPTER = ("book_id", "chapter_index", "title", "page_start", "page_end", "n_pages", "start_pos", "end_pos")


def page_index(pages: DataFrame) -> DataFrame:
    """book_id, page_num, pos (from 1), prev_page_num, first_page_num, last_page_num, n_pages: skinny rows."""
    x = spans.numbered(pages.select("book_id", "page_num"), ["book_id"], spans.block_of("page_num"), ["page_num"], lags={"prev_page_num": "page_num"}, whole={"first_page_num": ("min", "page_num"), "last_page_num": ("max", "page_num")})
    return x.select("book_id", "page_num", F.col("pos").cast("int").alias("pos"), "prev_page_num", "first_page_num", "last_page_num", F.col("of").alias("n_pages"))


def segment_by_candidates(index: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = BOOK) -> DataFrame:
    """Chapters from (book_id, page_num, title) starts: pages before the first join it, the end is the last real page. With further ``keys`` of the starts (as a stage) a set of chapters for each."""
    at = stored(candidates.select(*keys, "page_num", "title").join(index, ["book_id", "page_num"]).withColumnRenamed("pos", "at"), "starts")
    x = spans.numbered(at, list(keys), spans.block_of("at"), ["at"], leads={"next": "at", "before_next": "prev_page_num"}).withColumn("i", (F.col("pos") - 1).cast("int"))
    first = F.col("i") == 0
    start, end = F.when(first, F.lit(1)).otherwise(F.col("at")), F.coalesce(F.col("next") - 1, F.col("n_pages")).cast("int")
    return x.select(*keys, F.col("i").alias("chapter_index"), "title", F.when(first, F.col("first_page_num")).otherwise(F.col("page_num")).alias("page_start"), F.coalesce("before_next", "last_page_num").alias("page_end"), (end - start + 1).cast("int").alias("n_pages"), start.cast("int").alias("start_pos"), end.alias("end_pos"))


def segment_by_outline(index: DataFrame, outline: DataFrame) -> DataFrame:
    """Chapters from (book_id, seq, title, page_num) bookmarks, at least two: each runs to the next one's page less one, one without pages goes,
    pages before the first are in none, the end is the nominal one. Books with fewer than two chapters left have none."""
    marks = spans.numbered(outline.select("book_id", "page_num", "title", "seq"), ["book_id"], spans.block_of("page_num"), ["page_num", "seq"], leads={"next": "page_num"}).where("of >= 2").drop("pos", "of")
    pages = index.select("book_id", "page_num", "pos", "last_page_num", F.lit(1).alias("is_page"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("struct<seq:int,title:string,page_num:int,next:int>").alias("m"))
    rows = marks.select("book_id", "page_num", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("last_page_num"), F.lit(0).alias("is_page"), F.col("seq").cast("int").alias("seq"), F.struct(F.col("seq").cast("int").alias("seq"), "title", F.col("page_num").cast("int").alias("page_num"), F.col("next").cast("int").alias("next")).alias("m"))
    got = spans.carried(pages.unionByName(rows), ["book_id"], spans.block_of("page_num"), ["page_num", "is_page", "seq"], "m").where("is_page = 1 and m is not null")
    ch = got.groupBy("book_id", "m").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").cast("int").alias("n_pages"), F.max("last_page_num").alias("last"))
    ch = spans.numbered(stored(ch, "outline-chapters"), ["book_id"], spans.block_of("start_pos"), ["start_pos"]).withColumn("i", (F.col("pos") - 1).cast("int")).where("of >= 2")
    return ch.select("book_id", F.col("i").alias("chapter_index"), F.col("m.title").alias("title"), F.col("m.page_num").alias("page_start"), F.coalesce(F.col("m.next") - 1, F.col("last")).alias("page_end"), "n_pages", "start_pos", "end_pos")


def segment_by_patterns(pages: DataFrame, index: DataFrame | None = None) -> DataFrame:
    pages = profile.digested(pages, scoring.may_be_chosen)
    return segment_by_candidates(page_index(pages) if index is None else index, scoring.find_heading(pages))


def annotate_numbers(chapters: DataFrame) -> DataFrame:
    """Chapters whose title has a number, with value and kind."""
    return chapters.withColumn("_n", tx.extract_chapter_num(F.col("title"))).where("_n is not null").withColumn("value", F.col("_n.value")).withColumn("kind", F.col("_n.kind")).drop("_n")


def sequence_continuity(numbered: DataFrame, keys: tuple[str, ...] = BOOK) -> DataFrame:
    """book_id, kind, n, continuity: steps of one count 1, of two 0.6, over all steps; 0 for a single number."""
    by = [*keys, "kind"]
    x = spans.numbered(numbered.select(*by, "chapter_index", "value"), by, spans.block_of("chapter_index"), ["chapter_index"], lags={"_before": "value"})
    step = F.col("value") - F.col("_before")
    good = x.withColumn("_g", F.when(step == 1, 1.0).when(step == 2, 0.6).when(step.isNotNull(), 0.0))
    return good.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("_g") / F.nullif(F.count("*") - 1, F.lit(0)), F.lit(0.0)).alias("continuity"))


def best_sequence(chapters: DataFrame, numbered: DataFrame | None = None, keys: tuple[str, ...] = BOOK) -> DataFrame:
    """book_id, kind, continuity of the preferred kind that runs on, where numbered chapters cover three fifths."""
    by = list(keys)
    numbered = stored(annotate_numbers(chapters), "numbered") if numbered is None else numbered
    total = chapters.groupBy(*by).agg(F.count("*").alias("n_all"))
    some = numbered.groupBy(*by).agg(F.count("*").alias("n_num"))
    ok = total.join(some, by).where((F.col("n_all") >= 2) & (F.col("n_num") >= 2) & (F.col("n_num") / F.col("n_all") >= COVERAGE)).select(*by)
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in KINDS.items()))
    good = sequence_continuity(numbered, keys).where((F.col("n") >= 2) & (F.col("continuity") >= CONTINUITY)).join(ok, by)
    return good.groupBy(*by).agg(F.max_by(F.struct("kind", "continuity"), rank).alias("b")).select(*by, "b.kind", "b.continuity")


def merge_around_sequence(chapters: DataFrame, sequence: DataFrame, numbered: DataFrame | None = None, keys: tuple[str, ...] = BOOK) -> DataFrame:
    """The sequence's chapters: what stands before the first joins it, what stands after the last joins the last, others between lose
    their pages; dropped_pages counts those for the book."""
    by = list(keys)
    both = (annotate_numbers(chapters) if numbered is None else numbered).join(sequence.select(*by, "kind"), [*by, "kind"])
    whole = chapters.groupBy(*by).agg(F.min("start_pos").alias("lo"), F.max("end_pos").alias("hi"), F.min("page_start").alias("lo_page"), F.max_by("page_end", "end_pos").alias("hi_page"))
    x = spans.numbered(stored(both.join(whole, by), "members"), by, spans.block_of("chapter_index"), ["chapter_index"]).withColumn("i", (F.col("pos") - 1).cast("int"))
    first, last = F.col("i") == 0, F.col("pos") == F.col("of")
    start, end = F.when(first, F.col("lo")).otherwise(F.col("start_pos")), F.when(last, F.col("hi")).otherwise(F.col("end_pos"))
    out = x.select(*by, F.col("i").alias("chapter_index"), "title", F.when(first, F.col("lo_page")).otherwise(F.col("page_start")).alias("page_start"), F.when(last, F.col("hi_page")).otherwise(F.col("page_end")).alias("page_end"), (end - start + 1).cast("int").alias("n_pages"), start.alias("start_pos"), end.alias("end_pos"), (F.col("hi") - F.col("lo") + 1).alias("_all"))
    kept = out.groupBy(*by).agg(F.sum("n_pages").alias("_kept"))
    return out.join(kept, by).withColumn("dropped_pages", (F.col("_all") - F.col("_kept")).cast("int")).drop("_all", "_kept")


def structural_breaks(pages: DataFrame) -> DataFrame:
    """book_id, page_num, title: a page under 60 words after one over 80 whose first line starts with a capital and is short."""
    skinny = pages.select("book_id", "page_num", profile.words(pages).alias("n_words"), F.get(profile.top_lines(pages, 1), F.lit(0)).alias("title"))
    x = spans.numbered(stored(skinny, "page-words"), ["book_id"], spans.block_of("page_num"), ["page_num"], lags={"before": "n_words"})
    return x.where((F.col("before") > 80) & (F.col("n_words") < 60) & F.col("title").rlike("^[A-Z]") & (F.length("title") < 60)).select("book_id", "page_num", "title")


def n_page_sections(index: DataFrame) -> DataFrame:
    """Books of 20 pages or more in 5 to 20 sections of equal length."""
    k = F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("n_pages") / 20)))
    x = index.where("n_pages >= 20").withColumn("i", F.floor((F.col("pos") - 1) / F.ceil(F.col("n_pages") / k)).cast("int"))
    ch = x.groupBy("book_id", F.col("i").alias("chapter_index")).agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.count("*").cast("int").alias("n_pages"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"))
    return ch.withColumn("title", F.format_string("Section %d (pp. %d–%d)", F.col("chapter_index") + 1, F.col("page_start"), F.col("page_end"))).select(*CHAPTER)


def whole_book(index: DataFrame) -> DataFrame:
    return index.groupBy("book_id").agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.count("*").cast("int").alias("n_pages"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos")).select("book_id", F.lit(0).alias("chapter_index"), F.lit("Full Book").alias("title"), "page_start", "page_end", "n_pages", "start_pos", "end_pos")


def _facts(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """n, dup (chapters whose title stands more than once) for each book and stage."""
    return chapters.groupBy(*keys, "title").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("dup"))


def _quality(n: Column, total: Column) -> Column:
    avg = total / n
    density = F.when(avg > 80, 0.8).when(avg < 4, 0.6).otherwise(1.0)
    return density * 0.7 + F.least(F.lit(1.0), n / 5) * 0.3


def _sane(n: Column, dup: Column, total: Column) -> Column:
    return (n > 0) & (total / n >= 1.5) & ~((n == 1) & (total > 30)) & (dup / n <= 0.4)


def chapter_quality(chapters: DataFrame, counts: DataFrame) -> DataFrame:
    """book_id, quality: 0.7 of a density score and 0.3 of min(1, chapters / 5)."""
    return _facts(chapters, ["book_id"]).join(counts, "book_id").select("book_id", _quality(F.col("n"), F.col("n_pages")).alias("quality"))


def sanity_check(chapters: DataFrame, counts: DataFrame) -> DataFrame:
    """book_id, sane for every book of counts; false without chapters."""
    return counts.join(_facts(chapters, ["book_id"]), "book_id", "left").select("book_id", F.coalesce(_sane(F.col("n"), F.col("dup"), F.col("n_pages")), F.lit(False)).alias("sane"))


def diagnostics(chapters: DataFrame, counts: DataFrame) -> DataFrame:
    """book_id, detected_chapters, avg_pages_per_chapter (rounded half up), min_pages, max_pages, warnings; strategy if the chapters have one."""
    dup = chapters.groupBy("book_id", "title").agg(F.count("*").alias("c"), F.min("chapter_index").alias("i")).where("c > 1").groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda d: F.concat(F.lit("title used more than once: "), d["title"])).alias("dups"))
    keep = [F.first("strategy").alias("strategy")] if "strategy" in chapters.columns else []
    x = chapters.groupBy("book_id").agg(F.count("*").cast("int").alias("detected_chapters"), F.min("n_pages").alias("min_pages"), F.max("n_pages").alias("max_pages"), *keep).join(counts.select("book_id", F.col("n_pages").alias("_total")), "book_id").join(dup, "book_id", "left")
    avg = F.floor(F.col("_total") / F.col("detected_chapters") + 0.5).cast("int")
    warn = F.concat(F.array_compact(F.array(F.when(avg < 4, F.lit("chapters are very short: under 4 pages on average")), F.when(F.col("min_pages") == 0, F.lit("a chapter holds no page")))), F.coalesce("dups", F.expr("cast(array() as array<string>)")))
    return x.select("book_id", *(["strategy"] if keep else []), "detected_chapters", avg.alias("avg_pages_per_chapter"), "min_pages", "max_pages", warn.alias("warnings"))


def stage_chapters(pages: DataFrame, outline: DataFrame | None = None, scored: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """The chapters of every stage that found any, with its number in ``stage``. Texts are read once, for the pages' digest; starts and intervals are skinny, used several times and written to the shared folder.

    ``scored``: the pages' scored_lines(), where they are at hand; the context of rich pages is in them, so that these may then be a digest.
    ``chosen``: their score_pages_at() for both thresholds, where it is at hand.
    """
    context = stored(profile.book_context(pages), "contexts") if scored is None and "lines" in pages.columns else None
    pages = profile.digested(pages, scoring.may_be_chosen)
    index = stored(page_index(pages), "page-index")
    skinny = ["book_id", "page_num", "title"]
    if chosen is None:
        chosen = scoring.score_pages_at(stored(scoring.scored_lines(pages, context), "scored-lines") if scored is None else scored, scoring.BOTH)
    both = chosen.select(*skinny, F.when(F.col("threshold") == scoring.THRESHOLD, 2).otherwise(3).alias("stage"))
    # all that follows works on these rows
    starts = stored(both.unionByName(scoring.find_heading(pages).select(*skinny, F.lit(5).alias("stage"))).unionByName(structural_breaks(pages).select(*skinny, F.lit(6).alias("stage"))), "chapter-starts")
    # a stage of starts needs two of them; the relaxed one is for books that had two at the full threshold
    n = starts.groupBy("book_id", "stage").count().where("count >= 2").select("book_id", "stage")
    ok = n.where("stage != 3").unionByName(n.where("stage = 3").join(n.where("stage = 2").select("book_id"), "book_id", "left_semi"))
    every = ("book_id", "stage")
    plain = segment_by_candidates(index, starts.join(ok, list(every)), every).unionByName(_staged({7: n_page_sections(index), 8: whole_book(index)}))
    if outline is not None:
        plain = plain.unionByName(_staged({0: segment_by_outline(index, outline)}))
    first = stored(plain.select(*CHAPTER, "stage"), "plain-chapters")
    # the sequences of the scored chapters and of those by patterns
    source = first.where("stage in (2, 5)").withColumn("stage", F.col("stage") - 1)
    numbered = stored(annotate_numbers(source), "numbered")
    made = merge_around_sequence(source, stored(best_sequence(source, numbered, every), "best-sequences"), numbered, every)
    return first.unionByName(stored(made.select(*CHAPTER, "stage"), "sequences"))


def _staged(made: dict[int, DataFrame]) -> DataFrame:
    out = None
    for stage in sorted(made):
        one = made[stage].select(*CHAPTER).withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    return out


def stage_results(staged: DataFrame, counts: DataFrame) -> DataFrame:
    """book_id, stage, n, quality, sane, valid of every stage that found chapters."""
    x = _facts(staged, ["book_id", "stage"]).join(counts, "book_id")
    q, sane, stage = _quality(F.col("n"), F.col("n_pages")), _sane(F.col("n"), F.col("dup"), F.col("n_pages")), F.col("stage")
    valid = F.when(stage.isin(1, 4), sane & (q >= SEQUENCE_QUALITY) & (F.col("n") >= 2)).when(stage.isin(2, 3, 5), sane & (q >= PLAIN_QUALITY)).otherwise(F.lit(True))
    return x.select("book_id", "stage", "n", q.alias("quality"), sane.alias("sane"), valid.alias("valid"))


def detect_chapters(pages: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """The chapters of the first stage that holds, with its strategy, for every book; pages: book_id, page_num, text and, if rich, width, height, lines."""
    return first_valid(stage_chapters(pages, outline), profile.page_counts(pages))


def first_valid(staged: DataFrame, counts: DataFrame) -> DataFrame:
    """The chapters of each book's first stage that holds, with its strategy."""
    best = stage_results(staged, counts).where("valid").groupBy("book_id").agg(F.min("stage").alias("stage"))
    names = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    return staged.join(best, ["book_id", "stage"]).select("book_id", names[F.col("stage")].alias("strategy"), *CHAPTER[1:])


def page_chapter(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, page_num, chapter_index: each page's chapter by the last start at or before it; pages that no chapter holds are left out."""
    index = page_index(pages).select("book_id", "page_num", "pos", F.lit(1).alias("is_page"), F.lit(None).cast("struct<chapter_index:int,end_pos:int>").alias("c"))
    starts = chapters.select("book_id", F.lit(None).cast("int").alias("page_num"), F.col("start_pos").alias("pos"), F.lit(0).alias("is_page"), F.struct(F.col("chapter_index").cast("int").alias("chapter_index"), F.col("end_pos").cast("int").alias("end_pos")).alias("c"))
    return spans.carried(stored(index.unionByName(starts), "pages-and-starts"), ["book_id"], spans.block_of("pos"), ["pos", "is_page"], "c").where((F.col("is_page") == 1) & (F.col("pos") <= F.col("c.end_pos"))).select("book_id", "page_num", F.col("c.chapter_index").alias("chapter_index"))
