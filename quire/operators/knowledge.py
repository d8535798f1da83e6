"""Request tables for a model, its answers, and the knowledge of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as tx

#: Lists of a chapter's knowledge with their caps, and call settings.
CAPS = {"concepts": 20, "principles": 15, "actionable_ideas": 15, "vocabulary": 20, "quotes": 10}
FIELD = {"concepts": "concepts", "principles": "principles", "actionable_ideas": "actionableIdeas", "vocabulary": "vocabulary", "quotes": "quotes"}
KEY = {"vocabulary": "$.term", "quotes": "$.text"}
CHAPTER_TOKENS, CHAPTER_TEMPERATURE, SUMMARY_TOKENS, SUMMARY_TEMPERATURE = 1500, 0.2, 1024, 0.25
SYSTEM = "You extract knowledge from books. Answer only with JSON: summary (string), concepts, principles, actionableIdeas (strings), vocabulary (term, definition), quotes (text, context)."
#: What a model is asked; the first is followed by title and text, the second by the numbered summaries.
PROMPT, SUMMARY_PROMPT = "Read the chapter below and list what it teaches.", "Summarize the book from its chapter summaries."


def build_chapter_requests(chapters: DataFrame) -> DataFrame:
    """One request a chapter: system text, prompt with title and text, token limit, temperature."""
    user = F.concat(F.lit(PROMPT + '\n\nCHAPTER: "'), "title", F.lit('"\n\nTEXT:\n'), F.coalesce("compressed_text", F.lit("")))
    return chapters.select(F.col("id").alias("request_id"), "book_id", F.col("index").alias("chapter_index"), F.lit(SYSTEM).alias("system"), user.alias("prompt"), F.lit(CHAPTER_TOKENS).alias("max_tokens"), F.lit(CHAPTER_TEMPERATURE).alias("temperature"))


def build_book_summary_requests(chapters: DataFrame) -> DataFrame:
    """One request a book with two or more chapter summaries, numbered over those that are not empty."""
    ok = chapters.where(F.coalesce("summary", F.lit("")) != "")
    x = ok.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "summary"))), lambda s, i: F.concat(F.lit("[Chapter "), (i + 1).cast("string"), F.lit("] "), s["summary"])).alias("s")).where(F.size("s") >= 2)
    return x.select("book_id", F.lit(SYSTEM).alias("system"), F.concat(F.lit(SUMMARY_PROMPT + "\n\nCHAPTER SUMMARIES:\n"), F.array_join("s", "\n\n")).alias("prompt"), F.lit(SUMMARY_TOKENS).alias("max_tokens"), F.lit(SUMMARY_TEMPERATURE).alias("temperature"))


def _empty() -> Column:
    return F.struct(F.lit("").alias("summary"), *(F.expr("cast(array() as array<string>)").alias(c) for c in CAPS))


def parse_chapter_knowledge(raw: Column) -> Column:
    """The JSON object from the first { to the last }, fields of a wrong type as empty; null if there is none or it is no JSON."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    good = (body != "") & (F.size(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")) == 1)
    v = F.try_parse_json(body)
    is_text = F.schema_of_variant(F.try_variant_get(v, "$.summary", "variant")) == "STRING"
    summary = F.when(is_text, tx.trim(F.try_variant_get(v, "$.summary", "string")))
    fields = F.from_json(body, "struct<" + ",".join(f"`{f}`:array<string>" for f in FIELD.values()) + ">")
    return F.when(good, F.struct(F.coalesce(summary, F.lit("")).alias("summary"), *(F.coalesce(fields[f], F.expr("cast(array() as array<string>)")).alias(c) for c, f in FIELD.items())))


def apply_responses(chapters: DataFrame, responses: DataFrame) -> DataFrame:
    """Chapters with their answer (book_id, chapter_index, raw; raw null: the call failed); of several of one chapter that of the largest ``attempt`` holds
    (without such a column two answers of a chapter are an error). A processed chapter is never done again, whatever is answered. A failed call leaves a chapter
    unprocessed with empty knowledge, an answer that cannot be read processes it with empty knowledge. Chapters without an answer stay as they are."""
    key = [F.col("book_id"), F.col("chapter_index").alias("index")]
    if "attempt" in responses.columns:
        r = responses.select(*key, F.struct("raw").alias("_r"), F.struct("attempt", "raw").alias("_o")).groupBy("book_id", "index").agg(F.max_by("_r", "_o").alias("_r"))
    else:
        r = responses.select(*key, F.struct("raw").alias("_r")).groupBy("book_id", "index").agg(F.max("_r").alias("_r"), F.count("*").alias("_n")).where(_single("a chapter has several answers and there is no attempt to choose by"))
    r = r.select("book_id", "index", F.col("_r.raw").alias("_raw"), F.lit(True).alias("_there"))
    x = chapters.join(r, ["book_id", "index"], "left").withColumn("_new", F.coalesce("_there", F.lit(False)) & ~F.coalesce("ai_processed", F.lit(False)))
    k = F.when(F.col("_new"), F.coalesce(parse_chapter_knowledge(F.col("_raw")), _empty()))
    x = x.withColumn("_k", k)
    old = F.col("ai_knowledge").cast(x.schema["_k"].dataType) if "ai_knowledge" in chapters.columns else F.lit(None).cast(x.schema["_k"].dataType)
    new = {"ai_processed": F.col("_raw").isNotNull(), "summary": F.col("_k.summary"), "ai_knowledge": F.col("_k")}
    for name, value in new.items():
        x = x.withColumn(name, F.when(F.col("_new"), value).otherwise(old if name == "ai_knowledge" else F.col(name)))
    return x.drop("_raw", "_there", "_new", "_k")


def _single(what: str) -> Column:
    """True where _n is one, an error elsewhere."""
    return F.when(F.col("_n") > 1, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True))


def explode_knowledge(chapters: DataFrame) -> DataFrame:
    """book_id, category, chapter_index, position, item: one row an item, nulls included."""
    lists = F.array(*(F.struct(F.lit(c).alias("category"), F.col(f"ai_knowledge.{c}").alias("items")) for c in CAPS))
    x = chapters.select("book_id", F.col("index").alias("chapter_index"), F.explode(lists).alias("l"))
    return x.select("book_id", F.col("l.category").alias("category"), "chapter_index", F.posexplode("l.items").alias("position", "item"))


def item_key(category: Column, item: Column) -> Column:
    """What makes two items one: lower-case trimmed text; of an object its term or text, ``[object object]`` if it has none; a null is kept as ``null`` where objects stand."""
    out = F.coalesce(item, F.lit(""))
    for c, path in KEY.items():
        own = F.get_json_object(item, path)
        key = F.when(item.isNull(), F.lit("null")).when(F.ltrim(item).startswith("{"), F.coalesce(F.nullif(own, F.lit("")), F.lit("[object Object]"))).otherwise(item)
        out = F.when(category == c, key).otherwise(out)
    return F.lower(tx.trim(out))


def dedup_items(items: DataFrame) -> DataFrame:
    """The first of the items with one key, in chapter and position order; empty keys go."""
    x = items.withColumn("item_key", item_key(F.col("category"), F.col("item"))).where("item_key != ''")
    w = Window.partitionBy("book_id", "category", "item_key").orderBy("chapter_index", "position")
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cap_items(items: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The first items of each list, with their rank."""
    caps = caps or CAPS
    w = Window.partitionBy("book_id", "category").orderBy("chapter_index", "position")
    limit = F.coalesce(*(F.when(F.col("category") == c, F.lit(n)) for c, n in caps.items()))
    return items.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= max(caps.values())) & (F.col("rank") <= limit))


def aggregate_knowledge(chapters: DataFrame) -> DataFrame:
    """One row a book with its five lists; a book without items has empty ones."""
    kept = cap_items(dedup_items(explode_knowledge(chapters)))
    lists = kept.groupBy("book_id").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("rank", "item")))), lambda s: s["item"]).alias(c) for c in CAPS))
    none = F.expr("cast(array() as array<string>)")
    return chapters.select("book_id").distinct().join(lists, "book_id", "left").select("book_id", *(F.coalesce(c, none).alias(c) for c in CAPS))


def choose_book_summary(books: DataFrame, chapters: DataFrame, responses: DataFrame) -> DataFrame:
    """id, summary: the book's own, else its only chapter summary, else the answer (book_id, raw), else the first chapter summary, else empty."""
    s = chapters.where(F.coalesce("summary", F.lit("")) != "").groupBy("book_id").agg(F.count("*").alias("_n"), F.min_by("summary", "index").alias("_first"))
    r = responses.select("book_id", F.col("raw").alias("_raw"))
    x = books.select("id", F.col("summary").alias("_own")).join(s, F.col("id") == s["book_id"], "left").drop("book_id").join(r, F.col("id") == r["book_id"], "left").drop("book_id")
    return x.select("id", F.when(F.coalesce("_own", F.lit("")) != "", F.col("_own")).when(F.col("_n") == 1, F.col("_first")).when(F.col("_n") > 1, F.coalesce("_raw", "_first")).otherwise(F.lit("")).alias("summary"))


def _tried(chapters: DataFrame) -> Column:
    """Chapters that were asked for: a failed call leaves empty knowledge, one that was never made none."""
    return F.count_if(F.coalesce("ai_processed", F.lit(False)) | (F.col("ai_knowledge").isNotNull() if "ai_knowledge" in chapters.columns else F.lit(False)))


def call_metrics(chapters: DataFrame) -> DataFrame:
    """book_id, chapters, ai_calls_total (one more than chapters), ai_calls_done: a call for every chapter that was tried, failed ones too."""
    return chapters.groupBy("book_id").agg(F.count("*").cast("int").alias("chapters"), (F.count("*") + 1).cast("int").alias("ai_calls_total"), _tried(chapters).cast("int").alias("ai_calls_done"))


def finalize_books(books: DataFrame, chapters: DataFrame, responses: DataFrame) -> DataFrame:
    """Books with their summary, status ``complete`` and calls done: one for every chapter that was tried and one for a summary that was
    made now, be it from a book's only chapter summary. A summary that was there, or whose call failed, is no call done."""
    some = F.coalesce("summary", F.lit("")) != ""
    made = chapters.groupBy("book_id").agg(_tried(chapters).cast("int").alias("_done"), F.count_if(some).alias("_n"))
    s = choose_book_summary(books, chapters, responses).withColumnRenamed("summary", "_s")
    told = responses.where("raw is not null").select("book_id", F.lit(1).alias("_told")).distinct()
    x = books.join(s, "id").join(made, books["id"] == made["book_id"], "left").drop("book_id").join(told, books["id"] == told["book_id"], "left").drop("book_id")
    one = F.when(some, 0).when(F.col("_n") == 1, 1).when(F.col("_n") > 1, F.coalesce("_told", F.lit(0))).otherwise(0)
    x = x.withColumn("pipeline_metrics", F.col("pipeline_metrics").withField("ai_calls_done", (F.coalesce("_done", F.lit(0)) + one).cast("int")))
    return x.withColumn("summary", F.col("_s")).withColumn("status", F.lit("complete")).drop("_s", "_done", "_n", "_told")
