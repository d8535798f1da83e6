"""Books, glyph runs, responses and calls derived from the given tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import profile, scoring

ROMAN_ONES = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
ROMAN_TENS = ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents that a book may hold at most: a source of any size is many books, so no book grows with the tables.
BOOK = 4000


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each source and BOOK doc_ids, a page for each of its documents in order; every fourth page gets a first line that depends on the source's number."""
    return _numbered(_in_books(spark, sf_dir)).select("book_id", "page_num", F.concat("first_line", F.coalesce("text", F.lit(""))).alias("text"))


def book_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_digest() of book_pages() for what chooses among lines: texts are digested where they are read, and page numbers and first lines are given to the digests, so that no text is shuffled or sorted."""
    d = _in_books(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    x = _numbered(profile.text_digest(d, ["book_id", "doc_id", "lang", "source"], scoring.may_be_chosen))
    return profile.with_first_line(x, F.col("first_line")).drop("doc_id", "lang", "source", "style", "n", "first_line")


def _in_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.expr(f"doc_id div {BOOK}").cast("string")).alias("book_id"), "doc_id", "text", "lang", "source")


def _numbered(d: DataFrame) -> DataFrame:
    """Rows of documents in books with page_num and first_line, whose line end is part of it (none: empty)."""
    x = d.withColumn("page_num", F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id"))).withColumn("style", F.expr("cast(regexp_extract(source, '([0-9]+)', 1) as int) % 4")).withColumn("n", F.expr("(page_num + 3) div 4"))
    arr = lambda xs: F.array(*map(F.lit, xs))
    roman = F.concat(F.repeat(F.lit("C"), F.floor(F.col("n") / 100).cast("int")), F.get(arr(ROMAN_TENS), (F.floor(F.col("n") / 10) % 10).cast("int")), F.get(arr(ROMAN_ONES), (F.col("n") % 10).cast("int")))
    head = F.when(F.col("page_num") % 4 != 1, F.lit("")).when(F.col("style") == 0, F.concat(F.lit("Chapter "), F.col("n").cast("string"), F.lit(": "), F.upper("lang"), F.lit("\n"))).when(F.col("style") == 1, F.lit("")).when(F.col("style") == 2, F.concat(roman, F.lit(". Title\n")))
    head = head.otherwise(F.when(F.col("n") % 2 == 0, F.lit("Interlude\n")).otherwise(F.concat(F.lit("THE "), F.upper("lang"), F.lit(" PART\n"))))
    return x.withColumn("first_line", head)


BOOK_PAGES_SQL = f"""
    book_pages_raw AS (
      SELECT source || '-' || doc_id // {BOOK} AS book_id, CAST(row_number() OVER (PARTITION BY source, doc_id // {BOOK} ORDER BY doc_id) AS INTEGER) AS page_num, coalesce(text, '') AS body, lang,
        CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4 AS style FROM documents),
    book_pages_n AS (SELECT *, (page_num + 3) // 4 AS n FROM book_pages_raw),
    book_pages AS (
      SELECT book_id, page_num, CASE WHEN page_num % 4 <> 1 THEN '' WHEN style = 0 THEN 'Chapter ' || n || ': ' || upper(lang) || chr(10) WHEN style = 1 THEN ''
        WHEN style = 2 THEN repeat('C', n // 100) || ({list(ROMAN_TENS)})[(n // 10) % 10 + 1] || ({list(ROMAN_ONES)})[n % 10 + 1] || '. Title' || chr(10)
        WHEN n % 2 = 0 THEN 'Interlude' || chr(10) ELSE 'THE ' || upper(lang) || ' PART' || chr(10) END || body AS text
      FROM book_pages_n)"""


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's words as glyph runs: ten a line, 14 points apart, a little off the line, bold in every seventh."""
    return book_pages(spark, sf_dir).select("book_id", "page_num", F.explode(items()).alias("i")).select("book_id", "page_num", "i.*")


def items() -> Column:
    """A page's glyph runs as one array, of its text."""

    def run(word: Column, i: Column) -> Column:
        y, bold = (F.lit(720.0) - 14 * F.floor(i / 10) + (i % 3) - 1).cast("double"), F.when(i % 7 == 0, "Helvetica-Bold").when(i % 11 == 0, "HelveticaB").otherwise("Times-Italic")
        size = F.when(i % 5 == 0, 0.0).otherwise((F.lit(10.0) + i % 2)).cast("double")
        return F.struct(i.alias("item_seq"), word.alias("str"), (F.lit(72.0) + 40 * (i % 10)).alias("x"), y.alias("y"), F.lit(11.0).alias("scale_x"), size.alias("scale_y"), (F.length(word) * 5.0).alias("width"), bold.alias("font_name"))

    return F.transform(F.split("text", r"\s+", -1), run)


TEXT_ITEMS_SQL = r"""
    items_raw AS (SELECT book_id, page_num, unnest(string_split_regex(text, '\s+')) AS str, unnest(range(len(string_split_regex(text, '\s+')))) AS i FROM book_pages),
    text_items AS (
      SELECT book_id, page_num, CAST(i AS INTEGER) AS item_seq, str, 72.0::DOUBLE + 40 * (i % 10) AS x, 720.0::DOUBLE - 14 * (i // 10) + (i % 3) - 1 AS y, 11.0::DOUBLE AS scale_x,
        CASE WHEN i % 5 = 0 THEN 0.0 ELSE 10.0 + i % 2 END::DOUBLE AS scale_y, length(str) * 5.0::DOUBLE AS width,
        CASE WHEN i % 7 = 0 THEN 'Helvetica-Bold' WHEN i % 11 = 0 THEN 'HelveticaB' ELSE 'Times-Italic' END AS font_name FROM items_raw)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer for each conversation turn (conversation = book, turn = chapter): prose around JSON of the turn's words; every fifth broken, every seventh a rate limit."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("b"), F.col("conv_id").cast("string")).alias("book_id"), F.col("turn").cast("int").alias("chapter_index"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", "").alias("t"), (F.col("conv_id") + F.col("turn")).alias("k"))
    w = F.filter(F.split("t", " ", -1), lambda x: x != "")
    c = c.withColumn("w", w)
    at = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("none"))
    body = F.concat(F.lit('Here: {"summary": " '), at(0), F.lit(' ", "concepts": ["'), at(1), F.lit('", "'), F.upper(at(1)), F.lit('", "'), at(2), F.lit('"], "principles": ["'), at(3), F.lit('"], "actionableIdeas": "oops", "vocabulary": [{"term": "'), at(4), F.lit('", "definition": "d"}, "'), at(4), F.lit('"], "quotes": [{"text": "'), at(5), F.lit('", "context": "c"}]}'), F.when(F.col("k") % 5 == 0, F.lit(" }")).otherwise(F.lit(" end")))
    return c.select("book_id", "chapter_index", F.lit("anthropic").alias("provider"), F.when(F.col("k") % 7 == 0, 429).otherwise(200).cast("int").alias("http_status"), F.when(F.col("k") % 7 == 0, F.lit(None)).otherwise(body).alias("raw"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unprocessed chapters, one for each conversation turn."""
    c = table(spark, sf_dir, "conversations")
    book = F.concat(F.lit("b"), F.col("conv_id").cast("string"))
    return c.select(F.concat(book, F.lit("-ch-"), F.col("turn").cast("string")).alias("id"), book.alias("book_id"), F.col("turn").cast("int").alias("index"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("title"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.coalesce("text", F.lit("")).alias("compressed_text"), F.lit(False).alias("ai_processed"), F.lit(None).cast("string").alias("summary"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: an event a call, its user the key, errors as statuses."""
    e = table(spark, sf_dir, "events")
    secs = (F.col("value") % 20).cast("int")
    fail = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").cast("string").alias("key"), F.concat(F.lit("Chapter "), (F.col("event_id") % 9).cast("string")).alias("label"), F.lit("openai").alias("provider"), F.col("ts").alias("started_at"), F.timestamp_add("SECOND", secs, F.col("ts")).alias("ended_at"), F.when(~fail, 200).when(F.col("event_id") % 2 == 0, 429).otherwise(500).alias("http_status"), F.when(fail, F.lit("failed")).alias("message"))


CALLS_SQL = """
    calls AS (
      SELECT event_id AS call_id, CAST(user_id AS VARCHAR) AS key, 'Chapter ' || (event_id % 9) AS label, ts AS started_at, ts + INTERVAL 1 SECOND * CAST(trunc(value % 20) AS INTEGER) AS ended_at,
        CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 429 ELSE 500 END AS http_status FROM events)"""
