"""Queries of the column functions, over pages, lines and titles of the derived books."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"regexp_replace({c}, {quoted(f'^{tx.WS}+|{tx.WS}+' + chr(92) + 'z')}, '', 'g')"


def lines(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')"


def words(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, {quoted(tx.WS + '+')}), lambda x: x <> ''))"


def is_match(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted(pattern)})"


def heading(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {is_match(c, p)} THEN {quoted(n)}" for n, p in tx.HEADINGS) + " END"


def mostly_caps(c: str) -> str:
    return f"(length(regexp_replace({c}, '[^a-zA-Z]', '', 'g')) >= 2 AND length(regexp_replace({c}, '[^A-Z]', '', 'g')) / length(regexp_replace({c}, '[^a-zA-Z]', '', 'g')) >= 0.7)"


def all_caps(c: str) -> str:
    return f"(length({c}) BETWEEN 3 AND 80 AND {words(c)} BETWEEN 1 AND 12 AND {is_match(c, tx.CAPS_LINE)} AND regexp_matches({c}, '[A-Z]{{2,}}'))"


def case_of(c: str, values: dict[str, int]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in values.items()) + " END"


def roman(c: str) -> str:
    """Right to left, less than the largest so far is taken off."""
    v = f"list_transform(string_split(reverse(upper({c})), ''), lambda x: {case_of('x', tx.ROMANS)})"
    total = "list_transform([%s], lambda v: list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] < coalesce(list_max(v[1:i - 1]), 0) THEN -v[i] ELSE v[i] END)))[1]" % v
    return f"CASE WHEN regexp_matches(upper({c}), '^[IVXLCDM]+$') AND {total} BETWEEN 1 AND 500 THEN {total} END"


def number(c: str) -> str:
    """{value, kind} by the first of the rules that matches and has a value."""
    tries = []
    for kind, how, pattern in tx.NUMBER_RULES:
        g = f"regexp_extract({trim(c)}, {quoted(pattern)}, 1)"
        word = f"regexp_replace(lower({g}), {quoted(tx.WS + '+')}, '-', 'g')"
        value = {"arabic": f"try_cast(nullif({g}, '') AS INTEGER)", "word": case_of(word, tx.NUMBERS), "roman": f"CASE WHEN {g} <> '' THEN {roman(g)} END"}[how]
        tries.append(f"CASE WHEN ({value}) IS NOT NULL THEN {{'value': CAST(({value}) AS INTEGER), 'kind': {quoted(kind)}}} END")
    return f"coalesce({', '.join(tries)})"


PAGES = f"WITH {views.BOOK_PAGES_SQL}"
LINES = f"{PAGES}, lines AS (SELECT book_id, page_num, unnest({lines('text')}) AS line FROM book_pages)"


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.book_pages(spark, sf_dir).select("book_id", "page_num", F.explode(tx.split_lines(F.col("text"))).alias("line"))


@query(f"{LINES} SELECT book_id, page_num, count(*) AS n_lines, min(line) AS least_line FROM lines GROUP BY ALL")
def t2_split_lines(spark, sf_dir):
    return page_lines(spark, sf_dir).groupBy("book_id", "page_num").agg(F.count("*").alias("n_lines"), F.min("line").alias("least_line"))


@query(f"{PAGES} SELECT book_id, page_num, {words('text')} AS n_words FROM book_pages")
def t3_word_count(spark, sf_dir):
    return views.book_pages(spark, sf_dir).select("book_id", "page_num", tx.word_count(F.col("text")).cast("long").alias("n_words"))


@query(
    r"""WITH f AS (SELECT doc_id, replace(replace(lang || '-' || source || '_' || regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), '-', ' '), '_', ' ') AS s FROM documents)
    SELECT doc_id, array_to_string(list_transform(string_split(s, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM f"""
)
def t4_infer_title(spark, sf_dir):
    name = F.concat("lang", F.lit("-"), "source", F.lit("_"), F.regexp_replace("text", "[^A-Za-z0-9 ]", " "), F.lit(".PDF"))
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.infer_title(name).alias("title"))


_NUMBER_VALUES = ", ".join(f"('{w}', {n})" for w, n in tx.NUMBERS.items())


@query(f"WITH n(word, value) AS (VALUES {_NUMBER_VALUES}) SELECT e.event_id, n.word, n.value FROM events e JOIN n ON n.value = e.event_id % 30 + 1")
def t5_word_to_int(spark, sf_dir):
    words_ = F.array(*(F.lit(w) for w, _ in sorted(tx.NUMBERS.items(), key=lambda x: x[1])))
    e = views.table(spark, sf_dir, "events").withColumn("word", F.get(words_, (F.col("event_id") % 30).cast("int")))
    return e.select("event_id", "word", tx.word_to_int(F.upper(F.regexp_replace("word", "-", " "))).alias("value"))


@query(
    f"""{PAGES}, r AS (SELECT book_id, page_num, n, repeat('C', n // 100) || ({list(views.ROMAN_TENS)})[(n // 10) % 10 + 1] || ({list(views.ROMAN_ONES)})[n % 10 + 1] AS roman FROM book_pages_n)
    SELECT book_id, page_num, roman, CAST(n AS INTEGER) AS value FROM r"""
)
def t6_roman_to_int(spark, sf_dir):
    p = views.book_pages(spark, sf_dir).select("book_id", "page_num", F.expr("(page_num + 3) div 4").alias("n"))
    arr = lambda xs: F.array(*map(F.lit, xs))
    roman = F.concat(F.repeat(F.lit("C"), F.floor(F.col("n") / 100).cast("int")), F.get(arr(views.ROMAN_TENS), (F.floor(F.col("n") / 10) % 10).cast("int")), F.get(arr(views.ROMAN_ONES), (F.col("n") % 10).cast("int")))
    return p.select("book_id", "page_num", roman.alias("roman"), tx.roman_to_int(F.lower(roman)).alias("value"))


@query(f"{LINES} SELECT book_id, page_num, line, {heading('line')} AS pattern FROM lines")
def t7_heading_pattern(spark, sf_dir):
    return page_lines(spark, sf_dir).withColumn("pattern", tx.heading_pattern(F.col("line")))


@query(f"{LINES} SELECT book_id, page_num, line FROM lines WHERE {all_caps('line')}")
def t8_is_all_caps_heading(spark, sf_dir):
    return page_lines(spark, sf_dir).where(tx.is_all_caps_heading(F.col("line")))


@query(f"{LINES} SELECT book_id, page_num, line FROM lines WHERE {mostly_caps('line')}")
def t9_is_mostly_caps(spark, sf_dir):
    return page_lines(spark, sf_dir).where(tx.is_mostly_caps(F.col("line")))


#: Every line as it stands, and with a heading of each kind before it: all eight rules meet texts.
NUMBERED = ("", "Chapter {n} ", "ch. {n}: ", "CHAPTER {w} ", "Chapter {r}: ", "Part {n} ", "part {w} ", "PART {r} - ", "{r}. ", "{n}. ")


def _roman_text(n: int) -> str:
    return views.ROMAN_TENS[n // 10] + views.ROMAN_ONES[n % 10]


def _prefix_sql() -> str:
    parts = {i: "''" if not p else " || ".join({"{n}": "CAST(n AS VARCHAR)", "{w}": "word", "{r}": "roman"}.get(x, quoted(x)) for x in re.split(r"(\{.\})", p) if x) for i, p in enumerate(NUMBERED)}
    return "CASE how " + " ".join(f"WHEN {i} THEN {v}" for i, v in parts.items()) + " END"


_WORDS = sorted(tx.NUMBERS.items(), key=lambda x: x[1])
NUMBERED_SQL = f"""{LINES}, w(word, n, roman) AS (VALUES {", ".join(f"('{w}', {n}, '{_roman_text(n)}')" for w, n in _WORDS)}),
    few AS (SELECT book_id, page_num, line, length(line) % {len(NUMBERED)} AS how, length(line) % 30 + 1 AS n FROM lines),
    said AS (SELECT book_id, page_num, {_prefix_sql()} || line AS line FROM few JOIN w USING (n))"""


@query(f"{NUMBERED_SQL} SELECT book_id, page_num, line, x.kind AS kind, x.value AS value FROM (SELECT *, {number('line')} AS x FROM said) WHERE x IS NOT NULL")
def t10_extract_chapter_num(spark, sf_dir):
    n = F.length("line") % 30 + 1
    of = lambda values: F.get(F.array(*map(F.lit, values)), n - 1)
    marks = {"{n}": n.cast("string"), "{w}": of([w for w, _ in _WORDS]), "{r}": of([_roman_text(v) for _, v in _WORDS])}
    before = F.lit("")
    for i, p in enumerate(NUMBERED):
        said = F.concat(F.lit(""), *(marks.get(x, F.lit(x)) for x in re.split(r"(\{.\})", p)))
        before = F.when(F.length("line") % len(NUMBERED) == i, said).otherwise(before)
    x = page_lines(spark, sf_dir).withColumn("line", F.concat(before, "line")).withColumn("n", tx.extract_chapter_num(F.col("line"))).where("n is not null")
    return x.select("book_id", "page_num", "line", "n.kind", "n.value")


@query(f"SELECT doc_id, {trim('''regexp_replace(regexp_replace(replace(text || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')''')} AS text FROM documents")
def t12_normalize_text(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.concat("text", F.lit("\r\n\n\n\n"), "text")).alias("text"))


#: Providers, statuses and messages as they may come, by the call's number.
PROVIDERS, CODES, SAID = ("gemini", "anthropic", "openai", "other"), (200, 429, 500, 503, 529), ("", "Quota exceeded", "RESOURCE_EXHAUSTED", "a Rate Limit", "Overloaded", "failed")
_PICK = {name: f"({list(values)})[call_id // {by} % {len(values)} + 1]" for name, values, by in (("provider", PROVIDERS, 1), ("status", CODES, 4), ("message", SAID, 20))}
_LIMITED = " ".join(f"WHEN provider = '{p}' THEN status IN {codes if len(codes) > 1 else f'({codes[0]})'} OR " + " OR ".join(f"contains(lower(message), '{x}')" for x in said) for p, (codes, said) in tx.RATE_LIMITS.items())


@query(f"WITH {views.CALLS_SQL}, c AS (SELECT call_id, {', '.join(f'{v} AS {k}' for k, v in _PICK.items())} FROM calls) SELECT call_id, provider, status, message, CASE {_LIMITED} ELSE false END AS limited FROM c")
def t17_is_rate_limit_error(spark, sf_dir):
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.expr(f"call_id div {by}") % len(values)).cast("int"))
    c = views.calls(spark, sf_dir).select("call_id", pick(PROVIDERS, 1).alias("provider"), pick(CODES, 4).alias("status"), pick(SAID, 20).alias("message"))
    return c.withColumn("limited", tx.is_rate_limit_error(F.col("provider"), F.col("status"), F.col("message")))


@query(
    f"""WITH c AS (SELECT conv_id, turn, {trim("regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')")} AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE nullif(t, '') END AS text, CASE WHEN turn % 4 = 3 THEN 'stopped: SAFETY' WHEN t = '' THEN 'empty response' END AS error FROM c"""
)
def t18_response_text(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "")).alias("t"))
    provider = F.get(F.array(F.lit("gemini"), F.lit("anthropic"), F.lit("openai"), F.lit("gemini")), (F.col("turn") % 4).cast("int"))
    text = lambda a, b: F.concat(F.lit(a), "t", F.lit(b))
    body = F.when(provider == "anthropic", text('{"content":[{"text":"', '"}]}')).when(provider == "openai", text('{"choices":[{"message":{"content":"', '"}}]}'))
    body = body.otherwise(F.concat(text('{"candidates":[{"content":{"parts":[{"text":"', '"}]},"finishReason":"'), F.when(F.col("turn") % 4 == 3, "SAFETY").otherwise("STOP"), F.lit('"}]}')))
    return c.withColumn("r", tx.response_text(provider, body)).select("conv_id", "turn", "r.text", "r.error")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value >= 80 THEN 'High' WHEN value >= 60 THEN 'Medium-High' ELSE 'Medium' END ELSE CASE WHEN value >= 70 THEN 'Medium-High' WHEN value >= 55 THEN 'Medium' ELSE 'Low' END END AS confidence FROM events")
def t19_confidence(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", tx.confidence(F.col("value"), F.col("event_type") == "error").alias("confidence"))
