"""Column functions over page, line, title and response text.

Spaces, line ends and case follow the source format's rules, not Spark's: trim
takes every Unicode space and line end, ``$`` is written ``\\z``, and patterns
with a case flag match accented letters of both cases. Lengths are in code
points. All patterns but NO_SPACE also run on RE2, so that SQL can use the same text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: what counts as a space, a heading, a number -----------------
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same spaces as characters, and what is none of them as a Java class that tells most characters in two tests instead of one for each part.
SPACES = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NO_SPACE = r"[^\t\n\x0B\f\r \x{00A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
UNITS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
WORD_NUMBER = rf"{UNITS}|twenty(?:(?:{WS}|-)(?:one|two|three|four|five|six|seven|eight|nine))?"
LETTER = r"A-Z\x{00C0}-\x{024F}"
DASH = r":\-\x{2013}\x{2014}"
HEADINGS = (
    ("chapter-number", rf"(?i)^(chapter|ch\.?){WS}*\d+(?:{WS}*\z|{WS}*[{DASH}\x{{00B7}}]|{WS}+[{LETTER}0-9])"),
    ("chapter-word", rf"(?i)^chapter{WS}+({WORD_NUMBER})(?:{WS}*\z|{WS}*[{DASH}]|{WS}+[{LETTER}])"),
    ("bare-arabic", rf"^\d{{1,2}}\.{WS}+[{LETTER}]"),
    ("part", rf"(?i)^part{WS}+(\d+|one|two|three|four|five|six|seven|eight|nine|ten|[ivxlc]+)(?:{WS}*\z|{WS}*[{DASH}])"),
    ("section", rf"(?i)^section{WS}+\d+({WS}|\z)"),
    ("bare-roman", rf"^[IVXLC]{{1,6}}\.{WS}+[A-Za-z]"),
    ("matter", rf"(?i)^(prologue|epilogue|introduction|preface|foreword|conclusion|afterword|appendix|acknowledgements?|bibliography|interlude)(?:{WS}*\z|{WS}*[{DASH}])"),
)
#: How the patterns begin, in two characters.
HEADING_START = r"(?i)^(?:[0-9ivxlc]|pa|se|pr|ep|fo|af|ap|ac|bi)"
ROMAN_HEADING = HEADINGS[5][1]
LABEL = r"(?i)^(chapter|part)\z"
NUMBER_LINE = rf"(?i)^({WORD_NUMBER}|\d{{1,3}})\z"
NUMBER_PREFIX = rf"(?i)^({UNITS}|twenty)"
DIGITS = r"^[0-9]+\z"
CAPS_LINE = rf"^(?:[A-Z0-9\-\x{{2013}}\x{{2014}}:,.'!?\"\x{{201C}}\x{{201D}}\x{{2018}}\x{{2019}}]|{WS})+\z"
NUMBER_RULES = (
    ("chapter", "arabic", rf"(?i)^(?:chapter|ch\.?){WS}+(\d{{1,3}})(?:{WS}|\z|[{DASH}\x{{00B7}}])"),
    ("chapter", "word", rf"(?i)^(?:chapter|ch\.?){WS}+({WORD_NUMBER})(?:{WS}|\z|[{DASH}])"),
    ("chapter", "roman", rf"(?i)^(?:chapter|ch\.?){WS}+([IVXLC]{{1,6}})(?:{WS}|\z|[{DASH}])"),
    ("part", "arabic", rf"(?i)^part{WS}+(\d{{1,2}})(?:{WS}|\z|[{DASH}])"),
    ("part", "word", rf"(?i)^part{WS}+(one|two|three|four|five|six|seven|eight|nine|ten)(?:{WS}|\z|[{DASH}])"),
    ("part", "roman", rf"(?i)^part{WS}+([IVXLC]{{1,6}})(?:{WS}|\z|[{DASH}])"),
    ("roman", "roman", rf"^([IVXLC]{{1,6}})\.{WS}+[A-Za-z]"),
    ("arabic-bare", "arabic", rf"^(\d{{1,2}})\.{WS}+[{LETTER}]"),
)
#: Limits are part of the rules: provider -> statuses and phrases of a rate limit.
RATE_LIMITS = {
    "gemini": ((429, 503), ("quota", "resource_exhausted", "rate limit")),
    "anthropic": ((429, 529), ("rate limit", "overloaded")),
    "openai": ((429,), ("rate limit", "quota")),
}
TEXT_PATHS = {"gemini": "$.candidates[0].content.parts[0].text", "anthropic": "$.content[0].text", "openai": "$.choices[0].message.content"}
# --- end of fixed values ---------------------------------------------------------

NUMBERS = {w: i + 1 for i, w in enumerate(UNITS.split("|"))} | {"twenty": 20, "thirty": 30} | {f"twenty-{w}": 21 + i for i, w in enumerate(UNITS.split("|")[:9])}
ROMANS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def _java(pattern: str) -> str:
    """The same pattern with Java's flag for case beyond ASCII."""
    return pattern.replace("(?i)", "(?iu)", 1)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(_java(pattern))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def split_lines(c: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(c, "\n", -1), trim), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NO_SPACE}+"))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def infer_title(filename: Column) -> Column:
    """The file name without .pdf, dashes and underscores as spaces, the first letter of each ASCII word in upper case."""
    plain = F.regexp_replace(F.regexp_replace(filename, r"(?i)\.pdf\z", ""), "[-_]", " ")
    parts = F.split(plain, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", -1)
    up = F.transform(parts, lambda p: F.when(p.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(p))
    return F.array_join(up, "")


def word_to_int(c: Column) -> Column:
    """one to thirty; inner spaces count as hyphens; else null."""
    table = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))
    return F.try_element_at(table, F.regexp_replace(F.lower(c), f"{WS}+", "-"))


def roman_to_int(c: Column) -> Column:
    """Right to left, less than the largest so far is taken off; null unless 1 to 500."""
    table = F.create_map(*(F.lit(x) for pair in ROMANS.items() for x in pair))
    letters = F.reverse(F.split(F.upper(c), ""))

    def step(acc: Column, ch: Column) -> Column:
        v = F.coalesce(F.try_element_at(table, ch), F.lit(0))
        low = v < acc["prev"]
        return F.struct((acc["total"] + F.when(low, -v).otherwise(v)).alias("total"), F.when(low, acc["prev"]).otherwise(v).alias("prev"))

    total = F.aggregate(letters, F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev")), step, lambda acc: acc["total"])
    return F.when(F.upper(c).rlike("^[IVXLCDM]+\\z") & total.between(1, 500), total)


def heading_pattern(c: Column) -> Column:
    """Name of the first heading pattern that matches, else null. Lines that do not begin as any of them does are not tried further."""
    return F.when(matches(F.left(c, F.lit(2)), HEADING_START), F.coalesce(*(F.when(matches(c, p), F.lit(name)) for name, p in HEADINGS)))


def is_all_caps_heading(c: Column) -> Column:
    return F.length(c).between(3, 80) & word_count(c).between(1, 12) & c.rlike(CAPS_LINE) & c.rlike("[A-Z]{2,}")


def is_mostly_caps(c: Column) -> Column:
    """At least two ASCII letters and seven tenths of them capitals: 3 capitals or more for 7 small letters. A line whose beginning has too many small letters is told by that beginning."""
    capitals, small = F.length(F.regexp_replace(c, "[^A-Z]+", "")), lambda t: F.length(F.regexp_replace(t, "[^a-z]+", ""))
    return (capitals * 3 >= small(F.left(c, F.lit(64))) * 7) & (capitals >= 2) & (capitals * 3 >= small(c) * 7)


def extract_chapter_num(title: Column) -> Column:
    """struct(value, kind) by the first rule that matches and has a value, else null."""
    t = trim(title)
    tries = []
    for kind, how, pattern in NUMBER_RULES:
        got = F.regexp_extract(t, _java(pattern), 1)
        value = {"arabic": F.try_to_number(got, F.lit("999")).cast("int"), "word": word_to_int(got), "roman": roman_to_int(got)}[how]
        tries.append(F.when((got != "") & value.isNotNull(), F.struct(value.cast("int").alias("value"), F.lit(kind).alias("kind"))))
    return F.coalesce(*tries)


def normalize_text(c: Column) -> Column:
    one = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "[ \t]+", " ")
    return trim(F.regexp_replace(one, "\n{3,}", "\n\n"))


def is_rate_limit_error(provider: Column, status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for name, (codes, phrases) in RATE_LIMITS.items():
        said = F.coalesce(status.isin(*codes), F.lit(False))
        for p in phrases:
            said = said | F.contains(low, F.lit(p))
        out = F.when(provider == name, said).otherwise(out)
    return out


def response_text(provider: Column, body: Column) -> Column:
    """struct(text, error): the answer's trimmed text, or why there is none."""
    text = F.coalesce(*(F.when(provider == p, F.get_json_object(body, path)) for p, path in TEXT_PATHS.items()))
    stop = F.get_json_object(body, "$.candidates[0].finishReason")
    gemini = provider == "gemini"
    error = (
        F.when(gemini & F.get_json_object(body, "$.candidates[0]").isNull(), F.lit("no candidates"))
        .when(gemini & stop.isNotNull() & (stop != "") & ~stop.isin("STOP", "MAX_TOKENS"), F.concat(F.lit("stopped: "), stop))
        .when(F.coalesce(text, F.lit("")) == "", F.lit("empty response"))
    )
    return F.struct(F.when(error.isNull(), trim(text)).alias("text"), error.alias("error"))


def confidence(score: Column, has_keyword: Column) -> Column:
    keyed = F.when(score >= 80, "High").when(score >= 60, "Medium-High").otherwise("Medium")
    plain = F.when(score >= 70, "Medium-High").when(score >= 55, "Medium").otherwise("Low")
    return F.when(has_keyword, keyed).otherwise(plain)
