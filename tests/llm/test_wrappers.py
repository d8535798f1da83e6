"""Main text of pages: the given table against a plain reading of it, and made sites."""

import html
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quire.llm import wrappers as w

COLUMNS = "page_id long, url string, html string"


def test_given_pages(spark, sf):
    """The table's articles hold h1, p, b and br alone, cut anywhere: read by splitting."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in w.main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def site(name, n, body, seed=1):
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(99)) for _ in range(k))
    return [(f"https://{name}/{k}", *body(k, words)) for k in range(n)]


def soup(k, words):
    """Without an element that says what is the article: constant parts, link lists of changing links, slogans in a row of divs."""
    a, b = words(30), words(40)
    page = f"""<html><body><div class=top><div class=logo>The Daily Herald of Everything</div><ul class=links>{''.join(f'<li><a href=/{x}>{words(1)}</a>' for x in range(5))}</ul></div>
      <div class=text id=p{k}><h1>{words(4)} {k}</h1><p>{a} &amp; caf&eacute;<p>{b}<div class="cookie-notice">{words(5)}</div><p class=note>Reprints need the written leave of the house.</p></div>
      <div class=last>All rights are with their holders.</div></body>"""
    return page, f"{a} & café", b


def article(k, words):
    """A main element with a line that all pages have, comments and a sidebar inside of it."""
    a, b = words(20), words(25)
    return f"<main><h2>Head {k}</h2><p>{a}</p><aside>{words(9)}</aside><p>Sign up and never miss a thing we write</p><p>{b}</p><div id='comments'><p>{words(8)}</p></div></main><p>{words(7)}</p>", a, b


def text_of(spark, sites, **more):
    rows = [(k, url, page) for k, (url, page, *_) in enumerate(sites)]
    return {r.page_id: r for r in w.main_text(spark.createDataFrame(rows, COLUMNS).repartition(7), **more).collect()}


@pytest.mark.parametrize("most", [0, w.BROADCAST])
def test_template_and_slots(spark, most):
    """Constant nodes go, lists of links go, varying slots stay; the same with wrappers joined by a shuffle."""
    sites = site("a.example", 12, soup) + site("b.example", 9, article, 2) + site("alone.example", 1, article, 3)
    got = text_of(spark, sites, most=most)
    for k, (url, _, a, b) in enumerate(sites):
        blocks = got[k].text.split("\n\n")
        if "a.example" in url:
            assert blocks[1:] == [a, b] and len(blocks) == 3
        elif "b.example" in url:
            assert blocks == [f"Head {k - 12}", a, b]
        else:
            # one page shows no template
            assert blocks == ["Head 0", a, "Sign up and never miss a thing we write", b]


def test_copies_are_no_template(spark):
    """Pages that say the same in their article keep it, however many they are."""
    copy = [(f"https://c.example/{k}", f"<nav>{k}</nav><article><p>one text</p><p>and its second part</p></article>") for k in range(40)]
    assert {r.text for r in text_of(spark, copy).values()} == {"one text\n\nand its second part"}


def test_edges(spark):
    rows = [
        (1, None, None), (2, "no url", ""), (3, "http://x.example", "plain &lt;text&gt; alone"), (4, "http://x.example/2", "<script>if (a</script>" + "<p>" + "long " * 50000),
        (4, "http://x.example/2", "<div>a<span class='share'>b</span> c</div>"), (None, "ftp://u@h.example:1/x", "<p>n</p>"), (6, "http://x.example", "<div>" * 5000 + "deep<p>er</p>"), (7, "", "<style>p"), (8, "u", "<p a='>'>q</p><p b=\"x>r</p>"),
    ]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("host", F.lit("z")).withColumn("text", F.lit("t")).withColumn("wrapper", F.lit(1))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in w.main_text(df).collect()), key=str)
    want = [(1, "", 0), (2, "", 0), (3, "plain <text> alone", 18), (4, " ".join(["long"] * 50000), 249999), (4, "a c", 3), (None, "n", 1), (6, "deep\n\ner", 8), (7, "", 0), (8, "q\n\nr", 4)]
    assert got == sorted(want, key=str)
    assert w.main_text(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<p><b>a<p>b</b> c<i>d</p>", ["a", "b cd"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]),
        ("a<br>b<!-- > c --> d&nbsp;e&#x41;&am", ["a b d eA&am"]),
        ("<div>x<textarea><p>y</p></textarea><svg><text>z</text></svg></div>w</div>v", ["x", "wv"]),
        ("<P>A</P><SCRIPT>'</p>'</SCRIPT><p hidden>b<p style='display: none'>c<p>D", ["A", "D"]),
        ("<dl><dt>a<dd>b<dt>c</dl><p>x</span>y</em>", ["a", "b", "c", "xy"]),
        ("<p>a &lt;b&gt; 1 < 2 > 0</p>", ["a <b> 1 < 2 > 0"]),
    ],
)
def test_reading(page, want):
    assert [b[1] for b in w.parsed(page)[1] if not b[0].out] == want


def tree(rng, sig="r", depth=0):
    kids = rng.sample("abcd", rng.randrange(4)) if depth < 3 else []
    return w.Slot(sig, kids=[tree(rng, k, depth + 1) for k in kids])


def plain_matching(a, b):
    """Every way to pair the children in order."""
    if a.sig != b.sig:
        return 0
    best = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for x in combinations(a.kids, n):
            for y in combinations(b.kids, n):
                best = max(best, sum(map(plain_matching, x, y)))
    return best + 1


def test_simple_tree_matching():
    rng = random.Random(5)
    for _ in range(200):
        a, b = tree(rng), tree(rng)
        assert w.matched(a, b) == plain_matching(a, b)


def shape(s):
    return (s.sig, s.pages, s.chars, s.links, tuple(sorted(s.common)), tuple(sorted(map(shape, s.kids))))


def test_wrapper_does_not_depend_on_order():
    pages = [p for _, p, *_ in site("a", 10, soup) + site("b", 6, article)]
    fold = lambda ps: [x := None, *(x := (w.slots(*w.parsed(p))[0] if x is None else w.merged(x, w.slots(*w.parsed(p))[0])) for p in ps)][-1]
    one = fold(pages)
    random.Random(1).shuffle(pages)
    assert shape(w.merged(fold(pages[:7]), fold(pages[7:]))) == shape(one)
    assert shape(w.Slot.of(one.plain())) == shape(one)
