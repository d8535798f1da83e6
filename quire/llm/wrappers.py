"""Main text of pages by wrapper induction.

A page is a tree of its block elements; siblings of one signature (element, classes, id) are one slot. The trees of a host's pages are
aligned by simple tree matching and become its wrapper: every slot with the number of its pages, its text and link lengths and
the texts that all of those pages have there. Tasks fold their own pages first, so pages are not shuffled; wrappers are merged in
rounds of FAN, so a host of any size is many small merges. A page is then aligned with its host's wrapper: a slot's constant texts are the
template, a slot that is mostly links is a menu, what varies is content. Elements that say what they are (nav, footer, aside,
classes like ``sidebar`` or ``cookie-notice``) never hold content, whatever varies in them.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import released, slices, split_join, stored

#: Pages that a text must be constant in to be template, share of link text from which a slot is a menu, share of a page's text from which constant text tells copies, not a template.
CONSTANT, MENU, COPY = 5, 0.5, 0.5
#: Wrappers merged by one group of a round, pages that a task folds before it gives its wrappers away, bytes of wrappers that are broadcast at most.
FAN, FLUSH, BROADCAST = 64, 20_000, 32 << 20
#: Nesting from which elements are siblings (as browsers do).
DEPTH = 200
RESULT = "page_id long, url string, text string, n_chars long, n_blocks long, n_template long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("html body address article aside blockquote center dd details summary div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main nav ol p pre section table caption thead tbody tfoot tr ul".split())
#: Elements whose content is never the article's.
DROPPED = RAW | frozenset("head nav header footer aside form template svg canvas object video audio button select input label fieldset dialog menu search".split())
#: A start tag that ends an open paragraph.
ENDS_P = BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption"}
#: An element that its like, or another of its kind, ends, up to the nearest of the elements that hold it.
ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
#: Words in classes, ids and roles of what is not the article.
ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars widget widgets related recommended recommendations comment comments commentlist disqus respond replies share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead pagination pager skip contentinfo complementary search dialog form toolbar hidden".split()
)
#: Elements that hold a whole page or article: their classes tell of what they hold.
WHOLE = frozenset("html body main article".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A block element of a page."""

    __slots__ = ("kids", "main", "out", "sig", "up")

    def __init__(self, sig: str, up: Node | None, out: bool, main: bool) -> None:
        self.sig, self.up, self.out, self.main, self.kids = sig, up, out, main, []


def look(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Signature of an element, whether it is no content by its name or attributes, whether it is said to be the main part."""
    if not attributes.strip():
        return tag, tag in DROPPED, tag in ("article", "main")
    sig, out, main = tag, tag in DROPPED, tag in ("article", "main")
    for m in ATTRIBUTE.finditer(attributes):
        if m.start() and not attributes[m.start() - 1].isspace():
            continue
        name, value = m[1].lower(), entities.unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out = out or tag not in WHOLE
        elif name == "itemprop":
            main = main or value == "articleBody"
        elif name in ("class", "id", "role"):
            for w in value.split():
                sig += f" {name[0]}:{re.sub(r'[0-9]+', 'N', w)}"
                low = w.lower()
                main = main or name == "role" and low in ("main", "article")
                if tag not in WHOLE and not low.startswith(("has-", "with-", "no-", "non-")):
                    out = out or any(x.lower() in ROLES for x in WORD.findall(w))
    return sig, out, main


def parsed(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The root, and the page's blocks of text in order: element, text with single spaces, characters of it that are links.

    Unclosed and wrongly nested elements are read as browsers do: a block ends an open paragraph, an item ends the one before it, an
    inline element's end never ends a block, ends without a start are skipped.
    """
    root = Node("", None, False, False)
    blocks: list[tuple[Node, str, int]] = []
    # an open element: name, its block, out, whether it is a block, whether it is a link
    stack: list[tuple[str, Node, bool, bool, bool]] = [("", root, False, True, False)]
    held: list[str] = []
    linked = 0

    def ended() -> None:
        """What was read since the last end of a block is a block."""
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((stack[-1][1], text, min(linked, len(text))))
            held.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        name, _, out, _, link = stack[-1]
        if text and not out:
            text = entities.unescape(text) if "&" in text else text
            held.append(text)
            if link:
                linked += len(text.strip())

    def close(to: int) -> None:
        if any(s[3] for s in stack[to:]):
            ended()
        del stack[to:]

    def nearest(names: tuple[str, ...], within: tuple[str, ...]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in within:
                return 0
        return 0

    at, end = 0, page.rfind(">") + 1
    while at < end:
        m = TAG.search(page, at, end)
        if not m:
            break  # what is left is text
        said(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                said(m[0][9:].removesuffix("]]>"))
            continue
        name, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if name == "br" or name == "p" and not nearest(("p",), ()):
                ended() if name == "p" else said(" ")
                continue
            k = nearest((name,), ("td", "th", "table") if name not in ("table", "body", "html", "tr", "td", "th", "tbody", "thead", "tfoot") and name not in BLOCK else ())
            if k and (name in BLOCK or name in ("td", "th") or not any(s[3] for s in stack[k + 1 :])):
                close(k)
                if name in ("td", "th"):
                    said(" ")
            continue
        if name in ENDS_P and (k := nearest(("p",), ("button", "table", "td", "th", "caption"))):
            close(k)
        if name in ENDED and (k := nearest(ENDED[name], HOLDS[name])):
            close(k)
        if name in ("td", "th"):
            said(" ")
        if name in RAW:
            shut = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if not shut:
                at = len(page)
                break
            at = (page.find(">", shut.end()) + 1) or len(page)
            continue
        if name in VOID:
            if name == "br":
                said(" ")
            elif name == "hr":
                ended()
            continue
        sig, out, main = look(name, attributes)
        block, up = name in BLOCK, stack[-1]
        node, out = up[1], out or up[2]
        if block:
            ended()
            if len(stack) < DEPTH:
                node = Node(sig, up[1], out, main and not out)
                up[1].kids.append(node)
        if not attributes.rstrip().endswith("/") or name not in ("svg", "path", "use"):
            stack.append((name, node, out, block, up[4] or name == "a"))
    if at < len(page):
        said(page[at:])
    ended()
    return root, blocks


class Slot:
    """A place of a wrapper: its signature, pages, characters of text and of links, the texts that all its pages have here, places below it."""

    __slots__ = ("chars", "common", "kids", "links", "pages", "sig")

    def __init__(self, sig: str, pages: int = 1, chars: int = 0, links: int = 0, common: set[int] | None = None, kids: list[Slot] | None = None) -> None:
        self.sig, self.pages, self.chars, self.links, self.common, self.kids = sig, pages, chars, links, common or set(), kids or []

    def plain(self, least: int = 0) -> list:
        """As JSON; constants that too few pages show are left out."""
        return [self.sig, self.pages, self.chars, self.links, sorted(self.common) if self.pages >= least else [], [k.plain(least) for k in self.kids]]

    @classmethod
    def of(cls, x: list) -> Slot:
        return cls(x[0], x[1], x[2], x[3], set(x[4]), [cls.of(k) for k in x[5]])


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def slots(root: Node, blocks: list[tuple[Node, str, int]]) -> tuple[Slot, dict[int, Slot]]:
    """A page as a wrapper of its own, and the slot of each of its elements: siblings of one signature share one."""
    top = Slot("")
    at = {id(root): top}
    work = deque([root])
    below: dict[int, dict[str, Slot]] = {}
    while work:
        node = work.popleft()
        mine = at[id(node)]
        names = below.setdefault(id(mine), {})
        for kid in node.kids:
            if kid.out:
                continue
            slot = names.get(kid.sig)
            if slot is None:
                slot = names[kid.sig] = Slot(kid.sig)
                mine.kids.append(slot)
            at[id(kid)] = slot
            work.append(kid)
    for node, text, links in blocks:
        slot = at[id(node)]
        slot.common.add(digest(text))
        slot.chars += len(text)
        slot.links += links
    return top, at


def matched(a: Slot, b: Slot) -> int:
    """Simple tree matching: pairs of the largest mapping that keeps roots, ancestors and order."""
    return 1 + sum(matched(a.kids[i], b.kids[j]) for i, j in pairs(a.kids, b.kids)) if a.sig == b.sig else 0


def pairs(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """Places of two lists that are matched, in order: the alignment of the largest mappings. A list has each signature once, so equal lists match one to one."""
    if len(a) == len(b) and all(x.sig == y.sig for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    n, m = len(a), len(b)
    weight = {(i, j): matched(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if x.sig == y.sig}
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight.get((i, j), 0))
    out, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merged(a: Slot, b: Slot) -> Slot:
    """b's pages added to a, in place: matched places become one, others are put in where they stand.

    A signature that crosses the alignment is still the one place that it has, so a wrapper's size is bounded by the host's distinct signatures and not by its pages.
    """
    a.pages, a.chars, a.links, a.common = a.pages + b.pages, a.chars + b.chars, a.links + b.links, a.common & b.common
    if not b.kids:
        return a
    to = {j: i for i, j in pairs(a.kids, b.kids)}
    taken, spare = set(to.values()), {}
    for i, k in enumerate(a.kids):
        if i not in taken:
            spare.setdefault(k.sig, k)
    kids, at = [], 0
    for j, k in enumerate(b.kids):
        if j in to:
            kids += a.kids[at : to[j]]
            kids.append(merged(a.kids[to[j]], k))
            at = to[j] + 1
        elif k.sig in spare:
            merged(spare[k.sig], k)
        else:
            kids.append(k)
    a.kids = kids + a.kids[at:]
    return a


def aligned(page: Slot, wrapper: Slot) -> dict[int, Slot]:
    """The wrapper's slot of each slot of a page of it."""
    out, work = {}, [(page, wrapper)]
    while work:
        p, w = work.pop()
        out[id(p)] = w
        to = dict(pairs(p.kids, w.kids))
        rest = {k.sig: k for j, k in enumerate(w.kids) if j not in to.values()}
        for i, k in enumerate(p.kids):
            found = w.kids[to[i]] if i in to else rest.get(k.sig)
            if found is not None:
                work.append((k, found))
    return out


def content(page: str, wrapper: Slot | None) -> tuple[list[str], int]:
    """The page's blocks of content in order, and how many of its blocks the wrapper tells to be template or menu."""
    root, blocks = parsed(page)

    def inside(node: Node | None) -> bool:
        while node is not None:
            if node.main:
                return True
            node = node.up
        return False

    own, at = slots(root, blocks)
    main = [inside(b[0]) for b in blocks]
    some = [b for b, m in zip(blocks, main) if m] or blocks
    free = not any(main)
    to = aligned(own, wrapper) if wrapper is not None else {}
    kept = []
    fixed = 0
    for node, text, links in some:
        w = to.get(id(at[id(node)]))
        if w is None:
            # without a second page a block that is all links is a menu where nothing says what is the article
            menu, constant = free and links >= len(text) and node.sig.split(" ")[0] == "li", False
        else:
            menu = free and w.links >= MENU * w.chars and (links >= MENU * len(text))
            constant = w.pages >= CONSTANT and digest(text) in w.common
        fixed += constant * len(text)
        kept.append((text, menu, constant))
    copies = fixed > COPY * sum(len(t) for t, menu, _ in kept if not menu)
    out = [t for t, menu, constant in kept if not menu and (copies or not constant)]
    return out, len(kept) - len(out)


def host(url: str = "url"):
    """The host that a URL names, empty if it names none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _wrapper_rows(rows: list[tuple[str, int, Slot]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].pages for r in rows], pa.int64()), pa.array([json.dumps(r[2].plain(), separators=(",", ":")) for r in rows], pa.string())], names=["host", "part", "n", "wrapper"])


WRAPPER = "host string, part long, n long, wrapper string"


def induced(pages: DataFrame) -> DataFrame:
    """host, n (pages), wrapper (JSON) of every host over (host, html) rows; pages whose URL names no host share a wrapper of nothing."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        part, held, n = TaskContext.get().partitionId(), {}, 0
        for batch in slices(batches, 128):
            for name, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                # the pages of no host have nothing in common
                one = slots(*parsed(html or ""))[0] if name else Slot("")
                held[name] = merged(held[name], one) if name in held else one
            n += batch.num_rows
            if n >= FLUSH:
                yield _wrapper_rows([(k, part, v) for k, v in held.items()])
                held, n = {}, 0
        if held:
            yield _wrapper_rows([(k, part, v) for k, v in held.items()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for name, part, wrapper in zip(*(batch[c].to_pylist() for c in ("host", "part", "wrapper"))):
                one = Slot.of(json.loads(wrapper))
                if (name, part) != key:
                    if held is not None:
                        yield _wrapper_rows([(*key, held)])
                    key, held = (name, part), one
                else:
                    held = merged(held, one)
        if held is not None:
            yield _wrapper_rows([(*key, held)])

    made = stored(pages.select("host", "html").mapInArrow(fold, WRAPPER), "wrappers")
    top = made.agg(F.max("part")).first()[0]
    while top is not None:
        made = made.withColumn("part", F.expr(f"part div {FAN}"))
        made = stored(made.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(merge, WRAPPER), "wrappers")
        top = top // FAN or None
    return made.select("host", "n", "wrapper")


def main_text(pages: DataFrame, most: int = BROADCAST) -> DataFrame:
    """page_id, url, text (blocks of content joined by blank lines), n_chars, n_blocks, n_template of every page.

    Null and empty html, and pages without content, have an empty text. A null or odd URL names no host: such a page is read by what its elements say
    alone, and so is the only page of a host. Pages and texts of any length are read whole; repeated pages are rows of their own. A host whose
    pages are copies has no template: what all of them say is kept where it is over half of a page. An empty table gives an empty one; other columns are left out.
    """
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    wrappers = induced(kept)
    size, total = wrappers.agg(F.sum(F.length("wrapper")), F.sum("n")).first()
    if total is None:
        return pages.sparkSession.createDataFrame([], RESULT)
    if size <= most:
        both = kept.join(F.broadcast(wrappers.drop("n")), "host")
    else:
        both = split_join(kept, wrappers, ["host"], "page_id", total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        known: dict[str, Slot | None] = {}
        for batch in slices(batches, 128):
            out = []
            for page_id, url, html, name, wrapper in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "host", "wrapper"))):
                if name not in known:
                    if len(known) >= 256:
                        known.clear()
                    one = Slot.of(json.loads(wrapper))
                    known[name] = one if name and one.pages > 1 else None
                blocks, template = content(html or "", known[name])
                text = "\n\n".join(blocks)
                out.append((page_id, url, text, len(text), len(blocks), template))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_template"])

    return both.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, RESULT)
