"""Main text of web pages by tree scoring.

Paragraphs earn points for length and commas and pass them to their ancestors, less the farther
up; a container's points are discounted by the share of its text inside links. The best container
and such of its siblings as look alike are kept, without the parts that never are article text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import slices

_OTHER = r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({})>|<[!?/][^>]*(?:>|\Z)"
_TOKEN = re.compile(_OTHER.format(r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""), re.S)
#: For what follows a tag whose quotes don't close: a tag ends at the next >.
_LOOSE = re.compile(_OTHER.format(r"[^>]*+"), re.S)
_TAG_START = re.compile(r"</?[a-zA-Z]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Fixed values of HTML: elements without content, with raw content, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose start ends an open paragraph; those that end an open one of their kind.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What bounds the search for an open element that a start tag closes.
SCOPE = frozenset("table ul ol dl div section article main body html form nav aside header footer blockquote".split())
#: Elements that are never article text.
NEVER = frozenset("head nav footer aside button select dialog svg canvas object menu template audio video".split()) | RAW
#: Words in class, id or role that mark a part as no article text.
MARKS = frozenset("ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus replies respond sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead related recommended recommendations share sharing social newsletter subscribe subscription signup login widget widgets toolbar skip toc contentinfo complementary search".split())
#: Marks of readers' comments, which can be longer than the article.
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: Words beside a mark that say it's absent, or a state of the page, not its name.
NEGATIONS = frozenset("no has have without with hide free enabled disabled open closed on off active".split())
#: Words that make a container likely.
GOOD = frozenset("article content main body entry post story text blog".split())
#: Fixed values of HTML: headings; what holds parts of an article, but is not one.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("p pre li blockquote dd dt ul ol dl figure table tbody thead tfoot tr".split()) | HEADINGS


class Node:
    __slots__ = ("tag", "parent", "score", "chars", "linked", "skip", "mark", "at", "bonus")

    def __init__(self, tag: str, parent: Node | None, skip: bool, at: int, bonus: float, mark: str = ""):
        self.tag, self.parent, self.skip, self.at, self.bonus, self.mark = tag, parent, skip, at, bonus, mark
        self.score = self.chars = self.linked = 0.0


def _words(name: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", name).lower()))


def _kind(tag: str, attributes: str, inside_article: bool) -> tuple[bool, str, float]:
    """(never article text, mark against it, bonus as a container). A mark is "part", "comments" or none."""
    if tag in NEVER or (tag == "header" and not inside_article):
        return True, "", 0.0
    bonus, mark = 25.0 if tag in ("article", "main") else 0.0, "part" if tag == "form" else ""
    if attributes and not attributes.isspace():
        if _HIDDEN.search(attributes):
            return True, "", 0.0
        names = [_words(n) for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]
        good = any(n & GOOD for n in names)
        marks = set().union(*[n & MARKS for n in names if not n & NEGATIONS])
        if marks and tag not in ("body", "html", "article", "main") and not (good and marks <= {"header"}):
            mark = "comments" if marks & COMMENTS else "part"
        bonus += 10.0 * good
    return False, mark, bonus


def blocks(html: str) -> list[tuple[Node, str, int]]:
    """Text blocks in page order: (innermost block element, text, characters inside links)."""
    root = Node("html", None, False, 0, 0.0)
    stack, out = [root], []
    held: list[str] = []
    links, anchor = 0, False
    articles = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((stack[-1], text, min(links, len(text))))
            held.clear()
        links = 0

    def pop_to(k: int) -> None:
        nonlocal articles
        while len(stack) > k:
            articles -= stack.pop().tag == "article"

    at, end, count = 0, len(html), 0
    token = _TOKEN
    while at < end:
        m, place = None, html.find("<", at)
        while place >= 0:
            m = token.match(html, place)
            if m:
                break
            if _TAG_START.match(html, place):
                if token is _LOOSE:  # no > follows: the rest is text
                    break
                token = _LOOSE  # quotes that don't close; once a page
            else:
                place = html.find("<", place + 1)
        stop = m.start() if m else end
        if stop > at and not stack[-1].skip:
            text = unescape(html[at:stop])
            held.append(text)
            if anchor:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1]:
            if tag in RAW and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                anchor = True
            elif tag == "hr":
                flush()
            if tag in VOID or tag in INLINE:
                if tag in INLINE and tag != "a" and m[3] and not m[3].isspace() and any(_kind(tag, m[3], True)[:2]) and not m[3].rstrip().endswith("/"):
                    stack.append(Node(tag, stack[-1], True, count, 0.0))
                continue
            flush()
            anchor = False
            closes = SELF_CLOSING.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in closes:
                    pop_to(k)
                elif stack[k].tag in SCOPE:
                    break
            count += 1
            skip, mark, bonus = _kind(tag, m[3], articles > 0)
            if tag != "html":
                stack.append(Node(tag, stack[-1], skip or stack[-1].skip, count, bonus, mark))
                articles += tag == "article"
        elif tag == "a":
            anchor = False
        elif tag in INLINE:
            if stack[-1].tag == tag and stack[-1].skip:
                pop_to(len(stack) - 1)
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    flush()
                    pop_to(k)
                    break
    flush()
    return out


def unmarked(found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside marked elements. Structure, not size, tells whether a mark names a part of the page or
    the page: it is ignored on an element that holds the likeliest container while there is none as
    likely outside, and where there is no container, on one that all prose of the page is in. Comments
    are only kept where nothing else is likely or prose. Outer marks are judged before those within."""
    while True:
        likely: list[set[int]] = [set(), set(), set()]  # blocks by how likely their container below any mark is
        inside: dict[int, list[set[int]]] = {}  # the same by marked element
        marked: dict[int, Node] = {}
        outer: set[int] = set()
        for i, (node, text, linked) in enumerate(found):
            n = len(text) - linked
            if n <= 0:
                continue
            path, kind, x = [], 0, node
            while x is not None:
                if x.mark:
                    path.append(x)
                elif not path:
                    kind = max(kind, 2 if x.tag in ("article", "main") else int(x.bonus > 0))
                x = x.parent
            if kind or (n >= 25 and not path):
                likely[kind].add(i)
            for y in path:
                marked[id(y)] = y
                inside.setdefault(id(y), [set(), set(), set()])[kind].add(i)
            if path:
                outer.add(id(path[-1]))
        named = set()
        for k in outer:
            own = inside[k]
            within, out = (max((r for r in (1, 2) if s[r]), default=0) for s in (own, [a - b for a, b in zip(likely, own)]))
            plain = bool(likely[0] - own[0])
            if (within > 0 and not out and not plain) if marked[k].mark == "comments" else (within > out or not (within or out or plain)):
                named.add(tuple(frozenset(s) for s in own))
        if not named:
            return [b for b in found if not _marked(b[0])]
        for k, own in inside.items():  # an element that holds the same blocks says no more
            if (k in outer or marked[k].mark != "comments") and tuple(frozenset(s) for s in own) in named:
                marked[k].mark = ""


def _marked(x: Node | None) -> bool:
    while x is not None:
        if x.mark:
            return True
        x = x.parent
    return False


def extract(html: str | None) -> str:
    """The main text: blocks joined by line feeds, empty if there is none."""
    found = unmarked(blocks(html or ""))
    if not found:
        return ""
    nodes: dict[int, Node] = {}
    for node, text, linked in found:
        n = len(text)
        points = 1 + sum(text.count(c) for c in ",，、") + min(n / 100, 3) if n >= 25 else n / 25
        points *= 1 - linked / n
        up, share = node, 1.0
        depth = 0
        while up is not None:
            nodes[id(up)] = up
            up.chars += n
            up.linked += linked
            if depth or (up.tag not in PARTS and up.tag != "td"):
                up.score += points * share
                share = 0.5 if share == 1 else share * 2 / 3
            depth += 1
            up = up.parent
    value = lambda x: (x.score + x.bonus * (x.score > 0)) * (1 - x.linked / x.chars)
    best = max((x for x in nodes.values() if x.tag not in PARTS), key=lambda x: (value(x), -x.at))
    top = value(best)
    keep = {id(best)}
    heads = {id(node) for node, _, linked in found if node.tag in HEADINGS and not linked}
    sections = {id(node.parent) for node, text, linked in found if (node.tag == "p" or id(node) in heads) and linked < len(text) / 4}
    for x in nodes.values():
        if x.parent is best.parent and x is not best and best.parent is not None:
            prose = x.tag == "p" and x.linked / x.chars < 0.25 and (x.chars > 80 or not x.linked)
            section = x.tag == best.tag and x.linked / x.chars < 0.25 and id(x) in sections
            if value(x) >= max(10.0, 0.2 * top) or ((prose or section or id(x) in heads) and best.tag not in ("article", "main")):
                keep.add(id(x))
    inside: dict[int, bool] = {}

    def kept(x: Node | None) -> bool:
        path = []
        while x is not None and id(x) not in inside and id(x) not in keep:
            path.append(id(x))
            x = x.parent
        yes = x is not None and (id(x) in keep or inside[id(x)])
        inside.update(dict.fromkeys(path, yes))
        return yes

    return "\n".join(text for node, text, _ in found if kept(node))


def main_text(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns, ``text`` and ``n_chars`` of every row.

    Null or empty HTML, and pages of nothing but menus and the like, give an empty text and zero.
    Repeated rows are treated alike; an empty table gives an empty result; other columns of the
    input are ignored. Of containers with equal points the first on the page is taken. A page takes
    time in proportion to its length times its nesting, its markup sound or broken; a task holds
    about 8 MB of pages at once, or one page.
    """
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, column=k)):
            texts = [extract(x) for x in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keys, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keys)
    return pages.select(*keys, F.col(html).alias("_html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
