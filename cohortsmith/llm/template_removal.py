"""Main text of web pages, with site templates removed.

Every element's subtree is hashed (its tag and its folded text, in page order), and Spark counts on
how many distinct pages of a host each hash stands. Subtrees that recur on the pages of the host
(menus, notices, adverts, footers, which take turns: ``MIN_PAGES`` or more and ``SHARE`` of the host's
pages) are deleted. In addition, elements go that are never main text by their tag or role, or by a
class or id that consists of such words alone; they are hashed and counted like the others, but add nothing to the hash of what holds them.
Within an article element, where copied passages recur too, and for phrases within a line of text, a
subtree goes only at ``ARTICLE_MIN`` and ``ARTICLE_SHARE``; what holds an article never goes as a whole.

Pages of equal html on a host count once, so groups of copies make no template. Hashes are summed
up before the shuffle. The recurring subtrees of a host are few by counting (at most the mean number
of elements of a page over the share); they are broadcast to the second pass over the pages when all
hosts together have at most ``BROADCAST`` of them, and joined by host beyond that.

The text: the blocks of the page's article elements, or main elements, or else of the body, in page
order; character references decoded, white space inside a block one space, blocks joined by two \\n.

Defined cases: a null or empty html, or a page without text, gives the empty text; html without
closing tags, or cut off, is read as far as it goes; a null or unreadable url is a host of its own
named by the empty string; repeated rows give a result each; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, stored

#: A subtree is a template on so many pages of its host, and on this share of them.
MIN_PAGES, SHARE = 3, 0.03
#: The same within an article or a line of text.
ARTICLE_MIN, ARTICLE_SHARE = 10, 0.6
#: Recurring subtrees of all hosts that may be broadcast (16 bytes each and the host).
BROADCAST = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
NEVER = frozenset("head nav header footer aside form button select option input dialog menu object audio video canvas".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the second kind ends an open element of the first (HTML's optional end tags).
ENDS = {"p": BLOCK - {"td", "th", "tr", "li", "dd", "dt", "caption", "tbody", "thead", "tfoot", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
        "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Words of a class or id that name what is not main text.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar submenu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments commentlist respond reply replies disqus related recommended widget pagination pager skip".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|<[!?][^>]*(?:>|\Z)|([^<]+)|(<)""", re.S)
#: Words that a name may hold beside those, and still name no main text (``site-footer``, ``ad-slot``).
BESIDE = frozenset("site top bottom left right container wrapper box area list bar inner slot unit zone posts articles buttons links icons user users form".split())
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Words of a name: between other characters, and in camel case.
_NAMES = (r"[^A-Za-z0-9]+", r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _names_no_text(value: str) -> bool:
    """A class or id one of whose names consists of such words alone: ``cookie-notice``, but not
    ``related-work`` or ``has-sidebar``."""
    for name in value.split():
        for pattern in _NAMES:
            words = {w.lower() for w in re.split(pattern, name) if w and not w.isdigit()}
            if words & WORDS and words <= WORDS | BESIDE:
                return True
        if name.lower() in WORDS:
            return True
    return False


def _never(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(never main text, by its class or id alone)."""
    if tag in NEVER:
        return not (tag == "header" and in_article and not attrs), False  # an article's own heading
    named = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "role" and value.lower() in ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            named = named or _names_no_text(value)
    return named, named


class Node:
    __slots__ = ("tag", "never", "named", "children", "article")

    def __init__(self, tag: str, never: bool, named: bool, article: bool):
        self.tag, self.never, self.named, self.article, self.children = tag, never, named, article, []


def parse(html: str | None) -> Node:
    """A tree of elements and texts (character references decoded)."""
    root = Node("#", False, False, False)
    stack, html = [root], html or ""
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        if not m:
            break
        at = m.end()
        close, tag, attrs, _, text, lone = m.groups()
        if text or lone:
            stack[-1].children.append(html_lib.unescape(text or lone))
            continue
        if not tag:
            continue
        tag = tag.lower()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in BLOCK:
                    break  # a stray inline end tag doesn't close the article
            continue
        if tag in BLOCK or tag == "option":
            # inline elements left open don't keep a paragraph open
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].tag
                if open_tag in ENDS and tag in ENDS[open_tag]:
                    del stack[k:]
                    break
                if open_tag in BLOCK and open_tag not in ("p",):
                    break
        attrs = attrs.rstrip("/ \t\n\r\f").strip()
        node = Node(tag, *_never(tag, attrs, stack[-1].article), stack[-1].article or tag == "article")
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:  # raw text up to the end tag
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            node.children.append(html[at:end.start() if end else n])
            at = end.end() if end else n
            continue
        if not m.group(0).endswith("/>") or tag in BLOCK:
            stack.append(node)
    return root


def _fold(text: str) -> str:
    return " ".join(text.split())


_WHOLE = frozenset(("html", "body", "article", "main"))


def walk(root: Node) -> list[tuple[Node, int, bool]]:
    """(element, subtree hash, in an article or a line of text) of the elements with text, those
    dropped by name too, children first; not of those that are or hold an article or main element.
    An explicit stack: pages may nest deeply."""
    out, todo = [], [(root, False, None)]
    parts: dict[int, str] = {}
    holds: set[int] = set()
    while todo:
        node, phrase, state = todo.pop()
        elements = [c for c in node.children if not isinstance(c, str)]
        if state is None:
            todo.append((node, phrase, True))
            # inline elements beside text, and those in them, are a part of its line
            line = phrase or any(isinstance(c, str) and not c.isspace() for c in node.children)
            todo += [(c, line and c.tag not in BLOCK and not c.never, None) for c in reversed(elements)]
        else:
            own = [_fold(c) if isinstance(c, str) else "" if c.never else parts[id(c)] for c in node.children]
            text = " ".join(x for x in own if x)
            if node.tag in ("article", "main") or any(id(c) in holds for c in elements):
                holds.add(id(node))
            for c in elements:
                parts.pop(id(c), None)
            digest = parts[id(node)] = f"<{node.tag}>{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'replace'))}" if text else ""
            if text and node is not root and node.tag not in _WHOLE and id(node) not in holds:
                out.append((node, xxhash.xxh3_64_intdigest(digest.encode()) - 2**63, node.article or phrase))
    return out


def subtrees(html: str | None) -> list[tuple[int, bool]]:
    """Distinct (hash, stands in an article or a line of text) of a page's elements."""
    return list({(h, inside) for _, h, inside in walk(parse(html))})


def main_text(html: str | None, templates: frozenset | set = frozenset()) -> str:
    """The page's main text without the subtrees whose (hash, in an article or a line) is in ``templates``."""
    root = parse(html)
    if templates:
        for node, h, inside in walk(root):
            if (h, inside) in templates:
                node.never = True
    # an article that stands only in what is dropped by its class or id is main text all the same
    for tag, below in (("article", False), ("main", False), ("article", True), ("main", True)):
        tops = _tops(root, tag, below)
        if tops:
            break
    else:
        tops = [root]
    blocks: list[str] = []
    for top in tops:
        held: list[str] = []

        def flush():
            text = _fold("".join(held))
            held.clear()
            if text:
                blocks.append(text)

        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.tag == "br" or x.tag == "hr":
                held.append(" ")
            elif not x.never:
                edge = [None] if x.tag in BLOCK or x is top else []
                if edge:
                    flush()
                todo += edge + x.children[::-1]
        flush()
    return "\n\n".join(blocks)


def _tops(root: Node, tag: str, below_named: bool) -> list[Node]:
    """The outermost elements of a tag that are not dropped, in page order; those in elements that
    are dropped by class or id alone if ``below_named``."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag and not node.never:
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and (not c.never or below_named and c.named)]
    return out


def host(url: Column) -> Column:
    """The lower-cased host of a url, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, hash, in_article): subtrees that recur on many distinct pages of their host."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, p, [s for s, inside in found if not inside], [s for s, inside in found if inside])
                    for h, p, found in zip(b["host"], b["page"], map(subtrees, b["html"]))]
            yield pd.DataFrame(rows, columns=["host", "page", "outside", "inside"])

    own = need(pages, "url", "html").select(host(F.col("url")).alias("host"), F.coalesce(F.xxhash64("html"), F.lit(0)).alias("page"), "html")
    found = own.mapInPandas(each, "host string, page long, outside array<long>, inside array<long>")
    distinct = stored(found.groupBy("host", "page").agg(F.first("outside").alias("outside"), F.first("inside").alias("inside")), "subtrees")
    of_host = distinct.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    each_hash = [distinct.select("host", F.explode(c).alias("hash"), F.lit(c == "inside").alias("in_article")) for c in ("outside", "inside")]
    count = each_hash[0].union(each_hash[1]).groupBy("host", "hash", "in_article").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    least = F.when(F.col("in_article"), F.greatest(F.lit(ARTICLE_MIN), ARTICLE_SHARE * F.col("pages"))).otherwise(SHARE * F.col("pages"))
    return count.join(of_host, "host").where(F.col("n") >= least).select("host", "hash", "in_article")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    marks = [F.collect_set(F.when(F.col("in_article") == inside, F.col("hash"))).alias(name) for name, inside in (("outside", False), ("inside", True))]
    known = stored(templates(pages).groupBy("host").agg(*marks), "templates")
    small = (known.agg(F.sum(F.size("outside") + F.size("inside"))).first()[0] or 0) <= BROADCAST
    own = need(pages, "page_id", "url", "html").withColumn("host", host(F.col("url")))
    joined = own.join(F.broadcast(known) if small else known, "host", "left")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}  # of the hosts of this task's pages, the last few
        for b in batches:
            texts = []
            for h, page, outside, inside in zip(b["host"], b["html"], b["outside"], b["inside"]):
                if h not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[h] = frozenset() if outside is None else frozenset([*((int(x), False) for x in outside), *((int(x), True) for x in inside)])
                texts.append(main_text(page, seen[h]))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    id_type = own.schema["page_id"].dataType
    return joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "host", "outside", "inside").mapInPandas(
        each, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast(id_type))
