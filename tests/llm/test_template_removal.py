"""Main text of pages: hand-made pages, a brute-force template count, and the article of the given pages."""

import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import template_removal as T


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two<br>three <b>bold</b>er</p>", "one\n\ntwo three bolder"),
    ("<nav>menu</nav><article><h1>T &lt;1&gt;</h1><p>a\n b&nbsp;c</p><aside>x</aside></article><footer>f</footer>", "T <1>\n\na b c"),
    ("<body><div class='cookie-notice'>no</div><div id=sideBar>no</div><div class=story>yes</div><script>var a='</p><p>no'</script>", "yes"),
    ("<article><header><h1>H</h1></header><p>p</p><section class=comments><p>me too</p></section><form><p>q</form></article>", "H\n\np"),
    ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "a\n\nb\n\n1\n\n2"),
    ("<article><p><b>open<br><p>next</article>tail", "open\n\nnext"),
    ("<p>a <!-- c > --> b <", "a b <"), ("<p title='>'>q</p><p hidden>z</p>", "q"),
    ("<article><p>cut of", "cut of"), ("<style>p{}</style><title>t</title>x", "x"), ("<p>x</b></i>y</p>z", "xy\n\nz"),
])
def test_pages(page, text):
    assert T.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ('<article><p style="overflow:hidden">main text</p></article>', "main text"), ('<article><p title="hidden gems">main text</p></article>', "main text"),
    ('<article><p data-id="footer">main text</p></article>', "main text"), ('<article><p>see <a href="/x?id=ad">the link</a></p></article>', "see the link"),
    ("<article><p>see <a href=/x?id=ad>the link</a></p></article>", "see the link"),
    ('<article><section class="related-work"><p>earlier work</p></section></article>', "earlier work"),
    ('<article><p id="widget-theory">theory</p></article>', "theory"), ('<article><div class="entry-header-wrap"><h1>T</h1></div><p>p</p></article>', "T\n\np"),
    ('<div class="has-sidebar"><article>a</article><div class="sidebar">s</div></div>', "a"), ('<div class="sidebar"><article>a</article></div>', "a"),
    ('<article>a</article><ol class="comment-list"><li><article>me too</article></li></ol>', "a"),
    ('<p class="lead related-posts">no</p><p class="SiteFooter">no</p><p class="ad-slot-2">no</p><p>yes</p>', "yes"),
])
def test_names_drop_no_main_text(page, text):
    assert T.main_text(page) == text


def test_deep_and_long_pages():
    assert T.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(T.main_text("<p>" + "word " * 300000)) == 1499999


def test_given_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in T.extract(pages).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S).group(1)
        want = []
        for block in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article)):
            t = " ".join(html.unescape(block.replace("<br>", " ")).split())
            want += [t] if t else []
        r = got[p.page_id]
        assert r.text == "\n\n".join(want) and r.n_chars == len(r.text) and r.url == p.url


def site(spark, n):
    rows = [(i, f"https://user@Site{i % 2}.example.org:80/{i}", f"<div><span>Welcome to us</span></div><p>story {i} here</p>"
             + (f"<div><p>offer {i % 3}</p></div>" if i % 2 else "") + "<p>All rights</p>") for i in range(n)]
    rows += [(1000 + i, "http://other.example.org/", "<p>Welcome to us</p><p>same copy</p>") for i in range(40)]
    rows += [(2000, None, None), (2001, "no url", "<p>Welcome to us</p>"), (2001, "no url", "<p>Welcome to us</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("n", F.lit(0))


@pytest.mark.parametrize("broadcast", [0, T.BROADCAST])
def test_templates_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(T, "BROADCAST", broadcast)
    pages = site(spark, 60)
    rows = pages.collect()
    by_host = {}
    for r in rows:
        m = re.match(r"\w+://(?:\w+@)?([^/:]*)", r.url or "")
        by_host.setdefault(m.group(1).lower() if m else "", set()).add(r.html)
    want = set()
    for h, own in by_host.items():
        c = Counter(x for p in own for x in T.subtrees(p))
        want |= {(h, *x) for x, n in c.items() if n >= T.MIN_PAGES and n >= (T.ARTICLE_SHARE if x[1] else T.SHARE) * len(own)}
    assert {tuple(r) for r in T.templates(pages).collect()} == want and want
    got = {r.page_id: r.text for r in T.extract(pages).collect()}
    assert got[0] == "story 0 here" and got[3] == "story 3 here" and got[1000] == "Welcome to us\n\nsame copy"
    assert got[2000] == "" and got[2001] == "Welcome to us" and T.extract(pages).count() == len(rows)


def test_empty_table(spark):
    assert T.extract(site(spark, 1).limit(0)).count() == 0


WORD = ("really", "quite")  # each in a line of half the pages


def test_blocks_that_take_turns_are_found_without_names(spark):
    """Eight menus, adverts and footers take turns, each on 5 of 40 pages of the host; no name tells them."""
    rows = [(i, "http://turns.example.org/", f"<nav><ul><li>menu {i % 8}</ul></nav><div class=x>advert <b>number</b> {i % 8}</div>"
             f"<div><p>story {i} is <b>{WORD[i % 2]}</b> new</p></div><div>footer {i % 8}</div><script>track({i})</script>") for i in range(40)]
    # copies of an article in pages that differ elsewhere: what holds the article is no template
    rows += [(100 + i, "http://copies.example.org/", f"<div><article><p>copied</p></article></div><p>{i}</p>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {tuple(r)[1:] for r in T.templates(pages.where("page_id < 100")).collect()}
    named = {h for k in range(8) for h, _ in T.subtrees(f"<nav><ul><li>menu {k}</ul></nav>")}
    assert len(named) == 24 and {(h, False) for h in named} <= found
    got = {r.page_id: r.text for r in T.extract(pages).collect()}
    assert got == {i: f"story {i} is {WORD[i % 2]} new" for i in range(40)} | {100 + i: "copied" for i in range(8)}
