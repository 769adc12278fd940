"""Main text of pages: the reader's rules by hand, templates by count, and whole tables against a plain recount."""

import html
import os
import random
import re

import pytest

from tessella.llm import html_extraction
from tessella.llm.html_extraction import article, read

PAGES = "page_id long, url string, html string"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

CASES = {
    "<p>a  b\n\tc</p><p>d</p>": "a b c d",
    "x<b>y</b>z<br>w": "xyz w",
    "a &amp; b &lt;c&gt; &eacute; &#233; &#xe9; &copy 2 &am": "a & b <c> é é é © 2 &am",
    "5 < 6 and a<b": "5 < 6 and a",
    "<p>one<p>two<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>": "one two a b 1 2 3",
    "<!-- <p>no</p> -->yes<!--> also<!-- never closed": "yes also",
    "<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style>yes": "yes",
    "<script>var t = '</p>'; never closed": "",
    "<p title='a > b' class=\"x>y\" id=z>in</p >out": "in out",
    "<p class=it's>He's</p>": "He's",
    "<body><nav>menu</nav><header><h1>Site</h1></header><p>text</p><aside>side</aside><footer>foot</footer></body>": "text",
    "<article><header><h1>Title</h1><p>by A</p></header><p>text</p><footer>share</footer></article>": "Title text",
    "<div>rest of it all</div><article><p>t</p></article>": "t",
    "<article>a</article><article>b</article>": "a b",
    "<main><p>in</p></main><p>out</p>": "in",
    "<div class='cookie-notice'>we use</div><div class='adBox'>buy</div><p>text of the page</p>": "text of the page",
    "<body class='has-sidebar no-ads'><p>text</p></body>": "text",
    "<div class='menu-open'><article><p>text</p></article></div>": "text",
    "<div class='header'><p>all of the text is in here</p></div><p>x</p>": "all of the text is in here x",
    "<article><p>text</p><section id=comments><article class=comment>great</article></section></article>": "text",
    "<div class=shadow>shade</div><div id=reads>read</div>": "shade read",
    "<p>seen</p><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><div role=navigation>no</div>": "seen",
    "<form><p>name</p><input value=x></form><select><option>a<option>b</select><button>go</button><p>t</p>": "t",
    "<b><p>bold</b> on</p>": "bold on",
    "</p></div></nothing>text": "text",
    "": "",
    "   ": "",
    "<": "<",
    "<p": "",
    "<title>t</title><textarea><p>x</textarea>y": "y",
    "a<sup>2</sup> + <a href=x>link</a>ed": "a2 + linked",
    "a b&nbsp;c": "a b c",
}


@pytest.mark.parametrize("page", CASES)
def test_rules(page):
    assert article(read(page), set()) == CASES[page]


def site(rnd, host, n, notice, copies=0):
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared, out = text(40), []
    for i in range(n):
        body = [text(rnd.randint(5, 60)) for _ in range(rnd.randint(1, 5))]
        if i % 4 == 0:
            body.append(shared)  # a passage of a quarter of the pages
        if copies and i < copies:
            body = copied if i else (copied := body)  # noqa: F821
        page = "<div class=top><p>Welcome to " + host + "</p></div>" + "".join(f"<p>{b}</p>" for b in body) + f"<div><p>{notice}</p><ul><li>One<li>Two</ul></div>"
        out.append((f"http://{host}/{i}?x", page, " ".join(body)))
    return out


def test_templates_go_and_copies_stay(spark):
    rnd = random.Random(3)
    rows = site(rnd, "a.example.org", 60, "All of this is ours, says the company that made it.") + site(rnd, "B.example.org", 12, "Another notice", copies=9) + site(rnd, "c.example.org", 3, "too few pages")
    table = [(i, u, h) for i, (u, h, _) in enumerate(rows)]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(table, PAGES).repartition(5)).collect()}
    for i, (_, _, want) in enumerate(rows[:60]):
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == rows[i][0]
    for i in range(60, 72):  # nine of twelve are copies: four pages to the counts, which is too few
        assert rows[i][2] in got[i].text
    assert all(r[2] in got[72 + i].text and "too few pages" in got[72 + i].text for i, r in enumerate(rows[72:]))


def test_counts_by_hand(spark):
    """Subtrees on half of a host's different pages, recounted from the pages' own hashes."""
    rnd = random.Random(9)
    rows = site(rnd, "a.example.org", 40, "n1") + site(rnd, "b.example.org", 11, "n2", copies=4)
    table = [(i, u, h) for i, (u, h, _) in enumerate(rows)] + [(0, rows[0][0], rows[0][1])]
    pages = spark.createDataFrame(table, PAGES)
    from tessella.llm.url_filters import host_of

    got = {r.host: set(r.subtrees) for r in html_extraction.templates(pages.select(host_of(pages.url).alias("host"), "html")).collect()}
    for host in ("a.example.org", "b.example.org"):
        seen, all_ = {}, set()
        for _, u, h in table:
            if f"//{host}/" in u:
                p = read(h)
                all_.add(p.longest)
                for x in set(p.hashes.values()):
                    seen.setdefault(x, set()).add(p.longest)
        assert got[host] == {x for x, s in seen.items() if len(s) >= 5 and 2 * len(s) >= len(all_)}
        assert got[host]


def test_edges(spark):
    table = [(1, None, None), (2, "no host", "<p>x</p>"), (None, "http://h/", ""), (4, "http://h/", "<p>" + "w " * 200_000), (4, "http://h/", "<p>" + "w " * 200_000), (5, "http://h/", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(table, PAGES).selectExpr("*", "1 AS host", "2 AS subtrees", "'t' AS text", "3 AS page")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extraction.extract(pages).collect()), key=str)
    long = " ".join(["w"] * 200_000)
    assert got == sorted([(1, "", 0), (2, "x", 1), (None, "", 0), (4, long, len(long)), (4, long, len(long)), (5, "deep", 4)], key=str)
    assert html_extraction.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_articles_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search("(?s)<article>(.*?)</article>", r.html)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())
