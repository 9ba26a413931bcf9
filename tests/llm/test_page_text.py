"""Main text of pages: planted pages, template subtrees per host, and a plain version of the counting."""

import html
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import page_text as P

SCHEMA = "page_id long, url string, html string, text string"


def text(page):
    return "\n".join(t for t, _ in P.parse(page)[0])


CASES = {
    "": "", "   ": "", "plain text": "plain text", "<p>one<p>two": "one\ntwo",
    "<body><nav>menu</nav><header>top</header><article><h1>T</h1><p>a &amp; b&nbsp;c</p></article><aside>x</aside><footer>f</footer></body>": "T\na & b c",
    "<article><p><b>Bold.<br><p>Next  \n one</p></article>": "Bold.\nNext one",
    "<script>var t='</p>';</script><style>p{}</style><article>x<script>no</script> y</article>": "x y",
    "<!-- <p>no</p> --><p>yes</p><!-- open": "yes",
    "<div class='comment-list'><article class='comment'><p>troll</p></article></div><article><p>real</p></article>": "real",
    "<div class='layout with-sidebar'><main><p>body</p><div class='sidebar'>side</div></main></div>": "body",
    "<main><div id='cookieNotice'>we use cookies</div><p>body</p><form><p>name</p></form></main>": "body",
    "<p>a<span class='ad'>buy</span>b</p>": "a\nb",
    "<div hidden>h</div><div style='display:none'>h</div><div aria-hidden='true'>h</div><p>v": "v",
    "<p title='it's > fine'>x</p>": "fine'>x", "<ul><li>one<li>two</ul>tail": "one\ntwo\ntail",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3", "a < b &lt; c": "a < b < c", "</p></div>loose</article>": "loose",
    "<article><header><h1>Title</h1></header><p>x</p></article>": "Title\nx", "&#x41;&#66;&copy;&unknown;": "AB©&unknown;",
}


@pytest.mark.parametrize("page", CASES)
def test_planted_pages(page):
    assert text(page) == CASES[page]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>/!-='\" abpdivscript&;#\n"), max_size=200))
def test_any_markup_parses(page):
    P.parse(page)


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "deep") == "deep"
    assert len(text("<p>word</p>" * 50_000)) == 250_000 - 1
    assert text("<" * 100_000 + "a") is not None


def site():
    out, rng = [], range(12)
    bar = "<div><p>Read us daily</p><p>On paper</p></div>"
    for i in rng:
        out.append((i, f"http://a.example/{i}", f"<body>{bar}<div><p>Story {i}</p></div><p>Shared words</p></body>", "x"))
        out.append((100 + i, f"http://b{i}.example/", f"<body>{bar}<p>Story {i}</p></body>", "x"))
        out.append((200 + i, "http://copies.example/", f"<body>{bar}<p>Same</p></body>", "x"))
        out.append((300 + i, None, f"<body>{bar}<p>{i}</p></body>", "x"))
        out.append((400 + i, f"http://c.example/{i}", f"<body><article>{bar}<p>Quoted often</p><p>Story {i}</p></article></body>", None))
    return out + [(900, "http://a.example/none", None, "x"), (900, "http://a.example/none", None, "x"), (None, "bad url", "", "x"), (0, "http://a.example/0", out[0][2], "x")]


def brute(rows):
    on, pages, out = defaultdict(set), defaultdict(set), []
    hosts = {u: (re.match(r"http://([^/]*)", u or "") or ["", ""])[1] for _, u, _, _ in rows}
    for _, u, h, _ in rows:
        if hosts[u]:
            pages[hosts[u]].add(h)
            for k in P.parse(h)[1]:
                on[hosts[u], k].add(h)
    for i, u, h, _ in rows:
        cut = {k for k in P.parse(h)[1] if len(on[hosts[u], k]) >= max(P.MIN_PAGES, P.MIN_SHARE * len(pages[hosts[u]]))}
        cut &= {k for _, around in P.parse(h)[0] for k in around}
        t = "\n".join(t for t, k in P.parse(h)[0] if cut.isdisjoint(k))
        out.append((i, u, t, len(t), len(cut)))
    return sorted(out, key=str)


def test_template_removal(spark):
    rows = site()
    got = sorted((tuple(r) for r in P.main_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
    by = {r[0]: r[2] for r in got}
    assert by[1] == "Story 1" and by[101] == "Read us daily\nOn paper\nStory 1" and by[201].endswith("Same") and by[401] == "Quoted often\nStory 1"
    assert P.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in P.main_text(pages).collect():
        inside = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)
