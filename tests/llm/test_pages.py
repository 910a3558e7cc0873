from __future__ import annotations

import html
import random
import re

import pytest

from gridspark.llm import pages



def text(source):
    root = pages.parse(source)
    pages.weigh(root)
    return pages.text_of(root, frozenset())


BODY = "<h1>Title</h1><p>A sentence of the article.</p><p>And one more.</p>"
PLAIN = "Title A sentence of the article. And one more."
FURNITURE = "<nav>menu</nav><div class='sidebar'><p>aside</p></div><footer>foot</footer>"
WRAPPED = [
    f"<div class='layout has-sidebar'><article>{BODY}</article>{FURNITURE}</div>",
    f"<div id='page' class='no-sidebar'>{FURNITURE}<main>{BODY}</main></div>",
    f"<form id='aspnetForm'>{FURNITURE}<article>{BODY}</article></form>",
    f"<article><form>{BODY}</form><div class=share>tweet</div></article>",
    f"<div class='page-with-menu sidebar'>{FURNITURE}<div class=text>{BODY}</div></div>",
    f"<form><div class='content header-fixed'>{BODY}</div>{FURNITURE}</form>",
    f"<div class='cookie-ready'><article>{BODY}</article></div><p>outside</p>",
    f"<div class='sidebar-left'><article>{BODY}</article><section class='comments'><article>reader " + "words " * 99 + "</article></section></div>",
    f"<article>{BODY}<div id='comments'><p>" + "reader comment " * 99 + "</p></div></article>",
    f"<article>{BODY}<form><p>your mail</p><input></form><div class='newsletter'>join</div></article>",
    f"<article>{BODY}</article><div class='related'><article>" + "other " * 99 + "</article></div>"]


@pytest.mark.parametrize("source", WRAPPED)
def test_wrappers_keep_the_article(source):
    assert text(f"<html><body>{source}</body></html>") == PLAIN


def test_formulas_stay():
    assert text("<article><p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds</p></article>") == "so a=1 holds"


CASES = {
    "": "", "just < text & more": "just < text & more", "<p>a<b>b</b>c<p>d": "abc d", "<article><h1>T</h1><p>x &amp; y</p></article><p>out": "T x & y",
    "<nav>n</nav><main><p>a<br>b</main><footer>f</footer>": "a b", "<body><header>h</header><p>a</p><aside>s</aside></body>": "a",
    "<div class='cookie-notice'>c</div><p>t</p><section id=comments>r</section>": "t", "<p>a</p><form>f<p>g</form>z": "a z",
    "<script>if (a<b) {'</p>'}</script><style>p{}</style>x<!-- y <p> -->z": "xz", "<ul><li>a<li>b</ul>": "a b",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1 2 3", "<p>a&nbsp;b&#33; &copy;</p>": "a b! ©", "<a href='x>y'>l</a>k": "lk",
    "<article><p>t<div class=ad>buy</div><div class='sharing-buttons'>s</div></article>": "t", "<p hidden>h</p><p style='display: none'>i</p>v": "v",
    "<article><p>a</p></article><article><p>b</p></article>": "a b", "<p>open": "open", "<div class=adventure>kept</div>": "kept"}


@pytest.mark.parametrize("source", CASES)
def test_text_of_a_page(source):
    assert text(source) == CASES[source]


def site(n, body, host="a.example"):
    return [(i, f"http://{host}/{i}", body(i)) for i in range(n)]


def test_templates_against_a_plain_count(spark):
    rng = random.Random(4)
    boxes = [f"<div class=b{k}><span>box {k}</span></div>" for k in range(12)]
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<body><div class=u{i // 5}>few</div>" + "".join(rng.sample(boxes, 1 + i % 3 * 2)) + f"<article><p>own {i % 150}</p>"
             + rng.choice(boxes) + "</article><ul><li>" + rng.choice("abc") + "</ul></body>") for i in range(400)]
    seen, sizes = {}, {}
    for _, url, html in rows:
        root = pages.parse(html)
        pages.weigh(root)
        whole, host = pages.digest(root), url.split("/")[2]
        sizes.setdefault(host, set()).add(whole)
        for h in pages.candidates(root):
            seen.setdefault((host, h), set()).add(whole)
    want = {k for k, of in seen.items() if len(of) >= 10 and len(of) ** 2 >= len(sizes[k[0]])}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.host, r.hash) for r in pages.templates(df.select(pages.host_of(df.url).alias("host"), "html")).collect()}
    assert got == want and 0 < len(want) < len(seen)


def test_templates_of_a_site_go(spark):
    furniture = "<div class=x1><span>All rights</span><p>Same on every page</p></div>"
    rows = site(30, lambda i: f"<body>{furniture}<div><p>Own text {i}</p></div></body>")
    rows += [(100 + i, f"http://b.example/{i}", f"<body>{furniture}<div><p>Few {i}</p></div></body>") for i in range(3)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Own text 7" and got[101] == "All rights Same on every page Few 1"


def test_copies_of_an_article_stay(spark):
    rows = site(40, lambda i: "<article><h1>One</h1><p>Copied everywhere</p><div><p>Also</p></div></article>")
    rows += site(40, lambda i: f"<article><h1>One</h1><p>Copied everywhere</p><p>Edited {i}</p><div class=z>furniture</div></article>", "b.example")
    got = {r.url: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["http://a.example/5"] == "One Copied everywhere Also"
    assert got["http://b.example/5"] == "One Copied everywhere Edited 5"


def test_query_against_marked_articles(sure, spark, sf_dir):
    got = sure("op3_main_text", "page_id")
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"<(/?(p|h1|br|ul|li)\b[^>]*)>", " ", body))
        assert got[r.page_id]["text"] == " ".join(html.unescape(body).split())
        assert got[r.page_id]["n_chars"] == len(got[r.page_id]["text"])


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "no url", "<p>t</p>", "y"), (2, "http://H.Example:80/a", "<p>" + "w " * 100_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted((str(r.page_id), r.text[:3], r.n_chars) for r in pages.extract(df).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "w w", 199_999), ("None", "t", 1)]
    assert pages.extract(df.limit(0)).count() == 0


def test_breaks_inline_words_and_headings_are_no_templates(spark):
    rows = site(30, lambda i: f"<article><p>line {i}<br>line two<hr>three</p>ab<div></div>cd<div>&nbsp;</div>ef</article>")
    rows += site(30, lambda i: f"<body><h2>Summary</h2><p>{i} <b>Note</b>: see <a href=/x>here</a></p><div>x{i}<p></p>y</div></body>", "b.example")
    rows += site(30, lambda i: f"<article>t{i}<div class=x7>Box</div>u<div class=ad>Buy</div>v<script>s</script>w</article>", "c.example")
    got = {r.url: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["http://a.example/5"] == "line 5 line two three ab cd ef"
    assert got["http://b.example/5"] == "Summary 5 Note: see here x5 y"
    assert got["http://c.example/5"] == "t5 u vw"


def test_templates_of_hosts_of_copies_and_of_sections(spark):
    rows = site(30, lambda i: f"<body><div class=x7>Box</div><p>Own {i}</p></body>")
    rows += [(1000 + i, f"http://a.example/copy{i}", rows[0][2]) for i in range(300)]
    rows += site(200, lambda i: f"<body><div class=x7>Section {i // 20}</div><p>Own {i}</p></body>", "b.example")
    rows += site(400, lambda i: f"<body><div class=x7>Few {i // 12}</div><p>Own {i}</p></body>", "c.example")
    got = {r.url: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["http://a.example/5"] == "Own 5" and got["http://a.example/copy9"] == "Own 0"
    assert got["http://b.example/50"] == "Own 50"
    assert got["http://c.example/30"] == "Few 2 Own 30"  # 12 of 400 pages are fewer than 20
