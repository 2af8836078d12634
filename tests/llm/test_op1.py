import math
from collections import Counter, defaultdict

from studyloom.llm import op1_styletree as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><nav><ul><li><a href=1>Home</a></ul></nav><article><header><h1>Title &amp; more</h1></header>
<p>One<br>two <a href="x>y">link</a>.<p><b>Three<p>Four<ul><li>i1<li>i2</ul><div class="share-buttons">Tweet</div>
<pre>a
 b</pre><script>var t="</p>";</script><section id="comments"><article class="comment"><p>nice</article></section></article>
<aside>side</aside><form><label>Mail</label><input></form><div id="ad-1">Buy</div><footer>foot</footer></body></html>"""


def text_of(source, known=None):
    return H.extract(H.parse(source), known or {})


def test_article_without_its_furniture():
    assert text_of(PAGE) == "Title & more\nOne two link.\nThree\nFour\ni1\ni2\na b"


def test_odd_markup():
    assert text_of("") == "" and text_of("   ") == "" and text_of("<script>x") == ""
    assert text_of("plain &lt;b&gt; text <b>bold</b> <") == "plain <b> text bold <"
    assert text_of("<p>a<p>b</div></p><p>c") == "a\nb\nc"
    assert text_of("<table><tr><td>x<td>y<tr><td>z</table>") == "x\ny\nz"
    assert text_of("<div>a<p>b</p>c</div>") == "a\nb\nc"
    assert text_of("<main><h1>x</h1><p>y</p></main><footer>z</footer>") == "x\ny"
    assert text_of("<body><div class='content'><p>long enough text of the article</p></div><div class=sidebar>s</div>") == "long enough text of the article"
    text_of("<div>" * 30_000 + "x"), text_of('<a "' * 20_000), text_of("<" * 100_000), text_of("<!--" * 50_000)


def test_wrappers_and_comments():
    body = "<p>" + "word " * 60 + "</p>"
    want = " ".join(["word"] * 60)
    assert text_of(f"<body><form id=aspnet><div class='with-sidebar'><article>{body}</article><div class=sidebar>s</div></div></form>") == want
    assert text_of(f"<body><div id=page class=has-menu><div class=content>{body}</div><div class=menu>m</div></div>") == want
    assert text_of(f"<main><article>{body}</article><section id=comments><h2>Comments</h2><article>c1</article></section></main>") == want
    assert text_of(f"<article>{body}<section class=comments><h2>3 comments</h2><article><p>nice {'x ' * 90}</p></article></section></article>") == want
    assert text_of(f"<body><form><p>Search</p><input></form><div class=post>{body}</div><div class=footer>f</div>") == want


def brute_importances(pages):
    """The tree's importances from their definition, one page at a time."""
    m, styles, texts = Counter(), defaultdict(Counter), defaultdict(Counter)
    for url, source in pages:
        host = H.host_of(url)
        for path, kind, f in H.features(H.parse(source or "")):
            if kind == 0:
                m[host, path] += 1
                styles[host, path][f] += 1
            else:
                texts[host, path][f] += 1
    out = {}
    for k, n in m.items():
        if n == 1:
            out[k] = (1, 1.0, 1.0)
            continue
        entropy = -sum(c / n * math.log(c / n, n) for c in styles[k].values())
        inner = [math.log(c, n) for c in texts[k].values()]
        out[k] = (n, entropy, 1 - min(1.0, sum(inner) / len(inner) if inner else 0.0))
    return out


def test_importances_against_their_definition(spark):
    pages = [(i, f"http://h{i % 3}.org/{i}", f"<body><div class=x>same</div><div><p>text {i}</p>{'<p>more' if i % 2 else ''}</div></body>") for i in range(30)]
    df = spark.createDataFrame(pages, "id long, url string, html string").repartition(4)
    got = {r["site"]: (r["pages"], r["presentation"], r["content"]) for r in H.importances(df)[0].collect()}
    want = brute_importances([(u, h) for _, u, h in pages])
    want = {H.site_of(*k): v for k, v in want.items()}
    assert got.keys() == want.keys()
    for k in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want[k], strict=True))


def test_what_every_page_of_a_host_repeats_goes(spark):
    pages = [(i, "http://a.org/", f"<body><div class=q>Please accept our terms</div><div class=w><p>Own words of page number {i} come here</p></div></body>", 1) for i in range(8)]
    pages += [(100, "http://lonely.org/", "<body><div class=q>Please accept our terms</div></body>", 1), (101, None, None, 1), (102, "bad url [", "", 1), (3, pages[3][1], pages[3][2], 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text long")
    got = {}
    rows = H.main_texts(df).collect()
    for r in rows:
        got[r["page"]] = r["text"]
    assert len(rows) == len(pages)
    assert all(got[i] == f"Own words of page number {i} come here" for i in range(8))
    assert got[100] == "Please accept our terms" and got[101] == "" and got[102] == ""
    assert H.main_texts(df.limit(0)).count() == 0


def test_copies_of_an_article_keep_their_text(spark):
    page = "<body><nav>n</nav><article><h1>T</h1><p>All of this is the same on every page</p></article></body>"
    df = spark.createDataFrame([(i, "http://a.org", page) for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in H.main_texts(df).collect()} == {"T\nAll of this is the same on every page"}
