"""Page text: parsing, tree matching, wrappers."""

from pondlake.llm import wrapper_html as wh

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="x">
<header><a href=/>Site {n}</a></header><nav><ul><li><a href="/a">A {n}</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies {n}</div><!-- ad --><div class="ad">Buy {n}</div>
<article><h1>Title  {n} &amp; more</h1><p>First <b>bold</b>&nbsp;text {n}.<p>Second<br>line &lt;x&gt; &#233; {n}
<ul><li>one {n}</li><li>two</ul><p>Same on all pages.</p><form><input value=1>Your mail {n}</form>
<div id="comments"><p>A reader {n}</p></div></article>
<aside>Side {n}</aside><div class="footer-links">Foot {n}</div><p class="legal-line">Fixed line</p><footer>&copy; {n}</footer></body></html>"""
WANT = "Title {n} & more\nFirst bold text {n}.\nSecond line <x> é {n}\none {n}\ntwo\nSame on all pages."


def _run(spark, rows):
    df = spark.createDataFrame([(i, u, t, 1, "c") for i, u, t in rows], "page_id long, url string, html string, slot int, tree string")
    return {r.page_id: r for r in wh.extract(df.repartition(3)).collect()}


def test_article_without_the_rest(spark):
    got = _run(spark, [(i, f"http://h{i % 2}.example/{i}", PAGE.format(n=i)) for i in range(14)])
    assert {i: r.text for i, r in got.items()} == {i: WANT.format(n=i) for i in range(14)}


def test_template_is_learned_where_nothing_names_it(spark):
    """No telling tags or classes: constant slots go, varying ones stay."""
    page = "<html><body><div class=q1><p>Welcome to our site</p></div><div class=q2><p>Body {n} of text</p><p>More {n}</p></div><div class=q3>Call us</div></body></html>"
    got = _run(spark, [(i, "http://plain.example/", page.format(n=i)) for i in range(8)])
    assert all(r.text == f"Body {i} of text\nMore {i}" for i, r in got.items())
    few = _run(spark, [(i, "http://plain.example/", page.format(n=i)) for i in range(2)])  # too few to learn from
    assert few[1].text == "Welcome to our site\nBody 1 of text\nMore 1\nCall us"


def test_copies_of_one_page_keep_their_article(spark):
    got = _run(spark, [(i, "http://same.example/x", PAGE.format(n=7)) for i in range(9)])
    assert {r.text for r in got.values()} == {WANT.format(n=7)}


def test_awkward_pages(spark):
    long = "<article>" + "".join(f"<p>p{i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a/", None), (2, "http://a/", ""), (3, None, "just text"), (4, "nonsense", "<p>a<p>b"), (5, "http://a/", "<div"),
            (6, "http://a/", "<article><p title='x>y\">one</p></article>"), (7, "http://a/", "a < b & c &amp; d &nosuch; &#x41;"),
            (8, "http://a/", "<article><script>if (a<b) {</article>"), (9, "http://a/", long), (None, "http://a/", "<main>null id</main>"),
            (10, "http://b/", "<table><tr><td>1<td>2<tr><td>3</table>"), (11, "http://a/", "<article>x<!-- never closed")]
    got = _run(spark, rows)
    assert {i: r.text for i, r in got.items() if i != 9} == {
        1: "", 2: "", 3: "just text", 4: "a\nb", 5: "", 6: 'y">one', 7: "a < b & c & d &nosuch; A", 8: "", None: "null id",
        10: "1\n2\n3", 11: "x"}
    assert got[9].text.count("\n") == 19_999
    assert _run(spark, [(1, "u", "<p>x</p>")])[1].blocks == ["x"]
    assert wh.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_simple_tree_matching_is_maximum():
    a = ["/html", "/html/body", "/html/body/div", "/html/body/div/p", "/html/body/ul", "/html/body/ul/li"]
    assert wh.match(a, a) == {i: i for i in range(6)}
    b = ["/html", "/html/body", "/html/body/nav!", "/html/body/div", "/html/body/div/p"]
    assert wh.match(a, b) == {0: 0, 1: 1, 2: 3, 3: 4}
    # order is kept: of two crossed children the heavier subtree is matched
    x = ["/r", "/r/a", "/r/a/c", "/r/a/d", "/r/b"]
    y = ["/r", "/r/b", "/r/a", "/r/a/c", "/r/a/d"]
    assert wh.match(x, y) == {0: 0, 1: 2, 2: 3, 3: 4}


def test_given_pages(spark):
    """The generated pages: the whole article element, block by block."""
    import re
    from html import unescape
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    got = {r.page_id: r.text for r in wh.extract(pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_inline_adverts_and_one_word_names(spark):
    page = ("<article><p>Text <span class='ad'>Buy <span>now</span></span>goes on <b>here</b>.</p><ol class='commentlist'><li>nice</li></ol>"
            "<div id=sidebarLeft>side</div><p><a class='share-link'>Share <p>End</p><p class='commentary'>Said.</p></article>")
    assert _run(spark, [(1, "http://x/", page)])[1].text == "Text goes on here.\nEnd\nSaid."


def test_names_of_wrappers_and_headings_leave_the_article(spark):
    """Wrappers named by what stands in them, page-wide forms and generated anchors take no article text."""
    body = ("<h1>T {n}</h1><h2 id='related-work'>Related {n}</h2><p class='alert'>Mind {n}</p><section id=search><p>Found {n}</p></section>"
            "<div class='hidden-layers'><p>Layer {n}</p></div><h3><span id='Menu'>Menu {n}</span></h3><div class='comments'>Nice {n}</div>")
    want = "T {n}\nRelated {n}\nMind {n}\nFound {n}\nLayer {n}\nMenu {n}"
    wraps = ["<div class='has-sidebar'>", "<div class='content with-sidebar'>", "<div class='no-comments'>", "<form id=aspnetForm>", "<div class='sidebar-layout'>"]
    for k, wrap in enumerate(wraps):
        end = "</form>" if "form" in wrap else "</div>"
        page = f"<body>{wrap}<nav>Go {{n}}</nav><article>{body}</article><aside><article>Teaser {{n}}</article></aside>{end}<footer>F {{n}}</footer></body>"
        got = _run(spark, [(i, f"http://w{k}/{i}", page.format(n=i)) for i in range(6)])
        assert {i: r.text for i, r in got.items()} == {i: want.format(n=i) for i in range(6)}, wrap


def test_empty_page_falls_back_on_varying_slots(spark):
    page = "<body><nav>Go {n}</nav><form><div class=q>Body {n}</div><h4>Fixed</h4></form><footer>F {n}</footer></body>"
    got = _run(spark, [(i, f"http://f/{i}", page.format(n=i)) for i in range(6)])
    assert {i: r.text for i, r in got.items()} == {i: f"Body {i}" for i in range(6)}


def test_copies_among_other_pages_keep_their_article(spark):
    """Copies prove no template beside varying pages of the host either; distinct pages do."""
    page = "<body><article><h1>T {n}</h1>{more}<p>Body {n}</p></article></body>"
    rows = [(i, f"http://c/{i}", page.format(n=i, more="")) for i in range(12)]
    rows += [(100 + i, "http://c/x", page.format(n="x", more="<blockquote>Quoted</blockquote><table><tr><td>1<td>2</table>")) for i in range(8)]
    rows += [(200 + i, f"http://c/y{i}", page.format(n=i, more="<pre>Same note</pre>")) for i in range(6)]
    got = _run(spark, rows)
    assert {got[100 + i].text for i in range(8)} == {"T x\nQuoted\n1\n2\nBody x"}
    assert all(got[i].text == f"T {i}\nBody {i}" for i in range(12))
    assert all(got[200 + i].text == f"T {i}\nBody {i}" for i in range(6))


def test_constant_paragraph_beside_varying_siblings(spark, monkeypatch):
    """One label, no article element: the paragraph on every page goes, those of some pages stay."""
    page = "<body><div class=q><h2>T {n}</h2><p>Body {n}.</p><p>Subscribe to our weekly letter</p>{more}</div></body>"
    rows = [(i, f"http://s/{i}", page.format(n=i, more="<p>Shared by a third.</p>" if i % 3 == 0 else "")) for i in range(30)]
    got = _run(spark, rows)
    assert {i: r.text for i, r in got.items()} == {
        i: f"T {i}\nBody {i}." + ("\nShared by a third." if i % 3 == 0 else "") for i in range(30)}
    monkeypatch.setattr(wh, "LEAST_PAGES", 10 ** 9)  # nothing is learned: the paragraph stays
    assert all("Subscribe" in r.text for r in _run(spark, rows).values())


def test_template_that_the_reference_tree_lacks(spark):
    """Every page has its own tree; one slot outside the reference is constant over them."""
    page = "<body><div class=c{k}><p>Body {n}</p></div>{more}</body>"
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(30)]
    rows = [(i, f"http://t/{i}", page.format(k=names[i], n=i, more="<div class=zz>Read our terms.</div>")) for i in range(30)]
    rows += [(100 + i, f"http://t/x{i}", page.format(k="ref", n=i, more="")) for i in range(9)]
    got = _run(spark, rows)
    assert {i: r.text for i, r in got.items()} == {i: f"Body {i % 100}" for i in got}


def test_names_that_end_in_text_stay_in_an_article(spark):
    page = ("<article><h1>T</h1><div class='widget-text'><p>One</p></div><div id='banner-text'>Two</div>"
            "<div class='widget'>Gone</div><div class='ad banner-text'>Gone</div></article><div class='footer-text'>Gone</div>")
    assert _run(spark, [(1, "http://x/", page)])[1].text == "T\nOne\nTwo"


def test_deep_and_wide_pages_take_linear_time():
    import time
    wide = "".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>w{i}</div>" for i in range(17_000))
    deep = ["<div>" * 100_000 + "x", "<p><button>" + "<div>" * 100_000 + "x", "<ul><li>" * 50_000 + "x", "<table><td>" * 50_000 + "x"]
    for html in [*deep, wide]:
        start = time.time()
        slots, blocks = wh.parse(html)
        assert blocks and len(wh.match(slots, slots)) == len(slots)
        assert time.time() - start < 5
    assert len(wh.parse(wide)[1]) == 17_000


def test_matching_equals_brute_force():
    """Random trees with unlike siblings: as many pairs as the plain recursion finds, order kept."""
    import random
    rng = random.Random(5)

    def tree(depth, path=""):
        out = []
        for x in rng.sample("abcde", rng.randint(0, 4)):
            out += [f"{path}/{x}", *(tree(depth - 1, f"{path}/{x}") if depth else [])]
        return out

    def best(a, b, x="", y=""):
        kids = lambda t, p: [q for q in t if q.rpartition("/")[0] == p]
        xs, ys = kids(a, x), kids(b, y)
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, u in enumerate(xs):
            for j, v in enumerate(ys):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + 1 + best(a, b, u, v) if u[-1] == v[-1] else 0)
        return m[-1][-1]

    for _ in range(200):
        a, b = tree(2), tree(2)
        pairs = wh.match(a, b)
        assert len(pairs) == best(a, b) and all(a[i] == b[j] for i, j in pairs.items())
        siblings = sorted((a[i].rpartition("/")[0], i, j) for i, j in pairs.items())
        assert all(j < k for (p, _, j), (q, _, k) in zip(siblings, siblings[1:]) if p == q)
