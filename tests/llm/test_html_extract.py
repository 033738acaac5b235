import json

from leafmill.llm import html_extract as H


def page(k, article, **more):
    return f"""<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style><script>var a="</article><p>no</p>";</script></head><body>
<header>Site {k}</header><nav><ul><li><a href=/>Home</a><li>News</ul></nav><!-- <p>no</p> --><div class="ad top">Buy {k}</div>{article}
<div id="comments"><p>Reader {k}</p></div><form><label>Mail</label><input name=q></form><aside>Side</aside><footer>&copy; {k}</footer>{more.get("end", "</body></html>")}"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as path", "'z' as host")


def texts(spark, rows):
    return {r.page_id: r.text for r in H.html_extract(pages(spark, rows)).collect()}


def test_articles(spark):
    one = "<article><h1>A &amp; B</h1><p>First\n  line<br>goes&nbsp;on <b>bold</b>!<p>Second &#8364;<ul><li>x<li>y</ul><div class='share'>Share</div><div class=notice>Cookies</div></article>"
    rows = [(k, "http://h.org/" + str(k), page(k, one if k % 2 else f"<article><h1>T{k}</h1><p>Body {k}</article>", end="")) for k in range(12)]
    found = texts(spark, rows)
    assert found[1] == "A & B\n\nFirst line goes on bold!\n\nSecond €\n\nx\n\ny"
    assert found[2] == "T2\n\nBody 2"


def test_wrapper_finds_the_region_without_an_article(spark):
    body = lambda k: f"<div class='page'><div class='top'>Welcome to us</div><div class='story'><h1>T{k}</h1>" + "".join(f"<p>Par {k} {j}</p>" for j in range(k % 3 + 1)) + "</div></div>"
    rows = [(k, "https://u@H.org:80/x", page(k, body(k))) for k in range(9)]
    assert texts(spark, rows)[4] == "T4\n\nPar 4 0\n\nPar 4 1"


def test_copies_on_one_host_keep_their_text(spark):
    rows = [(k, "http://h.org/", page(1, "<article><h1>Same</h1><p>Text</p></article>")) for k in range(8)]
    assert set(texts(spark, rows).values()) == {"Same\n\nText"}


def test_alignment():
    read = lambda t: H.expression(H.tree(t))
    a, b = read("<div><h2>One</h2><p>x</p><p>y</p></div>"), read("<div><h2>Two</h2><table><tr><td>z</table><p>w</p></div>")
    (div,) = H.align(a, b)
    assert [(i[H.LABEL], i[H.MANY], i[H.MAY]) for i in div[H.INNER]] == [("h2", 0, 0), ("table", 0, 1), ("p", 1, 0)]
    assert div[H.INNER][0][H.INNER][0][H.VALUE] is None
    many = read("".join(f"<h3>{k}</h3><p>{k}</p>" for k in range(200)))
    assert [(i[H.LABEL], i[H.MANY]) for i in many] == [("*", 1)]
    assert H.align(a, a) == a and json.loads(json.dumps(a)) == a


def test_odd_rows(spark):
    rows = [(1, None, None), (2, None, ""), (2, None, ""), (None, "not a url", "plain <b>text</b> &lt;kept&gt;"), (3, "http://x/", "<p>open <i>tags"), (4, "http://x/", "<" * 50 + "p>q"), (5, "http://x/", "<div>" * 300 + "deep"), (6, "http://x/", "<p>" + "long " * 50_000)]
    found = texts(spark, rows)
    assert found[1] == found[2] == "" and found[None] == "plain text <kept>" and found[3] == "open tags" and found[5] == "deep"
    assert found[6] == ("long " * 50_000).strip()
    assert H.html_extract(pages(spark, rows).where("false")).count() == 0


def test_texts_of_a_single_page_stay(spark):
    own = {3: "<blockquote>Only on three</blockquote>", 4: "<h3>Only on four</h3>", 5: "<ul><li>Only on five</li></ul>"}
    top = lambda k: "" if k == 19 else "<div class='top'>Welcome to us</div>"
    body = lambda k: f"<div class='page'>{top(k)}<div class='story'><h1>T{k}</h1><p>Par {k}</p>{own.get(k, '')}<p>End {k}</p></div></div>"
    flat = lambda k: f"<div class='page'>{top(k)}<h1>T{k}</h1><p>Par {k}</p>{own.get(k, '')}<p>End {k}</p></div>"
    named = lambda k: f"<div class='page'>{top(k)}<div id='post-{k}'><h1>T{k}</h1><p>Par {k}</p></div></div>"
    rows = [(100 * h + k, f"http://h{h}.org/{k}", page(k, f(k))) for h, f in enumerate((body, flat, named)) for k in range(20)]
    rows += [(300 + k, "http://h3.org/", page(k if k < 9 else 9, named(k if k < 9 else 9))) for k in range(200)]
    found = texts(spark, rows)
    for h in (0, 1):
        for k in range(20):
            mid = {3: "Only on three\n\n", 4: "Only on four\n\n", 5: "Only on five\n\n"}.get(k, "")
            assert found[100 * h + k] == f"T{k}\n\nPar {k}\n\n{mid}End {k}"
    for k in range(20):
        assert found[200 + k] == f"T{k}\n\nPar {k}"
    assert found[302] == "T2\n\nPar 2" and found[499] == "T9\n\nPar 9"  # most pages of the host are copies of one


def test_hostile_pages_take_linear_time(spark):
    import time

    began = time.time()
    for broken in ('<a "' * 250_000 + "'", "<script>" * 100_000, "<a " + "a " * 300_000 + ">", "<!--" * 200_000, "<div>" * 5000 + "x" + "</div>" * 5000):
        H.expression(H.tree(broken))
    assert time.time() - began < 20
    deep = "<div>" * 3000 + "<p>one</p><p>two</p>" + "</div>" * 3000 + "<p>after</p>"
    rows = [(k, "http://h/", deep) for k in range(2)] + [(9, "http://h/", '<p>a</p><a title="never closed>x</a><p>b</p>')]
    found = texts(spark, rows)
    assert H.main_text(deep, [], set()) == "one\n\ntwo\n\nafter" and found[0].startswith("one\n\ntwo") and found[9] == "a\n\nx\n\nb"


def test_marks_are_whole_words_and_content_stays():
    read = lambda t: H.main_text(t, [], set())
    assert read("<div class='main-content side-by-side'>one</div><section class='search-results-analysis'>two</section><div class='tagged-union'>three</div>") == "one\n\ntwo\n\nthree"
    assert read("<p>own</p><div class='related-posts'>x</div><div class='site-notice'>x</div><div class='cookie-banner'>x</div><div class='search-box'>x</div><div id=comments>x</div>") == "own"


def test_marks_that_only_hold_a_word_say_nothing(spark):
    read = lambda t: H.main_text(t, [], set())
    for outer in ("<div class='layout no-sidebar'>", "<div id='page' class='has-header'>", "<article class='post comments-open'>", "<article class='post-12 type-post category-news tag-cookies'>"):
        assert read(f"{outer}<p>text</p>{outer[0]}/{outer[1:].split()[0]}>") == "text"
    assert read("<article><p class='modal-verbs'>a</p><h2 id='navigation'>b</h2><section id='sharing-economy'>c</section><div class='post-comments'>x</div><div class='top-nav-bar'>x</div></article>") == "a\n\nb\n\nc"
    rows = [(k, "http://a/", f"<div id='top'>Menu</div><div id='page' class='site no-sidebar'><h1>T{k}</h1><p>Text {k}</p></div>") for k in range(8)]
    rows += [(10 + k, "http://b/", f"<nav>Menu</nav><article id='post-{k}' class='post-{k} type-post tag-cookies'><h1>T{k}</h1><p>Text {k}</p></article>") for k in range(8)]
    found = texts(spark, rows)
    assert all(found[k].endswith(f"T{k}\n\nText {k}") and found[10 + k] == f"T{k}\n\nText {k}" for k in range(8))


def test_deep_elements_keep_what_they_are(spark):
    inner = "<nav>menu items</nav><p>body text</p><script>var x=1;</script><style>.a{}</style><footer>foot</footer>"
    for n in (130, 5000):
        deep = "<div>" * n + inner + "</div>" * n
        assert H.main_text(f"<article><p>Lead</p>{deep}</article>", [], set()) == "Lead\n\nbody text"
        assert H.main_text("<div>" * n + f"<nav>x</nav><article><p>text</p><div>{inner}</div></article>" + "</div>" * n, [], set()) == "text\n\nbody text"
    rows = [(k, "http://h/", "<div>" * 5000 + f"<nav>m</nav><article><p>text {k}</p>{inner}</article>" + "</div>" * 5000) for k in range(6)]
    assert texts(spark, rows) == {k: f"text {k}\n\nbody text" for k in range(6)}


def test_unlike_pages_lose_no_items(monkeypatch):
    monkeypatch.setattr(H, "CELLS", 3)
    read = lambda t: H.expression(H.tree(t))
    a, b = read("<p>1</p><h2>2</h2><ul></ul>"), read("<table></table><h2>3</h2><pre>4</pre>")
    labels = [i[H.LABEL] for i in H.align(a, b)]
    assert {"p", "h2", "ul", "table", "pre"} == set(labels) and labels.count("h2") == 2


def test_tags_that_close_nothing_take_linear_time():
    import time

    began = time.time()
    for broken in ("<b>" * 100_000 + "<hr>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<li><div>" + "<b>" * 100_000 + "<li>" * 100_000):
        H.main_text(broken, [], set())
    assert time.time() - began < 20
