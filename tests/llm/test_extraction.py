import pytest

from folioscope.llm import extraction as X

FRAME = '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>%s<footer>&copy; me</footer></body></html>'


def text(page):
    root = X.parse(page)
    return X.main_text(root, X.main_paths(X.wrapper_of(root)))


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n two&nbsp; three</p><p></p><p>four</p></article>", "A & B\none two three\nfour"),
        ("<article><p><b>open<br><p>next <i>in</i>line</p></article>", "open\nnext inline"),
        ('<article><p>text</p><div class="ad">buy</div><aside>side</aside><form><p>mail</p></form></article>', "text"),
        ('<article><p>text</p><section id="comments"><p>first!</p></section></article>', "text"),
        ('<div class="cookie-notice"><p>We use cookies</p></div><main><p>a</p><ul><li>b<li>c</ul></main>', "a\nb\nc"),
        ("<div class=ad><p>never closed<article><p>text here, long enough</p></article>", "text here, long enough"),
        ('<div id="wrap"><div class="story"><p>long text without links at all</p><p>and more of it</p></div><div class="sidebar"><p>side</p></div></div>', "long text without links at all\nand more of it"),
        ("<article><p>a</p><table><tr><td>b<td>c</table><pre>d\n  e</pre></article>", "a\nb\nc\nd e"),
        ("<article><p>cut off in a ta", "cut off in a ta"),
        ("<article><p>cut off in an attribute</p><p cla", "cut off in an attribute"),
        ("<article><!-- x <p>no</p> --><p>1 &lt; 2 &#228; &#x1F600;</p></article>", "1 < 2 ä 😀"),
        ("<article><script>if (a < b) document.write('<p>no</p>')</script><p>yes</p></article>", "yes"),
    ],
)
def test_pages(body, wanted):
    assert text(FRAME % body if "cut off" not in body else FRAME.split("%s")[0] + body) == wanted


def test_plain_and_empty_pages():
    assert text("") == ""
    assert text("just text") == "just text"
    assert text("<p>a<p>b") == "a\nb"
    assert X.main_text(X.parse("<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000), ["/none"]) == "deep"


def test_alignment_makes_optional_and_repeated_items():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<p>x</p>", "<ul><li>a</li></ul><h2>y</h2><p>x</p><p>z</p>"]
    whole = X.wrapper_of(X.parse(pages[0]))
    for page in pages[1:]:
        whole = X.merged(whole, X.wrapper_of(X.parse(page)))
    assert X.expression(whole) == "( <ul> ( <li> #text </li> )+ </ul> )? ( <h2> #text </h2> )? ( <p> #text </p> )+"


def test_repeated_runs_become_a_group():
    page = "<dl>" + "<dt>a</dt><dd>b</dd>" * 4 + "</dl>"
    assert X.expression(X.wrapper_of(X.parse(page))) == "<dl> ( <dt> #text </dt> <dd> #text </dd> )+ </dl>"


def test_edges_on_spark(spark):
    from pyspark.sql import functions as F

    article = FRAME % "<article><h1>T</h1><p>some words of text</p></article>"
    rows = [(1, "http://a.org/1", article), (2, "http://a.org/2", None), (3, None, article), (4, "no host", ""), (5, "HTTP://A.org/5", "plain"), (1, "http://a.org/1", article)]
    rows += [(10 + i, "http://a.org/x", FRAME % ("<div><p>w</p></div>" * (i % 7) + f"<article><p>page {i}</p>" + "<ul><li>z</li></ul>" * (i % 5) + "</article>")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "wrapper", "places", "part", "count", "row_id")})
    found = X.extract_pages(pages).collect()
    assert len(found) == len(rows)
    got = {r.row_id: r.main_text for r in found}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("T\nsome words of text", "", "T\nsome words of text", "", "plain")
    assert got[13] == "page 3\nz\nz\nz"
    assert X.infer_wrappers(pages, fan_in=3).where("host = 'a.org'").count() == 1
    assert X.extract_pages(pages.where("false")).count() == 0


def test_the_given_pages(spark, sf_dir):
    """Against a reading of the test pages by their one known layout."""
    import html
    import re

    from folioscope.llm import catalog

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in catalog.op3_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("named", ['section id="discussion"', 'div class="related-work"', 'div class="search-results"', 'div class="has-sidebar"', 'div class="notice"'])
def test_sections_of_an_article_stay_whatever_their_name(named):
    tag = named.split()[0]
    assert text(FRAME % f"<article><p>one</p><{named}><p>two</p></{tag}></article>") == "one\ntwo"


def test_comments_are_no_main_text():
    assert text(FRAME % '<article><p>long text of the story</p></article><article class="comment"><p>first!</p></article>') == "long text of the story"
    assert text(FRAME % '<article class="post comments-open"><p>story</p></article>') == "story"


def test_text_that_all_pages_of_a_host_have_is_left_out(spark):
    body = '<article><p>story number %d of this host</p><div class="blurb"><p>Buy our book</p></div><div class="notice"><p>%s</p></div><div class="x"><p>body %d</p></div></article>'
    pages = [(i, f"http://same.org/{i}", FRAME % (body % (i, "All rights kept", i))) for i in range(8)]
    pages += [(100 + i, f"http://varies.org/{i}", FRAME % (body % (i, f"Note {i}", i))) for i in range(8)]
    pages += [(200 + i, f"http://copies.org/{i}", FRAME % (body % (1, "All rights kept", 1))) for i in range(8)]
    got = {r.row_id: r.main_text for r in X.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "story number 3 of this host\nbody 3"
    assert got[103] == "story number 3 of this host\nNote 3\nbody 3"
    assert "story number 1 of this host" in got[203] and "body 1" in got[203]


@pytest.mark.parametrize("levels", [10, 50, 62, 80, 3000])
def test_deep_pages_keep_their_text_in_order(levels):
    deep = "<div>" * levels + "<p>one <a>two</a> three</p>four<div><p>five</p></div>six" + "</div>" * levels
    assert text(f"<div><article>{deep}<p>tail</p></article></div>") == "one two three\nfour\nfive\nsix\ntail"
    hidden = "<div>" * levels + '<nav><div><p>menu</p></div></nav><p>text</p>' + "</div>" * levels
    assert text(f"<div><article>{hidden}<p>tail</p></article></div>") == "text\ntail"


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ("<p>a</p><p hidden>b</p><p>c</p>", "a\nc"),
        ('<p>a</p><div style="color:red; display: none"><p>b</p></div><p>c</p>', "a\nc"),
        ('<p>a <span style="display:none">b <span>c</span> d</span>e</p>', "a e"),
        ('<p>a <span hidden><i>b</i> <a href="/x">c</a> d</span>e</p>', "a e"),
        ('<p title="a hidden thing">a</p><p data-x=\'hidden\'>b</p>', "a\nb"),
        ('<p>a</p><div id="newsletter-archive"><p>b</p></div><section class="cookies-recipe"><p>c</p></section>', "a\nb\nc"),
        ('<p>a</p><div id="newsletter-box"><p>b</p></div><section class="adItem"><p>c</p></section><div class="comments-list"><p>d</p></div>', "a"),
    ],
)
def test_hidden_elements_and_whole_names(body, wanted):
    assert text(FRAME % f"<article>{body}</article>") == wanted


@pytest.mark.parametrize("named", ["responses", "user-feedback", "x1"])
def test_repeated_blocks_of_person_and_date_are_comments(spark, named):
    said = '<div class="entry"><span class="author">Ann</span><time>May %d</time><p>I say %d</p></div>'
    story = '<div class="byline"><span class="author">Bo</span><time>May 1</time></div><p>the long story number %d of this host, told here</p><p>its end %d and all that follows from it</p>'
    pages = [(i, "http://c.org/x", FRAME % (f"<article>{story % (i, i)}<section class='{named}'><h3>Words</h3>" + "".join(said % (j, j) for j in range(i % 4)) + "</section></article>")) for i in range(8)]
    got = {r.row_id: r.main_text for r in X.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert "I say" not in got[i] and "Words" not in got[i]
        assert f"story number {i} of" in got[i] and f"its end {i} and" in got[i]


def test_long_pages_align_in_bounded_time():
    import random
    import time

    rng = random.Random(3)
    page = lambda i: "".join(f"<{(t := rng.choice(['p', 'h2', 'div', 'ul', 'blockquote']))}>x{i} {j}</{t}>" for j in range(20_000))
    pages = [f"<article>{page(i)}</article>" for i in range(2)]
    start = time.time()
    whole = X.merged(*(X.wrapper_of(X.parse(p)) for p in pages))
    assert time.time() - start < 5
    assert X.expression(whole) == "<article> ( ( <blockquote> #text </blockquote> )* ( <div> #text </div> )* ( <h2> #text </h2> )* ( <p> #text </p> )* ( <ul> #text </ul> )* )+ </article>"
    found = X.main_text(X.parse(pages[0]), X.main_paths(whole), X.left_out(whole, X.main_paths(whole)))
    assert found == "\n".join(f"x0 {j}" for j in range(20_000))
