import html
import re

import edge
import pytest

from lockstep.llm import extraction as ex
from lockstep.llm.queries import QUERIES

TRICKY = """<html><body class="no-sidebar"><header><h1>Site</h1></header><div id="wrap"><div class="cookie-notice"><p>We use cookies</p></div><main><article><header><h1>T &lt; x</h1></header>
<p>One  two<br>three <a href="x>y">li&nbsp;nk</a></p><script>if (a<b) "</p>"</script><div class="ad-slot">Buy</div><!-- <p>hidden</p> --><p>Four<p>Five<ul><li>a<li>b</ul><form>f<p>q</p></form></article>
<section id="comments"><p>nice!</p></section></main><aside>s</aside></div><footer>f</footer>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("plain &amp; text", "plain & text"), ("<p>a<", "a<"), ('<div><p>x</p><a title="oops>y</a>z', "x\n\nyz"), (TRICKY, "T < x\n\nOne two three li nk\n\nFour\n\nFive\n\na\n\nb"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 400 + "deep" + "</div>" * 900, "deep"), ("<b>" * 50 + "&copy", "©")],
)
def test_single_pages(page, text):
    assert ex.article(page, None) == text


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<h2 id='sharing'>Sharing</h2>", "Sharing"), ("<h2 class='menu notice'>The menu</h2>", "The menu"), ("<section id='search'><p>How we search</p></section>", "How we search"), ("<p class='commentary'>So they say</p>", "So they say"), ("<p class='notice'>Seen</p>", "Seen"),
        ("<div class='commentary'><p>Verse by verse</p></div>", "Verse by verse"), ("<div id='related'>Kin</div>", "Kin"), ("<ul id='menu'><li>Soup</li></ul>", "Soup"), ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>", "So x=1 holds"),
        ("<div class='comments'><p>Nice</p></div>", None), ("<div id='comments'><p>Nice</p></div>", None), ("<section class='related-posts'><p>More</p></section>", None), ("<div class='ad'>Buy</div>", None), ("<div role='navigation'>Home</div>", None), ("<ul class='share'><li>Post it</li></ul>", None),
    ],
)
def test_words_close_containers_only(inside, text):
    wanted = "First\n\nLast" if text is None else f"First\n\n{text}\n\nLast"
    assert ex.article(f"<nav>Home</nav><article><p>First</p>{inside}<p>Last</p></article><div id='sidebar'><p>Side</p></div>", None) == wanted


def page(k, paragraphs, extra=""):
    body = "".join(f"<p>Paragraph {k}.{i} of this page</p>" for i in range(paragraphs))
    return f"<html><head><title>t</title></head><body><div><ul><li>Home</li><li>News</li></ul></div><div><p>Welcome to our site, always the same words</p></div><div>{extra}<h1>Title {k}</h1>{body}</div><div><p>All rights reserved by us for ever</p></div></body></html>"


def wrapper(pages):
    out = None
    for p in pages:
        tree = ex.skeleton(ex.read_page(p))
        out = ex.merge(out, tree) if out else tree
    return out


def test_wrapper_finds_what_varies_without_any_class_names():
    pages = [page(k, 1 + k % 3, "<h2>Now</h2>" if k % 2 else "") for k in range(6)]
    w = wrapper(pages)
    path = ex.region(w)
    for k, p in enumerate(pages):
        now = ["Now"] if k % 2 else []  # on half of the pages only: it may belong to the article
        assert ex.article(p, path, ex.constants(w, path)).split("\n\n") == now + [f"Title {k}"] + [f"Paragraph {k}.{i} of this page" for i in range(1 + k % 3)]


def test_copies_and_few_pages_lose_nothing():
    same = [page(1, 2)] * 5
    path = ex.region(wrapper(same))
    assert "Paragraph 1.0 of this page" in ex.article(same[0], path, ex.constants(wrapper(same), path))
    near = [page(1, 2)] * 8 + [page(2, 2)]
    path = ex.region(wrapper(near))
    assert ex.article(near[0], path, ex.constants(wrapper(near), path)).count("of this page") == 2
    two = [page(1, 2), page(2, 2)]
    assert ex.constants(wrapper(two), ex.region(wrapper(two))) == []


def test_wrappers_stay_small():
    w = None
    for k in range(300):
        odd = "".join(f"<div class=c{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + k // 26)}><p>{k} {j}</p></div>" for j in range(30))
        tree = ex.skeleton(ex.read_page(f"<body><div><p>Menu</p></div><div><h1>Title {k}</h1>{odd}</div></body>"))
        w = ex.bounded(ex.merge(w, tree) if w else tree)
    nodes, waiting = 0, [w]
    while waiting:
        nodes += 1
        waiting += waiting.pop().children
    assert nodes <= ex.MOST_NODES + ex.MOST_CHILDREN
    text = ex.article("<body><div><p>Menu</p></div><div><h1>T</h1><div class=new><p>x</p></div></div></body>", ex.region(w), ex.constants(w, ex.region(w)))
    assert text == "T\n\nx"


@pytest.mark.parametrize("tag", ["div", "p", "b", "table", "nav", "ul><li", "article"])
def test_deep_and_long_pages(spark, tag):
    deep = f"<{tag}>" * 100_000 + "deep" + f"</{tag}>" * 10
    long = "<article>" + "".join(f"<p>word {k}</p><h2>x{k}</h2>" for k in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a.org/1", deep), (2, "http://a.org/2", long), (3, "http://a.org/3", "y" * 1_000_000)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in edge.plain(ex.extract(df))}
    assert found[1] == ("" if tag == "nav" else "deep") and found[2].count("\n\n") == 59_999 and found[3] == "y" * 1_000_000


def test_deep_text_keeps_its_order():
    inside = "<div>" * 300 + "<p>a</p>b<section>c<div>d</div>e</section><nav>n<p>m</p></nav>f" + "</div>" * 300 + "g"
    assert ex.article(inside, []) == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng"


def test_rounds_of_merging_give_one_wrapper_a_host(spark, monkeypatch):
    monkeypatch.setattr(ex, "WIDTH", 2)
    df = spark.createDataFrame([(f"h{k % 2}", page(k, 1 + k % 3)) for k in range(60)], "host string, html string").repartition(12)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    found = edge.plain(ex.wrappers(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    import json

    assert sorted((r["host"], json.loads(r["wrapper"])[2]) for r in found) == [("h0", 30), ("h1", 30)]


def test_repeats_and_options():
    tree = ex.skeleton(ex.read_page("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p><hr></div>"))
    assert [(c.label, c.many) for c in tree.children[0].children] == [("(h2 p)", "+")]
    merged = wrapper(["<div><p>a</p><h3>x</h3></div>", "<div><p>b</p><table><tr><td>1</td></tr></table><h3>x</h3></div>"])
    assert [(c.label, c.many) for c in merged.children[0].children] == [("p", "1"), ("table", "?"), ("h3", "1")]
    p, _, h3 = merged.children[0].children
    assert ex._varies(p) and not ex._varies(h3)
    assert ex.Node.unpacked(merged.packed()).packed() == merged.packed()


def test_tables(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<html><body><nav>n</nav><article><h1>T{i}</h1>" + "".join(f"<p>Text {i} {k} &amp; so on</p>" for k in range(i % 5 + 1)) + "</article><footer>foot</footer></body></html>") for i in range(40)]
    rows += [(100, None, "<article><p>x</p></article>"), (101, "http://h0.example/null", None), (None, "no scheme", "<p>y</p>"), (102, "http://h0.example/odd", "<table><tr><td>cell<td>two</table>"), (103, "http://h1.example/x", rows[1][2]), (103, "http://h1.example/x", rows[1][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    found = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in edge.plain(ex.extract(df))), key=str)
    want = [(i, f"http://h{i % 3}.example/{i}", "\n\n".join([f"T{i}"] + [f"Text {i} {k} & so on" for k in range(i % 5 + 1)])) for i in range(40)]
    want += [(100, None, "x"), (101, "http://h0.example/null", ""), (None, "no scheme", "y"), (102, "http://h0.example/odd", "cell\n\ntwo")] + [(103, "http://h1.example/x", want[1][2])] * 2
    assert found == sorted(((*w, len(w[2])) for w in want), key=str)
    assert edge.plain(ex.extract(edge.empty(spark, df))) == []


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {r.page_id: r.text for r in QUERIES["op5_html_extraction"](spark, sf).collect()}
    for k, page_html in pages.items():
        inner = re.search(r"<article>(.*?)(</article>|$)", page_html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert found[k] == "\n\n".join(b for b in blocks if b)


def test_given_pages_without_the_lists(spark, monkeypatch):
    """Without the words and the article's name the wrappers lose nothing, and add nothing but adverts, which vary from page to page as articles do."""
    monkeypatch.setattr(ex, "_WORDS", set())
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    by = {}
    for r in pages:
        by.setdefault(r.url.split("/")[2], []).append((r.page_id, r.html.replace("<article>", "<div class=x>").replace("</article>", "</div>"), r.html))
    equal, total = 0, 0
    for own in by.values():
        if len(own) < 5:
            continue
        w = wrapper([h for _, h, _ in own])
        path = ex.region(w)
        left_out = ex.constants(w, path)
        for _, changed, given in own:
            inner = re.search(r"<article>(.*?)(</article>|$)", given, re.S)[1]
            blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
            adverts = [" ".join(html.unescape(a).split()) for a in re.findall(r'<div class="ad">(.*?)</div>', given, re.S)]
            equal += [b for b in ex.article(changed, path, left_out).split("\n\n") if b not in adverts] == [b for b in blocks if b]
            total += 1
    assert total > 100 and equal >= 0.97 * total, (equal, total)


def test_nothing_beside_the_longest_child_is_dropped():
    article = lambda k: f"<article><h1>T{k}</h1><div class=lead>Lead {k}</div><div class=body><p>{'word ' * 50}{k}</p></div></article>"
    pages = [article(k) for k in range(4)]
    assert ex.article(pages[2], ex.region(wrapper(pages))) == f"T2\n\nLead 2\n\n{'word ' * 50}2"
    plain = [f"<div><p>Text {k}</p></div>" for k in range(4)] + [f"<div><p>Text 4</p><table><tr><td>{'cell ' * 500}</table></div>"]
    assert ex.article(plain[4], ex.region(wrapper(plain))).startswith("Text 4\n\ncell")
    twice = [f"<div class=part>First {k}</div><div class=part>Second {k} is longer</div>" for k in range(3)]
    assert ex.article(twice[1], ["div.part"]) == "First 1\n\nSecond 1 is longer"
