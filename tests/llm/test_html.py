"""Wrapper induction: odd and broken pages, the alignment against recursion, and pages on which the wrapper must decide."""

import random
import time

import pytest

from clicklog.llm import html_extract, html_tree

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(i, f"http://{host}.example/{i}", page) for i, (host, page) in enumerate(pages)]
    return [r.text for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]


@pytest.mark.parametrize(("page", "want"), [
    ("<p data-x=it's>First</p><p>Second it's</p><p>Third</p>", "First\nSecond it's\nThird"), ('<p title="a"b">First</p>', "First"), ("a < b <3 & c", "a < b <3 & c"),
    ("<head><title>t</title><body><p>no end of head", "no end of head"), ("x<!-- a > b -->y<!-->z", "xyz"), ("<p>one<li>two<li>three", "one\ntwo\nthree"),
    ("<p>&lt;b&gt; &am<i>p;</i> &#0000065;&#x42;" + "&#" + "9" * 5000 + ";", "<b> &amp; AB�"), ("<script>var a='</p>'</script>t<style>p{}</STYLE >u", "tu"),
    ("<p>a\n\t b&nbsp;c<br>d</p>", "a b c d"), ("<p>kept<p title=\"never closed>lost", "kept"), ("", ""), ("<<<>>>", "<<<>>>"),
])
def test_pages_are_read_by_html_rules(page, want):
    assert "\n".join(t for _, t in html_tree.Page(page).blocks) == want


def test_deep_long_and_broken_pages_are_whole_and_quick(spark):
    pages = {
        "deep": "<div>" * 100_000 + "found", "lists": "<ul><li>" * 600 + "found", "tags": "found" + "<a " * 400_000, "quotes": "found<p x=\"" * 3, "brackets": "<" * 500_000 + " found",
        "long": "<p>found</p>" + "<p>word</p>" * 500_000, "wide": "found" + "".join(f"<div>b{i}<p>x{i}</p></div>" for i in range(1000)), "ends": "<div>" * 50_000 + "</p>" * 50_000 + "found",
    }
    began = time.time()
    out = dict(zip(pages, texts(spark, [(n, p) for n, p in pages.items()]), strict=True))
    assert time.time() - began < 120 and all("found" in t for t in out.values())
    assert out["long"].count("word") == 500_000 and out["wide"].split("\n") == ["found", *(x for i in range(1000) for x in (f"b{i}", f"x{i}"))]


def matching(a, b):
    """Simple tree matching of (label, children) by its recursion."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1)]
    for x in a[1]:
        row = [0]
        for j, y in enumerate(b[1]):
            row.append(max(row[j], m[-1][j + 1], m[-1][j] + matching(x, y)))
        m.append(row)
    return m[-1][-1] + 1


def test_alignment_matches_as_many_nodes_as_the_recursion():
    rng = random.Random(3)

    def tree(depth):
        labels = [x for x in ["section", "div", "article", "main", "center"] for _ in range(3)]
        picked = sorted(rng.sample(range(len(labels)), rng.randint(0, 5 if depth else 0)), key=lambda _: rng.random())
        return [(labels[k], tree(depth - 1)) for k in picked]

    def html(nodes):
        return "".join(f"<{n}>{html(c)}</{n}>" for n, c in nodes)

    for _ in range(60):
        a, b = tree(3), tree(3)
        page, written = html_tree.Page(html(a)), html_tree.Reference.written(html_tree.Page(html(b)))
        reference = html_tree.Reference(written)
        known = {html_tree.joint(1, y) for y in range(1, len(reference.label))}
        assert sum(s in known for s in html_tree.align(page, reference)) + 1 == matching(("", a), ("", b))


def test_wrapper_decides_where_names_mislead(spark, monkeypatch):
    page = """<body><div class="story">Welcome to our pages, read by many</div><div class="sidebar"><h1>{t}</h1><p>{t} opens with a long line</p><p>{t} goes on and ends</p></div>
<div class="post-content">All rights are with us</div></body>"""
    pages = [("w", page.format(t=f"tale {i}")) for i in range(20)]
    want = [f"tale {i}\ntale {i} opens with a long line\ntale {i} goes on and ends" for i in range(20)]
    assert texts(spark, pages) == want
    monkeypatch.setattr(html_extract, "VARIES", -1)
    assert texts(spark, pages) != want  # names alone


def test_names_inside_the_article_do_not_drop_what_varies(spark):
    page = """<div class="notice">seen on every page</div><article><header><h1>{t}</h1></header><p>{t} opens with a long line of its own, as every tale here does, and goes on for a while</p>
<div class="share-price">{t} rose</div><p id="related">{t} is related</p><p class="notice">{t} noted</p><p>this line is on every page</p><div class="comments"><p>nice {t}</p></div><div class="ad">{t} buy</div></article><p class="notice">{t} outside</p>"""
    out = texts(spark, [("n", page.format(t=f"tale {i}")) for i in range(20)])
    assert out == ["\n".join(f"tale {i}{x}" for x in ("", " opens with a long line of its own, as every tale here does, and goes on for a while", " rose", " is related", " noted")) + "\nthis line is on every page" for i in range(20)]


@pytest.mark.parametrize("n", [2, 8, 30, 300])
def test_what_articles_have_in_common_stays_in_each(spark, n):
    page = """<div><p>our pages</p></div><div class="box"><p>top stories here</p></div><article><h1>Weather</h1><p>Today</p><h2>Background</h2><p>tale {i} opens with a long line of its own and goes on</p><h2>References</h2><p>see tale {i}</p></article><p>all rights are with us</p>"""
    out = texts(spark, [("same", page.format(i=i)) for i in range(n)])
    body = ["Weather\nToday\nBackground\ntale {i} opens with a long line of its own and goes on\nReferences\nsee tale {i}".format(i=i) for i in range(n)]
    assert all(b in t for b, t in zip(body, out, strict=True))
    assert n < 8 or out == body  # a few pages do not tell what the host's pages have in common


def test_copies_of_a_page_are_no_template_and_few_pages_are_kept(spark):
    pages = [("c", f"<div><p>one text that many pages copy</p><p>with a second line</p></div><div>{i}</div>") for i in range(30)]
    assert all(t.startswith("one text that many pages copy\nwith a second line") for t in texts(spark, [(h, p.rsplit("<div>", 1)[0]) for h, p in pages]))
    assert texts(spark, [("few", "<p>same</p><p>other a</p>"), ("few", "<p>same</p><p>other b</p>")]) == ["same\nother a", "same\nother b"]


def test_nulls_clashing_columns_and_repeated_rows(spark):
    rows = [(1, None, "<p>a</p>", "x", 1, 1), (1, None, "<p>a</p>", "x", 1, 1), (None, "http://h.example/", "<p>b</p>", "y", 2, 2), (3, "http://h.example/", None, "y", 2, 2), (4, "http://h.example/", "", "y", 2, 2)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string, host string, slot int, template int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "b", 1), (1, "a", 1), (1, "a", 1), (3, "", 0), (4, "", 0)]
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0
