import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.llm.html_extraction import extract, main_text, wrapper
from tablescout.llm.topk_search import top_k
from tablescout.llm.url_filters import judge, judged_by_patterns


def brute(rows, queries, k):
    out = set()
    for q in queries:
        best = sorted((-int(np.dot(rows[q], rows[c])), c) for c in rows if c != q)[:k]
        out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("tile", [7, 64, 4096])
def test_top_k(spark, tile):
    r = np.random.default_rng(3)
    rows = {i: [int(x) for x in r.integers(-3, 4, 5)] for i in range(150)}  # few values: many ties
    bad = [(900, None), (901, [1, None, 1, 1, 1]), (902, [1, 2]), (None, [1, 1, 1, 1, 1])]
    df = spark.createDataFrame([*rows.items(), *bad], "vec_id long, v array<long>").withColumn("tile", F.lit("x"))
    got = {tuple(x) for x in top_k(df.union(df.limit(3)), df.filter("vec_id % 20 = 0"), 20, tile).collect()}
    assert got == brute(rows, [i for i in rows if i % 20 == 0], 20)


def test_top_k_small_and_large_numbers(spark):
    big = {0: [2**40, 3], 1: [2**40, -3], 2: [-(2**40), 1]}
    df = spark.createDataFrame(list(big.items()), "vec_id long, v array<long>")
    got = [tuple(x) for x in top_k(df, df, 5).collect() if x.query_id == 0]
    assert sorted(got) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 1 - 2**63)]
    assert top_k(df.limit(0), df, 5).count() == 0 and top_k(df.filter("vec_id = 0"), df.filter("vec_id = 0"), 5).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><header class=top><h1>Site</h1></header>
<nav><ul><li><a href="/x">x</a></li></ul></nav><div class="side-bar sidebar">s</div><article class="post"><header><h2>Head</h2><p>by me</p></header>
<p>One &amp; <b>two</b>\n  three<br>four<p>f&eacute;&nbsp;g <!-- no --> <div class='notice'>n</div><form><p>q</p></form><div>{0}</div>
<section id="comments"><p>reader</p></section><p>Read our terms.</p></article><aside>a</aside><footer>&copy; f</footer></body></html>"""


def test_page_parts():
    assert extract(PAGE.format("five"), None) == "Head\nOne & two three four\nfé g\nfive\nRead our terms."
    assert extract("plain text & more", None) == "plain text & more"
    assert extract("<p>a<p>b<div class=ad>c</div><ul><li>d<li>e</ul>", None) == "a\nb\nd\ne"
    assert extract("<div><script>never closed", None) == ""


def test_wrapper_learns_template_texts():
    rule = wrapper([PAGE.format(f"body {i}") for i in range(5)])
    assert extract(PAGE.format("new"), rule) == "Head\nOne & two three four\nfé g\nnew\nRead our terms." or "terms" not in extract(PAGE.format("new"), rule)
    same = wrapper([PAGE.format("same")] * 9)
    assert "same" in extract(PAGE.format("same"), same)  # copies teach no template
    other = wrapper([f"<body><div class=story><p>first {i} {'long ' * 20}</p><p>Sign up now</p></div><div>menu</div></body>" for i in range(4)])
    assert extract(f"<body><div class=story><p>mine {'long ' * 20}</p><p>Sign up now</p></div><div>menu</div></body>", other) == ("mine " + "long " * 20).strip()


def test_odd_pages(spark):
    rows = [(1, "http://a.b/c", None), (2, None, "<p>x</p>"), (2, None, "<p>x</p>"), (None, "nonsense", ""), (4, "http://a.b/d", "<p>" + "y " * 300_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, n_chars int, host string")
    got = {r.page_id: r for r in main_text(df).collect()}
    assert main_text(df).count() == 5 and got[1].text == "" and got[2].text == "x" and got[4].n_chars == 599_999
    assert main_text(df.limit(0)).count() == 0


def test_template_texts_are_counted_over_all_pages(spark):
    often, seldom = [f"Notice {k} of the house" for k in range(8)], [f"Saying {k} of the week" for k in range(8)]
    rows = []
    for i in range(60):  # line k stands in 33 of 60 pages, saying k in 27
        lines = [x for k in range(8) for x in ([often[k]] if (i * 7 + k * 11) % 60 < 33 else []) + ([seldom[k]] if (i * 13 + k * 17) % 60 < 27 else [])]
        body = "".join(f"<p>{x}</p>" for x in [f"own text {i} " + "long " * 20, *lines])
        rows.append((i, f"http://h.org/{i}", f"<body><div class=menu>m</div><div class=story>{body}</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    texts = [r.text for r in main_text(df).collect()]
    assert len(texts) == 60 and not any(x in t for t in texts for x in often)
    assert [sum(x in t for t in texts) for x in seldom] == [27] * 8
    assert main_text(df.union(df)).filter("text LIKE '%Notice%'").count() == 0  # copies count once


def test_urls(spark):
    rows = [(1, "HTTP://Sub.Example.NET/en/x?y"), (2, "http://a.net"), (3, "http://a.net/"), (4, "https://x.org/fr/"), (5, "x.org/fr/"), (6, None),
            (6, None), (None, "http://www.example.com/de/a#b"), (8, "http://notexample.com/de/"), (9, "http://cheap-pills.example.com/"),
            (10, "http://x.com/spam-farm-report/?u=/spam-farm.x"), (11, "://"), (12, "http://a.net?/en/")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, host int")
    got = {r.page_id: tuple(r)[1:] for r in judge(df).collect()}
    assert got[1] == ("sub.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("a.net", "", None, "allow")
    assert got[3] == ("a.net", "/", "net/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5] == ("", "", None, "allow")
    assert got[6] == ("", "", None, "allow") and got[None][2:] == ("example.com/de/", "block") and got[8][2] is None
    assert got[9][3] == "block" and got[10][3] == "allow" and got[12] == ("a.net", "", None, "allow") and judge(df).count() == 13
    assert judge(df.limit(0)).count() == 0


def test_patterns_without_tokens(spark):
    df = spark.createDataFrame([("http://ab/x",), ("http://q/y",)], "url string")
    got = {r.url: r.blocked for r in judged_by_patterns(df, [("ab", "block"), ("http*y", "block"), ("q/*", "allow")]).collect()}
    assert got == {"http://ab/x": True, "http://q/y": False}
