"""Main text of pages: given documents, broken markup, and templates counted per host."""

import html
import random
import re

import pytest

from postura.llm import pages as P

CASES = [
    ("", ""),
    ("just text", "just text"),
    ("<p>a<p>b", "a\n\nb"),
    ("<body><nav>menu</nav><article><h1>T &amp; U</h1><p> a \n b&nbsp;c<br>d</p></article><footer>f</footer>", "T & U\n\na b c d"),
    ("<article><p><b>open <br><p>next</article>after", "open\n\nnext"),
    ("<script>var t='</p><article>x</article>'</script><main><p>m</p><aside>s</aside></main><div>o</div>", "m"),
    ("<div class='cookie-notice'>c</div><div class='post has-sidebar'><p>body</p></div><form><p>f</p></form>", "body"),
    ("<article><p>a</p><section id=comments><article class='comment'><p>hi</p></article></section></article>", "a"),
    ("<div class=banner-wrap><article><p>kept</p></article></div>", "kept"),
    ("<article><header><h1>Title</h1></header><p>x</p></article><header>site</header>", "Title\n\nx"),
    ("<ul><li>one<li>two</ul><table><tr><td>1<td>2</table>", "one\n\ntwo\n\n1\n\n2"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut</p><foo", "cut"),
    ("<article><p>1 < 2 &lt;b&gt; <!-- no --> <i>3</b></i>4</p>", "1 < 2 <b> 34"),
    ("<div>" * 30000 + "deep", "deep"),
    ("<!DOCTYPE html><title>t</title><style>p{}</style><p>é😀&copy</p>", "é😀©"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_main_text(source, text):
    assert P.JOIN.join(P.Page(source).kept()) == text


def site(rng, host, n, marked):
    menu = f"<div><span>{host} home</span><div>about us</div></div>"
    for i in range(n):
        body = "".join(f"<p>{host} text {rng.random()}</p>" for _ in range(rng.randint(1, 4))) + ("<p>often said</p>" if marked else "")
        inner = f"<article>{body}</article>" if marked else f"<div>{body}</div>"
        yield f"http://{host}/p{i}", f"<html><body>{menu}{inner}<div><p>all rights of {host}</p></div></body></html>", body


def test_templates_per_host(spark):
    rng = random.Random(11)
    rows = [r for host, n, m in (("a.example", 40, False), ("b.example", 6, False), ("c.example", 20, True)) for r in site(rng, host, n, m)]
    copy = ("http://b.example/copy", "<body><div><p>a copied page</p></div></body>", "<p>a copied page</p>")
    rows += [copy] * 50 + [("http://lone.example/", "<div><p>alone</p></div>", "<p>alone</p>")]
    rows += [(None, None, ""), ("no address", "", "")]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in P.extract(df.repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, (url, _, body) in enumerate(rows):
        want = P.JOIN.join(re.findall("<p>(.*?)</p>", body))
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))
    assert got[0].n_template > 0
    assert P.extract(df.where("false")).collect() == []


def test_article_of_the_test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r.page_id: r.html for r in df.collect()}
    got = P.extract(df).collect()
    assert len(got) == len(sources)
    for r in got:
        inner = re.search("<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>|<br>", "", inner))
        want = [" ".join(html.unescape(x).split()) for x in parts]
        assert r.text == "\n\n".join(x for x in want if x)
