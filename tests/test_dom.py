"""Tokens and element trees: markup cases of the HTML standard, long pages,
and a plain stack machine on random tag soup."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contactlake.functions import dom
from contactlake.functions import html as H
from contactlake.functions.text import let

TOKENS = [
    ("a < b <3 c", ["a ", "<", " b ", "<", "3 c"]),
    ("<!-->x<!--->y<!-- z --!>w<!--", ["<!-->", "x", "<!--->", "y", "<!-- z --!>", "w", "<!--"]),
    ("<p title='>' a=\">\" b=it's>t", ["<p title='>' a=\">\" b=it's>", "t"]),
    ("<script>'</div>'</SCRIPT >x", ["<script>'</div>'</SCRIPT >", "x"]),
    ("x<style>a{}", ["x", "<style>a{}"]),
    ("x<a href=\"y>z", ["x"]),
    ("x<div", ["x"]),
    ("</ x>a<?php b ?>c</>", ["</ x>", "a", "<?php b ?>", "c", "</>"]),
    ("<textarea><b>&amp;</b></textarea>", ["<textarea><b>&amp;</b></textarea>"]),
]

# html, "name(start-end<parent)" of the elements
TREES = [
    ("<p>1<p>2<div>3<p>4</div>5", "p(0-2<-1) p(2-4<-1) div(4-8<-1) p(6-8<4)"),
    ("<ul><li>1<ul><li>2</ul><li>3</ul>", "ul(0-9<-1) li(1-7<0) ul(3-6<1) li(4-6<3) li(7-9<0)"),
    ("<dl><dt>1<dd>2<dt>3</dl>", "dl(0-7<-1) dt(1-3<0) dd(3-5<0) dt(5-7<0)"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", "table(0-9<-1) tr(1-6<0) td(2-4<1) td(4-6<1) tr(6-9<0) th(7-9<6)"),
    ("<h1>a<h2>b</h2>", "h1(0-2<-1) h2(2-4<-1)"),
    ("<a>1<a>2</a>", "a(0-2<-1) a(2-4<-1)"),
    ("<div><span>x</div>y</span>", "div(0-3<-1) span(1-3<0)"),
    ("<select><option>1<option>2</select>", "select(0-5<-1) option(1-3<0) option(3-5<0)"),
    ("<div><br/><img><p/>t</div>", "div(0-5<-1) br(1-1<0) img(2-2<0) p(3-5<0)"),
    ("<b><x-y>1</x-y></b>", "b(0-4<-1) x-y(1-3<0)"),
    ("<table><td><div>1</td>2", "table(0-6<-1) td(1-4<0) div(2-4<1)"),
    ("</p></div>x<body><body a=b><html>", "body(3-6<-1)"),
    ("<p><table><tr><td>1</table></p>", "p(0-1<-1) table(1-5<-1) tr(2-5<1) td(3-5<2)"),
    ("", ""),
]


def shown(rows):
    return " ".join(f"{n.name}({n.id}-{n.end}<{n.parent})" for n in rows)


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, h string")
    return [r[0] for r in df.orderBy("i").select(expr("h")).collect()]


def test_tokens(spark):
    assert column(spark, [h for h, _ in TOKENS], dom.tokens) == [t for _, t in TOKENS]


def test_trees(spark):
    got = column(spark, [h for h, _ in TREES], lambda h: let(dom.tokens(h), dom.nodes))
    assert [shown(g) for g in got] == [t for _, t in TREES]


def test_null_and_blank(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",)], "h string")
    rows = df.select(dom.tokens("h").alias("t"), H.body_text("h").alias("x"), H.page_tree("h").alias("n")).collect()
    assert rows[0].t is None and rows[0].x is None and rows[1].t == [] and [r.x for r in rows[1:]] == ["", ""]


@pytest.mark.parametrize("n", [dom.BLOCK - 1, dom.BLOCK, 3 * dom.BLOCK + 5, 20_000])
def test_many_tags_and_depth(spark, n):
    page = "<div>" * n + "x" + "</div>" * (n // 2)
    got = column(spark, [page if n < 5000 else "<p>x" * n], lambda h: let(dom.tokens(h), dom.nodes))[0]
    assert len(got) == n and [g.id for g in got][:3] == ([0, 1, 2] if n < 5000 else [0, 2, 4])
    if n < 5000:
        assert sum(g.end < 2 * n for g in got) >= n // 2 and all(g.parent == g.id - 1 for g in got)
    else:
        assert all(g.end == g.id + 2 and g.parent == -1 for g in got)


def plain_tree(soup):
    """Intervals by a stack where nothing is implied: div, span and b only."""
    out, stack = [], []
    parts = re.findall(r"<[^>]*>|[^<]+", soup)
    for i, t in enumerate(parts):
        m = re.match(r"<(/?)(\w+)>", t)
        if not m:
            continue
        if not m[1]:
            node = [i, len(parts), stack[-1][0] if stack else -1, m[2]]
            stack.append(node)
            out.append(node)
        else:
            # div closes anything above it, the others stop at a div
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][3] == m[2]:
                    for node in stack[k:]:
                        node[1] = i
                    del stack[k:]
                    break
                if m[2] != "div" and stack[k][3] == "div":
                    break
    return " ".join(f"{n[3]}({n[0]}-{n[1]}<{n[2]})" for n in out)


def test_random_soup(spark):
    rng = random.Random(5)
    soups = ["".join(rng.choice(["<div>", "</div>", "<span>", "</span>", "<b>", "</b>", "t"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    soups = [re.sub("t+", "t", s) for s in soups]
    got = column(spark, soups, lambda h: let(dom.tokens(h), dom.nodes))
    assert [shown(g) for g in got] == [plain_tree(s) for s in soups]


def test_attributes(spark):
    tag = """<a HREF=x?a=1 class="p q" data-x='1"2' checked title= "t>t" href=second>"""
    df = spark.createDataFrame([(tag,)], "t string")
    names = ["href", "class", "data-x", "checked", "title", "id"]
    assert list(df.select(*[dom.attribute(F.col("t"), n) for n in names]).first()) == ["x?a=1", "p q", '1"2', "", "t>t", None]
    assert df.select(dom.has_class(F.col("t"), "q")).first()[0] and not df.select(dom.has_class(F.col("t"), "p q")).first()[0]
