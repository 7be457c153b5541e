"""The element interval index, and what reads it: result pages with nested markup and
footers, every container rule, nested tables and articles."""

import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from literal_rows import one
from webcorpus.functions import elements as E
from webcorpus.functions import page as P
from webcorpus.functions import serp as SP
from webcorpus.operators import serp as SX
from webcorpus.sources.serp_render import CONTAINERS, FOOTER


def contents(html):
    return [(e[0], html[e[4]:e[5]]) for e in E.intervals(html)]


@pytest.mark.parametrize("html, want", [
    ("<div>a<div>b</div>c</div>d", [("div", "a<div>b</div>c"), ("div", "b")]),
    ("<p>one<p>two<div>three</div>", [("p", "one"), ("p", "two"), ("div", "three")]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", [("ul", "<li>1<li>2<ul><li>3</ul><li>4"), ("li", "1"), ("li", "2<ul><li>3</ul>"), ("ul", "<li>3"), ("li", "3"), ("li", "4")]),
    ("<table><tr><td>1<td>2</div><tr><th>3</table>", [("table", "<tr><td>1<td>2</div><tr><th>3"), ("tr", "<td>1<td>2</div>"), ("td", "1"), ("td", "2</div>"), ("tr", "<th>3"), ("th", "3")]),
    ("<td><table><tr><td>x</table>y</td>", [("td", "<table><tr><td>x</table>y"), ("table", "<tr><td>x"), ("tr", "<td>x"), ("td", "x")]),
    ('<a href="x>y" title=\'>\'>t</a><br><img src=a>', [("a", "t"), ("br", ""), ("img", "")]),
    ("<script>if (a<b) '</div>'</SCRIPT ><b>x", [("script", "if (a<b) '</div>'"), ("b", "x")]),
    ("<!-- <div> --><i>y</i></i></div><!-- <b>", [("i", "y")]),
    ("<B CLASS=x>caps</b>", [("b", "caps")]),
    ("", []),
])
def test_intervals(html, want):
    assert contents(html) == want


def test_parents_depths_and_sizes():
    found = E.intervals("<div><p>a<b>c</b></p><i></i></div><u></u>")
    assert [(e[0], e[7], e[8], e[9], e[10]) for e in found] == [("div", 0, -1, 0, 3), ("p", 1, 0, 1, 1), ("b", 2, 1, 2, 0), ("i", 1, 0, 3, 0), ("u", 0, -1, 4, 0)]


class _Plain(HTMLParser):
    """Well-formed markup, read by the standard library."""

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append([tag, "", len(self.stack)])
        self.stack.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        for k in self.stack:
            self.found[k][1] += data


TREE = st.recursive(st.text("ab ", max_size=4), lambda kids: st.tuples(st.sampled_from(["div", "span", "b", "section"]), st.lists(kids, max_size=4)), max_leaves=25)


def _html(node):
    return node if isinstance(node, str) else f"<{node[0]} class='k'>{''.join(map(_html, node[1]))}</{node[0]}>"


@settings(max_examples=200, deadline=None)
@given(st.lists(TREE, max_size=4))
def test_well_formed_trees_against_the_standard_parser(nodes):
    import re
    html = "".join(map(_html, nodes))
    plain = _Plain()
    plain.feed(html)
    plain.close()
    got = [[e[0], re.sub("<[^>]*>", "", html[e[4]:e[5]]), e[7]] for e in E.intervals(html)]
    assert got == plain.found
    for e in E.intervals(html):
        inside = [x for x in E.intervals(html) if x[3] >= e[4] and x[6] <= e[5]]
        assert len(inside) == e[10]


@pytest.mark.parametrize("html", ["<a " * 100_000, "<b>" * 50_000 + "</i>" * 50_000, '<a "' * 100_000, "<script" * 50_000, "<!--" * 50_000, "<p><b>" * 20_000, "<td>" * 50_000, "<ul><li>" * 20_000, "</p>" * 50_000])
def test_hostile_pages_end(html):
    t0 = time.time()
    E.intervals(html)
    assert time.time() - t0 < 10


def test_selectors(spark):
    html = ('<div id="a" class="x g-blk" data-k="1"><p class="y">1</p><div><p class="y z">2</p></div></div>'
            '<div class="x"><p title="over 9">3</p><a href="#top">s</a><a href="https://e.org">t</a></div>')
    rules = {"y": [("p", "y")], "y z": [("p", "y", "z")], "x|q": [("div", "x|q", "!g-blk")], "child": [("div", "x"), ">", ("p",)], "below": [("div", "#a"), ("p",)], "has": [("div", "[data-k]")],
             "is": [("div", "[data-k=1]")], "not is": [("div", "[data-k=2]")], "in": [("p", "[title*=er 9]")], "start": [("a", "[href^=#]")], "any": [(None, "z")], "chain": [("div", "x"), ("div",), ">", ("p",)]}
    frame = spark.createDataFrame([(html,), (None,)], "html string").withColumn("i", E.element_index(F.col("html")))
    texts = [F.transform(E.select(F.col("i"), chain), lambda e: E.inner_html(F.col("html"), e)).alias(name.replace(" ", "_")) for name, chain in rules.items()]
    row = frame.select(*texts).collect()[0].asDict()
    assert row["y"] == ["1", "2"] and row["y_z"] == ["2"] and row["child"] == ["1", "3"] and row["below"] == ["1", "2"] and row["has"] == row["is"] != [] and row["not_is"] == []
    assert row["in"] == ["3"] and row["start"] == ["s"] and row["any"] == ["2"] and row["chain"] == ["2"] and len(row["x|q"]) == 1


def captures(spark, rows):
    return spark.createDataFrame([(i, e, 0, h) for i, (e, h) in enumerate(rows)], "query_id long, engine string, page_no int, html string")


def test_a_snippet_keeps_its_nested_parts_and_the_footer_stays_out(spark):
    google = ('<div class="g"><a href="https://a.org/1"><h3>First title</h3></a><div class="VwiC3b">First part <div>inner part</div> and the second part</div></div>'
              '<div class="g"><a href="https://a.org/2"><h3>Next title</h3></a></div><footer><cite>footer cite</cite><p>Footer words that are longer than thirty characters.</p></footer>')
    nested = ('<div class="g"><div class="g"><a href="https://b.org/1"><h3>Inner result</h3></a><cite>b.org</cite></div>'
              '<div class="g"><a href="https://b.org/2"><h3>Other result</h3></a></div></div>')
    got = SX.extract_results(captures(spark, [("google", google), ("google", nested)])).orderBy("query_id", "pos").collect()
    assert [(r["title"], r["url"], r["snippet"], r["displayed_url"]) for r in got] == [
        ("First title", "https://a.org/1", "First part inner part and the second part", "https://a.org/1"),
        ("Next title", "https://a.org/2", "", "https://a.org/2"),
        ("Inner result", "https://b.org/1", "", "b.org"), ("Other result", "https://b.org/2", "", "https://b.org/2")]


LAYOUT = {"google": '<a href="{u}"><h3 class="LC20lb">{t}</h3></a><div class="s">{s}</div>', "bing": '<h2><a href="{u}">{t}</a></h2><p>{s}</p>',
          "yahoo": '<h3 class="title"><a href="{u}">{t}</a></h3><p class="lh-16">{s}</p>', "duckduckgo": '<h2><a href="{u}">{t}</a></h2><span class="result__snippet">{s}</span>'}


def test_every_container_rule(spark):
    pages, want = [], []
    for engine, containers in CONTAINERS.items():
        assert len(containers) >= len(SP.RULES[engine]["containers"]) or engine == "duckduckgo"
        for start, end in containers:
            pages.append((engine, "".join(start + LAYOUT[engine].format(u=f"https://e.org/{i}", t=f"Title {i}", s=f"a snippet of more than twenty letters {i}") + end for i in range(2)) + FOOTER))
            # a class with the letters "ad" is an advert to the first engine
            want += [(len(pages) - 1, f"Title {i}", f"https://e.org/{i}", f"a snippet of more than twenty letters {i}") for i in range(2) if "Gx5Zad" not in start]
    got = SX.extract_results(captures(spark, pages)).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["title"], r["url"], r["snippet"]) for r in got] == want


def test_null_and_empty_pages(spark):
    got = SX.extract_results(captures(spark, [("google", None), ("bing", ""), ("yahoo", "<html>"), ("other", '<div class="g">'), (None, "x")]))
    assert got.collect() == [] and SX.extract_news(captures(spark, [("google", None), ("bing", "")])).collect() == []


def test_news_with_nested_markup(spark):
    google = ('<article><div class="SoaBEf"><div><a href="https://n.org/1"><div role="heading">A <div>nested</div> story</div></a></div><div class="GI74Re">one <div>two</div> three</div>'
              '<div class="CEMjEf"><span>Source <span>Desk</span></span></div></div></article><span class="WG9SHc">not of this story</span>')
    r = SX.extract_news(captures(spark, [("google", google)])).collect()
    assert [(x["title"], x["snippet"], x["source"], x["date"]) for x in r] == [("A nested story", "one two three", "Source Desk", "")]


def test_nested_tables(spark):
    html = ('<table><thead><tr><th>A<th>B</tr></thead><tbody><tr><td>1<td><table><tr><td>x</td><td>y</td></tr></table></td></tr>'
            '<tr><td>2</td><td>3</td></tr></tbody><tfoot><tr><td>sum</td></tr></tfoot></table><table></table><table><tr><td>only</table>')
    got = one(spark, P.tables(F.col("x")), html)
    assert [(t["headers"], t["rows"]) for t in got] == [
        (["A", "B"], [["1", "xy", "x", "y"], ["x", "y"], ["2", "3"]]), ([], [["x", "y"]]), ([], [["only"]])]
    assert one(spark, P.tables(F.col("x")), None) in (None, []) and one(spark, P.tables(F.col("x")), "no table") == []


def test_large_tables_stay_linear(spark):
    html = "<table>" + "".join(f"<tr><td>{i}</td><td>b</td></tr>" for i in range(4000)) + "</table>"
    t0 = time.time()
    assert len(one(spark, P.tables(F.col("x")), html)[0]["rows"]) == 4000
    assert time.time() - t0 < 20
