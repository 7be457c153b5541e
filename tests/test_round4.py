"""Steps whose cost must not grow with the square of a page's length, against plain readings."""

import random

import pytest
from pyspark.sql import functions as F

from webcorpus.functions import contacts as C
from webcorpus.functions import elements as E
from webcorpus.functions import page as P
from webcorpus.functions import structured as ST
from webcorpus.operators import pages as OP


def test_fold_blocks_give_what_one_fold_gives(spark):
    sums = lambda vs: E.fold(vs, F.lit(0), lambda s, v: s + v, lambda s, v: F.when(v % 2 == 1, F.struct(s.alias("s"))), "struct<s:int>")
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 200)] + [(None,)], "v array<int>").select(sums(F.col("v")).alias("x")).collect()
    assert [[e["s"] for e in r["x"] or []] for r in rows] == [[sum(range(k)) for k in range(1, n, 2)] for n in (0, 1, 63, 64, 65, 200)] + [[]]


def test_folds_hold_no_texts(spark):
    body = F.col("body")
    for c in (P.lists(body), P.paragraph_records(body)):
        folds = str(c).split("aggregate(")[1:]
        assert folds and not any("items:array" in f or "text:string" in f for f in folds)


def test_long_pages_keep_every_list_item_and_context(spark):
    n = 3000
    html = "<h1>a</h1>" + "".join(f"<div><p>p{i}</p><h2>h{i}</h2><p>q{i}</p></div>" for i in range(n)) + "<ul>" + "".join(
        f"<li>x{i}<ol><li>y{i}</li><li>z{i}</li></ol>t</li>" for i in range(n)) + "</ul>"
    row = spark.createDataFrame([(html,)], "b string").select(P.lists(F.col("b")).alias("l"), P.paragraph_records(F.col("b")).alias("p")).collect()[0]
    assert row["l"]["unordered"] == [[f"x{i}y{i}z{i}t" for i in range(n)]] and row["l"]["ordered"] == [[f"y{i}", f"z{i}"] for i in range(n)]
    assert [tuple(r) for r in row["p"]] == [x for i in range(n) for x in ((f"p{i}", "a"), (f"q{i}", f"h{i}"))]


def test_contact_patterns_see_candidate_words_only(spark):
    t = "call (202) 555-0100, +44 20 7946 0958;-12345678901 or a@b.co x.com/y\tfacebook.com/z 12 Oak Street, Springfield, IL 62704."
    c = spark.createDataFrame([(t,), (None,)], "t string").select(C.phones("t").alias("p"), C.emails("t").alias("e"), C.social_media(F.col("t")).alias("s"), C.addresses(F.col("t")).alias("a")).collect()
    assert {"(202) 555-0100", "202-555-0100", "+44 20 7946 0958", "123-456-7890", "1234567890"} <= set(c[0]["p"])
    assert c[0]["e"] == ["a@b.co"] and c[0]["s"] == {"twitter": ["x.com/y"], "facebook": ["facebook.com/z"]} and c[0]["a"] == ["12 Oak Street, Springfield, IL 62704"]


def _attributed(html):
    """``attributed_intervals`` read from the full index."""
    full, numbers, out, reach = E.intervals(html), {}, [], []
    for e in full:
        up = e[8]
        while up >= 0 and up not in numbers:
            up = full[up][8]
        if e[1][1 + len(e[0]):-1]:
            numbers[e[9]] = len(out)
            out.append(e[:8] + [numbers[up] if up >= 0 else -1, len(out), 0])
            reach.append((e[9], e[9] + e[10]))
    for k, (first, last) in enumerate(reach):
        out[k][10] = sum(first < other <= last for other, _ in reach)
    return out


def test_attributed_elements_are_those_of_the_full_index():
    rnd = random.Random(7)
    names = "p div li ul td tr table tbody span dl dd option select button br script title textarea h1".split()

    def piece():
        x = rnd.choice(names)
        return rnd.choice([f"<{x}>t</{x}>" * rnd.choice([1, 3]), "<table><tr><td>a</td><td><p>b</table>" * 2, f"<{x}>", f"</{x}>", f"<{x} itemscope class='h-x'>",
                           f"<{x.upper()} itemprop=q>", "<!-- <p> -->", "<", "text "])

    for _ in range(1500):
        html = "".join(piece() for _ in range(rnd.choice([3, 10, 30])))
        assert E.attributed_intervals(html) == _attributed(html)
    deep = "<div>" * 511 + "<b>t</b><ul><li>x</li></ul><p><i><a><div><b>q</b><b>q</b></div><li itemprop=1></div></div><b itemscope>z</b>"
    assert E.attributed_intervals(deep) == _attributed(deep)


def test_items_pass_over_plain_runs():
    page = "<p>a</p>" * 2000 + "<table>" + "<tr><td>1</td></tr>" * 2000 + "</table><div itemscope><b itemprop=n>v<p>x</p><p>y</p></b></div>"
    assert len(E.intervals(page)) > 6000 and len(ST.intervals(page)) == 2
    assert ST.microdata_items(page) == [{"properties": {"n": "vxy"}}]


@pytest.mark.parametrize("field", ["title", "contacts"])
def test_only_named_record_columns_are_built(spark, field):
    assert list(OP.field_columns(fields=(field,))) == [field]
