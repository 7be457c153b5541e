"""What a page record costs: tables without the index of the whole page, texts cleaned together as one by one,
small Arrow batches while records are written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webcorpus.functions import contacts as C
from webcorpus.functions import elements as E
from webcorpus.functions import page as P
from webcorpus.functions import text as T
from webcorpus.plans import q_records as Q
from webcorpus.session import PAGES_PER_BATCH
from webcorpus.sources.tables import SCHEMAS

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
FRAGMENTS = ["plain words", "", " a\t b\n", "<b>bold</b> &amp; &lt;x&gt; &eacute;", "open <a href='x", "y'> close", "é & ü", "& & &", "", "tab\x1cend  "]


def parts_of(html):
    """The table elements by the index of the whole page."""
    every = E.intervals(html)
    before = np.cumsum([0] + [e[0] in E.TABLE_PARTS for e in every]).tolist()
    return [[e[0], html[e[4]:e[5]] if e[0] in ("td", "th") else None, before[e[9]], before[e[9] + e[10] + 1] - before[e[9] + 1]] for e in every if e[0] in E.TABLE_PARTS]


@pytest.mark.parametrize("html", [
    "<p>a</p><p>b</p><table><thead><tr><th>h</th></tr></thead><tbody><tr><td>1</td><td>x</td></tr> <tr><td>2</td></tr></tbody></table>",
    "<p>open<table><tr><td>cell<tr><td>next<p>q</p><p>r</p></table>after</td>",
    "<table><tr><td><table><tr><td>in</td></tr></table>out</td></tr><tr></tr></table>",
    "<tr><td>no table</td></tr><ul><li>a</li><li>b</li></ul><TABLE class=x><TR><TD>up</TD></TR></TABLE>",
    "<script><table></script><table><tr><td>1</td></tr><!-- <tr><td>2</td></tr> --><tr><td title='</td>'>3</td></tr>",
    "<div>" * 511 + "<table><tr><td>deep</td></tr></table>", "<div>" * 509 + "<table><tr><td>deep</td></tr></table>",
])
def test_table_parts_are_those_of_the_whole_index(html):
    assert E.table_parts(html) == parts_of(html)


def test_tables_do_not_index_the_whole_page(monkeypatch):
    monkeypatch.setattr(E, "intervals", lambda html: pytest.fail("the whole page was indexed"))
    assert [p[0] for p in E.table_parts("<p>a</p><table><tr><td>1</td></tr></table>")] == ["table", "tr", "td"]


def test_fragments_cleaned_together_are_as_cleaned_alone(spark):
    rows = [(FRAGMENTS,), ([],), (None,), (["a\x02b", "c"],), (["&#2;", "x"],), (["&#65; one", "<i>two</i>"],), ([None, " x "],), (["a", "a\x01 b"],)]
    got = spark.createDataFrame(rows, "fs array<string>").select(
        T.inner_texts(F.col("fs")).alias("together"), F.transform("fs", T.inner_text).alias("alone")).collect()
    assert [r.together for r in got] == [r.alone for r in got]


def test_cells_with_separators_or_numeric_entities(spark):
    row = "<tr><td>{}</td><td> <b>x</b> &amp;\ty </td></tr>"
    pages = ["<table><thead><tr><th>H</th><th></th></tr></thead><tbody>" + row.format(c) + "<tr><td></td></tr></tbody></table>" for c in ("a", "a\x02b\x01c", "&#2;d&#1;", "é")]
    got = spark.createDataFrame([(p,) for p in pages], "html string").select(P.tables(F.col("html"))[0].alias("t")).collect()
    assert [r.t.headers for r in got] == [["H", ""]] * 4
    assert [r.t.rows for r in got] == [[[c, "x  y"], [""]] for c in ("a", "abc", "d", "é")]


def test_structured_pairs_in_odd_tags(spark):
    html = ('x itemprop="no" <b>1 < 2 <a <span itemprop=name>N</span><i class="a > h-x p-name">M</i><IMG itemprop="image" src="/i.png">'
            '<div class="h-card"><b class=\'p-org\'>O</b></div>')
    got = spark.createDataFrame([(html,)], "html string").select(P.microdata(F.col("html")).alias("d"), P.microformats(F.col("html")).alias("f")).first()
    assert [(p.prop, p.value) for p in got.d.properties] == [("name", "N"), ("image", "/i.png")]
    assert [p.value for p in got.f.properties] == ["M", "O"]


def test_contacts_between_many_words(spark):
    text = "word " * 50 + "a@b.org,c@d.org x.com/one twitter.com/two\nmail e@f.org 1 Oak st, Town, IL 62704. call --212-555-0100 (303) 555 1234 +49 30 1234567"
    got = spark.createDataFrame([(text,)], "t string").select(C.contacts(F.col("t")).alias("c")).first().c
    assert got.emails == ["a@b.org", "c@d.org", "e@f.org"]
    assert got.social_media == {"twitter": ["twitter.com/two", "x.com/one"]}
    assert got.addresses == ["1 Oak st, Town, IL 62704"]
    assert "212-555-0100" in got.phones and "303-555-1234" in got.phones


def test_records_are_written_in_small_batches(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "some words", "en", "s", 10)], SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    seen, before = [], spark.conf.get(BATCH)

    def stop(*_):
        seen.append(int(spark.conf.get(BATCH)))
        raise InterruptedError

    monkeypatch.setattr(Q.sinks, "write_table", stop)
    with pytest.raises(InterruptedError):
        Q.page_record(spark, str(tmp_path))
    assert seen == [min(PAGES_PER_BATCH, int(before) or PAGES_PER_BATCH)]
    assert spark.conf.get(BATCH) == before
