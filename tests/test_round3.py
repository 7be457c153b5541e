"""Steps that must read their input once, and keyword scores that are summed block by block."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webcorpus.functions import contacts as C
from webcorpus.functions import elements as E
from webcorpus.functions import page as P
from webcorpus.functions import structured as ST
from webcorpus.operators import search as SE


def test_contact_text_is_made_once(spark):
    text = str(C.contacts(P.raw_text(F.col("body")), F.col("html")))
    assert text.count("regexp_replace(body") == 1 and str(C.social_media(P.raw_text(F.col("body")))).count("regexp_replace(body") == 1


def test_meta_tags_are_found_once(spark):
    assert str(P.meta(F.col("body"))).count("regexp_extract_all(body") == 1


def test_texts_without_entities_pass_through(spark):
    rows = spark.createDataFrame([("a  b",), ("a &amp;lt; &#233; &unknown; b",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(P.decode_entities(F.col("t"))).collect()] == ["a & b", "a &lt; é  b", "", None]


def test_list_texts_around_other_tags(spark):
    html = "<p>out</p><UL><li>a <b>b</b> &amp; c<ol><LI>x</li></ol>tail</li></UL> <i>after</i> <ol>no item</ol><ul><li>open < end"
    got = spark.createDataFrame([(html,), (None,)], "b string").select(P.lists(F.col("b")).alias("l")).collect()
    assert got[0]["l"]["unordered"] == [["a b  cxtail"], ["open end"]] and got[0]["l"]["ordered"] == [["x"]]
    assert got[1]["l"] == ([], [])


def test_cells_come_with_the_table_index():
    html = "<div><table><tr><td>é<p>1</p></td><th>b</table></div><table>"
    assert E.table_parts(html) == [["table", None, 0, 3], ["tr", None, 1, 2], ["td", "é<p>1</p>", 2, 0], ["th", "b", 3, 0], ["table", None, 4, 0]]


def test_items_need_one_pass_over_the_elements(monkeypatch):
    calls = []
    real = ST.intervals
    monkeypatch.setattr(ST, "intervals", lambda page: calls.append(page) or real(page))
    page = '<div itemscope><b itemprop="name">n</b></div><div class="h-card"><b class="p-name">m</b></div>'
    got = ST._items.func(pa.array([page, None])).to_pylist()
    assert len(calls) == 1 and got[0]["microdata"] == '[{"properties": {"name": "n"}}]' and got[1] == {"microdata": "[]", "microformats": "[]"}


def test_element_columns_are_built_page_by_page():
    page = "<ul>" + "<li class='a'>x</li>" * 300 + "</ul>"
    pages = pa.array([page, None, ""] + [page] * 150)
    tracemalloc.start()
    got = E._index.func(pages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[list(e.values()) for e in p] for p in got[:3].to_pylist()] == [E.intervals(page), [], []]
    assert len(got) == 153 and most < 6 * got.get_total_buffer_size()


@pytest.mark.parametrize("size", [2, 1000])
def test_scores_do_not_depend_on_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(SE, "BLOCK_DOCS", size)
    docs = [(k, "red blue" if k % 3 else "red red green", "en") for k in range(9)] + [(20, None, "en"), (21, "rot", "de"), (3, "red red green", "en")]
    asked = [(1, "red", "en", 4), (2, "green blue", "en", 30), (3, "rot", "en", 5), (4, "rot", "de", 0), (5, "rot", "de", 2)]
    got = SE.bm25_search(spark.createDataFrame(docs, "doc_id long, text string, lang string"),
                         spark.createDataFrame(asked, "query_id long, query string, language string, num_results int"))
    rows = sorted(tuple(r)[:3] for r in got.collect())
    assert [r for r in rows if r[0] == 1] == [(1, 1, 3), (1, 2, 0), (1, 3, 6), (1, 4, 1)]
    assert len([r for r in rows if r[0] == 2]) == 9 and [r for r in rows if r[0] > 2] == [(5, 1, 21)]
    assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString()


def test_ids_that_repeat_across_languages_have_one_score(spark):
    docs = [(1, "red", "en"), (1, "red", "de"), (2, "red", "en"), (3, "blue", "en"), (4, "blue", "de")]
    asked = [(1, "red", "en", 1), (1, "red", "de", 1), (2, "red", "en", 5)]
    got = SE.bm25_search(spark.createDataFrame(docs, "doc_id long, text string, lang string"),
                         spark.createDataFrame(asked, "query_id long, query string, language string, num_results int")).collect()
    rows = sorted(tuple(r) for r in got)
    assert [r[:3] for r in rows] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 2, 2)]
    assert rows[0][3] > rows[2][3] == rows[3][3] > 0
