"""Scale properties of the plans: no Python worker in any
query but one Arrow pass where the element index is read, top-n queries carry a partial group limit before
the exchange, and page extraction runs without an exchange."""

import re

import pytest

from literal_rows import SMALL
from webcorpus.plans import catalog

catalog.load_all()
# one Arrow pass per page builds the element index, or items and contact fields from it
INDEXED = {"serp_web_roundtrip", "serp_news_roundtrip", "record_tables", "record_nested_tables", "record_nested_items", "record_nested_contacts", "contacts_structured",
           "page_record", "page_statistics", "page_metadata_view", "page_contacts_view"}
PYTHON_NODES = re.compile(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonUDF")


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_in_plan(spark, name):
    found = set(PYTHON_NODES.findall(plan_of(spark, name)))
    assert found <= ({"ArrowEvalPython", "PythonUDF"} if name in INDEXED else set())


@pytest.mark.parametrize("name", ["result_limit", "keyword_search_bm25"])
def test_top_n_has_partial_group_limit(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan_of(spark, name))


@pytest.mark.parametrize("name", ["page_overview", "page_paragraphs", "contacts_email", "clean_text"])
def test_page_extraction_is_narrow(spark, name):
    plan = plan_of(spark, name)
    exchanges = re.findall(r"Exchange (\w+)", plan)
    assert not exchanges
    assert "BroadcastExchange" not in plan and "SortMergeJoin" not in plan


def test_only_the_engine_table_is_broadcast_explicitly():
    import inspect
    from webcorpus import operators
    import pkgutil, importlib
    hits = []
    for mod in pkgutil.iter_modules(operators.__path__):
        src = inspect.getsource(importlib.import_module(f"webcorpus.operators.{mod.name}"))
        hits += [mod.name for _ in re.findall(r"F\.broadcast\(", src)]
    assert hits == ["federate"]
