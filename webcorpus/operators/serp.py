"""Result-page extraction as a DataFrame operator (SRC3, EXT22, EXT23, EXT26, FLT7-9,
WIN6, DEDUP1, SCL8-10).

Plan: the element interval index of each page is one column; the records of a page are
one projection over it (``functions.serp``), chosen by the page's engine. Pages are read
once, and nothing is exchanged: de-duplication, the choice of the container rule and
positions are local to a page.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import serp as SP
from ..functions.elements import element_index


@lru_cache
def _of_engine(jvm, of, engine: str) -> Column:
    """The records of one engine's pages; building the expression takes thousands of calls
    to the JVM, so each session does it once."""
    return of(F.col("html"), F.col("_index"), engine)


def _records(captures: DataFrame, engines, keys, of, kind: str) -> DataFrame:
    pages = captures.filter(F.col("engine").isin(*engines)).select(*keys, *({"engine"} - set(keys)), "html", element_index(F.col("html")).alias("_index"))
    records = F.array().cast(kind)
    for engine in engines:
        records = F.when(F.col("engine") == engine, _of_engine(SparkContext._active_spark_context._jvm, of, engine)).otherwise(records)
    return pages.select(*keys, F.posexplode(records).alias("_p", "_r")).withColumn("pos", (F.col("_p") + 1).cast("int"))


def extract_results(captures: DataFrame, keys=("query_id", "engine", "page_no")) -> DataFrame:
    """``captures(keys..., engine, html)`` -> one row per extracted result:
    ``(keys..., pos, title, url, snippet, displayed_url)``."""
    found = _records(captures, tuple(SP.RULES), list(keys), SP.web_records, SP.WEB_TYPE)
    return found.select(*keys, "pos", "_r.title", "_r.url", "_r.snippet", "_r.displayed_url")


def extract_news(captures: DataFrame, keys=("query_id", "engine", "page_no")) -> DataFrame:
    """EXT23: news records of Google, Bing and Yahoo result pages. Per container: the
    first link rule that finds an element; title from the heading (Google) or the link
    text (Bing: else ``a.title``; Yahoo: else the link's title attribute); URL
    unwrapped per engine and required to start with http; source, snippet and date
    from their first matching elements. Google keeps the first container rule that
    yields a record, Bing and Yahoo the first rule present on the page. No
    de-duplication (as in the original)."""
    found = _records(captures, tuple(SP.NEWS_RULES), list(keys), SP.news_records, SP.NEWS_TYPE)
    return found.select(*keys, "pos", "_r.title", "_r.url", "_r.snippet", "_r.source", "_r.date", F.lit("news").alias("type"))
