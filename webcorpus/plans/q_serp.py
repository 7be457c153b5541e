"""Result-page extraction round trip (SRC3, EXT22, EXT26, FLT7-9, WIN6, DEDUP1, SCL8, SCL10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serp as SX
from ..sources import derived
from ..sources.serp_render import PAGE_SIZE, render_captures
from . import duck as D
from .catalog import register


def _captures(spark, sf_dir):
    return render_captures(derived.view(spark, sf_dir, "engine_results"))


T, S, U = D.clean("title"), D.clean("snippet"), D.clean("url")
SNIPPET = (f"CASE WHEN engine = 'bing' THEN CASE WHEN length({S}) > 20 AND {S} <> {T} THEN {S} "
           f"WHEN length({D.clean('snippet || url')}) > 20 AND {D.clean('snippet || url')} <> {T} "
           f"THEN {D.clean('snippet || url')} ELSE {S} END ELSE {S} END")


@register("serp_web_roundtrip", oracle=f"""
{derived.duck_cte('engine_results')},
r AS (SELECT query_id, engine, CAST(floor((rank - 1) / {PAGE_SIZE}) AS INT) AS page_no, rank, {T} AS title, url,
             {SNIPPET} AS snippet, CASE WHEN engine = 'duckduckgo' THEN NULL ELSE {U} END AS displayed_url
      FROM engine_results WHERE type = 'web' AND url IS NOT NULL),
k AS (SELECT * FROM r WHERE CASE WHEN engine = 'duckduckgo' THEN title <> '' ELSE length(title) >= 3 END
      -- container classes 4 and 5 of the first engine hold the letters "ad", which its advert rule drops
      AND NOT (engine = 'google' AND (query_id + page_no) % 11 IN (3, 4))),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, engine, page_no, url ORDER BY rank) AS dup FROM k)
SELECT query_id, engine, page_no,
       CAST(row_number() OVER (PARTITION BY query_id, engine, page_no ORDER BY rank) AS INT) AS pos,
       title, url, snippet, displayed_url
FROM d WHERE dup = 1 OR engine = 'duckduckgo'""")
def serp_web_roundtrip(spark, sf_dir):
    return SX.extract_results(_captures(spark, sf_dir))


@register("provider_searxng_roundtrip", oracle=f"""
{derived.duck_cte('engine_results')}
SELECT query_id, engine, CAST(floor((rank - 1) / 10) AS INT) AS page_no,
       CAST(row_number() OVER (PARTITION BY query_id, engine, CAST(floor((rank - 1) / 10) AS INT) ORDER BY rank) AS INT) AS pos,
       title, coalesce(url, '') AS url, snippet, coalesce(url, '') AS displayed_url, engine AS engine_sources
FROM engine_results""")
def provider_searxng_roundtrip(spark, sf_dir):
    from ..sources import providers as PV
    docs = PV.render_searxng(derived.view(spark, sf_dir, "engine_results"))
    out = docs.select("query_id", "engine", "page_no",
                      F.posexplode(PV.searxng_results(F.col("json"), 10)).alias("pos", "r"))
    return out.select("query_id", "engine", "page_no", (F.col("pos") + 1).cast("int").alias("pos"),
                      "r.title", "r.url", "r.snippet", "r.displayed_url",
                      F.array_join("r.engine_sources", ",").alias("engine_sources"))


@register("serp_news_roundtrip", oracle=f"""
{derived.duck_cte('engine_results')},
r AS (SELECT query_id, engine, CAST(floor((rank - 1) / {PAGE_SIZE}) AS INT) AS page_no, rank, {T} AS title, url,
             {S} AS snippet, {D.clean("coalesce(regexp_extract(url, '//([^/?#]+)', 1), '')")} AS source,
             {D.clean("CAST(rank AS VARCHAR) || ' hours ago'")} AS date
      FROM engine_results WHERE engine IN ('google', 'bing', 'yahoo') AND url IS NOT NULL)
SELECT query_id, engine, page_no,
       CAST(row_number() OVER (PARTITION BY query_id, engine, page_no ORDER BY rank) AS INT) AS pos,
       title, url, snippet, source, date, 'news' AS type
FROM r WHERE title <> ''""")
def serp_news_roundtrip(spark, sf_dir):
    from ..sources.serp_render import render_news_captures
    return SX.extract_news(render_news_captures(derived.view(spark, sf_dir, "engine_results")))


@register("serp_images_roundtrip", oracle=f"""
{derived.duck_cte('engine_results')}
SELECT query_id, engine, CAST(floor((rank - 1) / 10) AS INT) AS page_no,
       CAST(row_number() OVER (PARTITION BY query_id, engine, CAST(floor((rank - 1) / 10) AS INT) ORDER BY rank) AS INT) AS pos,
       coalesce(image_url, '') AS image_url, coalesce(title, '') AS title, coalesce(url, '') AS page_url
FROM engine_results WHERE engine = 'bing' AND type = 'images'""")
def serp_images_roundtrip(spark, sf_dir):
    from ..sources import providers as PV
    pages = PV.render_bing_images(derived.view(spark, sf_dir, "engine_results"))
    out = pages.select("query_id", "engine", "page_no", F.posexplode(PV.bing_image_results(F.col("html"))).alias("p", "r"))
    return out.select("query_id", "engine", "page_no", (F.col("p") + 1).cast("int").alias("pos"),
                      "r.image_url", "r.title", "r.page_url")
