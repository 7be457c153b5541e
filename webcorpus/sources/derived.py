"""Derived views over the given tables (FIXTURES.md section 2).

Each view is one SQL text that Spark and DuckDB both run unchanged, so the operator
under test sees the same input on both sides. In Spark the base tables are passed as
DataFrame parameters (``spark.sql(text, pages=df)``): no global view names.

* ``url_list``      URL batch with scheme removed, blanks added and unknown hosts (SRC2)
* ``fetch_log``     request log per engine attempt, from ``events`` (SRC8); ts stays
                    wall-clock TIMESTAMP_NTZ (UTC) so reports do not depend on the session zone
* ``requests``      one search request per conversation, from its opening user turn, with
                    some invalid on purpose (empty, too long, 0 or 101 results, unknown type)
* ``engine_results`` ranked results per (query, engine) from documents x pages (SET1)
* ``link_edges``    page -> page edges (JON1); no stored link points to a stored page
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import tables

# --- fixed values -----------------------------------------------------------------
ENGINES = ("google", "duckduckgo", "bing", "yahoo")
ERROR_TEXTS = (
    "Blocked or captcha detected",
    "403 Forbidden",
    "429 too many requests",
    "Engine timed out after 30.0s",
    "No results found - selectors may be outdated or page layout changed",
    "No results found - Bing may have changed its layout or request was blocked",
    "All search strategies failed",
    None,
)
# ---------------------------------------------------------------------------------


def _sql_str(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_ENGINE_CASE = "CASE event_id % 4 " + " ".join(
    f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENGINES)) + " END"
_ERROR_CASE = "CASE event_id % 8 " + " ".join(
    f"WHEN {i} THEN {_sql_str(t)}" for i, t in enumerate(ERROR_TEXTS)) + " END"

VIEWS = {
    "url_list": """
SELECT CAST(page_id AS INT) AS ord,
       CASE WHEN page_id % 6 = 0 THEN '  ' || regexp_replace(url, '^https?://', '') || ' '
            WHEN page_id % 6 = 1 THEN regexp_replace(url, '^https?://', '')
            WHEN page_id % 6 = 2 THEN ' ' || url
            WHEN page_id % 6 = 5 THEN 'unknown' || CAST(page_id AS STRING) || '.example.org/missing'
            ELSE url END AS url
FROM {pages}""",
    "fetch_log": f"""
SELECT event_id AS request_id,
       ts,
       user_id AS query_id,
       {_ENGINE_CASE} AS engine,
       CASE event_id % 3 WHEN 0 THEN 'https' WHEN 1 THEN 'http' ELSE 'socks5' END AS protocol,
       (CASE event_id % 3 WHEN 0 THEN 'https' WHEN 1 THEN 'http' ELSE 'socks5' END) || '://proxy'
           || CAST(user_id % 50 AS STRING) || '.example.net:8080' AS proxy,
       CASE user_id % 3 WHEN 0 THEN 'list_a' WHEN 1 THEN 'list_b' ELSE 'manual' END AS proxy_source,
       CAST(event_id % 3 + 1 AS INT) AS attempt_no,
       event_type <> 'error' AS success,
       CAST(CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN 0 ELSE event_id % 10 + 1 END AS INT) AS n_results,
       CAST(CASE WHEN event_type <> 'error' THEN 200
                 WHEN event_id % 3 = 0 THEN 403 WHEN event_id % 3 = 1 THEN 429 ELSE 503 END AS INT) AS status_code,
       value AS response_time,
       CASE WHEN event_type <> 'error' AND event_id % 11 <> 0 THEN NULL ELSE {_ERROR_CASE} END AS error
FROM {{events}}""",
    "requests": """
SELECT CAST(conv_id AS BIGINT) AS query_id,
       CASE WHEN conv_id % 13 = 0 THEN ''
            WHEN conv_id % 17 = 0 THEN repeat(text, 6)
            WHEN conv_id % 4 = 0 THEN regexp_extract(trim(text), '^([^ ]+(?: +[^ ]+){{0,1}})', 1)
            WHEN conv_id % 4 = 1 THEN regexp_extract(trim(text), '^([^ ]+(?: +[^ ]+){{0,2}})', 1)
            WHEN conv_id % 4 = 2 THEN regexp_extract(trim(text), '^([^ ]+(?: +[^ ]+){{0,3}})', 1)
            ELSE regexp_extract(trim(text), '^([^ ]+(?: +[^ ]+){{0,4}})', 1) END AS query,
       CASE WHEN conv_id % 19 = 0 THEN 'maps'
            WHEN conv_id % 4 = 0 THEN 'all' WHEN conv_id % 4 = 1 THEN 'news'
            WHEN conv_id % 4 = 2 THEN 'images' ELSE 'videos' END AS search_type,
       CAST(CASE WHEN conv_id % 23 = 0 THEN 0 WHEN conv_id % 29 = 0 THEN 101 ELSE conv_id % 20 + 1 END AS INT) AS num_results,
       CASE WHEN conv_id % 3 = 0 THEN 'de' WHEN conv_id % 3 = 1 THEN 'en' ELSE 'fr' END AS language,
       CASE WHEN conv_id % 2 = 0 THEN 'us' ELSE 'gb' END AS country,
       CASE conv_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'moderate' ELSE 'strict' END AS safe_search
FROM {conversations}
WHERE turn = 0 AND role = 'user'""",
    "engine_results": """
SELECT r.query_id, r.engine, r.rank, r.type, r.title,
       CASE WHEN r.doc_id % 9 = 0 THEN NULL ELSE p.url END AS url,
       CASE WHEN r.type = 'images' THEN p.url || '/img.png' ELSE NULL END AS image_url,
       r.snippet
FROM (SELECT doc_id,
             CAST(floor(doc_id / 100) AS BIGINT) AS query_id,
             CASE doc_id % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'duckduckgo' WHEN 2 THEN 'bing' ELSE 'yahoo' END AS engine,
             CAST(floor((doc_id % 100) / 4) + 1 AS INT) AS rank,
             CASE WHEN doc_id % 37 = 0 THEN 'images' ELSE 'web' END AS type,
             regexp_extract(trim(text), '^([^ ]+(?: +[^ ]+){{0,5}})', 1) AS title,
             text AS snippet,
             (CAST(floor(doc_id / 100) AS BIGINT) * 3 + CAST(floor((doc_id % 100) / 4) AS BIGINT)) % (SELECT count(*) FROM {pages}) AS page_key
      FROM {documents}) r
JOIN {pages} p ON p.page_id = r.page_key""",
    "link_edges": """
SELECT src_id, CAST(k AS INT) AS pos, (src_id * (2 * k + 1) + k) % (SELECT count(*) FROM {pages}) AS dst_id
FROM (SELECT page_id AS src_id, 1 AS k FROM {pages}
      UNION ALL SELECT page_id AS src_id, 2 AS k FROM {pages}
      UNION ALL SELECT page_id AS src_id, 3 AS k FROM {pages}) s""",
}

BASES = {
    "url_list": ("pages",),
    "fetch_log": ("events",),
    "requests": ("conversations",),
    "engine_results": ("documents", "pages"),
    "link_edges": ("pages",),
}


def duck_sql(name: str) -> str:
    """The view's SQL with base tables named directly (the oracle's form)."""
    return VIEWS[name].format(**{b: b for b in BASES[name]})


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining the named views for an oracle query."""
    return "WITH " + ", ".join(f"{n} AS ({duck_sql(n)})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view as a Spark DataFrame."""
    keys = {"events": "event_id", "pages": "page_id", "documents": "doc_id", "conversations": "conv_id"}
    frames = {b: tables.spread(tables.read_table(spark, sf_dir, b, cast_ts=False), keys[b]) for b in BASES[name]}
    return spark.sql(VIEWS[name], **frames)
