"""Page labels and request validation (FLT2-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as Q
from ..operators import batch as B
from ..sources import derived, tables
from . import duck as D
from .catalog import register


def _contains_any(expr, words):
    return "(" + " OR ".join(f"contains(lower({expr}), {D.q(w)})" for w in words) + ")"


def _challenge_sql(h: str, pattern: bool = False) -> str:
    parts = []
    for name, pats in Q.CHALLENGE_PATTERNS:
        for p in pats:
            parts.append(f"WHEN regexp_matches(lower({h}), {D.q(p)}) THEN {D.q(p if pattern else name)}")
    return "CASE " + " ".join(parts) + " END"


@register("block_pages", oracle=f"""
SELECT page_id,
       coalesce(html IS NULL OR length(html) < {Q.MIN_PAGE_CHARS} OR {_contains_any('html', Q.BLOCK_PHRASES)}, true) AS is_blocked,
       coalesce({_contains_any('html', Q.RESULTS_BLOCK_PHRASES)}, false) AS results_page_blocked,
       {_challenge_sql('html')} AS challenge_type,
       {_challenge_sql('html', True)} AS challenge_pattern
FROM pages""")
def block_pages(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    h = F.col("html")
    return p.select("page_id", Q.is_blocked_page(h).alias("is_blocked"),
                    Q.is_blocked_results_page(h).alias("results_page_blocked"),
                    Q.challenge_type(h).alias("challenge_type"),
                    Q.challenge_pattern(h).alias("challenge_pattern"))


@register("capture_accept", oracle=f"""
SELECT page_id, CAST(length(html) AS BIGINT) AS html_length,
       length(html) > {Q.HTTP_ACCEPT_MIN_CHARS} AND NOT coalesce(length(html) < {Q.MIN_PAGE_CHARS} OR {_contains_any('html', Q.BLOCK_PHRASES)}, true) AS accepted_http,
       length(html) > {Q.RENDERED_ACCEPT_MIN_CHARS} AND NOT coalesce(length(html) < {Q.MIN_PAGE_CHARS} OR {_contains_any('html', Q.BLOCK_PHRASES)}, true) AS accepted_rendered
FROM pages""")
def capture_accept(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    h = F.col("html")
    return p.select("page_id", F.length(h).cast("long").alias("html_length"),
                    Q.capture_accepted(F.lit(200), h, False).alias("accepted_http"),
                    Q.capture_accepted(F.lit(200), h, True).alias("accepted_rendered"))


@register("request_validate", oracle=f"""
{derived.duck_cte('requests')}
SELECT query_id,
       array_to_string(list_filter([
         CASE WHEN length(coalesce(query, '')) < 1 THEN 'query_empty' END,
         CASE WHEN length(coalesce(query, '')) > {B.QUERY_MAX_CHARS} THEN 'query_too_long' END,
         CASE WHEN NOT coalesce(num_results BETWEEN {B.NUM_RESULTS_RANGE[0]} AND {B.NUM_RESULTS_RANGE[1]}, false) THEN 'num_results_out_of_range' END
       ], lambda x: x IS NOT NULL), ',') AS reasons,
       len(list_filter([
         CASE WHEN length(coalesce(query, '')) < 1 THEN 'query_empty' END,
         CASE WHEN length(coalesce(query, '')) > {B.QUERY_MAX_CHARS} THEN 'query_too_long' END,
         CASE WHEN NOT coalesce(num_results BETWEEN {B.NUM_RESULTS_RANGE[0]} AND {B.NUM_RESULTS_RANGE[1]}, false) THEN 'num_results_out_of_range' END
       ], lambda x: x IS NOT NULL)) = 0 AS is_valid
FROM requests""")
def request_validate(spark, sf_dir):
    v = B.validate_requests(derived.view(spark, sf_dir, "requests"))
    return v.select("query_id", F.array_join("reasons", ",").alias("reasons"), "is_valid")


def _map_sql(col, table, default):
    return ("CASE " + " ".join(f"WHEN {col} = {D.q(k)} THEN {D.q(v)}" for k, v in table)
            + f" ELSE {D.q(default)} END")


@register("request_normalize", oracle=f"""
{derived.duck_cte('requests')}
SELECT query_id, country || '-' || language AS region,
       {_map_sql('safe_search', B.BING_SAFE, B.BING_SAFE_DEFAULT)} AS bing_safe_search,
       {_map_sql('safe_search', B.DUCKDUCKGO_SAFE, B.DUCKDUCKGO_SAFE_DEFAULT)} AS duckduckgo_safe_search
FROM requests""")
def request_normalize(spark, sf_dir):
    n = B.normalize_requests(derived.view(spark, sf_dir, "requests"))
    return n.select("query_id", "region", "bing_safe_search", "duckduckgo_safe_search")
