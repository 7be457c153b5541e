"""Stream-equals-batch queries (STR2-STR6).

Windowed streams run in append mode: a window is emitted once the watermark (latest
event time minus the allowed delay) has passed its end, so the oracle of a windowed
stream is the batch result restricted to windows that end at or before
``max(ts) - delay``; windows still open when the input ends are not emitted."""

from __future__ import annotations

from ..sources import derived
from ..streaming import service as ST
from .catalog import ORACLES, register
from .q_service import HEALTH_SQL, normalized_cte


@register("source_health_stream", oracle=f"{HEALTH_SQL} SELECT * FROM hs")
def source_health_stream(spark, sf_dir):
    return ST.run_health(ST.fetch_log_stream(spark, sf_dir))


@register("stream_page_overview")
def stream_page_overview(spark, sf_dir):
    return ST.run_to_table(ST.page_overview_stream(spark, sf_dir), "pages")


@register("stream_first_seen", oracle=f"{derived.duck_cte('fetch_log')} SELECT DISTINCT proxy FROM fetch_log")
def stream_first_seen(spark, sf_dir):
    return ST.run_to_table(ST.first_seen_stream(ST.fetch_log_stream(spark, sf_dir)), "first_seen")


@register("stream_service_levels", oracle=f"""
{normalized_cte()}, b AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS wstart FROM n)
SELECT '1h' AS window_kind, strftime(wstart, '%Y-%m-%d %H:%M:%S') AS window_start, engine,
       count(*) AS requests, count(*) FILTER (WHERE success) AS successes,
       round(count(*) FILTER (WHERE success) / count(*), 6) AS success_rate
FROM b WHERE wstart + INTERVAL '1 hour' <= (SELECT max(ts) FROM fetch_log) - INTERVAL '1 hour'
GROUP BY wstart, engine""")
def stream_service_levels(spark, sf_dir):
    return ST.run_to_table(ST.service_levels_stream(ST.fetch_log_stream(spark, sf_dir)), "service_levels")


@register("stream_rate_per_minute", oracle=f"""
{derived.duck_cte('fetch_log')}
SELECT engine, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS requests,
       count(*) > 120 AS over_limit
FROM fetch_log GROUP BY ALL
HAVING date_trunc('minute', ts) + INTERVAL '1 minute' <= (SELECT max(ts) FROM fetch_log) - INTERVAL '10 minutes'""")
def stream_rate_per_minute(spark, sf_dir):
    return ST.run_to_table(ST.rate_stream(ST.fetch_log_stream(spark, sf_dir)), "rate")


CLOSED = "(SELECT max(ts) FROM fetch_log) - INTERVAL '1 hour'"  # windows that end by then are emitted
KINDS = (("1h", 3600, 3600), ("24h", 86400, 3600), ("7d", 604800, 86400))
WINDOWS = " UNION ALL ".join(
    f"SELECT engine, success, '{name}' AS window_kind, {size} AS size, CAST(floor(floor(epoch(ts)) / {slide}) * {slide} - k * {slide} AS BIGINT) AS st FROM n, range(0, {size // slide}) AS r(k)" for name, size, slide in KINDS)


@register("stream_success_levels", oracle=f"""
{normalized_cte()}, w AS ({WINDOWS}),
g AS (SELECT window_kind, st, engine, count(*) AS requests, count(*) FILTER (WHERE success) AS successes
      FROM w WHERE make_timestamp((st + size) * 1000000) <= {CLOSED} GROUP BY GROUPING SETS ((window_kind, st, engine), (window_kind, st)))
SELECT window_kind, strftime(make_timestamp(st * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, coalesce(engine, 'all') AS engine, requests, successes,
       round(successes / requests, 6) AS success_rate FROM g""")
def stream_success_levels(spark, sf_dir):
    parts = [ST.run_to_table(ST.success_levels_stream(ST.fetch_log_stream(spark, sf_dir), kind), f"success-{kind}") for kind, _, _ in KINDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DAY = "date_trunc('day', ts)"
DAY_TEXT = "strftime(day, '%Y-%m-%d %H:%M:%S') AS day"
DAY_CLOSED = f"day + INTERVAL '1 day' <= {CLOSED}"
LIMITS = "CASE error_type WHEN 'captcha_detected' THEN 0.05 WHEN 'blocked' THEN 0.05 WHEN 'rate_limited' THEN 0.02 WHEN 'timeout' THEN 0.01 WHEN 'selector_mismatch' THEN 0.1 END::DOUBLE"


@register("stream_error_mix", oracle=f"""
{normalized_cte()}, d AS (SELECT *, {DAY} AS day FROM n), tot AS (SELECT day, engine, count(*) AS requests FROM d GROUP BY 1, 2),
e AS (SELECT day, engine, error_type, count(*) AS errors FROM d WHERE NOT success GROUP BY 1, 2, 3)
SELECT {DAY_TEXT.replace('(day', '(e.day')}, e.engine, error_type, errors, requests, round(errors / requests, 6) AS share, {LIMITS} AS "limit", coalesce(errors / requests > {LIMITS}, false) AS over_limit
FROM e JOIN tot ON e.day = tot.day AND e.engine = tot.engine WHERE e.{DAY_CLOSED}""")
def stream_error_mix(spark, sf_dir):
    return ST.run_to_table(ST.error_mix_stream(ST.fetch_log_stream(spark, sf_dir)), "error-mix")


@register("stream_fallback_rate", oracle=f"""
{normalized_cte()}, q AS (SELECT {DAY} AS day, query_id, min(p) AS first, min(p) FILTER (WHERE success) AS won
      FROM (SELECT *, CASE engine WHEN 'google' THEN 1 WHEN 'duckduckgo' THEN 2 WHEN 'bing' THEN 3 WHEN 'yahoo' THEN 4 END AS p FROM n) GROUP BY 1, 2),
g AS (SELECT day, count(*) AS queries, count(*) FILTER (WHERE won > first) AS fallbacks, count(*) FILTER (WHERE won IS NULL) AS unanswered FROM q GROUP BY 1)
SELECT {DAY_TEXT}, queries, fallbacks, unanswered, round(fallbacks / queries, 6) AS fallback_rate FROM g WHERE {DAY_CLOSED}""")
def stream_fallback_rate(spark, sf_dir):
    return ST.run_to_table(ST.fallback_rate_stream(ST.fetch_log_stream(spark, sf_dir)), "fallback")


# below 10,000 values a day and engine the sketch is exact: the smallest value with 95 % of the others at or below it
@register("stream_latency", oracle=f"""
{derived.duck_cte('fetch_log')}, g AS (SELECT {DAY} AS day, engine, count(*) AS requests, avg(response_time) AS a, quantile_disc(response_time, 0.95) AS p FROM fetch_log GROUP BY 1, 2)
SELECT {DAY_TEXT}, engine, requests, round(a, 6) AS avg_response_time, round(p, 6) AS p95_response_time FROM g WHERE {DAY_CLOSED}""")
def stream_latency(spark, sf_dir):
    return ST.run_to_table(ST.latency_stream(ST.fetch_log_stream(spark, sf_dir)), "latency")


def _late_bind():
    from . import q_pages  # noqa: F401  (registers page_overview and its oracle first)
    if "page_overview" in ORACLES:
        ORACLES["stream_page_overview"] = ORACLES["page_overview"]


_late_bind()
