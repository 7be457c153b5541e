"""Request-log reports (CLS1-3, AGG3, AGG5-11, STR2 batch, STR6) on the derived
``fetch_log`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as Q
from ..operators import service as S
from ..sources import derived
from . import duck as D
from .catalog import register


def _log(spark, sf_dir):
    return derived.view(spark, sf_dir, "fetch_log")


def _any(expr, words):
    return "(" + " OR ".join(f"contains(lower({expr}), {D.q(w)})" for w in words) + ")"


def etype_sql(err: str, n: str) -> str:
    parts = [f"WHEN {_any(err, words)} THEN {D.q(name)}" for name, words, _ in Q.ERROR_RULES]
    return (f"CASE {' '.join(parts)} WHEN coalesce({n}, 0) = 0 THEN {D.q(Q.NO_RESULTS[0])} "
            f"ELSE {D.q(Q.UNKNOWN[0])} END")


def emsg_sql(err: str, n: str) -> str:
    parts = [f"WHEN {_any(err, words)} THEN {err if msg is None else D.q(msg)}" for _, words, msg in Q.ERROR_RULES]
    return (f"CASE {' '.join(parts)} WHEN coalesce({n}, 0) = 0 THEN {D.q(Q.NO_RESULTS[1])} "
            f"ELSE coalesce({err}, {D.q(Q.UNKNOWN[1])}) END")


def normalized_cte(timeout: bool = True) -> str:
    t = Q.DEFAULT_ENGINE_TIMEOUT
    if timeout:
        late = f"response_time > {t}"
        t_sql = (f"t AS (SELECT * REPLACE (CASE WHEN {late} THEN false ELSE success END AS success, "
                 f"CASE WHEN {late} THEN 0 ELSE n_results END AS n_results, "
                 f"CASE WHEN {late} THEN {D.q(f'Engine timed out after {t}s')} ELSE error END AS error) FROM fetch_log)")
    else:
        t_sql = "t AS (SELECT * FROM fetch_log)"
    ok = "(coalesce(success, false) AND coalesce(n_results, 0) > 0)"
    return (f"{derived.duck_cte('fetch_log')}, {t_sql}, "
            f"n AS (SELECT * REPLACE ({ok} AS success), "
            f"CASE WHEN NOT {ok} THEN {etype_sql('error', 'n_results')} END AS error_type, "
            f"CASE WHEN NOT {ok} THEN {emsg_sql('error', 'n_results')} END AS error_message FROM t)")


@register("error_classify", oracle=f"""
{normalized_cte()}
SELECT request_id, engine, success, CAST(n_results AS INT) AS n_results, error, error_type, error_message FROM n""")
def error_classify(spark, sf_dir):
    return S.normalized(_log(spark, sf_dir)).select(
        "request_id", "engine", "success", F.col("n_results").cast("int").alias("n_results"),
        "error", "error_type", "error_message")


@register("engine_outcomes", oracle=f"""
{normalized_cte(False)},
pe AS (SELECT query_id, engine, max(CAST(success AS INT)) AS ok FROM n GROUP BY 1, 2)
SELECT query_id, CAST(sum(ok) AS BIGINT) AS engines_succeeded, CAST(count(*) - sum(ok) AS BIGINT) AS engines_failed,
       sum(ok) > 0 AS success
FROM pe GROUP BY 1""")
def engine_outcomes(spark, sf_dir):
    return S.engine_outcomes(_log(spark, sf_dir))


HEALTH_SQL = f"""
{derived.duck_cte('fetch_log')},
e AS (SELECT proxy, ts, request_id, success, response_time, CASE WHEN success THEN -1 ELSE 1 END AS d FROM fetch_log),
r1 AS (SELECT *, sum(d) OVER (PARTITION BY proxy ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS s,
              count(*) FILTER (WHERE success) OVER (PARTITION BY proxy ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS succ,
              last_value(CASE WHEN success AND response_time > 0 THEN response_time END IGNORE NULLS)
                OVER (PARTITION BY proxy ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS rt,
              row_number() OVER (PARTITION BY proxy ORDER BY ts DESC, request_id DESC) AS rn_desc FROM e),
r2 AS (SELECT *, min(s) OVER (PARTITION BY proxy ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS m FROM r1),
h AS (SELECT proxy, CAST(s - least(0, m) AS BIGINT) AS failures, CAST(succ AS BIGINT) AS successes,
             success OR (s - least(0, m)) < {S.MAX_FAILURES} AS is_working, coalesce(rt, 0.0) AS response_time
      FROM r2 WHERE rn_desc = 1),
hs AS (SELECT *, round(CASE WHEN successes + failures = 0 THEN 0.5
                  ELSE successes / (successes + failures) * 0.7
                       + (CASE WHEN response_time > 0 THEN greatest(0.0, 1 - response_time / 10) ELSE 0.5 END) * 0.3 END, 6)
              AS score FROM h)"""


@register("source_health", oracle=f"{HEALTH_SQL} SELECT * FROM hs")
def source_health(spark, sf_dir):
    return S.source_health(_log(spark, sf_dir))


@register("source_scorecard", oracle=f"""{HEALTH_SQL},
src AS (SELECT DISTINCT proxy, protocol, proxy_source FROM fetch_log),
g AS (SELECT protocol, proxy_source, count(*) AS total, count(*) FILTER (WHERE is_working) AS working,
             count(*) FILTER (WHERE NOT is_working) AS failed
      FROM hs JOIN src USING (proxy) GROUP BY GROUPING SETS ((protocol), (proxy_source), ()))
SELECT CASE WHEN protocol IS NOT NULL THEN 'protocol' WHEN proxy_source IS NOT NULL THEN 'source' ELSE 'all' END AS dimension,
       coalesce(protocol, proxy_source, 'all') AS value, total, working, failed FROM g""")
def source_scorecard(spark, sf_dir):
    log = _log(spark, sf_dir)
    return S.source_scorecard(S.source_health(log), log.select("proxy", "protocol", "proxy_source").distinct())


@register("source_top5", oracle=f"""{HEALTH_SQL}
SELECT proxy, score, round(response_time, 2) AS response_time FROM hs WHERE is_working
ORDER BY score DESC, proxy LIMIT 5""")
def source_top5(spark, sf_dir):
    return S.top_sources(S.source_health(_log(spark, sf_dir)), 5)


def _window_sql():
    parts = []
    for name, size, slide in S.WINDOW_KINDS:
        n = size // slide
        parts.append(f"SELECT engine, success, {D.q(name)} AS window_kind, "
                     f"CAST(floor(floor(epoch(ts)) / {slide}) * {slide} - k * {slide} AS BIGINT) AS st "
                     f"FROM n, range(0, {n}) AS r(k)")
    return " UNION ALL ".join(parts)


@register("slo_success_rate", oracle=f"""
{normalized_cte()}, w AS ({_window_sql()}),
g AS (SELECT window_kind, st, engine, count(*) AS requests, count(*) FILTER (WHERE success) AS successes
      FROM w GROUP BY GROUPING SETS ((window_kind, st, engine), (window_kind, st)))
SELECT window_kind, strftime(make_timestamp(st * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
       coalesce(engine, 'all') AS engine, requests, successes, round(successes / requests, 6) AS success_rate FROM g""")
def slo_success_rate(spark, sf_dir):
    return S.success_rates(_log(spark, sf_dir))


DAY = "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')"


@register("slo_error_mix", oracle=f"""
{normalized_cte()}, d AS (SELECT *, {DAY} AS day FROM n),
tot AS (SELECT day, engine, count(*) AS requests FROM d GROUP BY 1, 2),
er AS (SELECT day, engine, error_type, count(*) AS n FROM d WHERE NOT success GROUP BY 1, 2, 3)
SELECT er.day, er.engine, error_type, er.n AS errors, requests, round(er.n / requests, 6) AS share,
       CASE {' '.join(f"WHEN error_type = {D.q(k)} THEN {v}" for k, v in S.ERROR_LIMITS)} END::DOUBLE AS "limit",
       coalesce(er.n / requests > CASE {' '.join(f"WHEN error_type = {D.q(k)} THEN {v}" for k, v in S.ERROR_LIMITS)} END, false) AS over_limit
FROM er JOIN tot USING (day, engine)""")
def slo_error_mix(spark, sf_dir):
    return S.error_mix(_log(spark, sf_dir))


@register("slo_latency_p95", oracle=f"""
{derived.duck_cte('fetch_log')}
SELECT {DAY} AS day, engine, count(*) AS requests, round(avg(response_time), 6) AS avg_response_time,
       round(quantile_cont(response_time, 0.95), 6) AS p95_response_time
FROM fetch_log GROUP BY 1, 2""")
def slo_latency_p95(spark, sf_dir):
    return S.latency(_log(spark, sf_dir))


PRIO = "CASE engine " + " ".join(f"WHEN {D.q(e)} THEN {i + 1}" for i, e in enumerate(S.ENGINE_PRIORITY)) + " END"
FALLBACK_SQL = f"""
pq AS (SELECT {DAY} AS day, query_id, min({PRIO}) AS first_prio, min(CASE WHEN success THEN {PRIO} END) AS win_prio
       FROM n GROUP BY 1, 2),
fb AS (SELECT day, count(*) AS queries, count(*) FILTER (WHERE win_prio > first_prio) AS fallbacks,
              count(*) FILTER (WHERE win_prio IS NULL) AS unanswered FROM pq GROUP BY 1)"""


@register("slo_fallback_rate", oracle=f"""
{normalized_cte()}, {FALLBACK_SQL}
SELECT day, queries, fallbacks, unanswered, round(fallbacks / queries, 6) AS fallback_rate FROM fb""")
def slo_fallback_rate(spark, sf_dir):
    return S.fallback_rate(_log(spark, sf_dir))


OUTAGE_SQL = f"""
o AS (SELECT engine, ts, success, count(*) FILTER (WHERE success) OVER (PARTITION BY engine ORDER BY ts, request_id) AS run FROM n),
down AS (SELECT engine, min(ts) AS first_bad, max(ts) AS last_bad, count(*) AS failures FROM o WHERE NOT success GROUP BY engine, run
         HAVING epoch_us(max(ts)) - epoch_us(min(ts)) > 60000000)"""


@register("slo_outages", oracle=f"""
{normalized_cte()}, {OUTAGE_SQL}
SELECT engine, strftime(first_bad, '%Y-%m-%d %H:%M:%S') AS outage_start, strftime(last_bad, '%Y-%m-%d %H:%M:%S') AS outage_end, failures,
       round((epoch_us(last_bad) - epoch_us(first_bad)) / 1e6, 6) AS seconds FROM down""")
def slo_outages(spark, sf_dir):
    found = S.outages(_log(spark, sf_dir))
    return found.select("engine", F.date_format("start", S.TS_FMT).alias("outage_start"), F.date_format("end", S.TS_FMT).alias("outage_end"), "failures", "seconds")


@register("slo_alerts", oracle=f"""
{normalized_cte()}, {OUTAGE_SQL}, d AS (SELECT *, {DAY} AS day FROM n), {FALLBACK_SQL},
pe AS (SELECT day, engine, count(*) FILTER (WHERE success) / count(*) AS v FROM d GROUP BY 1, 2),
ov AS (SELECT day, count(*) FILTER (WHERE NOT success) / count(*) AS err,
              count(*) FILTER (WHERE error_type = 'selector_mismatch') / count(*) AS sel FROM d GROUP BY 1),
lat AS (SELECT day, quantile_cont(response_time, 0.95) AS p95 FROM d GROUP BY 1),
a AS (
  SELECT day, 'success_rate_' || engine AS alert,
         CASE WHEN v < {S.SUCCESS_CRITICAL} THEN 'critical' WHEN v < {S.SUCCESS_WARNING} THEN 'warning' END AS level, v FROM pe
  UNION ALL SELECT day, 'error_rate', CASE WHEN err > {S.ERROR_CRITICAL} THEN 'critical' WHEN err > {S.ERROR_WARNING} THEN 'warning' END, err FROM ov
  UNION ALL SELECT day, 'selector_mismatch', CASE WHEN sel > {S.SELECTOR_WARNING} THEN 'warning' END, sel FROM ov
  UNION ALL SELECT day, 'p95_response_time', CASE WHEN p95 > {S.P95_CRITICAL_SECONDS} THEN 'critical' END, p95 FROM lat
  UNION ALL SELECT day, 'fallback_rate', CASE WHEN round(fallbacks / queries, 6) > {S.FALLBACK_WARNING} THEN 'warning' END,
                   round(fallbacks / queries, 6) FROM fb
  UNION ALL SELECT strftime(date_trunc('day', first_bad), '%Y-%m-%d %H:%M:%S'), 'down', 'critical', max((epoch_us(last_bad) - epoch_us(first_bad)) / 1e6) FROM down GROUP BY 1)
SELECT day, alert, level, round(v, 6) AS value FROM a WHERE level IS NOT NULL""")
def slo_alerts(spark, sf_dir):
    return S.alerts(_log(spark, sf_dir))


@register("rate_per_minute", oracle=f"""
{derived.duck_cte('fetch_log')},
pm AS (SELECT engine, date_trunc('minute', ts) AS minute, count(*) AS n FROM fetch_log GROUP BY 1, 2)
SELECT engine, max(n) AS max_per_minute,
       strftime(arg_min(minute, (-n, minute)), '%Y-%m-%d %H:%M:%S') AS busiest_minute,
       count(*) FILTER (WHERE n > {S.SEARCH_LIMIT_PER_MINUTE}) AS minutes_over_limit,
       count(*) AS active_minutes
FROM pm GROUP BY 1""")
def rate_per_minute(spark, sf_dir):
    return S.rate_per_minute(_log(spark, sf_dir))
