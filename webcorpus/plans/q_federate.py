"""Multi-engine queries (WIN1-7, DEDUP2, SET1, AGG1, AGG3-4, JON5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as BA
from ..operators import federate as FE
from ..sources import derived
from . import duck as D
from .catalog import register
from .q_service import etype_sql

CFG = ("cfg(engine, engine_no, page_size, page_cap, stop_below) AS (VALUES "
       + ", ".join(f"('{e}', {n}, {s}, {c}, {t})" for e, n, s, c, t in FE.ENGINE_CONFIG) + ")")
DAY = "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')"


def _attempts(spark, sf_dir):
    log = derived.view(spark, sf_dir, "fetch_log")
    log = log.withColumn("day", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss"))
    return FE.with_engine_config(log, spark)


FALLBACK_SQL = f"""
{derived.duck_cte('fetch_log')}, {CFG},
a AS (SELECT l.*, {DAY} AS day, c.engine_no, success AND coalesce(n_results, 0) > 0 AS usable
      FROM fetch_log l JOIN cfg c ON lower(l.engine) = c.engine),
g AS (SELECT query_id, day,
             arg_min({{'engine': engine, 'n': n_results}}, (engine_no, ts, request_id)) FILTER (WHERE usable) AS win,
             arg_max({{'error': error}}, (engine_no, ts, request_id)) AS last
      FROM a GROUP BY 1, 2),
r AS (SELECT query_id, day, win IS NOT NULL AS success,
             CASE WHEN win IS NOT NULL THEN win.engine ELSE 'none' END AS engine,
             CAST(CASE WHEN win IS NOT NULL THEN win.n ELSE 0 END AS INT) AS n_results,
             CASE WHEN win IS NULL THEN coalesce(last.error, {D.q(FE.NO_RESULTS_ERROR)}) END AS error
      FROM g)"""


@register("fallback_first_success", oracle=f"""{FALLBACK_SQL}
SELECT *, CASE WHEN NOT success THEN {etype_sql('error', '0')} END AS error_type FROM r""")
def fallback_first_success(spark, sf_dir):
    return FE.priority_fallback(_attempts(spark, sf_dir), ["query_id", "day"])


@register("batch_summary", oracle=f"""{FALLBACK_SQL}
SELECT count(*) AS total_queries, count(*) FILTER (WHERE success) AS successful_queries,
       count(*) FILTER (WHERE NOT success) AS failed_queries, count(*) FILTER (WHERE success) > 0 AS success FROM r""")
def batch_summary(spark, sf_dir):
    return FE.batch_summary(FE.priority_fallback(_attempts(spark, sf_dir), ["query_id", "day"]))


MERGE_SQL = f"""
{derived.duck_cte('engine_results')}, {CFG},
m AS (SELECT query_id, url, min({{'engine_no': c.engine_no, 'rank': rank, 'engine': r.engine, 'title': title,
                                  'snippet': snippet}}) AS b
      FROM engine_results r JOIN cfg c ON lower(r.engine) = c.engine
      WHERE url IS NOT NULL AND url <> '' GROUP BY 1, 2)"""


@register("merge_all_engines", oracle=f"""{MERGE_SQL}
SELECT query_id, url, b.engine AS engine, b.engine_no AS engine_no, b.rank AS rank, b.title AS title FROM m""")
def merge_all_engines(spark, sf_dir):
    return FE.merge_results(derived.view(spark, sf_dir, "engine_results"), spark)


@register("merge_summary", oracle=f"""{MERGE_SQL},
pe AS (SELECT query_id, r.engine, count(*) AS n FROM engine_results r JOIN cfg c ON lower(r.engine) = c.engine GROUP BY 1, 2),
s AS (SELECT query_id, count(*) FILTER (WHERE n > 0) AS engines_succeeded, sum(n) AS results_all_engines FROM pe GROUP BY 1),
t AS (SELECT query_id, count(*) AS total_results FROM m GROUP BY 1)
SELECT s.query_id, engines_succeeded, {FE.N_SEARCH_ENGINES} - engines_succeeded AS engines_failed,
       CAST(results_all_engines AS BIGINT) AS results_all_engines,
       CAST(coalesce(total_results, 0) AS BIGINT) AS total_results, engines_succeeded > 0 AS success
FROM s LEFT JOIN t USING (query_id)""")
def merge_summary(spark, sf_dir):
    return FE.merge_summary(derived.view(spark, sf_dir, "engine_results"), spark)


@register("pagination_cut", oracle=f"""
{derived.duck_cte('engine_results')}, {CFG},
p AS (SELECT query_id, r.engine, c.page_size, c.page_cap, c.stop_below,
             CAST(floor((rank - 1) / c.page_size) AS INT) AS page_no, count(*) AS n_rows
      FROM engine_results r JOIN cfg c ON lower(r.engine) = c.engine WHERE url IS NOT NULL
      GROUP BY ALL),
q AS (SELECT *, coalesce(sum(CAST(n_rows < stop_below AS INT)) OVER (PARTITION BY query_id, engine ORDER BY page_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS short_before,
             row_number() OVER (PARTITION BY query_id, engine ORDER BY page_no) - 1 AS present_before
      FROM p WHERE page_no < least(ceil(100 / page_size), page_cap))
SELECT query_id, engine, page_no, CAST(n_rows AS BIGINT) AS n_rows FROM q
WHERE short_before = 0 AND present_before = page_no""")
def pagination_cut(spark, sf_dir):
    return FE.pagination_cut(derived.view(spark, sf_dir, "engine_results"), spark, num_results=100)


@register("result_limit", oracle=f"""
{derived.duck_cte('engine_results', 'requests')},
r AS (SELECT e.query_id, e.engine, e.rank, e.url, q.num_results,
             row_number() OVER (PARTITION BY e.query_id, e.engine ORDER BY e.rank, e.url) AS pos
      FROM engine_results e JOIN requests q ON q.query_id = e.query_id
      WHERE e.url IS NOT NULL AND length(coalesce(q.query, '')) BETWEEN 1 AND 500 AND coalesce(q.num_results BETWEEN 1 AND 100, false))
SELECT query_id, engine, rank, url, CAST(pos AS INT) AS pos FROM r WHERE pos <= num_results""")
def result_limit(spark, sf_dir):
    valid, _ = BA.split_valid(derived.view(spark, sf_dir, "requests"))  # an invalid request is rejected, not clipped
    return FE.limit_per_query(derived.view(spark, sf_dir, "engine_results"), valid)


@register("query_envelopes", oracle=f"""{MERGE_SQL},
t AS (SELECT query_id, count(*) AS total_results, sha256(string_agg(url, '|' ORDER BY b.engine_no, b.rank, url)) AS urls_sha256 FROM m GROUP BY 1),
pe AS (SELECT query_id, r.engine, count(*) AS n FROM engine_results r JOIN cfg c ON lower(r.engine) = c.engine GROUP BY 1, 2),
s AS (SELECT query_id, count(*) AS engines_succeeded, 4 - count(*) AS engines_failed, sum(n) AS listed FROM pe GROUP BY 1)
SELECT s.query_id, engines_succeeded, engines_failed, CAST(listed AS BIGINT) AS listed, CAST(coalesce(total_results, 0) AS INT) AS total_results,
       coalesce(urls_sha256, sha256('')) AS urls_sha256, true AS success, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS error_type
FROM s LEFT JOIN t USING (query_id)""")
def query_envelopes(spark, sf_dir):
    results = derived.view(spark, sf_dir, "engine_results")
    names = F.array(*[F.lit(n) for n, no, *_ in FE.ENGINE_CONFIG if no != FE.ALTERNATIVE_NO])
    tried = results.select("query_id").distinct().select("query_id", F.explode(names).alias("engine"), F.lit(None).cast("string").alias("error"))
    env = FE.query_envelopes(results, spark, attempts=tried)
    return env.select("query_id", "engines_succeeded", "engines_failed",
                      F.aggregate(F.map_values("engines"), F.lit(0).cast("long"), lambda s, x: s + F.size(x)).alias("listed"), "total_results",
                      F.sha2(F.array_join(F.transform("all_results", lambda x: x["url"]), "|"), 256).alias("urls_sha256"),
                      "success", "error", "error_type")
