"""Multi-engine operators: priority fallback (WIN1-4), merge and de-duplication across
engines (SET1, DEDUP2, AGG3-4), pagination cut-off (WIN5, SCL11), result limits
(WIN7) and the engine configuration lookup (JON5).

Scale: de-duplication is an aggregate on (query, url) -- the key carries the URL, so
a hot query spreads over many reducers; the merged order is carried as
``(engine_no, rank)`` instead of a dense position, so no window sorts a whole query.
Fallback picks the winner per request with ``min_by`` aggregates (partial
aggregation map side) instead of a sort per request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality as Q

# --- fixed values -----------------------------------------------------------------
# engine, priority, results per page, page cap, stop when a page has fewer rows than
ENGINE_CONFIG = (
    ("google", 1, 10, 5, 3),
    ("duckduckgo", 2, 30, 3, 5),
    ("bing", 3, 10, 5, 5),
    ("yahoo", 4, 10, 5, 5),
    ("alternative", 5, 10, 1, 1),  # WIN2: tried last, only when every listed engine failed
)
NO_RESULTS_ERROR = "No results"
ALTERNATIVE_NO = 5
N_SEARCH_ENGINES = 4  # google, duckduckgo, bing, yahoo: the all-engines search
# ---------------------------------------------------------------------------------


def engine_config(spark: SparkSession) -> DataFrame:
    """JON5: the engine table (5 fixed rows, so broadcasting it is always safe)."""
    return F.broadcast(spark.createDataFrame(
        list(ENGINE_CONFIG), "engine string, engine_no int, page_size int, page_cap int, stop_below int"))


def with_engine_config(df: DataFrame, spark: SparkSession) -> DataFrame:
    """JON5: attach engine settings; unknown engines are skipped (inner join). Names
    match case-insensitively (the original skips ``Google`` at dispatch)."""
    cfg = engine_config(spark).withColumnRenamed("engine", "_cfg_engine")
    return df.join(cfg, F.lower(df["engine"]) == cfg["_cfg_engine"]).drop("_cfg_engine")


def priority_fallback(attempts: DataFrame, request_keys, enable_fallback: bool = True) -> DataFrame:
    """WIN1 + WIN3 + CLS2: per request, walk engines by priority (and attempts by time
    within an engine); the first attempt with success and results answers. Otherwise
    the request fails with the error of the last attempt tried (``No results`` when it
    gave none). With ``enable_fallback=False`` only the first engine is consulted.

    ``attempts`` needs: request keys, engine_no, ts, request_id, success, n_results,
    error, engine."""
    keys = list(request_keys)
    order = F.struct("engine_no", "ts", "request_id")
    a = attempts.withColumn("_usable", F.col("success") & (F.coalesce(F.col("n_results"), F.lit(0)) > 0))
    if not enable_fallback:
        # only the first engine tried, but the alternative provider still comes last (WIN2)
        alt = F.col("engine_no") == ALTERNATIVE_NO
        first = a.filter(~alt).groupBy(*keys).agg(F.min("engine_no").alias("_first"))
        a = a.join(first, keys, "left").filter((F.col("engine_no") == F.col("_first")) | alt).drop("_first")
    g = a.groupBy(*keys).agg(
        F.min_by(F.struct("engine", "n_results"), F.when(F.col("_usable"), order)).alias("win"),
        F.max_by(F.struct("engine", "error", "n_results"), order).alias("last"))
    ok = F.col("win").isNotNull() & F.col("win.engine").isNotNull()
    err = F.coalesce(F.col("last.error"), F.lit(NO_RESULTS_ERROR))
    return g.select(
        *keys,
        ok.alias("success"),
        F.when(ok, F.col("win.engine")).otherwise(F.lit("none")).alias("engine"),
        F.when(ok, F.col("win.n_results")).otherwise(F.lit(0)).cast("int").alias("n_results"),
        F.when(~ok, err).alias("error"),
        F.when(~ok, Q.error_type(err, F.lit(0))).alias("error_type"))


def batch_summary(responses: DataFrame) -> DataFrame:
    """AGG1: total / successful / failed queries; the batch succeeds if any did."""
    return responses.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if("success").alias("successful_queries"),
        F.count_if(~F.col("success")).alias("failed_queries")).withColumn(
        "success", F.col("successful_queries") > 0)


def merge_results(results: DataFrame, spark: SparkSession, key: str = "url") -> DataFrame:
    """SET1 + DEDUP2: union of every engine's results, rows without ``key`` dropped
    (so image results vanish with the default key), first occurrence per (query, key)
    in engine order, then rank. Output carries ``engine`` (the original ``_engine``)
    and the order columns ``engine_no``, ``rank``."""
    r = with_engine_config(results, spark).filter(F.col(key).isNotNull() & (F.col(key) != ""))
    best = F.struct("engine_no", "rank", "engine", "title", "snippet")
    return (r.groupBy("query_id", key).agg(F.min(best).alias("b"))
            .select("query_id", key, "b.engine", "b.engine_no", "b.rank", "b.title"))


def merge_summary(results: DataFrame, spark: SparkSession) -> DataFrame:
    """AGG3 + AGG4 over result lists: per query, engines with results, engines without,
    results per engine and merged distinct count."""
    per_engine = (with_engine_config(results, spark).groupBy("query_id", "engine")
                  .agg(F.count(F.lit(1)).alias("n")))
    merged = merge_results(results, spark).groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    n_engines = N_SEARCH_ENGINES
    summary = per_engine.groupBy("query_id").agg(
        F.count_if(F.col("n") > 0).alias("engines_succeeded"),
        F.sum("n").alias("results_all_engines"))
    return (summary.join(merged, "query_id", "left")
            .select("query_id", "engines_succeeded",
                    (F.lit(n_engines) - F.col("engines_succeeded")).alias("engines_failed"),
                    F.col("results_all_engines").cast("long").alias("results_all_engines"),
                    F.coalesce("total_results", F.lit(0)).cast("long").alias("total_results"),
                    (F.col("engines_succeeded") > 0).alias("success")))


def pagination_cut(results: DataFrame, spark: SparkSession, num_results: int = 100,
                   fast_mode: bool = False) -> DataFrame:
    """WIN5 + SCL11: pages of each (query, engine) in order, up to and including the
    first page with fewer rows than the engine's threshold, within the page budget
    ``min(ceil(num_results / page_size), page_cap)`` (1 page for google in fast mode).
    Rows without a URL do not count (parsers drop them)."""
    r = with_engine_config(results, spark).filter(F.col("url").isNotNull())
    pages = (r.groupBy("query_id", "engine", "engine_no", "page_size", "page_cap", "stop_below",
                       F.floor((F.col("rank") - 1) / F.col("page_size")).cast("int").alias("page_no"))
             .agg(F.count(F.lit(1)).alias("n_rows")))
    budget = F.least(F.ceil(F.lit(num_results) / F.col("page_size")), F.col("page_cap"))
    if fast_mode:
        budget = F.when(F.col("engine") == "google", F.lit(1)).otherwise(budget)
    w = Window.partitionBy("query_id", "engine").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    w_n = Window.partitionBy("query_id", "engine").orderBy("page_no")
    short = (F.col("n_rows") < F.col("stop_below")).cast("int")
    # an absent page number is a page without rows: it is short, so nothing after it
    # is fetched; a page is kept only if every earlier page is present and not short
    return (pages.filter(F.col("page_no") < budget)
            .withColumn("_short_before", F.coalesce(F.sum(short).over(w), F.lit(0)))
            .withColumn("_present_before", F.row_number().over(w_n) - 1)
            .filter((F.col("_short_before") == 0) & (F.col("_present_before") == F.col("page_no")))
            .select("query_id", "engine", "page_no", F.col("n_rows").cast("long").alias("n_rows")))


def limit_per_query(results: DataFrame, limits: DataFrame) -> DataFrame:
    """WIN7: first ``num_results`` rows (by rank) of each (query, engine); nothing else
    bounds the result. The largest number asked for is read first and stands in the plan
    as a literal, so Spark cuts each group to that many rows per map partition before
    the exchange; the per-request limit applies after."""
    most = limits.agg(F.max("num_results")).first()[0] or 0
    r = results.filter(F.col("url").isNotNull()).join(limits.select("query_id", "num_results"), "query_id")
    w = Window.partitionBy("query_id", "engine").orderBy("rank", "url")
    return (r.withColumn("pos", F.row_number().over(w))
            .filter(F.col("pos") <= most)
            .filter(F.col("pos") <= F.col("num_results"))
            .select("query_id", "engine", "rank", "url", F.col("pos").cast("int").alias("pos")))


def query_envelopes(results: DataFrame, spark: SparkSession, max_per_engine: int | None = None,
                    attempts: DataFrame | None = None) -> DataFrame:
    """AGG4: one response row per query: results per engine (``map<engine, array>``, in
    rank order, an empty array for an engine of ``attempts`` that answered nothing), the
    merged distinct list of all rows (DEDUP2 order), counters, and the error fields of a
    query that no engine answered.

    ``attempts(query_id, engine, error)`` lists what was tried; without it only engines
    with results are known. ``max_per_engine`` is an explicit wish of the caller and
    shortens the listed results only, never the merged list or the counters."""
    r = with_engine_config(results, spark)
    listed = r
    if max_per_engine is not None:
        w = Window.partitionBy("query_id", "engine").orderBy("rank", "url")
        listed = r.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_per_engine)
    per_engine = (listed.groupBy("query_id", "engine")
                  .agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url", "snippet"))).alias("results")))
    if attempts is not None:
        tried = (with_engine_config(attempts, spark).groupBy("query_id", "engine")
                 .agg(F.max_by("error", "engine_no").alias("error"), F.max("engine_no").alias("engine_no")))
        per_engine = (tried.join(per_engine, ["query_id", "engine"], "full")
                      .withColumn("results", F.coalesce("results", F.array().cast(
                          "array<struct<rank:int,title:string,url:string,snippet:string>>"))))
    else:
        per_engine = per_engine.withColumn("error", F.lit(None).cast("string")).withColumn("engine_no", F.lit(0))
    engines = per_engine.groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("engine", "results"))).alias("engines"),
        F.count_if(F.size("results") > 0).alias("engines_succeeded"),
        F.count_if(F.size("results") == 0).alias("engines_failed"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("engine_no"))).alias("_error"))
    merged = (merge_results(results, spark).groupBy("query_id")
              .agg(F.array_sort(F.collect_list(F.struct("engine_no", "rank", "url", "engine", "title")))
                   .alias("all_results")))
    out = (engines.join(merged, "query_id", "left")
           .withColumn("all_results", F.coalesce("all_results", F.array().cast(
               "array<struct<engine_no:int,rank:int,url:string,engine:string,title:string>>")))
           .withColumn("total_results", F.size("all_results"))
           .withColumn("success", F.col("engines_succeeded") > 0))
    error = F.coalesce("_error", F.lit(NO_RESULTS_ERROR))
    return out.withColumn("error", F.when(~F.col("success"), error)).withColumn(
        "error_type", F.when(~F.col("success"), Q.error_type(error, F.lit(0)))).drop("_error")
