"""Service-level reports over a request log (AGG3, AGG5-11, STR2 batch, STR6).

Times: ``ts`` is a wall-clock ``TIMESTAMP_NTZ`` (UTC), so every report is independent of
the session time zone.

Input: a ``fetch_log`` DataFrame (request_id, ts, query_id, engine, protocol, proxy,
proxy_source, attempt_no, success, n_results, status_code, response_time, error).

Scale notes:
* Every report is a hash aggregate with map-side partial aggregation; sliding
  windows are built from per-slide partial counts, so raw rows are never copied.
* Exact percentiles are computed from (group, value) counts, so the ordered window
  runs over distinct values per group, never over all rows of a group.
* Source health is a prefix scan: the failure counter ``f = max(0, f + d)`` has the
  closed form ``S_n - min(0, min_k S_k)``; per-minute chunks are scanned locally and
  combined with the associative rule ``(s1, m1) + (s2, m2) = (s1 + s2, min(m1, s1 + m2))``,
  so a hot source is split across minutes instead of sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as Q

# --- fixed values -----------------------------------------------------------------
ENGINE_PRIORITY = ("google", "duckduckgo", "bing", "yahoo")
WINDOW_KINDS = (("1h", 3600, 3600), ("24h", 86400, 3600), ("7d", 604800, 86400))
MAX_FAILURES = 3
SEARCH_LIMIT_PER_MINUTE = 120
# Alert thresholds of the monitoring plan.
SUCCESS_CRITICAL, SUCCESS_WARNING = 0.70, 0.80
ERROR_CRITICAL, ERROR_WARNING = 0.30, 0.20
P95_CRITICAL_SECONDS = 10.0
DOWN_SECONDS = 60.0
SELECTOR_WARNING = 0.10
FALLBACK_WARNING = 0.30
ERROR_LIMITS = (("captcha_detected", 0.05), ("blocked", 0.05), ("rate_limited", 0.02),
                ("timeout", 0.01), ("selector_mismatch", 0.10))
# ---------------------------------------------------------------------------------

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def engine_priority(engine_col) -> "F.Column":
    out = None
    for i, e in enumerate(ENGINE_PRIORITY):
        out = F.when(engine_col == e, F.lit(i + 1)) if out is None else out.when(engine_col == e, F.lit(i + 1))
    return out


def normalized(log: DataFrame, timeout: float | None = Q.DEFAULT_ENGINE_TIMEOUT) -> DataFrame:
    """CLS3 (optional) then CLS2 + CLS1 on every attempt."""
    df = Q.apply_timeout(log, timeout) if timeout is not None else log
    return Q.normalize_response(df)


def engine_outcomes(log: DataFrame) -> DataFrame:
    """AGG3: per query, engines that produced results vs engines that did not."""
    per_engine = (normalized(log, None).groupBy("query_id", "engine")
                  .agg(F.max(F.col("success").cast("int")).alias("ok")))
    return (per_engine.groupBy("query_id")
            .agg(F.sum("ok").cast("long").alias("engines_succeeded"),
                 (F.count(F.lit(1)) - F.sum("ok")).cast("long").alias("engines_failed"))
            .withColumn("success", F.col("engines_succeeded") > 0))


def health_summary(log: DataFrame, key: str = "proxy", chunk: str = "1 minute") -> DataFrame:
    """What a stretch of a source's log does to its health, per source: the sum ``s`` of the
    steps (+1 on failure, -1 on success), their least running sum ``m``, successes, the
    last outcome and the last positive response time of a success. Summed over time
    chunks first, so a source with a third of all rows is many groups."""
    ev = (log.select(key, "ts", "request_id", "success", "response_time")
          .withColumn("d", F.when(F.col("success"), F.lit(-1)).otherwise(F.lit(1)))
          .withColumn("chunk", F.window("ts", chunk).start))
    w_local = Window.partitionBy(key, "chunk").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("s_local", F.sum("d").over(w_local))
    order_key = F.struct("ts", "request_id")
    timed = F.col("success") & (F.col("response_time") > 0)
    chunks = ev.groupBy(key, "chunk").agg(
        F.sum("d").alias("s"), F.min("s_local").alias("m"), F.count_if(F.col("success")).alias("successes"),
        F.max_by("success", order_key).alias("last_success"), F.max(order_key).alias("last_key"),
        F.max_by(F.when(timed, F.col("response_time")), F.when(timed, order_key)).alias("rt"),
        F.max(F.when(timed, order_key)).alias("rt_key"))
    w_chunks = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("s_before", F.coalesce(F.sum("s").over(w_chunks), F.lit(0)))
    return chunks.groupBy(key).agg(
        F.sum("s").alias("s"), F.min(F.col("s_before") + F.col("m")).alias("m"), F.sum("successes").alias("successes"),
        F.max_by("last_success", "last_key").alias("last_success"), F.max_by("rt", "rt_key").alias("rt"))


def merge_summaries(before: DataFrame, after: DataFrame, key: str = "proxy") -> DataFrame:
    """The summary of two stretches that follow one another."""
    a, b = before.alias("a"), after.alias("b")

    def both(c):
        return F.coalesce(F.col(f"a.{c}"), F.lit(0)), F.coalesce(F.col(f"b.{c}"), F.lit(0))

    (sa, sb), (na, nb) = both("s"), both("successes")
    return a.join(b, key, "full").select(
        key, (sa + sb).alias("s"), F.least(F.col("a.m"), sa + F.col("b.m")).alias("m"), (na + nb).alias("successes"),
        F.coalesce(F.col("b.last_success"), F.col("a.last_success")).alias("last_success"), F.coalesce(F.col("b.rt"), F.col("a.rt")).alias("rt"))


def health_of(summary: DataFrame, key: str = "proxy") -> DataFrame:
    """The health record that a log's summary stands for: the failure counter falls by one
    on success but not below zero, so it is ``s - min(0, m)``."""
    failures = F.col("s") - F.least(F.lit(0), F.col("m"))
    return (summary.select(
        key,
        failures.cast("long").alias("failures"),
        F.col("successes").cast("long").alias("successes"),
        (F.col("last_success") | (failures < MAX_FAILURES)).alias("is_working"),
        F.coalesce(F.col("rt"), F.lit(0.0)).alias("response_time"))
        .withColumn("score", F.round(Q.quality_score(F.col("successes"), F.col("failures"),
                                                     F.col("response_time")), 6)))


def source_health(log: DataFrame, key: str = "proxy", chunk: str = "1 minute") -> DataFrame:
    """STR2 (batch): final health record per source after its log in (ts, request_id)
    order: failures (+1 on failure, -1 floored at 0 on success), successes, is_working
    (off at 3 failures, on after a success), latest positive response time of a success,
    and the AGG6 score."""
    return health_of(health_summary(log, key, chunk), key)


def source_scorecard(health: DataFrame, sources: DataFrame, key: str = "proxy") -> DataFrame:
    """AGG5: total / working / failed sources overall, by protocol and by list."""
    h = health.join(sources, key)
    return (h.groupingSets([["protocol"], ["proxy_source"], []], "protocol", "proxy_source")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if("is_working").alias("working"),
                 F.count_if(~F.col("is_working")).alias("failed"),
                 F.grouping("protocol").alias("_p"), F.grouping("proxy_source").alias("_s"))
            # the grouping flags tell a null key's group from the groups without that key
            .select(F.when(F.col("_p") == 0, F.lit("protocol")).when(F.col("_s") == 0, F.lit("source"))
                    .otherwise(F.lit("all")).alias("dimension"),
                    F.when(F.col("_p") == 0, F.col("protocol")).when(F.col("_s") == 0, F.col("proxy_source"))
                    .otherwise(F.lit("all")).alias("value"),
                    "total", "working", "failed"))


def top_sources(health: DataFrame, n: int = 5, key: str = "proxy") -> DataFrame:
    """TOP2: working sources by score, descending (key breaks ties). A global top-n:
    Spark plans it as TakeOrderedAndProject (per-partition top-n, then merge)."""
    return (health.filter("is_working").orderBy(F.desc("score"), F.asc(key)).limit(n)
            .select(key, "score", F.round("response_time", 2).alias("response_time")))


def success_rates(log: DataFrame) -> DataFrame:
    """AGG7: success rate per engine and overall in 1h tumbling, 24h/1h and 7d/1d
    sliding windows.

    Counts are additive, so the log is aggregated once into per-(engine, slide)
    partials (map-side partial aggregation: the shuffle carries one row per task and
    bucket), and only those partial rows are copied into the sliding windows they
    belong to; raw rows are never multiplied by the window overlap."""
    n = normalized(log).select(F.unix_timestamp("ts").alias("sec"), "engine", "success")
    slides = sorted({slide for _, _, slide in WINDOW_KINDS})
    parts = n.groupBy("engine", *[F.floor(F.col("sec") / sl).cast("long").alias(f"b{sl}") for sl in slides]).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("success").alias("successes"))
    expanded = None
    for name, size, slide in WINDOW_KINDS:
        per = (parts.groupBy("engine", f"b{slide}")
               .agg(F.sum("requests").alias("requests"), F.sum("successes").alias("successes")))
        one = (per.select("engine", f"b{slide}", "requests", "successes",
                          F.explode(F.sequence(F.lit(0), F.lit(size // slide - 1))).alias("k"))
               .select("engine", F.lit(name).alias("window_kind"),
                       ((F.col(f"b{slide}") - F.col("k")) * slide).alias("start"), "requests", "successes"))
        expanded = one if expanded is None else expanded.unionByName(one)
    g = (expanded.groupingSets([["window_kind", "start", "engine"], ["window_kind", "start"]],
                               "window_kind", "start", "engine")
         .agg(F.sum("requests").alias("requests"), F.sum("successes").alias("successes"), F.grouping("engine").alias("_all")))
    start_text = F.date_format(F.expr("timestampadd(SECOND, start, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), TS_FMT)
    return g.select("window_kind", start_text.alias("window_start"), F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("engine")).alias("engine"),
                    F.col("requests").cast("long").alias("requests"), F.col("successes").cast("long").alias("successes"),
                    F.round(F.col("successes") / F.col("requests"), 6).alias("success_rate"))


def error_mix(log: DataFrame) -> DataFrame:
    """AGG8: share of each error type per day and engine, with the acceptable limit."""
    df = normalized(log).withColumn("day", F.date_format(F.date_trunc("day", "ts"), TS_FMT))
    totals = df.groupBy("day", "engine").agg(F.count(F.lit(1)).alias("requests"))
    errs = df.filter(~F.col("success")).groupBy("day", "engine", "error_type").agg(F.count(F.lit(1)).alias("n"))
    limit = None
    for name, lim in ERROR_LIMITS:
        limit = F.when(F.col("error_type") == name, F.lit(lim)) if limit is None else \
            limit.when(F.col("error_type") == name, F.lit(lim))
    return (errs.join(totals, ["day", "engine"])
            .select("day", "engine", "error_type", F.col("n").alias("errors"), "requests",
                    F.round(F.col("n") / F.col("requests"), 6).alias("share"),
                    limit.alias("limit"),
                    F.coalesce(F.col("n") / F.col("requests") > limit, F.lit(False)).alias("over_limit")))


def exact_percentile(df: DataFrame, group_cols, value: str, p: float, accuracy: int = 10_000) -> DataFrame:
    """Exact linear-interpolated percentile per group by distributed selection.

    A mergeable sketch per group gives two values that the percentile lies between; rows
    below, between and above them are counted (partial sums), which tells the part that
    holds each of the two ranks asked for; only the values of that part, about
    4 / ``accuracy`` of a group, are sorted. The sketch decides what is sorted, not the
    result. Nulls and groups of nulls alone have no rows."""
    df = df.select(*group_cols, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    margin = 2.0 / accuracy
    keys = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in group_cols]
    around = F.percentile_approx("_v", F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin))), F.lit(accuracy))
    bounds = df.groupBy(*group_cols).agg(around.alias("_around"), F.count(F.lit(1)).alias("_n"))
    bounds = bounds.select(*[F.col(c).alias(f"_b_{c}") for c in group_cols], "_around", "_n")
    part = F.when(F.col("_v") < F.col("_around")[0], 0).when(F.col("_v") <= F.col("_around")[1], 1).otherwise(2)
    parted = df.join(bounds, keys).select(*group_cols, "_v", "_n", part.alias("_part"))

    def cut(name):
        return F.coalesce(F.sum(name).over(Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    pos = p * (F.col("_n") - 1)
    held = parted.groupBy(*group_cols, "_part").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")).withColumn("_before", cut("_c"))  # at most three rows a group
    asked = held.withColumn("_rank", F.explode(F.array(F.floor(pos), F.ceil(pos)))).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    asked = asked.groupBy(*group_cols, "_part", "_before").agg(F.min("_rank").alias("_lo"), F.max("_rank").alias("_hi"))
    asked = asked.select(*[F.col(c).alias(f"_b_{c}") for c in group_cols], F.col("_part").alias("_p"), "_before", "_lo", "_hi")
    inside = parted.join(asked, [*keys, F.col("_part") == F.col("_p")]).groupBy(*group_cols, "_part", "_v").agg(F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in ("_n", "_before", "_lo", "_hi")])
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*group_cols, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_end", end)
    value_at = [F.min(F.when((F.col("_end") > F.col(r)), F.col("_v"))).alias(r) for r in ("_lo", "_hi")]
    # the two ranks may lie in neighbouring parts: the smaller part's first, the larger part's last
    found = ranked.groupBy(*group_cols, "_part").agg(*value_at, F.first("_n").alias("_n"))
    found = found.groupBy(*group_cols).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.first("_n").alias("_n"))
    return found.select(*group_cols, (F.col("_lo") + (pos - F.floor(pos)) * (F.col("_hi") - F.col("_lo"))).alias(f"p{int(p * 100)}"))


def latency(log: DataFrame, p: float = 0.95, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """AGG9: p95 and mean response time per day and engine (all attempts), exact by
    ``exact_percentile``; with ``exact=False`` the sketch's value, in one pass."""
    df = log.select(F.date_format(F.date_trunc("day", "ts"), TS_FMT).alias("day"), "engine", "response_time")
    if exact:
        pct = exact_percentile(df, ["day", "engine"], "response_time", p, accuracy)
    else:
        pct = df.groupBy("day", "engine").agg(
            F.percentile_approx("response_time", p, accuracy).alias(f"p{int(p * 100)}"))
    avg = df.groupBy("day", "engine").agg(F.count(F.lit(1)).alias("requests"),
                                          F.avg("response_time").alias("avg_rt"))
    return (avg.join(pct, ["day", "engine"], "left")
            .select("day", "engine", "requests", F.round("avg_rt", 6).alias("avg_response_time"),
                    F.round(f"p{int(p * 100)}", 6).alias("p95_response_time")))


def outages(log: DataFrame, longer_than: float = DOWN_SECONDS, chunk_seconds: int = 3600) -> DataFrame:
    """AGG11 "down for more than a minute": the maximal runs of failed requests of an
    engine, in order of time and request id, whose first and last request lie more than
    ``longer_than`` seconds apart: engine, start, end, failures, seconds.

    Runs are found inside time chunks, so an engine with a third of all requests is many
    tasks. A run that reaches the edge of its chunk is one of at most two pieces of it;
    only those are put in order over all chunks of an engine, and pieces without a success
    between them are one run."""
    df = normalized(log).where(F.col("ts").isNotNull()).select("engine", "ts", "request_id", F.coalesce("success", F.lit(False)).alias("ok"),
                                                    F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / chunk_seconds).alias("chunk"))
    seen = Window.partitionBy("engine", "chunk").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("run", F.count_if("ok").over(seen))
    bad = ~F.col("ok")
    runs = df.groupBy("engine", "chunk", "run").agg(F.count_if(bad).alias("failures"), F.min(F.when(bad, F.col("ts"))).alias("start"), F.max(F.when(bad, F.col("ts"))).alias("end"))
    last = F.max("run").over(Window.partitionBy("engine", "chunk"))
    runs = runs.withColumn("last", last)
    whole = runs.where((F.col("run") > 0) & (F.col("run") < F.col("last"))).select("engine", "start", "end", "failures")
    # the run after the chunk's last success begins anew, the one before its first goes on
    pieces = runs.where((F.col("run") == 0) | (F.col("run") == F.col("last"))).withColumn("fresh", (F.col("run") > 0).cast("int"))
    place = Window.partitionBy("engine").orderBy("chunk", "run").rowsBetween(Window.unboundedPreceding, 0)
    joined = pieces.withColumn("island", F.sum("fresh").over(place)).groupBy("engine", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("failures").alias("failures"))
    found = whole.unionByName(joined.select("engine", "start", "end", "failures")).where("failures > 0")
    found = found.withColumn("seconds", F.expr("timestampdiff(MICROSECOND, start, end)") / 1e6).where(F.col("seconds") > longer_than)
    return found.select("engine", "start", "end", F.col("failures").cast("long").alias("failures"), F.round("seconds", 6).alias("seconds"))


def fallback_rate(log: DataFrame) -> DataFrame:
    """AGG10: per day, share of queries not answered by the first engine tried, and
    queries no engine answered."""
    df = normalized(log).select(F.date_format(F.date_trunc("day", "ts"), TS_FMT).alias("day"), "query_id",
                                engine_priority(F.col("engine")).alias("prio"), "success")
    per_q = df.groupBy("day", "query_id").agg(
        F.min("prio").alias("first_prio"),
        F.min(F.when(F.col("success"), F.col("prio"))).alias("win_prio"))
    return (per_q.groupBy("day").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("win_prio") > F.col("first_prio")).alias("fallbacks"),
        F.count_if(F.col("win_prio").isNull()).alias("unanswered"))
        .withColumn("fallback_rate", F.round(F.col("fallbacks") / F.col("queries"), 6)))


def alerts(log: DataFrame) -> DataFrame:
    """AGG11: the monitoring plan's critical / warning conditions per day (``down``: the
    longest outage that began on the day, in seconds)."""
    df = normalized(log).withColumn("day", F.date_format(F.date_trunc("day", "ts"), TS_FMT))
    # per (day, engine) and per day in one aggregate (grouping sets)
    counts = (df.groupingSets([["day", "engine"], ["day"]], "day", "engine")
              .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"),
                   F.count_if(~F.col("success")).alias("bad"),
                   F.count_if(F.col("error_type") == "selector_mismatch").alias("sel_n")))
    per_engine = counts.filter(F.col("gid") == 0).select("day", "engine", (F.col("ok") / F.col("n")).alias("v"))
    eng = per_engine.select("day", F.concat(F.lit("success_rate_"), F.col("engine")).alias("alert"),
                            F.when(F.col("v") < SUCCESS_CRITICAL, F.lit("critical"))
                            .when(F.col("v") < SUCCESS_WARNING, F.lit("warning")).alias("level"), "v")
    overall = counts.filter(F.col("gid") == 1).select(
        "day", (F.col("bad") / F.col("n")).alias("err"), (F.col("sel_n") / F.col("n")).alias("sel"))
    err = overall.select("day", F.lit("error_rate").alias("alert"),
                         F.when(F.col("err") > ERROR_CRITICAL, F.lit("critical"))
                         .when(F.col("err") > ERROR_WARNING, F.lit("warning")).alias("level"), F.col("err").alias("v"))
    sel = overall.select("day", F.lit("selector_mismatch").alias("alert"),
                         F.when(F.col("sel") > SELECTOR_WARNING, F.lit("warning")).alias("level"), F.col("sel").alias("v"))
    p95 = exact_percentile(df.select("day", "response_time"), ["day"], "response_time", 0.95)
    lat = p95.select("day", F.lit("p95_response_time").alias("alert"),
                     F.when(F.col("p95") > P95_CRITICAL_SECONDS, F.lit("critical")).alias("level"), F.col("p95").alias("v"))
    fb = fallback_rate(log).select("day", F.lit("fallback_rate").alias("alert"),
                                   F.when(F.col("fallback_rate") > FALLBACK_WARNING, F.lit("warning")).alias("level"),
                                   F.col("fallback_rate").alias("v"))
    down = outages(log).groupBy(F.date_format(F.date_trunc("day", "start"), TS_FMT).alias("day")).agg(F.max("seconds").alias("v"))
    down = down.select("day", F.lit("down").alias("alert"), F.lit("critical").alias("level"), "v")
    out = eng.unionByName(err).unionByName(sel).unionByName(lat).unionByName(fb).unionByName(down)
    return out.filter(F.col("level").isNotNull()).select("day", "alert", "level", F.round("v", 6).alias("value"))


def rate_per_minute(log: DataFrame, limit: int = SEARCH_LIMIT_PER_MINUTE) -> DataFrame:
    """STR6: requests per engine and minute against the per-minute limit; one row per
    engine with the busiest minute and the number of minutes over the limit."""
    per_min = (log.groupBy("engine", F.date_trunc("minute", "ts").alias("minute"))
               .agg(F.count(F.lit(1)).alias("n")))
    return (per_min.groupBy("engine").agg(
        F.max("n").alias("max_per_minute"),
        F.date_format(F.min_by("minute", F.struct(-F.col("n"), F.col("minute"))), TS_FMT).alias("busiest_minute"),
        F.count_if(F.col("n") > limit).alias("minutes_over_limit"),
        F.count(F.lit(1)).alias("active_minutes")))
