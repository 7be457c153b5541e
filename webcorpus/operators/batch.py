"""Batch operators: URL batches against the page table (SRC2, JON4, AGG2), request
validation with quarantine (FLT2) and batch summaries (AGG1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# --- fixed values -----------------------------------------------------------------
# Safe-search level -> engine code, with the engine's default for unknown levels.
BING_SAFE = (("off", "0"), ("moderate", "1"), ("strict", "2"))
BING_SAFE_DEFAULT = "1"
DUCKDUCKGO_SAFE = (("off", "off"), ("moderate", "moderate"), ("strict", "on"))
DUCKDUCKGO_SAFE_DEFAULT = "moderate"
QUERY_MAX_CHARS = 500
NUM_RESULTS_RANGE = (1, 100)
# ---------------------------------------------------------------------------------


def scrape_batch(url_list: DataFrame, pages: DataFrame) -> DataFrame:
    """SRC2 + JON4: every input URL gets one outcome row, in input order (``ord``).

    The URL is sanitized and validated; valid URLs are left-joined to the stored pages
    on the exact URL. Invalid -> ``Invalid URL``; not stored -> ``Failed to fetch
    website``. Only ``page_id``/``url`` of the page side enter the join, so the html is
    not shuffled; the page side is hash-partitioned by url (or broadcast by AQE when
    the batch side is small)."""
    s = url_list.select("ord", U.sanitize_url(F.col("url")).alias("url"))
    s = s.withColumn("is_valid", U.is_valid_url(F.col("url")))
    p = pages.select(F.col("url").alias("page_url"), "page_id")
    j = s.join(p, (s.url == p.page_url) & s.is_valid, "left")
    return j.select(
        "ord", "url",
        F.col("page_id").isNotNull().alias("success"),
        F.when(~F.col("is_valid"), F.lit("Invalid URL"))
         .when(F.col("page_id").isNull(), F.lit("Failed to fetch website")).alias("error"),
        "page_id")


def batch_summary(outcomes: DataFrame, total_name: str = "total") -> DataFrame:
    """AGG2: total / successful / failed; the batch itself always succeeds."""
    return outcomes.agg(
        F.lit(True).alias("success"),
        F.count(F.lit(1)).alias(total_name),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """FLT2: add ``reasons`` (array of rule names that fail) and ``is_valid``.

    Row rules of the request model: query 1..500 characters, num_results 1..100. The
    search type is free text there (an unknown type simply finds nothing downstream),
    so it is not a validation rule. List-size caps of the batch endpoint are dropped
    (a batch is a DataFrame of any size)."""
    q = F.coalesce(F.col("query"), F.lit(""))
    reasons = F.array_compact(F.array(
        F.when(F.length(q) < 1, F.lit("query_empty")),
        F.when(F.length(q) > QUERY_MAX_CHARS, F.lit("query_too_long")),
        F.when(~F.coalesce(F.col("num_results").between(*NUM_RESULTS_RANGE), F.lit(False)),
               F.lit("num_results_out_of_range")),
    ))
    return requests.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


CRAWL_DEPTH_RANGE = (1, 5)
CRAWL_PAGES_RANGE = (1, 200)
CONCURRENCY_RANGE = (1, 30)
TIMEOUT_RANGE = (5.0, 120.0)


def validate_crawl_requests(requests: DataFrame) -> DataFrame:
    """FLT2 for page requests: URL present, max_depth 1..5, max_pages 1..200,
    max_concurrent 1..30, per-engine timeout 5..120 s (each rule only where the column
    exists)."""
    cols = set(requests.columns)
    rules = [F.when(F.length(F.trim(F.coalesce(F.col("url"), F.lit("")))) < 1, F.lit("url_missing"))]
    for col, (lo, hi), name in (("max_depth", CRAWL_DEPTH_RANGE, "max_depth_out_of_range"),
                                ("max_pages", CRAWL_PAGES_RANGE, "max_pages_out_of_range"),
                                ("max_concurrent", CONCURRENCY_RANGE, "max_concurrent_out_of_range"),
                                ("per_engine_timeout", TIMEOUT_RANGE, "timeout_out_of_range")):
        if col in cols:
            rules.append(F.when(~F.coalesce(F.col(col).between(lo, hi), F.lit(False)), F.lit(name)))
    reasons = F.array_compact(F.array(*rules))
    return requests.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT2 quarantine: (valid rows, rejected rows with reasons)."""
    v = validate_requests(requests)
    return v.filter("is_valid").drop("reasons", "is_valid"), v.filter("NOT is_valid")


def _code(level, table, default):
    m = F.create_map(*[F.lit(x) for pair in table for x in pair])
    return F.coalesce(F.element_at(m, F.coalesce(level, F.lit(""))), F.lit(default))


def normalize_requests(requests: DataFrame) -> DataFrame:
    """SCL12: region ``country-language`` and per-engine safe-search codes (map
    literals, so the lookup is a native expression)."""
    return requests.select(
        "*", F.concat_ws("-", F.col("country"), F.col("language")).alias("region"),
        _code(F.col("safe_search"), BING_SAFE, BING_SAFE_DEFAULT).alias("bing_safe_search"),
        _code(F.col("safe_search"), DUCKDUCKGO_SAFE, DUCKDUCKGO_SAFE_DEFAULT).alias("duckduckgo_safe_search"))
