"""URL, text and contact queries (SCL1-6, FLT1, FLT10, EXT20-21, SRC2, JON4, AGG2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions import text as T
from ..functions import urls as U
from ..operators import batch as B
from ..sources import derived, tables
from . import duck as D
from .catalog import register


def _sanitize_sql(u: str) -> str:
    return f"CASE WHEN regexp_matches(trim({u}), '^https?://') THEN trim({u}) ELSE 'https://' || trim({u}) END"


def _valid_sql(u: str) -> str:
    parts = D.q(U.URL_PARTS)
    return f"(regexp_extract({u}, {parts}, 1) <> '' AND regexp_extract({u}, {parts}, 3) <> '')"


@register("url_sanitize", oracle=f"""
{derived.duck_cte('url_list')}
SELECT ord, url AS raw_url, {_sanitize_sql('url')} AS url, {_valid_sql(_sanitize_sql('url'))} AS is_valid
FROM url_list""")
def url_sanitize(spark, sf_dir):
    ul = derived.view(spark, sf_dir, "url_list")
    s = U.sanitize_url(F.col("url"))
    return ul.select("ord", F.col("url").alias("raw_url"), s.alias("url"), U.is_valid_url(s).alias("is_valid"))


@register("url_domain", oracle=f"""
SELECT page_id, {D.host('url')} AS host, {D.registrable_domain('url')} AS domain FROM pages""")
def url_domain(spark, sf_dir):
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", U.url_host(F.col("url")).alias("host"),
                    U.registrable_domain(F.col("url")).alias("domain"))


@register("clean_text", oracle=f"""
SELECT doc_id, {D.clean('text')} AS cleaned, CAST(length({D.clean('text')}) AS BIGINT) AS cleaned_length
FROM documents""")
def clean_text(spark, sf_dir):
    d = tables.documents(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))
    return d.select("doc_id", "cleaned", F.length("cleaned").cast("long").alias("cleaned_length"))


@register("text_truncate", oracle="""
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || '...' END AS snippet
FROM documents""")
def text_truncate(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    return d.select("doc_id", T.truncate_text(F.col("text"), 500).alias("snippet"))


def _emails_sql(t: str) -> str:
    found = f"regexp_extract_all({t}, {D.q(C.EMAIL)})"
    fp = " OR ".join(f"contains(lower(m), {D.q(x)})" for x in C.EMAIL_FALSE_POSITIVES)
    local = "split_part(m, '@', 1)"
    tld = "reverse(split_part(reverse(m), '.', 1))"
    valid = (f"regexp_matches(m, {D.q(C.EMAIL_VALID)}) AND length({local}) <= 64 AND length(m) <= 254 "
             f"AND NOT regexp_matches({tld}, '^[0-9]+$')")
    norm = "split_part(e, '@', 1) || '@' || lower(split_part(e, '@', 2))"
    return (f"list_sort(list_distinct(list_transform(list_filter({found}, lambda m: NOT ({fp}) AND {valid}), "
            f"lambda e: {norm})))")


@register("contacts_email", oracle=f"""
SELECT doc_id, unnest({_emails_sql('text')}) AS email FROM documents""")
def contacts_email(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    return d.select("doc_id", F.explode(C.emails(F.col("text"))).alias("email"))


def _phones_sql(t: str) -> str:
    us = (f"list_transform(regexp_extract_all({t}, {D.q(C.PHONE_US)}, 0), lambda m: "
          f"regexp_extract(m, {D.q(C.PHONE_US)}, 1) || '-' || regexp_extract(m, {D.q(C.PHONE_US)}, 2) || '-' || "
          f"regexp_extract(m, {D.q(C.PHONE_US)}, 3))")
    allp = (f"list_concat({us}, regexp_extract_all({t}, {D.q(C.PHONE_INTL)}, 0), "
            f"regexp_extract_all({t}, {D.q(C.PHONE_GENERIC)}, 0))")
    return (f"list_sort(list_distinct(list_filter({allp}, lambda p: "
            f"length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)))")


@register("contacts_phone", oracle=f"""
SELECT doc_id, unnest({_phones_sql('text')}) AS phone FROM documents""")
def contacts_phone(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    return d.select("doc_id", F.explode(C.phones(F.col("text"))).alias("phone"))


@register("page_batch_outcomes", oracle=f"""
{derived.duck_cte('url_list')}, s AS (SELECT ord, {_sanitize_sql('url')} AS url FROM url_list)
SELECT s.ord, s.url,
       p.page_id IS NOT NULL AND {_valid_sql('s.url')} AS success,
       CASE WHEN NOT {_valid_sql('s.url')} THEN 'Invalid URL'
            WHEN p.page_id IS NULL THEN 'Failed to fetch website' END AS error,
       CASE WHEN {_valid_sql('s.url')} THEN p.page_id END AS page_id
FROM s LEFT JOIN pages p ON p.url = s.url""")
def page_batch_outcomes(spark, sf_dir):
    out = B.scrape_batch(derived.view(spark, sf_dir, "url_list"), tables.pages(spark, sf_dir))
    return out.select("ord", "url", "success", "error", "page_id")


@register("page_batch_summary", oracle=f"""
{derived.duck_cte('url_list')}, s AS (SELECT ord, {_sanitize_sql('url')} AS url FROM url_list),
o AS (SELECT p.page_id IS NOT NULL AND {_valid_sql('s.url')} AS success FROM s LEFT JOIN pages p ON p.url = s.url)
SELECT true AS success, count(*) AS total_urls, count(*) FILTER (WHERE success) AS successful,
       count(*) FILTER (WHERE NOT success) AS failed FROM o""")
def page_batch_summary(spark, sf_dir):
    out = B.scrape_batch(derived.view(spark, sf_dir, "url_list"), tables.pages(spark, sf_dir))
    return B.batch_summary(out, "total_urls")
