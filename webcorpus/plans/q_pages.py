"""Page extraction queries (EXT1-19, PRJ1-3, AGG12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions import page as P
from ..operators import pages as OP
from ..sources import tables
from . import duck as D
from .catalog import register

BODY_CTE = f"WITH b AS (SELECT page_id, url, {D.body('html')} AS body FROM pages)"
FULL_CTE = f"WITH b AS (SELECT page_id, url, {D.body('html', True)} AS body FROM pages)"


def _paras_len(expr):
    return f"list_sum(list_transform({expr}, lambda t: length(t)))"


@register("page_overview", headline=True, oracle=f"""
{BODY_CTE}
SELECT page_id,
       {D.registrable_domain('url')} AS domain,
       {D.title('body')} AS title,
       {D.language('body')} AS language,
       CAST(len({D.heading_texts('body', 1)}) AS BIGINT) AS h1_count,
       CAST(len({D.paragraph_texts('body')}) AS BIGINT) AS paragraph_count,
       CAST(coalesce({_paras_len(D.paragraph_texts('body'))}, 0) AS BIGINT) AS paragraph_chars,
       CAST(length({D.main_content('body')}) AS BIGINT) AS main_content_length,
       CAST(length({D.spaced_text('body')}) AS BIGINT) AS content_length
FROM b""")
def page_overview(spark, sf_dir):
    return OP.page_overview(tables.pages(spark, sf_dir))


@register("page_title_lang", oracle=f"""
{BODY_CTE}
SELECT page_id, {D.title('body')} AS title, {D.language('body')} AS language FROM b""")
def page_title_lang(spark, sf_dir):
    return (OP.with_body(tables.pages(spark, sf_dir))
            .select("page_id", P.title(F.col("body")).alias("title"), P.language(F.col("body")).alias("language")))


_HEAD_UNION = " UNION ALL ".join(
    f"SELECT page_id, 'h{k}' AS level, CAST(generate_subscripts(h, 1) AS BIGINT) AS pos, unnest(h) AS heading "
    f"FROM (SELECT page_id, {D.heading_texts('body', k)} AS h FROM b)" for k in range(1, 7))


@register("page_headings", oracle=f"{BODY_CTE} {_HEAD_UNION}")
def page_headings(spark, sf_dir):
    b = OP.with_body(tables.pages(spark, sf_dir)).select("page_id", F.explode(P.headings(F.col("body"))).alias("level", "h"))
    return b.select("page_id", "level", F.posexplode("h").alias("pos", "heading")) \
        .select("page_id", "level", (F.col("pos") + 1).cast("long").alias("pos"), "heading")


@register("page_paragraphs", oracle=f"""
{BODY_CTE}
SELECT page_id, CAST(generate_subscripts(p, 1) AS BIGINT) AS pos, unnest(p) AS text,
       CAST(length(unnest(p)) AS BIGINT) AS length
FROM (SELECT page_id, {D.paragraph_texts('body')} AS p FROM b)""")
def page_paragraphs(spark, sf_dir):
    b = OP.with_body(tables.pages(spark, sf_dir))
    return (b.select("page_id", F.posexplode(P.paragraph_texts(F.col("body"))).alias("pos", "text"))
            .select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "text",
                    F.length("text").cast("long").alias("length")))


@register("page_main_content", oracle=f"""
{BODY_CTE}
SELECT page_id, {D.main_content('body')} AS main_content FROM b""")
def page_main_content(spark, sf_dir):
    return OP.with_body(tables.pages(spark, sf_dir)).select("page_id", P.main_content(F.col("body")).alias("main_content"))


@register("page_visible_text", oracle=f"""
{BODY_CTE}
SELECT page_id, {D.spaced_text('body')} AS text_content FROM b""")
def page_visible_text(spark, sf_dir):
    return OP.with_body(tables.pages(spark, sf_dir)).select("page_id", P.text_content(F.col("body")).alias("text_content"))


def _links_sql(body_expr: str, url_expr: str) -> str:
    """Links of one page, in DuckDB: anchors -> (href, text) -> skip -> resolve -> first per url."""
    from ..functions import urls as U
    a_pat = r"(?is)(<a\b[^>]*>.*?</a\s*>)"
    tag_pat = r"(?is)^(<a\b[^>]*>)"
    txt_pat = r"(?is)^<a\b[^>]*>(.*)</a\s*>$"
    href = D.attr(f"regexp_extract(a, {D.q(tag_pat)}, 1)", "href")
    title = f"coalesce({D.attr(f'regexp_extract(a, {D.q(tag_pat)}, 1)', 'title')}, '')"
    text = D.inner_text(f"regexp_extract(a, {D.q(txt_pat)}, 1)")
    recs = (f"list_transform(regexp_extract_all({body_expr}, {D.q(a_pat)}, 1), "
            f"lambda a: {{'href': {href}, 'text': {text}, 'title': {title}}})")
    keep = (f"list_filter({recs}, lambda r: r.href IS NOT NULL AND NOT starts_with(r.href, '#') "
            f"AND NOT starts_with(r.href, 'javascript:') AND NOT starts_with(r.href, 'mailto:'))")
    res = f"list_transform({keep}, lambda r: {{'url': {resolve_sql('r.href', url_expr)}, 'text': r.text, 'title': r.title}})"
    return res


def resolve_sql(h_raw: str, base: str) -> str:
    """DuckDB form of functions.urls.resolve_url."""
    from ..functions import urls as U
    h = f"trim({h_raw})"
    parts = D.q(U.URL_PARTS)
    scheme = f"regexp_extract({base}, {parts}, 1)"
    netloc = f"regexp_extract({base}, {parts}, 3)"
    bpath = f"regexp_extract({base}, {parts}, 4)"
    origin = f"({scheme} || '://' || {netloc})"
    bdir = f"regexp_replace(CASE WHEN {bpath} = '' THEN '/' ELSE {bpath} END, '[^/]*$', '')"
    hpath = f"regexp_extract({h}, '^([^?#]*)', 1)"
    hrest = f"substr({h}, length({hpath}) + 1)"

    def dots(path):
        segs = f"string_split({path}, '/')"
        folded = (f"list_reduce(list_prepend([]::VARCHAR[], list_transform({segs}[2:], lambda s: [s])), "
                  f"lambda acc, s: CASE WHEN s[1] = '..' THEN acc[1:len(acc)-1] WHEN s[1] = '.' THEN acc "
                  f"ELSE list_concat(acc, s) END)")
        last = f"{segs}[-1]"
        tail = f"CASE WHEN ({last} = '..' OR {last} = '.') AND len({folded}) > 0 THEN '/' ELSE '' END"
        return f"('/' || array_to_string({folded}, '/') || {tail})"

    return (f"CASE WHEN regexp_matches({h}, '^(https?:)?//') OR regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} "
            f"WHEN {h} = '' THEN {base} "
            f"WHEN starts_with({h}, '#') THEN regexp_replace({base}, '#.*$', '') || {h} "
            f"WHEN starts_with({h}, '?') THEN {origin} || {bpath} || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {dots(hpath)} || {hrest} "
            f"ELSE {origin} || {dots(f'({bdir} || {hpath})')} || {hrest} END")


def _first_by_url(arr: str) -> str:
    return f"list_filter({arr}, lambda x, i: NOT list_contains(list_transform({arr}[1:i-1], lambda y: y.url), x.url))"


@register("page_links_all", oracle=f"""
{FULL_CTE}
SELECT page_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS pos, unnest(l).url AS url,
       unnest(l).text AS text, unnest(l).title AS title
FROM (SELECT page_id, {_first_by_url(_links_sql('body', 'url'))} AS l FROM b)""")
def page_links_all(spark, sf_dir):
    b = OP.with_body(tables.pages(spark, sf_dir), include_boilerplate=True)
    return (b.select("page_id", F.posexplode(P.links(F.col("body"), F.col("url"))).alias("pos", "l"))
            .select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "l.url", "l.text", "l.title"))


@register("page_links_parity", oracle=f"""
{BODY_CTE}
SELECT page_id, CAST(len({_first_by_url(_links_sql('body', 'url'))}) AS BIGINT) AS n_links FROM b""")
def page_links_parity(spark, sf_dir):
    b = OP.with_body(tables.pages(spark, sf_dir))
    return b.select("page_id", F.size(P.links(F.col("body"), F.col("url"))).cast("long").alias("n_links"))


@register("url_resolve", oracle=f"""
{FULL_CTE}
SELECT page_id, CAST(generate_subscripts(h, 1) AS BIGINT) AS pos, unnest(h) AS href,
       {resolve_sql('unnest(h)', 'url')} AS resolved
FROM (SELECT page_id, url, list_transform(regexp_extract_all(body, {D.q(r'(?is)(<a\b[^>]*>)')}, 1),
      lambda t: coalesce({D.attr('t', 'href')}, '')) AS h FROM b)""")
def url_resolve(spark, sf_dir):
    from ..functions import urls as U
    b = OP.with_body(tables.pages(spark, sf_dir), include_boilerplate=True)
    tags = F.regexp_extract_all(F.col("body"), F.lit(r"(?is)(<a\b[^>]*>)"), 1)
    hrefs = F.transform(tags, lambda t: F.coalesce(P.attr(t, "href"), F.lit("")))
    return (b.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
            .select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "href",
                    U.resolve_url(F.col("href"), F.col("url")).alias("resolved")))


def _statistics_sql() -> str:
    from .q_text import _emails_sql, _phones_sql
    raw = D.raw_text("body")
    imgs = (f"len(list_filter(regexp_extract_all(body, {D.q(r'(?is)(<img\b[^>]*>)')}, 1), lambda t: "
            f"coalesce({D.attr('t', 'src')}, '') <> '' OR coalesce({D.attr('t', 'data-src')}, '') <> ''))")
    social = " + ".join(f"len(list_distinct(regexp_extract_all(rawtext, {D.q(p)})))" for _, p in C.SOCIAL)
    ld = (f"len(list_filter(regexp_extract_all(html, {D.q(P.JSON_LD_BLOCK)}, 1), "
          f"lambda j: json_valid(trim(j)) AND trim(j) <> ''))")
    og = (f"len(list_filter(regexp_extract_all(body, {D.q(r'(?is)(<meta\b[^>]*>)')}, 1), lambda t: "
          f"coalesce(nullif({D.attr('t', 'name')}, ''), {D.attr('t', 'property')}, '') LIKE 'og:%' "
          f"AND coalesce({D.attr('t', 'content')}, '') <> ''))")
    structured = (f"({ld} > 0 OR {og} > 0 OR regexp_matches(html, {D.q(P.MICRODATA_PROP)}) "
                  f"OR regexp_matches(html, {D.q(P.MICROFORMAT_PROP)}) "
                  f"OR regexp_matches(html, {D.q(r'(?is)\sclass\s*=\s*["' + chr(39) + r'](?:[^"' + chr(39) + r']*\s)?(h-[a-z0-9-]+)')}))")
    heads = " + ".join(f"len({D.heading_texts('body', k)})" for k in range(1, 7))
    return f"""
WITH b AS (SELECT page_id, url, html, {D.body('html')} AS body FROM pages),
c AS (SELECT *, {raw} AS rawtext FROM b),
s AS (SELECT page_id, len({D.paragraph_texts('body')}) AS total_paragraphs, {heads} AS total_headings,
             {imgs} AS total_images, len({_first_by_url(_links_sql('body', 'url'))}) AS total_links,
             len({_emails_sql('rawtext')}) AS email_count, len({_phones_sql('rawtext')}) AS phone_count,
             length({D.spaced_text('body')}) AS content_length, {structured} AS has_structured_data,
             {social} AS social_media_count FROM c)
SELECT page_id, CAST(total_paragraphs AS INT) AS total_paragraphs, CAST(total_headings AS INT) AS total_headings,
       CAST(total_images AS INT) AS total_images, CAST(total_links AS INT) AS total_links,
       email_count > 0 OR phone_count > 0 AS has_contacts, CAST(content_length AS INT) AS content_length,
       has_structured_data, CAST(email_count AS INT) AS email_count, CAST(phone_count AS INT) AS phone_count,
       CAST(social_media_count AS INT) AS social_media_count
FROM s"""


@register("page_statistics", oracle=_statistics_sql())
def page_statistics(spark, sf_dir):
    rec = OP.extract_pages(tables.pages(spark, sf_dir))
    return rec.select("page_id", "statistics.*")


@register("domain_rollup", oracle=f"""
WITH b AS (SELECT page_id, url, {D.body('html')} AS body, {D.body('html', True)} AS full_body FROM pages)
SELECT {D.registrable_domain('url')} AS domain, count(*) AS pages,
       CAST(sum(len({D.paragraph_texts('body')})) AS BIGINT) AS paragraphs,
       CAST(sum(len(list_filter(string_split({D.spaced_text('body')}, ' '), lambda w: w <> ''))) AS BIGINT) AS words,
       CAST(sum(len({_first_by_url(_links_sql('full_body', 'url'))})) AS BIGINT) AS links
FROM b GROUP BY 1""")
def domain_rollup(spark, sf_dir):
    return OP.domain_rollup(tables.pages(spark, sf_dir))


@register("domain_link_targets", oracle=f"""
WITH b AS (SELECT url, {D.body('html', True)} AS full_body FROM pages),
u AS (SELECT DISTINCT {D.registrable_domain('url')} AS domain, unnest(list_transform({_first_by_url(_links_sql('full_body', 'url'))}, lambda r: r.url)) AS target FROM b),
x AS (SELECT *, regexp_extract(domain, '^[^.]*\\.(.*)$', 1) AS suffix FROM u)
SELECT 'domain' AS level, domain AS name, count(*) AS targets, true AS estimate_close FROM x GROUP BY domain
UNION ALL SELECT 'suffix', suffix, count(DISTINCT target), true FROM x GROUP BY suffix""")
def domain_link_targets(spark, sf_dir):
    """Exact counts, and whether the estimate is within four standard errors of them."""
    out = OP.link_targets(tables.pages(spark, sf_dir))
    close = F.abs(F.col("estimate") - F.col("targets")) <= 4 * 1.04 / 64 * F.col("targets") + 1
    return out.select("level", "name", "targets", close.alias("estimate_close"))


def _contexts_sql(b: str) -> str:
    """EXT6 in DuckDB: the same token fold with list_reduce and an initial state."""
    toks = f"regexp_extract_all({b}, {D.q(P.CONTEXT_TOKENS)}, 0)"
    init = "{'depth': 0, 'stack': []::STRUCT(d INTEGER, t VARCHAR)[], 'ctx': []::VARCHAR[]}"
    heading = (f"{{'depth': acc.depth, 'stack': list_append(acc.stack, {{'d': acc.depth, 't': {D.inner_text('tok')}}}), "
               f"'ctx': acc.ctx}}")
    closing = "{'depth': acc.depth - 1, 'stack': list_filter(acc.stack, lambda e: e.d <= acc.depth - 1), 'ctx': acc.ctx}"
    para = "{'depth': acc.depth, 'stack': acc.stack, 'ctx': list_append(acc.ctx, acc.stack[-1].t)}"
    other = "{'depth': acc.depth + 1, 'stack': acc.stack, 'ctx': acc.ctx}"
    step = (f"lambda acc, tok: CASE WHEN regexp_matches(tok, {D.q(r'(?is)^<h[1-6]\b')}) THEN {heading} "
            f"WHEN starts_with(tok, '</') THEN {closing} "
            f"WHEN regexp_matches(tok, {D.q(r'(?is)^<p\b')}) THEN {para} ELSE {other} END")
    return f"list_reduce({toks}, {step}, {init}).ctx"


def _segments_sql(b: str) -> str:
    marked = D.rr(D.rr(b, P.P_START, "chr(1)"), P.P_END, "chr(2)")
    return f"list_transform(regexp_extract_all({marked}, {D.q(P.SEGMENT)}, 1), lambda s: {D.inner_text('s')})"


@register("page_paragraph_context", oracle=f"""
{BODY_CTE},
x AS (SELECT page_id, {_segments_sql('body')} AS segs, {_contexts_sql('body')} AS ctx FROM b),
y AS (SELECT page_id, list_filter(list_transform(segs, lambda t, i: {{'text': t, 'context': CASE WHEN len(segs) = len(ctx) THEN ctx[i] END}}),
                                  lambda r: length(r.text) >= {P.MIN_PARAGRAPH_LENGTH}) AS recs FROM x)
SELECT page_id, CAST(generate_subscripts(recs, 1) AS BIGINT) AS pos, unnest(recs).context AS context FROM y""")
def page_paragraph_context(spark, sf_dir):
    b = OP.with_body(tables.pages(spark, sf_dir))
    return (b.select("page_id", F.posexplode(P.paragraphs(F.col("body"))).alias("pos", "p"))
            .select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("p.context").alias("context")))
