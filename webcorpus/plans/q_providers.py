"""Provider answers rendered from the result table, for every query and engine, and read
back (SRC5-7, EXT24-25), page requests with parts left out (PRJ4), named engine and
alternative provider (WIN2, WIN4). The oracles state the expected rows from the result
table. Limits that the original has are passed where its results are claimed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import federate as FE
from ..operators import pages as OP
from ..sources import derived, tables
from ..sources import providers as PV
from . import duck as D
from .catalog import register
from .q_federate import CFG, DAY
from .q_service import etype_sql

RESULTS = derived.duck_cte("engine_results")
FIELDS = ("type", "title", "url", "snippet", "displayed_url", "source", "date", "image_url", "thumbnail_url", "page_url")


def _documents(spark, sf_dir, kinds: int, item):
    """(query_id, engine, kind, items): the ranked results of each query and engine, as
    the structs that ``item`` names by kind."""
    rows = derived.view(spark, sf_dir, "engine_results").withColumn("kind", F.pmod("query_id", F.lit(kinds)))
    return rows.groupBy("query_id", "engine", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", *item))).alias("items"))


def _listed(docs, result, columns=FIELDS):
    out = docs.select("query_id", "engine", F.posexplode(result).alias("p", "r"))
    return out.select("query_id", "engine", (F.col("p") + 1).cast("int").alias("pos"), *[F.col(f"r.{c}").alias(c) for c in columns])


POS = "CAST(row_number() OVER (PARTITION BY query_id, engine ORDER BY rank) AS INT) AS pos"
TITLE, LINK, SNIPPET = "coalesce(title, '')", "coalesce(url, '')", "coalesce(snippet, '')"
HOST = "regexp_extract(url, '//([^/?#]+)', 1)"


@register("provider_brave", oracle=f"""
{RESULTS}, k AS (SELECT *, query_id % 3 AS kind, {POS}, {TITLE} AS t, {LINK} AS u, {SNIPPET} AS s, coalesce({HOST}, '') AS h FROM engine_results)
SELECT query_id, engine, pos, ['web', 'news', 'image'][kind + 1] AS type, t AS title, CASE WHEN kind < 2 THEN u END AS url, CASE WHEN kind < 2 THEN s END AS snippet,
       CASE WHEN kind = 0 THEN h END AS displayed_url, CASE WHEN kind = 1 THEN h ELSE 'brave' END AS source, CASE WHEN kind = 1 THEN rank || ' days' END AS date,
       CASE WHEN kind = 2 THEN u END AS image_url, CASE WHEN kind = 2 THEN coalesce(image_url, '') END AS thumbnail_url, CASE WHEN kind = 2 THEN h END AS page_url FROM k""")
def provider_brave(spark, sf_dir):
    """SRC5: web, news or images by query, whole answers."""
    host = F.regexp_extract("url", "//([^/?#]+)", 1)
    meta = F.struct(host.alias("netloc")).alias("meta_url")
    docs = _documents(spark, sf_dir, 3, ["title", "url", F.col("snippet").alias("description"), meta, F.concat(F.col("rank").cast("string"), F.lit(" days")).alias("age"),
                                         F.struct(F.col("image_url").alias("src")).alias("thumbnail"), host.alias("source")])
    lists = F.transform("items", lambda i: i.dropFields("rank"))
    json = F.when(F.col("kind") == 0, F.to_json(F.struct(F.struct(lists.alias("results")).alias("web")))).otherwise(F.to_json(F.struct(lists.alias("results"))))
    docs = docs.select("query_id", "engine", "kind", json.alias("json"))
    doc = F.col("json")
    return _listed(docs, F.when(F.col("kind") == 0, PV.brave_results(doc, "all")).when(F.col("kind") == 1, PV.brave_results(doc, "news")).otherwise(PV.brave_results(doc, "images")))


@register("provider_library_records", oracle=f"""
{RESULTS}, k AS (SELECT *, query_id % 4 AS kind, {TITLE} AS t, {LINK} AS u, {SNIPPET} AS s FROM engine_results),
f AS (SELECT *, {POS} FROM k WHERE kind <> 0 OR u <> '')
SELECT query_id, engine, pos, ['web', 'news', 'image', 'video'][kind + 1] AS type, t AS title, CASE WHEN kind <> 2 THEN u END AS url, CASE WHEN kind < 2 THEN s END AS snippet,
       NULL::VARCHAR AS displayed_url, CASE WHEN kind = 1 THEN engine ELSE 'duckduckgo' END AS source, CASE WHEN kind = 1 THEN 'day ' || rank END AS date,
       CASE WHEN kind = 2 THEN coalesce(image_url, '') END AS image_url, CASE WHEN kind = 2 THEN coalesce(image_url, '') WHEN kind = 3 THEN u END AS thumbnail_url,
       CASE WHEN kind = 2 THEN u END AS page_url, CASE WHEN kind = 2 THEN 0 END AS width, CASE WHEN kind = 2 THEN CAST(rank * 10 AS INT) END AS height,
       CASE WHEN kind = 3 THEN '0:' || rank END AS duration, CASE WHEN kind = 3 THEN CAST(rank AS BIGINT) END AS views FROM f""")
def provider_library_records(spark, sf_dir):
    """SRC6: text, news, image and video records by query; each key under its other name
    in every second record."""
    odd = F.col("rank") % 2 == 1

    def either(name, a, b):
        return [F.when(odd, F.col(name)).alias(a), F.when(~odd, F.col(name)).alias(b)]
    docs = _documents(spark, sf_dir, 4, [
        F.col("title").alias("title"), F.col("url").alias("_url"), *either("url", "href", "link"), *either("snippet", "body", "snippet"), F.col("engine").alias("source"),
        F.concat(F.lit("day "), F.col("rank").cast("string")).alias("date"), F.col("image_url").alias("image"), (F.col("rank") * 10).alias("height"), F.when(odd, F.col("url")).alias("content"),
        F.when(~odd, F.col("url")).alias("_even"), F.struct(F.col("url").alias("large")).alias("images"), F.concat(F.lit("0:"), F.col("rank").cast("string")).alias("duration"),
        F.struct(F.col("rank").cast("long").alias("viewCount")).alias("statistics")])

    def json(*fields):
        return F.to_json(F.transform("items", lambda i: F.struct(*[i[a].alias(b) for a, b in fields])))
    text = json(("title", "title"), ("href", "href"), ("link", "link"), ("body", "body"), ("snippet", "snippet"))
    news = json(("title", "title"), ("href", "url"), ("link", "link"), ("body", "body"), ("snippet", "excerpt"), ("source", "source"), ("date", "date"))
    image = json(("title", "title"), ("image", "image"), ("_url", "url"), ("height", "height"))
    video = json(("title", "title"), ("content", "content"), ("_even", "url"), ("images", "images"), ("duration", "duration"), ("statistics", "statistics"))
    doc = F.when(F.col("kind") == 0, text).when(F.col("kind") == 1, news).when(F.col("kind") == 2, image).otherwise(video)
    docs = docs.select("query_id", "engine", "kind", doc.alias("json"))
    doc = F.col("json")
    found = F.when(F.col("kind") == 0, PV.library_text_results(doc)).when(F.col("kind") == 1, PV.library_news_results(doc)).when(F.col("kind") == 2, PV.library_image_results(doc)) \
        .otherwise(PV.library_video_results(doc))
    return _listed(docs, found, (*FIELDS, "width", "height", "duration", "views"))


@register("provider_instant_answer", oracle=f"""
{RESULTS}, k AS (SELECT *, {TITLE} AS t, {LINK} AS u, row_number() OVER (PARTITION BY query_id, engine ORDER BY rank) AS i FROM engine_results),
top AS (SELECT query_id, engine, row_number() OVER (PARTITION BY query_id, engine ORDER BY rank) AS pos, t, u FROM k WHERE t <> '' AND rank % 5 <> 0),
h AS (SELECT query_id, engine, max(t) FILTER (WHERE i = 1) AS heading, max(u) FILTER (WHERE i = 1) AS abstract_url, count(*) AS results FROM k GROUP BY 1, 2)
SELECT h.query_id, h.engine, heading, abstract_url, results, CAST(pos AS INT) AS pos, top.t AS topic, top.u AS topic_url
FROM h JOIN top ON h.query_id = top.query_id AND h.engine = top.engine WHERE pos <= 10""")
def provider_instant_answer(spark, sf_dir):
    """SRC7: an answer per query and engine; every fifth topic is a group without a text
    of its own, which is passed over. The original keeps ten topics."""
    docs = _documents(spark, sf_dir, 1, ["title", "url"])
    group = F.struct(F.lit("group").alias("Name"))
    topics = F.transform("items", lambda i: F.when(i["rank"] % 5 == 0, F.to_json(group)).otherwise(F.to_json(F.struct(i["title"].alias("Text"), i["url"].alias("FirstURL")))))
    body = F.to_json(F.struct(F.col("items")[0]["title"].alias("Heading"), F.col("items")[0]["url"].alias("AbstractURL"), F.transform("items", lambda i: F.struct(i["title"].alias("Text"), i["url"].alias("FirstURL"))).alias("Results")))
    # topics of both shapes in one list
    doc = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(', "RelatedTopics": ['), F.array_join("topics", ", "), F.lit("]}"))
    docs = docs.select("query_id", "engine", body.alias("j"), topics.alias("topics")).select("query_id", "engine", PV.instant_answer(doc, topic_limit=10).alias("a"))
    out = docs.select("query_id", "engine", F.col("a.heading").alias("heading"), F.col("a.abstract_url").alias("abstract_url"), F.size("a.results").cast("long").alias("results"),
                      F.posexplode("a.related_topics").alias("p", "r"))
    return out.select("query_id", "engine", "heading", "abstract_url", "results", (F.col("p") + 1).cast("int").alias("pos"), F.col("r.text").alias("topic"), F.col("r.url").alias("topic_url"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@register("serp_videos_roundtrip", oracle=f"""
{RESULTS}, k AS (SELECT *, {D.clean('title')} AS t FROM engine_results WHERE engine IN ('bing', 'yahoo') AND url IS NOT NULL)
SELECT query_id, engine, {POS}, t AS title, CASE WHEN engine = 'bing' AND rank % 2 = 0 THEN 'https://www.bing.com/videos/' || rank ELSE url END AS url, '1:' || rank AS duration, 'https://t.example.org/' || rank AS thumbnail
FROM k WHERE t <> ''""")
def serp_videos_roundtrip(spark, sf_dir):
    """EXT25: video pages of two layouts; root-relative links are made absolute on the
    first's origin, redirects of the second are unwrapped."""
    from ..sources.serp_render import _pct
    rank = F.col("rank").cast("string")
    wrapped = F.concat(F.lit("https://r.search.yahoo.com/_ylt=A/RU="), _pct(F.col("url")), F.lit("/RK=2/RS=a"))
    href = F.when((F.col("engine") == "bing") & (F.col("rank") % 2 == 0), F.concat(F.lit("/videos/"), rank)).when((F.col("engine") == "yahoo") & (F.col("rank") % 2 == 0), wrapped).otherwise(F.col("url"))
    link = F.concat(F.lit('<a class="vr-title" href="'), href, F.lit('">'), _escaped(F.coalesce("title", F.lit(""))), F.lit('</a><img src="https://t.example.org/'), rank, F.lit('">'))
    bing = F.concat(F.lit('<div class="mc_vtvc">'), link, F.lit('<span class="mc_vtvc_meta_dur">1:'), rank, F.lit("</span></div>"))
    yahoo = F.concat(F.lit('<li class="vr">'), link, F.lit('<span class="v-time">1:'), rank, F.lit("</span></li>"))
    rows = derived.view(spark, sf_dir, "engine_results").where(F.col("engine").isin("bing", "yahoo") & F.col("url").isNotNull())
    blocks = rows.withColumn("block", F.when(F.col("engine") == "bing", bing).otherwise(yahoo)).groupBy("query_id", "engine").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    pages = blocks.select("query_id", "engine", F.concat(F.lit("<html><body>"), F.array_join(F.transform("b", lambda x: x["block"]), ""), F.lit("</body></html>")).alias("html"))
    kind = "array<struct<title:string,url:string,duration:string,thumbnail:string>>"
    of = {"bing": (PV.bing_video_results, "thumbnail"), "yahoo": (PV.yahoo_video_results, "thumbnail_url")}
    lists = {e: _video(f, thumb) for e, (f, thumb) in of.items()}
    found = F.when(F.col("engine") == "bing", lists["bing"].cast(kind)).otherwise(lists["yahoo"].cast(kind))
    return _listed(pages, found, ("title", "url", "duration", "thumbnail"))


def _video(results, thumb: str):
    return F.transform(results(F.col("html")), lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["duration"].alias("duration"), r[thumb].alias("thumbnail")))


@register("page_optional_drops", oracle="""
SELECT page_id, 'final_url,images,language,links,page_id,request_id,status_code,success,title,url' AS everything, 'final_url,language,page_id,request_id,status_code,success,title,url' AS without FROM pages""")
def page_optional_drops(spark, sf_dir):
    """PRJ4: the columns of a record with and without the parts that a request leaves out."""
    pages, fields = tables.pages(spark, sf_dir), ("title", "links", "images", "language")
    full = OP.extract_pages(pages, fields, with_statistics=False)
    less = OP.extract_pages(pages, (*fields, "contacts"), with_statistics=False, extract_contacts=False, extract_links=False, extract_images=False)
    return less.select("page_id", F.lit(",".join(sorted(full.columns))).alias("everything"), F.lit(",".join(sorted(less.columns))).alias("without"))


ASKED_SQL = f"""
{derived.duck_cte('fetch_log')}, {CFG},
l AS (SELECT * REPLACE (CASE WHEN engine = 'yahoo' THEN 'alternative' ELSE engine END AS engine), {DAY} AS day FROM fetch_log),
c AS (SELECT l.*, cfg.engine_no FROM l JOIN cfg ON lower(l.engine) = cfg.engine),
a AS (SELECT * FROM c WHERE engine_no = 5 OR engine_no = (SELECT min(engine_no) FROM c x WHERE x.query_id = c.query_id AND x.day = c.day AND x.engine_no <> 5)),
g AS (SELECT query_id, day, arg_min({{'engine': engine, 'n': n_results}}, (engine_no, ts, request_id)) FILTER (WHERE success AND coalesce(n_results, 0) > 0) AS win,
             arg_max({{'error': error}}, (engine_no, ts, request_id)) AS last FROM a GROUP BY 1, 2),
r AS (SELECT query_id, day, win IS NOT NULL AS success, CASE WHEN win IS NOT NULL THEN win.engine ELSE 'none' END AS engine, CAST(CASE WHEN win IS NOT NULL THEN win.n ELSE 0 END AS INT) AS n_results,
             CASE WHEN win IS NULL THEN coalesce(last.error, 'No results') END AS error FROM g)"""


@register("fallback_named_engine", oracle=f"{ASKED_SQL} SELECT *, CASE WHEN NOT success THEN {etype_sql('error', '0')} END AS error_type FROM r")
def fallback_named_engine(spark, sf_dir):
    """WIN2 + WIN4: fallback switched off, so only the first engine tried answers, but the
    alternative provider (which stands in for the fourth engine here) still comes last."""
    log = derived.view(spark, sf_dir, "fetch_log").withColumn("engine", F.when(F.col("engine") == "yahoo", "alternative").otherwise(F.col("engine")))
    log = log.withColumn("day", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss"))
    return FE.priority_fallback(FE.with_engine_config(log, spark), ["query_id", "day"], enable_fallback=False)
