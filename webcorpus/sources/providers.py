"""Provider JSON readers (SRC4-SRC7, EXT26): JSON documents in a string column become
rows of the common ``results`` schema with ``from_json`` + ``slice`` + ``transform``
(native, no Python). Invalid JSON parses to null and yields no rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT_TYPE = ("struct<type:string,title:string,url:string,snippet:string,displayed_url:string,"
               "source:string,date:string,image_url:string,thumbnail_url:string,page_url:string,"
               "engine_sources:array<string>,width:int,height:int,duration:string,publisher:string,"
               "published:string,views:bigint,video_source:string>")

SEARXNG_SCHEMA = ("struct<results:array<struct<title:string,url:string,content:string,pretty_url:string,"
                  "engines:array<string>>>>")
BRAVE_SCHEMA = ("struct<results:array<struct<title:string,url:string,description:string,source:string,age:string,"
                "thumbnail:struct<src:string>,meta_url:struct<netloc:string>>>,"
                "web:struct<results:array<struct<title:string,url:string,description:string,"
                "meta_url:struct<netloc:string>>>>>")
LIBRARY_TEXT_SCHEMA = "array<struct<title:string,href:string,link:string,body:string,snippet:string>>"
INSTANT_SCHEMA = ("struct<Abstract:string,AbstractSource:string,AbstractURL:string,Image:string,Heading:string,"
                  "Answer:string,AnswerType:string,Definition:string,DefinitionSource:string,"
                  "RelatedTopics:array<string>,Results:array<struct<Text:string,FirstURL:string>>>")


def _cut(items: Column, most: int | None) -> Column:
    """The first ``most`` items; all without a limit."""
    return items if most is None else F.slice(items, 1, most)


def _result(**fields) -> Column:
    names = ["type", "title", "url", "snippet", "displayed_url", "source", "date", "image_url", "thumbnail_url",
             "page_url", "engine_sources", "width", "height", "duration", "publisher", "published", "views",
             "video_source"]
    cols = [(fields.get(n) if n in fields else F.lit(None)).alias(n) for n in names]
    return F.struct(*cols).cast(RESULT_TYPE)


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def searxng_results(doc: Column, num_results: int | Column) -> Column:
    """SRC4: ``results[:n]`` -> title, url, snippet (content), displayed_url (pretty_url,
    else url), engine_sources."""
    items = F.from_json(doc, SEARXNG_SCHEMA)["results"]
    n = num_results if isinstance(num_results, Column) else F.lit(num_results)
    return F.transform(F.slice(F.coalesce(items, F.array()), 1, n), lambda i: _result(
        type=F.lit("web"), title=_s(i["title"]), url=_s(i["url"]), snippet=_s(i["content"]),
        displayed_url=F.coalesce(i["pretty_url"], i["url"], F.lit("")), source=F.lit("searxng"),
        engine_sources=F.coalesce(i["engines"], F.array().cast("array<string>"))))


def brave_results(doc: Column, search_type: str, num_results: int | None = None) -> Column:
    """SRC5: three layouts. Images and news read ``results``; every other type,
    videos included, reads ``web.results`` (so a videos answer without ``web`` is empty)."""
    d = F.from_json(doc, BRAVE_SCHEMA)
    if search_type == "images":
        return F.transform(_cut(F.coalesce(d["results"], F.array()), num_results), lambda i: _result(
            type=F.lit("image"), image_url=_s(i["url"]), thumbnail_url=_s(i["thumbnail"]["src"]),
            title=_s(i["title"]), page_url=_s(i["source"]), source=F.lit("brave")))
    if search_type == "news":
        return F.transform(_cut(F.coalesce(d["results"], F.array()), num_results), lambda i: _result(
            type=F.lit("news"), title=_s(i["title"]), url=_s(i["url"]), snippet=_s(i["description"]),
            source=_s(i["meta_url"]["netloc"]), date=_s(i["age"])))
    return F.transform(_cut(F.coalesce(d["web"]["results"], F.array()), num_results), lambda i: _result(
        type=F.lit("web"), title=_s(i["title"]), url=_s(i["url"]), snippet=_s(i["description"]),
        displayed_url=_s(i["meta_url"]["netloc"]), source=F.lit("brave")))


def library_text_results(doc: Column) -> Column:
    """SRC6 (text records): url from ``href`` or ``link``, snippet from ``body`` or
    ``snippet``; records without a URL are dropped."""
    items = F.coalesce(F.from_json(doc, LIBRARY_TEXT_SCHEMA), F.array())
    recs = F.transform(items, lambda i: _result(
        type=F.lit("web"), title=_s(i["title"]), url=F.coalesce(i["href"], i["link"], F.lit("")),
        snippet=F.coalesce(i["body"], i["snippet"], F.lit("")), source=F.lit("duckduckgo")))
    return F.filter(recs, lambda r: r["url"] != "")


LIBRARY_NEWS_SCHEMA = ("array<struct<title:string,url:string,link:string,body:string,excerpt:string,"
                       "source:string,date:string>>")
LIBRARY_IMAGE_SCHEMA = ("array<struct<title:string,image:string,thumbnail:string,url:string,width:int,"
                        "height:int>>")
LIBRARY_VIDEO_SCHEMA = ("array<struct<title:string,content:string,url:string,images:struct<large:string>,"
                        "duration:string,publisher:string,published:string,statistics:struct<viewCount:bigint>>>")


def library_news_results(doc: Column) -> Column:
    """SRC6 (news records): url from ``url`` or ``link``, snippet from ``body`` or
    ``excerpt``, source and date as given."""
    items = F.coalesce(F.from_json(doc, LIBRARY_NEWS_SCHEMA), F.array())
    return F.transform(items, lambda i: _result(
        type=F.lit("news"), title=_s(i["title"]), url=F.coalesce(i["url"], i["link"], F.lit("")),
        snippet=F.coalesce(i["body"], i["excerpt"], F.lit("")), source=_s(i["source"]), date=_s(i["date"])))


def library_image_results(doc: Column) -> Column:
    """SRC6 (image records): image, thumbnail (else the image), page url, width and
    height as integers (0 when absent)."""
    items = F.coalesce(F.from_json(doc, LIBRARY_IMAGE_SCHEMA), F.array())
    return F.transform(items, lambda i: _result(
        type=F.lit("image"), image_url=_s(i["image"]), thumbnail_url=F.coalesce(i["thumbnail"], i["image"], F.lit("")),
        title=_s(i["title"]), page_url=_s(i["url"]), width=F.coalesce(i["width"], F.lit(0)),
        height=F.coalesce(i["height"], F.lit(0)), source=F.lit("duckduckgo")))


def library_video_results(doc: Column) -> Column:
    """SRC6 (video records): url from ``content`` or ``url``, thumbnail from
    ``images.large``, view count from ``statistics.viewCount`` (0 when absent)."""
    items = F.coalesce(F.from_json(doc, LIBRARY_VIDEO_SCHEMA), F.array())
    return F.transform(items, lambda i: _result(
        type=F.lit("video"), title=_s(i["title"]), url=F.coalesce(i["content"], i["url"], F.lit("")),
        thumbnail_url=_s(i["images"]["large"]), duration=_s(i["duration"]), publisher=_s(i["publisher"]),
        published=_s(i["published"]), views=F.coalesce(i["statistics"]["viewCount"], F.lit(0).cast("bigint")),
        source=F.lit("duckduckgo")))


def instant_answer(doc: Column, topic_limit: int | None = None) -> Column:
    """SRC7: nine renamed fields; related topics that are objects with text (the original
    keeps the first 10); results as (text, url)."""
    d = F.from_json(doc, INSTANT_SCHEMA)
    topics = F.transform(F.coalesce(d["RelatedTopics"], F.array().cast("array<string>")),
                         lambda t: F.from_json(t, "struct<Text:string,FirstURL:string>"))
    topics = F.filter(topics, lambda t: t.isNotNull() & (F.coalesce(t["Text"], F.lit("")) != ""))
    pair = "array<struct<text:string,url:string>>"
    return F.struct(
        _s(d["Abstract"]).alias("abstract"), _s(d["AbstractSource"]).alias("abstract_source"),
        _s(d["AbstractURL"]).alias("abstract_url"), _s(d["Image"]).alias("image"),
        _s(d["Heading"]).alias("heading"), _s(d["Answer"]).alias("answer"),
        _s(d["AnswerType"]).alias("answer_type"), _s(d["Definition"]).alias("definition"),
        _s(d["DefinitionSource"]).alias("definition_source"),
        _cut(F.transform(topics, lambda t: F.struct(_s(t["Text"]).alias("text"), _s(t["FirstURL"]).alias("url"))), topic_limit).cast(pair).alias("related_topics"),
        F.transform(F.coalesce(d["Results"], F.array()), lambda r: F.struct(
            _s(r["Text"]).alias("text"), _s(r["FirstURL"]).alias("url"))).cast(pair).alias("results"),
    ).alias("instant_answer")


def render_searxng(results) -> "DataFrame":  # noqa: F821
    """JSON captures in the SearXNG layout, one per (query, engine, page of 10 ranks),
    rendered from result rows with ``to_json`` (fixture for the round trip)."""
    pages = (results.withColumn("page_no", F.floor((F.col("rank") - 1) / 10).cast("int"))
             .groupBy("query_id", "engine", "page_no")
             .agg(F.array_sort(F.collect_list(F.struct(
                 "rank", "title", "url", F.col("snippet").alias("content"), F.col("url").alias("pretty_url"),
                 F.array(F.col("engine")).alias("engines")))).alias("items")))
    return pages.select("query_id", "engine", "page_no", F.to_json(F.struct(
        F.transform("items", lambda i: i.dropFields("rank")).alias("results"))).alias("json"))


# --- image result pages (EXT24) ---------------------------------------------------
IMAGE_URL = r"https?://[^\"']+\.(?:jpg|jpeg|png|gif|webp)"
BING_IMAGE_META = "struct<murl:string,turl:string,t:string,purl:string>"


def google_image_results(raw_html: Column, limit: int | None = None) -> Column:
    """EXT24 (Google): image URLs inside ``AF_initDataCallback`` scripts, those with
    'encrypted' or 'gstatic' dropped; without any, the ``img`` tags with an http src not
    pointing at google and not inline data. The original cuts each script's URLs and the
    tags at 50 before it filters: ``limit``."""
    from ..functions.page import attr
    scripts = F.regexp_extract_all(raw_html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), 1)
    found = F.flatten(F.transform(F.filter(scripts, lambda s: s.contains("AF_initDataCallback")),
                                  lambda s: _cut(F.regexp_extract_all(s, F.lit(IMAGE_URL), 0), limit)))
    kept = F.filter(found, lambda u: ~F.lower(u).contains("encrypted") & ~F.lower(u).contains("gstatic"))
    from_scripts = F.transform(kept, lambda u: _result(type=F.lit("image"), image_url=u, thumbnail_url=u,
                                                       title=F.lit(""), page_url=F.lit(""), source=F.lit("google")))
    tags = _cut(F.regexp_extract_all(
        raw_html, F.lit(r"(?is)(<img\b[^>]*\ssrc\s*=\s*[\"']?[^\"'>\s]*http[^>]*>)"), 1), limit)
    imgs = F.transform(tags, lambda t: F.struct(
        F.coalesce(F.when(F.coalesce(attr(t, "src"), F.lit("")) != "", attr(t, "src")), attr(t, "data-src"),
                   F.lit("")).alias("src"), F.coalesce(attr(t, "alt"), F.lit("")).alias("alt")))
    from_tags = F.transform(
        F.filter(imgs, lambda i: (i["src"] != "") & ~i["src"].contains("google") & ~i["src"].startswith("data:")),
        lambda i: _result(type=F.lit("image"), image_url=i["src"], thumbnail_url=i["src"], title=i["alt"],
                          page_url=F.lit(""), source=F.lit("google")))
    return F.when(F.size(from_scripts) > 0, from_scripts).otherwise(from_tags)


def bing_image_results(raw_html: Column, limit: int | None = None) -> Column:
    """EXT24 (Bing): ``a.iusc`` items in page order; metadata from the JSON in the
    ``m`` attribute (murl, turl, t, purl; invalid JSON skipped), else the inner
    ``img`` (src, alt) with the item's href as page; first 50 results."""
    from ..functions.page import attr
    items = F.regexp_extract_all(raw_html, F.lit(
        r"(?is)(<a\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?iusc(?:\s[^\"']*)?[\"'])[^>]*>.*?</a\s*>)"), 1)

    def one(item):
        start = F.regexp_extract(item, r"(?is)^(<a\b[^>]*>)", 1)
        m = F.coalesce(attr(start, "m"), F.lit(""))
        meta = F.from_json(m, BING_IMAGE_META)
        img = F.regexp_extract(item, r"(?is)(<img\b[^>]*>)", 1)
        from_m = F.when(F.try_parse_json(m).isNotNull(), _result(
            type=F.lit("image"), image_url=_s(meta["murl"]), thumbnail_url=_s(meta["turl"]), title=_s(meta["t"]),
            page_url=_s(meta["purl"]), source=F.lit("bing")))
        from_img = F.when(img != "", _result(
            type=F.lit("image"), image_url=F.coalesce(attr(img, "src"), F.lit("")),
            thumbnail_url=F.coalesce(attr(img, "src"), F.lit("")), title=F.coalesce(attr(img, "alt"), F.lit("")),
            page_url=F.coalesce(attr(start, "href"), F.lit("")), source=F.lit("bing")))
        return F.when(m != "", from_m).otherwise(from_img)

    return _cut(F.filter(F.transform(items, one), lambda r: r.isNotNull()), limit)


def render_bing_images(results) -> "DataFrame":  # noqa: F821
    """Bing image pages (EXT24 fixture): one ``a.iusc`` per image row with its
    metadata as HTML-escaped JSON in ``m``; one page per (query, 10 ranks)."""
    img = results.filter((F.col("engine") == "bing") & (F.col("type") == "images"))
    meta = F.to_json(F.struct(F.col("image_url").alias("murl"), F.col("image_url").alias("turl"),
                              F.col("title").alias("t"), F.col("url").alias("purl")))
    esc = F.replace(F.replace(F.replace(meta, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")),
                    F.lit("<"), F.lit("&lt;"))
    block = F.concat(F.lit('<div class="imgpt"><a class="iusc" m="'), esc, F.lit('" href="/images/x">'),
                     F.lit('<img src="https://tse.example.net/th.jpg" alt="thumb"></a></div>'))
    pages = (img.withColumn("page_no", F.floor((F.col("rank") - 1) / 10).cast("int"))
             .groupBy("query_id", "engine", "page_no")
             .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks")))
    return pages.select("query_id", "engine", "page_no",
                        F.concat(F.lit("<html><body>"), F.array_join(F.transform("blocks", lambda b: b["block"]), ""),
                                 F.lit("</body></html>")).alias("html"))


# --- video result pages (EXT25) ---------------------------------------------------
BING_ORIGIN = "https://www.bing.com"


def bing_video_results(raw_html: Column) -> Column:
    """EXT25 (Bing): ``div.mc_vtvc`` / ``div.dg_u`` items in page order; title from the
    first link's title attribute, else its text; root-relative links made absolute on
    the Bing origin; duration, thumbnail and views from their first elements; items
    without a title dropped. Items run from one container start tag to the next."""
    from ..functions.page import attr
    from ..functions.serp import _segments
    from ..functions.text import ANY_TAG, clean_text, decode_entities

    def text(html):
        return clean_text(decode_entities(F.regexp_replace(html, ANY_TAG, "")))

    def one(seg):
        a_tag = F.regexp_extract(seg, r"(?is)(<a\b[^>]*>)", 1)
        a_inner = F.regexp_extract(seg, r"(?is)<a\b[^>]*>(.*?)(?:</a\s*>|$)", 1)
        t_attr = F.coalesce(attr(a_tag, "title"), F.lit(""))
        title = clean_text(F.when(t_attr != "", t_attr).otherwise(decode_entities(F.regexp_replace(a_inner, ANY_TAG, ""))))
        href = F.coalesce(attr(a_tag, "href"), F.lit(""))
        url = F.when(href.startswith("/"), F.concat(F.lit(BING_ORIGIN), href)).otherwise(href)
        dur = F.regexp_extract(seg, r"(?is)<span\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?(?:mc_vtvc_meta_dur|duration)"
                                    r"(?:\s[^\"']*)?[\"'])[^>]*>(.*?)</span\s*>", 1)
        views = F.regexp_extract(seg, r"(?is)<span\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?mc_vtvc_meta_row_pri"
                                      r"(?:\s[^\"']*)?[\"'])[^>]*>(.*?)</span\s*>", 1)
        img = F.regexp_extract(seg, r"(?is)(<img\b[^>]*>)", 1)
        return F.when(a_tag != "", F.struct(
            F.lit("video").alias("type"), title.alias("title"), url.alias("url"),
            F.coalesce(attr(img, "src"), F.lit("")).alias("thumbnail"), text(dur).alias("duration"),
            text(views).alias("views"), F.lit("bing").alias("source")))

    items = F.transform(_segments(raw_html, ("div", "mc_vtvc|dg_u")), one)
    return F.filter(items, lambda r: r.isNotNull() & (r["title"] != ""))


def yahoo_image_results(raw_html: Column, limit: int | None = None) -> Column:
    """EXT24 (Yahoo): every ``img`` inside ``li.ld`` / ``li[data-pos]`` items; image from
    data-src, else src (empty or 'spacer' images skipped); title from alt; page URL from
    the enclosing link, redirect unwrapped; first 50."""
    from ..functions.page import attr
    from ..functions.serp import _segments
    from ..functions.urls import unwrap_yahoo_redirect
    pair = r"(?is)(?:(<a\b[^>]*>)(?:(?!</a\s*>).)*?)?(<img\b[^>]*>)"

    def per_item(seg):
        anchors = F.regexp_extract_all(seg, F.lit(pair), 1)
        imgs = F.regexp_extract_all(seg, F.lit(pair), 2)
        return F.arrays_zip(anchors.alias("a"), imgs.alias("img"))

    items = F.flatten(F.transform(_segments(raw_html, ("li", "ld")), per_item))
    items = F.concat(items, F.flatten(F.transform(_segments(raw_html, ("li", "[data-pos]")), per_item)))

    def one(z):
        src = F.coalesce(F.when(F.coalesce(attr(z["img"], "data-src"), F.lit("")) != "", attr(z["img"], "data-src")),
                         attr(z["img"], "src"), F.lit(""))
        page = unwrap_yahoo_redirect(F.coalesce(attr(z["a"], "href"), F.lit("")))
        return F.when((src != "") & ~src.contains("spacer"), _result(
            type=F.lit("image"), image_url=src, thumbnail_url=src, title=F.coalesce(attr(z["img"], "alt"), F.lit("")),
            page_url=page, source=F.lit("yahoo")))

    return _cut(F.filter(F.transform(items, one), lambda r: r.isNotNull()), limit)


def google_video_results(raw_html: Column) -> Column:
    """EXT25 (Google): ``div.g`` / ``div[data-hveid]`` items with an ``h3`` title; the
    first link to youtube / video / watch, else the first link; redirect unwrapped and
    required to start with http; duration and snippet from their elements."""
    from ..functions.page import attr
    from ..functions.serp import _segments
    from ..functions.text import ANY_TAG, clean_text, decode_entities
    from ..functions.urls import unwrap_google_redirect

    def text(h):
        return clean_text(decode_entities(F.regexp_replace(h, ANY_TAG, "")))

    def one(seg):
        h3 = F.regexp_extract(seg, r"(?is)<h3\b[^>]*>(.*?)</h3\s*>", 1)
        video_a = F.regexp_extract(seg, r"(?is)(<a\b(?=[^>]*\shref\s*=\s*[\"']?[^\"'>]*(?:youtube|video|watch))[^>]*>)", 1)
        any_a = F.regexp_extract(seg, r"(?is)(<a\b[^>]*>)", 1)
        a = F.when(video_a != "", video_a).otherwise(any_a)
        url = unwrap_google_redirect(F.coalesce(attr(a, "href"), F.lit("")))
        dur = F.coalesce(
            F.when(seg.rlike(r"(?is)<div\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?J1mWY(?:\s[^\"']*)?[\"'])"),
                   text(F.regexp_extract(seg, r"(?is)<div\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?J1mWY(?:\s[^\"']*)?[\"'])[^>]*>(.*?)</div\s*>", 1))),
            F.when(seg.rlike(r"(?is)<span\b(?=[^>]*\sclass\s*=\s*[\"'][^\"']*duration)"),
                   text(F.regexp_extract(seg, r"(?is)<span\b(?=[^>]*\sclass\s*=\s*[\"'][^\"']*duration)[^>]*>(.*?)</span\s*>", 1))),
            F.lit(""))
        snip = text(F.regexp_extract(seg, r"(?is)<div\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?VwiC3b(?:\s[^\"']*)?[\"'])[^>]*>(.*?)</div\s*>", 1))
        ok = seg.rlike(r"(?is)<h3\b") & (a != "") & url.startswith("http")
        return F.when(ok, _result(type=F.lit("video"), title=text(h3), url=url, snippet=snip, duration=dur,
                                  source=F.lit("google")))

    return F.filter(F.transform(_segments(raw_html, ("div", "g")), one), lambda r: r.isNotNull())


def _class_el(tag: str | None, cls: str) -> str:
    """Regex: start tag (any tag when None) carrying a class token, then inner html."""
    t = tag or "[A-Za-z][A-Za-z0-9]*"
    return (rf"(?is)<{t}\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?{cls}(?:\s[^\"']*)?[\"'])[^>]*>(.*?)"
            rf"</[A-Za-z][A-Za-z0-9]*\s*>")


def yahoo_video_results(raw_html: Column) -> Column:
    """EXT25 (Yahoo): ``li.vr`` / ``div[data-uuid]`` items; link ``a.vr-title`` else the
    first link; title from its text, else its title attribute; redirect unwrapped;
    duration, thumbnail and video source from their first elements."""
    from ..functions.page import attr
    from ..functions.serp import _segments
    from ..functions.text import ANY_TAG, clean_text, decode_entities
    from ..functions.urls import unwrap_yahoo_redirect

    def text(h):
        return clean_text(decode_entities(F.regexp_replace(h, ANY_TAG, "")))

    def first_of(seg, pats):
        return F.coalesce(*[F.when(seg.rlike(p), text(F.regexp_extract(seg, p, 1))) for p in pats], F.lit(""))

    def one(seg):
        titled = r"(?is)(<a\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?vr-title(?:\s[^\"']*)?[\"'])[^>]*>)(.*?)</a\s*>"
        plain = r"(?is)(<a\b[^>]*>)(.*?)</a\s*>"
        use_t = seg.rlike(titled)
        a_tag = F.when(use_t, F.regexp_extract(seg, titled, 1)).otherwise(F.regexp_extract(seg, plain, 1))
        a_txt = F.when(use_t, F.regexp_extract(seg, titled, 2)).otherwise(F.regexp_extract(seg, plain, 2))
        title = F.when(text(a_txt) != "", text(a_txt)).otherwise(clean_text(F.coalesce(attr(a_tag, "title"), F.lit(""))))
        img = F.regexp_extract(seg, r"(?is)(<img\b[^>]*>)", 1)
        rec = _result(type=F.lit("video"), title=title,
                      url=unwrap_yahoo_redirect(F.coalesce(attr(a_tag, "href"), F.lit(""))),
                      thumbnail_url=F.coalesce(attr(img, "src"), F.lit("")),
                      duration=first_of(seg, [_class_el("span", "v-time"), _class_el(None, "duration")]),
                      video_source=first_of(seg, [_class_el("span", "v-source"), _class_el(None, "source")]),
                      source=F.lit("yahoo"))
        return F.when((a_tag != "") & (title != ""), rec)

    items = F.concat(F.transform(_segments(raw_html, ("li", "vr")), one),
                     F.transform(_segments(raw_html, ("div", "[data-uuid]")), one))
    return F.filter(items, lambda r: r.isNotNull())


def duckduckgo_news_results(raw_html: Column) -> Column:
    """EXT23 (DuckDuckGo HTML, news): like the web results (``a.result__a`` or ``h2 a``,
    snippet element, no de-duplication), typed news, with the source taken from
    ``.result__extras__url`` when present."""
    from ..functions.page import attr
    from ..functions.serp import _segments
    from ..functions.text import ANY_TAG, clean_text, decode_entities

    def text(h):
        return clean_text(decode_entities(F.regexp_replace(h, ANY_TAG, "")))

    def one(seg):
        ra = r"(?is)(<a\b(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?result__a(?:\s[^\"']*)?[\"'])[^>]*>)(.*?)</a\s*>"
        h2a = r"(?is)<h2\b[^>]*>.*?(<a\b[^>]*>)(.*?)</a\s*>"
        use_ra = seg.rlike(ra)
        tag = F.when(use_ra, F.regexp_extract(seg, ra, 1)).otherwise(F.regexp_extract(seg, h2a, 1))
        title = text(F.when(use_ra, F.regexp_extract(seg, ra, 2)).otherwise(F.regexp_extract(seg, h2a, 2)))
        url = F.coalesce(attr(tag, "href"), F.lit(""))
        snip_pat = _class_el(None, "result__snippet")
        extras = _class_el(None, "result__extras__url")
        rec = _result(type=F.lit("news"), title=title, url=url,
                      snippet=F.when(seg.rlike(snip_pat), text(F.regexp_extract(seg, snip_pat, 1))).otherwise(F.lit("")),
                      source=F.when(seg.rlike(extras), text(F.regexp_extract(seg, extras, 1)))
                      .otherwise(F.lit("duckduckgo")))
        return F.when((tag != "") & (title != "") & (url != ""), rec)

    return F.filter(F.transform(_segments(raw_html, ("div", "result|results_links")), one),
                    lambda r: r.isNotNull())
