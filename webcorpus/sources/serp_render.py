"""``serp_captures``: result pages rendered from ``engine_results`` (FIXTURES.md).

The given tables hold no result pages, so captures are rendered with ``concat`` from
the result rows: one page per (query, engine, page_no) of 10 ranks, in each engine's
result layout, with an advert block (skipped by the extractor's advert filter) and
redirect links (Google ``/url?q=``, Yahoo ``/RU=.../RK=``) that the extractor must
unwrap. Ground truth is the rows themselves. Rows without a URL are rendered without a
link, so the extractor drops them, as the original does.

The layouts are hard on purpose: each page uses another one of its engine's container
rules; snippets hold nested elements of the name of their own element, titles inline
markup; an empty container and one without any text stand between the results; and the
page ends with a footer that has a citation, a paragraph and a link of its own, right
after the last container.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 10


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _pct(c):
    """Percent-encode the characters that would end a redirect parameter."""
    out = F.replace(c, F.lit("%"), F.lit("%25"))
    for ch, enc in (("&", "%26"), ("?", "%3F"), ("=", "%3D"), ("#", "%23"), ("/", "%2F"), (":", "%3A")):
        out = F.replace(out, F.lit(ch), F.lit(enc))
    return out


def _thirds(c, name: str, inner: str):
    """The text in three parts, the middle one inside a nested element."""
    n = F.greatest(F.length(c), F.lit(0))
    third = F.floor(n / 3).cast("int")
    a, m, z = F.substring(c, F.lit(1), third), F.substring(c, third + 1, third), F.substring(c, third * 2 + 1, n)
    return F.concat(_esc(a), F.lit(f"<{name} class={inner!r}><b>"), _esc(m), F.lit(f"</b></{name}>"), _esc(z))


# Start and end of a result container, one pair per container rule of the engine.
CONTAINERS = {
    "google": [('<div class="g">', "</div>"), ('<div class="g g-blk">', "</div>"), ('<div data-hveid="CA"><div class="g g-blk">', "</div></div>"),
               ('<div class="Gx5Zad fP1Qef xpd EtOod pkphOe">', "</div>"), ('<div class="Gx5Zad">', "</div>"), ('<div class="tF2Cxc">', "</div>"),
               ('<div data-sokoban-container="x">', "</div>"), ('<div class="N54PNb">', "</div>"), ('<div class="MjjYud">', "</div>"),
               ('<div data-content-feature="1">', "</div>"), ('<div class="hlcw0c">', "</div>")],
    "bing": [('<li class="b_algo">', "</li>"), ('<div class="b_algo">', "</div>"), ('<ol id="b_results"><li class="b_algo">', "</li></ol>"),
             ('<ol id="b_results"><li>', "</li></ol>"), ('<div id="b_results"><ul><li class="b_algo">', "</li></ul></div>")],
    "yahoo": [('<div class="dd algo algo-sr">', "</div>"), ('<ul><li class="algo">', "</li></ul>"), ('<div class="algo-sr">', "</div>"), ('<div data-uuid="7">', "</div>"),
              ('<ol class="searchCenterMiddle"><li>', "</li></ol>"), ('<div class="Sr">', "</div>")],
    "duckduckgo": [('<div class="result">', "</div>"), ('<div class="results_links">', "</div>"), ('<div class="result results_links">', "</div>")],
}


def _container(engine: str, k: int):
    """Start (0) or end (1) tag of this page's container rule."""
    pairs = F.array(*[F.lit(p[k]) for p in CONTAINERS[engine]])
    return F.element_at(pairs, (F.pmod(F.col("query_id") + F.col("page_no"), F.lit(len(CONTAINERS[engine]))) + 1).cast("int"))


def _block(engine: str):
    t, u = F.concat(F.lit("<em>"), _esc(F.col("title")), F.lit("</em>")), F.col("url")
    has = u.isNotNull()
    start, end = _container(engine, 0), _container(engine, 1)
    if engine == "google":
        href = F.when(F.col("rank") % 5 == 0, F.concat(F.lit("/url?q="), _pct(u), F.lit("&amp;sa=U"))).otherwise(u)
        link = F.when(has, F.concat(F.lit('<a href="'), href, F.lit('"><h3 class="LC20lb">'), t, F.lit("</h3></a>"))) \
            .otherwise(F.concat(F.lit('<h3 class="LC20lb">'), t, F.lit("</h3>")))
        return F.concat(start, F.lit('<div class="yuRUbf"><div>'), link, F.lit('</div></div><div class="VwiC3b">'), _thirds(F.col("snippet"), "div", "lyLwlc"),
                        F.lit("</div><cite>"), F.coalesce(u, F.lit("")), F.lit("</cite>"), end)
    if engine == "bing":
        a = F.when(has, F.concat(F.lit('<a href="'), u, F.lit('">'), t, F.lit("</a>"))).otherwise(t)
        return F.concat(start, F.lit('<h2>'), a, F.lit('</h2><div class="b_caption"><div></div><p>'), _thirds(F.col("snippet"), "span", "algoSlug"),
                        F.lit('</p><div class="b_attribution"><cite>'), F.coalesce(u, F.lit("")), F.lit("</cite></div></div>"), end)
    if engine == "yahoo":
        href = F.when(F.col("rank") % 3 == 0, F.concat(
            F.lit("https://r.search.yahoo.com/_ylt=Aw/RV=2/RE=1/RO=10/RU="), _pct(u), F.lit("/RK=2/RS=ab"))).otherwise(u)
        a = F.when(has, F.concat(F.lit('<a href="'), href, F.lit('">'), t, F.lit("</a>"))).otherwise(t)
        return F.concat(start, F.lit('<h3 class="title">'), a, F.lit('</h3><div class="compText"><div><p class="s-desc">'), _thirds(F.col("snippet"), "span", "fc-falcon"),
                        F.lit('</p></div></div><span class="fz-ms"><span>'), F.coalesce(u, F.lit("")), F.lit("</span></span>"), end)
    a = F.when(has, F.concat(F.lit('<a class="result__a" href="'), u, F.lit('">'), t, F.lit("</a>"))) \
        .otherwise(F.concat(F.lit('<span class="result__a">'), t, F.lit("</span>")))
    return F.concat(start, F.lit('<div class="links_main"><h2 class="result__title">'), a,
                    F.lit('</h2><a class="result__snippet">'), _thirds(F.col("snippet"), "span", "hl"), F.lit("</a></div>"), end)


FOOTER = ('<div class="g"></div><div class="g"><div> <span></span></div></div><footer id="foot"><cite>footer citation</cite>'
          '<p>This footer paragraph is longer than every snippet limit.</p><div class="VwiC3b">Footer text that is not a snippet.</div>'
          '<a href="/preferences">settings</a></footer>')
ADVERTS = {
    "google": '<div class="g commercial-unit" data-text-ad="1"><a href="https://ads.example.com/g">'
              '<h3 class="LC20lb">Sponsored offer today</h3></a><div class="VwiC3b">Advert copy that is long enough.</div></div>',
    "bing": '<li class="b_algo b_ad"><h2><a href="https://ads.example.com/b">Sponsored offer today</a></h2></li>',
    "yahoo": '<div class="dd algo ads"><h3 class="title"><a href="https://ads.example.com/y">Sponsored offer</a></h3></div>',
    "duckduckgo": "",
}


def render_captures(results: DataFrame) -> DataFrame:
    """``serp_captures(query_id, engine, search_type, page_no, html)`` for web results.
    One aggregate per page; blocks are ordered by rank inside the page."""
    web = (results.filter(F.col("type") == "web")
           .withColumn("page_no", F.floor((F.col("rank") - 1) / PAGE_SIZE).cast("int")))
    block = None
    for e in ADVERTS:
        block = F.when(F.col("engine") == e, _block(e)) if block is None else block.when(F.col("engine") == e, _block(e))
    advert = None
    for e, html in ADVERTS.items():
        advert = F.when(F.col("engine") == e, F.lit(html)) if advert is None else advert.when(F.col("engine") == e, F.lit(html))
    pages = (web.withColumn("block", block)
             .groupBy("query_id", "engine", "page_no")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks")))
    return pages.select(
        "query_id", "engine", F.lit("all").alias("search_type"), "page_no",
        F.concat(F.lit('<html><head><title>results</title></head><body><div id="search">'), advert,
                 F.array_join(F.transform("blocks", lambda b: b["block"]), ""),
                 F.lit(f"</div>{FOOTER}</body></html>")).alias("html"))


def _b64url(c):
    """URL-safe base64 without padding (the Bing click-redirect form)."""
    return F.regexp_replace(F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_"), "=+$", "")


def _news_block(engine: str):
    u, t, s = F.col("url"), _esc(F.col("title")), _esc(F.col("snippet"))
    host = F.coalesce(F.regexp_extract(u, "//([^/?#]+)", 1), F.lit(""))
    when = F.concat(F.col("rank").cast("string"), F.lit(" hours ago"))
    if engine == "google":
        href = F.when(F.col("rank") % 4 == 0, F.concat(F.lit("/url?q="), _pct(u), F.lit("&amp;sa=U"))).otherwise(u)
        a = F.when(u.isNotNull(), F.concat(F.lit('<a href="'), href, F.lit('">'))).otherwise(F.lit("<a>"))
        return F.concat(F.lit('<div class="SoaBEf">'), a, F.lit('<div role="heading">'), t,
                        F.lit('</div></a><div class="CEMjEf"><span>'), host, F.lit('</span></div><div class="GI74Re">'),
                        s, F.lit('</div><span class="WG9SHc">'), when, F.lit("</span></div>"))
    if engine == "bing":
        href = F.when(F.col("rank") % 3 == 0, F.concat(F.lit("https://www.bing.com/ck/a?!&amp;&amp;p=ab&amp;u=a1"),
                                                         _b64url(u), F.lit("&amp;ntb=1"))).otherwise(u)
        a = F.when(u.isNotNull(), F.concat(F.lit('<a class="title" href="'), href, F.lit('">'), t, F.lit("</a>"))) \
            .otherwise(F.concat(F.lit('<a class="title">'), t, F.lit("</a>")))
        return F.concat(F.lit('<div class="news-card">'), a, F.lit('<div class="snippet">'), s,
                        F.lit('</div><div class="source"><a>'), host, F.lit('</a></div><span class="time">'), when,
                        F.lit("</span></div>"))
    href = F.when(F.col("rank") % 3 == 0, F.concat(
        F.lit("https://r.search.yahoo.com/_ylt=Aw/RV=2/RE=1/RO=10/RU="), _pct(u), F.lit("/RK=2/RS=ab"))).otherwise(u)
    a = F.when(u.isNotNull(), F.concat(F.lit('<h4><a href="'), href, F.lit('">'), t, F.lit("</a></h4>"))) \
        .otherwise(F.concat(F.lit("<h4>"), t, F.lit("</h4>")))
    return F.concat(F.lit('<div class="dd NewsArticle">'), a, F.lit('<p class="s-desc">'), s,
                    F.lit('</p><span class="s-source">'), host, F.lit('</span><span class="s-time">'), when,
                    F.lit("</span></div>"))


def render_news_captures(results: DataFrame) -> DataFrame:
    """News result pages (EXT23 fixture) of Google, Bing and Yahoo from their rows of
    the result table, with each engine's redirect form on some links."""
    engines = ("google", "bing", "yahoo")
    g = (results.filter(F.col("engine").isin(*engines))
         .withColumn("page_no", F.floor((F.col("rank") - 1) / PAGE_SIZE).cast("int")))
    block = None
    for e in engines:
        block = F.when(F.col("engine") == e, _news_block(e)) if block is None else block.when(F.col("engine") == e, _news_block(e))
    pages = (g.withColumn("block", block).groupBy("query_id", "engine", "page_no")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks")))
    return pages.select("query_id", "engine", F.lit("news").alias("search_type"), "page_no",
                        F.concat(F.lit('<html><body><div id="rso">'),
                                 F.array_join(F.transform("blocks", lambda b: b["block"]), ""),
                                 F.lit("</div></body></html>")).alias("html"))
