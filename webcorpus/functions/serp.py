"""Rule-driven record extraction from captured result pages (EXT22, EXT23, EXT26, FLT7-9,
WIN6, DEDUP1, SCL8-10).

Rules are data: per engine an ordered list of container rules, and per record ordered
title, link, snippet and cite rules. They are evaluated over the page's element interval
index (``functions.elements``), so a container, and every element in it, reaches to its
own end tag, whatever is nested in it, and nothing that follows a container leaks into its
record. A rule list is tried in order exactly as the original does: keep the first value
that qualifies, else the value of the last rule that matched; the first container rule
that yields any record wins (WIN6).

A rule is a chain of element rules ``(name or None, *tests)`` as ``elements.select``
reads it (class tokens, ``#id``, attribute tests, negation, ``">"`` for a child). This is
what the result layouts need, not a CSS engine. Records are built in one projection per
page; no rows are exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import elements as E
from .page import ATTR_VALUE
from .text import ANY_TAG, clean_text, decode_entities
from .urls import unwrap_bing_redirect, unwrap_google_redirect, unwrap_yahoo_redirect

SEG = "\u0001"

# --- fixed values -----------------------------------------------------------------
# Chains of element rules, in the order in which they are tried.
GOOGLE_WEB = {
    "containers": [[("div", "g", "!g-blk", "![data-ad-client]")], [("div", "g")], [("div", "[data-hveid]"), ">", ("div", "g")],
                   [("div", "Gx5Zad", "fP1Qef", "xpd", "EtOod", "pkphOe")], [("div", "Gx5Zad")], [("div", "tF2Cxc")],
                   [("div", "[data-sokoban-container]")], [("div", "N54PNb")], [("div", "MjjYud")],
                   [("div", "[data-content-feature=1]")], [("div", "hlcw0c")]],
    "titles": [[("h3", "LC20lb")], [("h3",)], [("div", "[role=heading]"), ("h3",)], [("div", "[role=heading]")],
               [("a",), ("h3",)], [("a", "[data-ved]"), ("h3",)]],
    "links": [[("a", "[href]", "![href^=#]", "![href^=javascript]")], [("a", "[data-ved]")], [("a", "sVXRqc")]],
    "snippets": [[("div", "VwiC3b")], [("div", "[data-sncf=1]")], [("div", "[data-sncf=2]")], [("span", "aCOpRe")],
                 [("div", "[data-sncf]")], [("div", "s")], [("span", "st")], [("div", "ITZIwc")],
                 [("div", "lEBKkf")], [("span", "qXLe6d")]],
    "fallbacks": [[("p",)], [("span",)], [("div",)]],
    "cites": [[("cite",)]],
    "ad_words": ("ad", "sponsor", "commercial"),
    "ad_attrs": ("data-ad-client", "data-text-ad"),
}
BING_WEB = {
    "containers": [[("li", "b_algo")], [("div", "b_algo")], [("ol", "#b_results"), ">", ("li", "b_algo")],
                   [("ol", "#b_results"), ">", ("li",)], [("div", "#b_results"), ("li", "b_algo")]],
    "titles": [[("h2",), ("a",)], [("h2",)], [("a",)]],
    "snippets": [[("div", "b_caption"), ("p",)], [("p", "b_paractl")], [("div", "b_caption")], [("p",)]],
    "cites": [[("div", "b_attribution"), ("cite",)], [("cite",)]],
    "ad_words": ("b_ad", "ad_", "ads", "sponsor"),
    "ad_attrs": ("data-ad",),
}
YAHOO_WEB = {
    "containers": [[("div", "dd", "algo")], [("li", "algo")], [("div", "algo-sr")], [("div", "[data-uuid]")],
                   [("ol", "searchCenterMiddle"), ("li",)], [("div", "Sr")]],
    "titles": [[("h3", "title"), ("a",)], [("h3",), ("a",)], [("a", "ac-algo")], [("a", "[href]")]],
    "snippets": [[("p", "s-desc")], [("div", "compText")], [("p", "lh-16")], [("p",)]],
    "cites": [[("span", "fc-green")], [("span", "fz-ms")], [("cite",)]],
    "ad_words": ("ads", "ad-", "sponsor", "commercial"),
    "ad_attrs": ("data-ad",),
}
DUCKDUCKGO_HTML = {
    "containers": [[("div", "result|results_links")]],
    "titles": [[("a", "result__a")], [("h2",), ("a",)]],
    "snippets": [[("a", "result__snippet")], [(None, "result__snippet")]],
}
GOOGLE_NEWS = {
    "containers": [[("div", "SoaBEf")], [("div", "dbsr")], [("article",)], [("div", "WlydOe")], [("g-card",)]],
    "choice": "records",  # first container rule that yields a record
    "headings": [[("div", "[role=heading]")]],
    "links": [[("a", "[href*=http]")], [("a",)]],
    "sources": [[("div", "CEMjEf"), ("span",)], [("span", "NUnG9d")]],
    "snippets": [[("div", "GI74Re")], [("div", "Y3v8qd")]],
    "dates": [[("time",)], [("span", "WG9SHc")]],
}
BING_NEWS = {
    "containers": [[("div", "news-card")], [("div", "newsitem")], [("article", "card")]],
    "choice": "presence",  # first container rule present on the page
    "headings": [[("a", "title")]],  # used only when the link text is empty
    "links": [[("a", "[href*=http]")], [("a",)]],
    "sources": [[("div", "source"), ("a",)], [("span", "source")]],
    "snippets": [[("div", "snippet")], [("p",)]],
    "dates": [[("span", "time")], [("time",)]],
}
YAHOO_NEWS = {
    "containers": [[("div", "dd", "NewsArticle")], [("li", "algo-news")], [("div", "[data-uuid]")]],
    "choice": "presence",
    "headings": [],
    "links": [[("h4",), ("a",)], [("a", "thmb")], [("a",)]],
    "sources": [[("span", "s-source")], [("cite",)]],
    "snippets": [[("p", "s-desc")], [("p",)]],
    "dates": [[("span", "s-time")], [("time",)]],
}
NEWS_RULES = {"google": GOOGLE_NEWS, "bing": BING_NEWS, "yahoo": YAHOO_NEWS}
GOOGLE_INTERNAL = ("/search", "/url", "/imgres", "/maps", "/support")
MIN_TITLE = 3          # shorter titles are rejected
GOOD_TITLE = 3         # a title longer than this stops the title rules
GOOD_SNIPPET = 20      # a snippet longer than this stops the snippet rules
FALLBACK_SNIPPET = 30  # google: p / span / div text longer than this, cut at 500
FALLBACK_CUT = 500     # the original cuts such a text here
# ---------------------------------------------------------------------------------


def _start_tag(tag: str | None, test: str | None) -> str:
    """Regex for a start tag with a class token or attribute test."""
    t = tag or "[A-Za-z][A-Za-z0-9]*"
    if test is None:
        cond = ""
    elif test.startswith("["):
        body = test[1:-1]
        if "*=" in body:  # attribute contains
            name, val = body.split("*=", 1)
            cond = rf"(?=[^>]*\s{name}\s*=\s*[\"']?[^\"'>]*{val})"
        elif "=" in body:
            name, val = body.split("=", 1)
            cond = rf"(?=[^>]*\s{name}\s*=\s*[\"']?{val}[\"'\s>/])"
        else:
            cond = rf"(?=[^>]*\s{body}(?:\s*=|[\s>/]))"
    else:
        # every listed class token must be present; "a|b" means either token
        conds = []
        for tok in test.split():
            alt = "|".join(tok.split("|"))
            conds.append(rf"(?=[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?(?:{alt})(?:\s[^\"']*)?[\"'])")
        cond = "".join(conds)
    return rf"<{t}\b{cond}[^>]*>"


def _segments(html: Column, container) -> Column:
    marked = F.regexp_replace(html, "(?is)(" + _start_tag(*container) + ")", SEG + "$1")
    return F.regexp_extract_all(marked, F.lit(r"\x01([^\x01]*)"), 1)


RULES = {"google": GOOGLE_WEB, "bing": BING_WEB, "yahoo": YAHOO_WEB, "duckduckgo": DUCKDUCKGO_HTML}
LISTS = ("containers", "titles", "links", "snippets", "fallbacks", "cites", "headings", "sources", "dates")
WEB_TYPE = "array<struct<title:string,url:string,snippet:string,displayed_url:string>>"
NEWS_TYPE = "array<struct<title:string,url:string,snippet:string,source:string,date:string>>"
ANCHOR = [("a", "[href]")]


def raw_attr(tag: Column, name: str) -> Column:
    """Value of an attribute as written, "" when it is absent."""
    pattern = ATTR_VALUE.replace("{name}", name)
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


class _Hits:
    """What the rules of one engine find in one container: for each rule list the
    (text, href, link, title) of each rule's first element, in rule order."""

    def __init__(self, hits: Column, places: dict):
        self.hits, self.places = hits, places

    def of(self, name: str) -> Column:
        at, n = self.places[name]
        return F.filter(F.slice(self.hits, at + 1, n), lambda h: h.isNotNull())

    def first(self, name: str) -> Column:
        """The first rule's hit that there is."""
        return F.try_element_at(self.of(name), F.lit(1))


def _containers(index: Column, rules: dict) -> Column:
    """(k, c): elements that match a container rule, with the number of the first rule
    they match, in rule order and in page order inside a rule."""
    def tagged(k):
        return lambda e: F.struct(F.lit(k).alias("k"), e.alias("c"))
    every = F.flatten(F.array(*[F.transform(E.select(index, chain), tagged(k)) for k, chain in enumerate(rules["containers"])]))
    return E.let(every, lambda some: E.let(F.transform(some, lambda x: x["c"]["open"]), lambda opens: F.filter(some, lambda x, i: F.array_position(opens, x["c"]["open"]) == i + 1)))


def _records(html: Column, index: Column, rules: dict, keep, record) -> Column:
    """(k, r): ``record(container, hits)`` of every container that ``keep`` lets pass."""
    names = [n for n in LISTS[1:] if rules.get(n)]
    chains = [c for n in names for c in rules[n]] + [ANCHOR]
    places, at = {}, 0
    for n in names + ["anchor"]:
        size = len(rules[n]) if n in rules else 1
        places[n], at = (at, size), at + size

    # what the parser asks of an element: its text, its href, and where rules need them the first link in it and its title
    linked, titled = rules is BING_WEB, rules is YAHOO_NEWS

    def hit(e, anchors):
        raw = [F.regexp_replace(E.inner_html(html, e), ANY_TAG, ""), raw_attr(e["tag"], "href")]
        if linked:
            raw.append(F.when(F.exists(anchors, lambda a: E.within(a, e)), raw_attr(E.first(anchors, e)["tag"], "href")))
        if titled:
            raw.append(raw_attr(e["tag"], "title"))

        def made(d):
            link = F.when(e["name"] == "a", d[1]).otherwise(d[2]) if linked else d[1]
            return F.struct(clean_text(d[0]).alias("text"), d[1].alias("href"), link.alias("link"), (d[len(raw) - 1] if titled else d[1]).alias("title"))
        return F.when(e.isNotNull(), E.let(F.transform(F.array(*raw), decode_entities), made))

    def of(m):
        def one(x):
            c = x["c"]
            firsts = F.transform(m["rules"], lambda found: E.first(found, c))
            hits = F.transform(firsts, lambda e: hit(e, m["links"]))
            return F.struct(x["k"].alias("k"), E.let(hits, lambda h: record(c, _Hits(h, places))).alias("r"))
        return F.transform(F.filter(m["containers"], lambda x: keep(x["c"])), one)

    found = F.struct(F.array(*[E.select(index, c) for c in chains]).alias("rules"), (E.select(index, [("a",)]) if linked else F.lit(None)).alias("links"), _containers(index, rules).alias("containers"))
    return E.let(found, of)


def _pick(hits: Column, good) -> Column:
    """The first good hit, else the last one."""
    return F.coalesce(F.try_element_at(F.filter(hits, good), F.lit(1)), F.try_element_at(hits, F.lit(-1)))


def _advert(c: Column, rules: dict) -> Column:
    """FLT7: class words or data attributes of the container."""
    ad = F.lit(False)
    for word in rules.get("ad_words", ()):
        ad = ad | F.lower(c["cls"]).contains(word)
    for name in rules.get("ad_attrs", ()):
        ad = ad | (raw_attr(c["tag"], name) != "")
    return ad


def _title_good(h: Column) -> Column:
    return F.length(h["text"]) > GOOD_TITLE


def _links_so_far(hits: Column) -> Column:
    """The last link seen when the title loop stops."""
    good = F.transform(hits, _title_good)
    stop = F.when(F.array_contains(good, True), F.array_position(good, True)).otherwise(F.size(hits))
    return F.try_element_at(F.filter(F.transform(F.slice(hits, 1, F.greatest(stop, F.lit(1)).cast("int")), lambda h: h["link"]), lambda x: x.isNotNull()), F.lit(-1))


def _web_record(engine: str, rules: dict, hits: _Hits) -> Column:
    """Title, URL, snippet and displayed URL of one container."""
    anchor = F.coalesce(hits.first("anchor")["href"], F.lit(""))

    def record(titles):
        title = F.coalesce(_pick(titles, _title_good)["text"], F.lit(""))
        if engine == "google":
            link = E.let(hits.of("links"), lambda links: F.coalesce(_pick(links, lambda h: h["href"].startswith("http"))["href"], F.lit("")))
            url = unwrap_google_redirect(E.let(link, lambda x: F.when(x != "", x).otherwise(anchor)))
        elif engine == "bing":
            url = E.let(F.coalesce(_links_so_far(titles), F.lit("")), lambda x: F.when(x != "", x).otherwise(anchor))
        elif engine == "yahoo":
            url = unwrap_yahoo_redirect(F.coalesce(_pick(titles, _title_good)["href"], F.lit("")))
        else:
            url, title = (F.try_element_at(titles, F.lit(1))[x] for x in ("href", "text"))
        return E.let(F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(url, F.lit("")).alias("url")), finished)

    def finished(r):
        title = r["title"]
        if engine == "duckduckgo":
            snippet = hits.first("snippets")["text"]
        else:
            differs = (lambda h: h["text"] != title) if engine in ("bing", "yahoo") else (lambda h: F.lit(True))
            snippet = E.let(hits.of("snippets"), lambda some: _pick(some, lambda h: (F.length(h["text"]) > GOOD_SNIPPET) & differs(h))["text"])
        if engine == "google":
            usable = F.filter(hits.of("fallbacks"), lambda h: (F.length(h["text"]) > FALLBACK_SNIPPET) & (h["text"] != title))
            other = F.substring(F.try_element_at(usable, F.lit(1))["text"], 1, FALLBACK_CUT)
            snippet = E.let(snippet, lambda x: F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(other))
        displayed = F.coalesce(hits.first("cites")["text"], r["url"]) if rules.get("cites") else F.lit(None).cast("string")
        return F.struct(title.alias("title"), r["url"].alias("url"), F.coalesce(snippet, F.lit("")).alias("snippet"), displayed.alias("displayed_url"))

    return E.let(hits.of("titles"), record)


def _usable(engine: str, r: Column) -> Column:
    """FLT8 / FLT9: which records the engine's parser keeps."""
    title, url = r["title"], r["url"]
    if engine == "duckduckgo":
        return (title != "") & (url != "")
    keep = (F.length(title) >= MIN_TITLE) & url.startswith("http")
    if engine == "google":
        for path in GOOGLE_INTERNAL:
            keep = keep & ~(url.contains("google.com") & url.contains(path))
    elif engine == "bing":
        keep = keep & ~url.contains("bing.com")
    return keep


def _first_per_url(records: Column) -> Column:
    """DEDUP1: the first record of each URL."""
    return E.let(records, lambda rs: E.let(F.transform(rs, lambda r: r["url"]), lambda urls: F.filter(rs, lambda r, i: F.array_position(urls, r["url"]) == i + 1)))


def _of_first_rule(records: Column) -> Column:
    """WIN6: the records (k, r) of the first container rule that has any."""
    return E.let(records, lambda some: E.let(F.array_min(F.transform(some, lambda x: x["k"])), lambda least: F.transform(F.filter(some, lambda x: x["k"] == least), lambda x: x["r"])))


def web_records(html: Column, index: Column, engine: str) -> Column:
    """EXT22: the web results of one page in page order.

    An element that matches several container rules is judged under the first: where
    that rule has no record, the element is not usable under a later one either."""
    rules = RULES[engine]

    def keep(c):
        if engine == "google":  # containers without any text are passed over
            return ~_advert(c, rules) & (F.trim(F.regexp_replace(E.inner_html(html, c), ANY_TAG, "")) != "")
        return ~_advert(c, rules)

    found = F.filter(_records(html, index, rules, keep, lambda c, hits: _web_record(engine, rules, hits)), lambda x: _usable(engine, x["r"]))
    found = _of_first_rule(found)
    return found.cast(WEB_TYPE) if engine == "duckduckgo" else _first_per_url(found).cast(WEB_TYPE)


def news_records(html: Column, index: Column, engine: str) -> Column:
    """EXT23: the news results of one page in page order, duplicates kept."""
    rules = NEWS_RULES[engine]

    def record(c, hits):
        def made(a):
            text, href = a["text"], a["href"]
            heading = hits.first("headings")["text"] if rules["headings"] else F.lit(None).cast("string")
            if engine == "google":
                title, url = F.coalesce(heading, text), unwrap_google_redirect(href)
            elif engine == "bing":
                title, url = F.when(text != "", text).otherwise(heading), unwrap_bing_redirect(href)
            else:
                title, url = F.when(text != "", text).otherwise(clean_text(a["title"])), unwrap_yahoo_redirect(href)
            rest = [F.coalesce(hits.first(k)["text"], F.lit("")).alias(n) for k, n in (("snippets", "snippet"), ("sources", "source"), ("dates", "date"))]
            return F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(url, F.lit("")).alias("url"), *rest)
        return E.let(hits.first("links"), made)

    def usable(x):
        return x["r"]["url"].startswith("http") & (x["r"]["title"] != "")

    found = _records(html, index, rules, lambda c: F.lit(True), record)
    if rules["choice"] == "records":
        return _of_first_rule(F.filter(found, usable)).cast(NEWS_TYPE)
    return F.transform(F.filter(E.let(found, lambda some: F.filter(some, lambda x: x["k"] == some[0]["k"])), usable), lambda x: x["r"]).cast(NEWS_TYPE)
