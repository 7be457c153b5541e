"""URL functions (SCL1-4, SCL8-10, FLT1).

All are native expressions. ``resolve_url`` is the relative-to-absolute join of the
link extractor; it covers the forms that occur in pages (absolute, scheme-relative,
root-relative, query-only, fragment-only, same-directory and ``..`` paths).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
# Scheme, optional user info, host, optional port, then path/query/fragment.
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
HTTP_PREFIX = r"^https?://"
# Public suffixes known offline. Callers can pass their own list to registrable_domain.
PUBLIC_SUFFIXES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "ai",
    "app", "dev", "me", "tv", "us", "uk", "de", "fr", "es", "it", "nl", "be", "ch",
    "at", "se", "no", "dk", "fi", "pl", "cz", "ru", "cn", "jp", "kr", "in", "br", "au",
    "ca", "mx", "ar", "eu", "ie", "pt", "gr", "tr", "za", "nz",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp",
    "co.nz", "com.br", "com.cn", "co.in", "co.za", "com.mx", "github.io", "sg", "hk", "tw",
    "com.tr", "org.tr", "gov.tr", "gov.in", "org.in", "ac.in", "co.kr", "or.kr", "com.sg",
    "com.hk", "com.tw", "com.ar", "org.br", "gov.br", "ac.jp", "or.jp", "org.nz", "org.za",
)
# ---------------------------------------------------------------------------------


def sanitize_url(url: Column) -> Column:
    """SCL1: trim, then prefix ``https://`` unless the URL starts with http(s)://."""
    t = F.trim(url)
    return F.when(t.rlike(HTTP_PREFIX), t).otherwise(F.concat(F.lit("https://"), t))


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 1)


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 3)


def url_host(url: Column) -> Column:
    """Lower-cased host without user info and port ("" when absent)."""
    netloc = url_netloc(url)
    no_user = F.regexp_replace(netloc, r"^.*@", "")
    return F.lower(F.regexp_replace(no_user, r":[0-9]*$", ""))


def is_valid_url(url: Column) -> Column:
    """SCL4 / FLT1: both scheme and network location non-empty."""
    return (F.coalesce(url_scheme(url), F.lit("")) != "") & (F.coalesce(url_netloc(url), F.lit("")) != "")


def registrable_domain(url: Column, suffixes=PUBLIC_SUFFIXES) -> Column:
    """SCL3: ``domain.suffix`` by the longest known public suffix. A host without a
    known suffix gives its last label followed by a dot, as the original does."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    sfx = F.array(*[F.lit(s) for s in suffixes])

    def last(k):
        return F.array_join(F.slice(labels, -k, k), ".")

    def take(k):
        return F.when(n >= k, last(k))

    return (F.when(host == "", F.lit("."))
            .when((n >= 3) & F.array_contains(sfx, last(2)), take(3))
            .when((n == 2) & F.array_contains(sfx, last(2)), F.concat(F.lit("."), last(2)))
            .when((n >= 2) & F.array_contains(sfx, last(1)), take(2))
            .when((n == 1) & F.array_contains(sfx, last(1)), F.concat(F.lit("."), last(1)))
            .otherwise(F.concat(F.element_at(labels, -1), F.lit("."))))


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal on an absolute path, as an array fold."""
    segs = F.split(path, "/", -1)
    folded = F.aggregate(
        F.slice(segs, 2, F.size(segs)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segs, -1)
    tail = F.when(((last == "..") | (last == ".")) & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(folded, "/"), tail)


def resolve_url(href: Column, base: Column) -> Column:
    """SCL2: make ``href`` absolute against ``base``. Absolute http(s) and ``//host``
    references are returned as they are (as the original helper does)."""
    h = F.trim(href)
    scheme = url_scheme(base)
    netloc = url_netloc(base)
    bpath = F.regexp_extract(base, URL_PARTS, 4)
    bquery = F.regexp_extract(base, URL_PARTS, 5)
    origin = F.concat(scheme, F.lit("://"), netloc)
    bdir = F.regexp_replace(F.when(bpath == "", F.lit("/")).otherwise(bpath), r"[^/]*$", "")
    # split href into path and rest (?query#fragment)
    hpath = F.regexp_extract(h, r"^([^?#]*)", 1)
    hrest = F.substring(h, F.length(hpath) + 1, 1 << 30)
    return (
        F.when(h.rlike(r"^(https?:)?//") | h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h == "", base)
        .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(origin, bpath, h))
        .when(h.startswith("/"), F.concat(origin, _remove_dot_segments(hpath), hrest))
        .otherwise(F.concat(origin, _remove_dot_segments(F.concat(bdir, hpath)), hrest))
    )


def unwrap_google_redirect(url: Column) -> Column:
    """SCL8: ``/url?q=...`` or ``/url?url=...`` -> the decoded target; web-cache links
    keep the cached URL. Anything else is returned unchanged."""
    q = F.regexp_extract(url, r"^/url\?(?:.*&)?(?:q|url)=([^&]*)", 1)
    cache = F.regexp_extract(url, r"webcache\.googleusercontent\.com/search\?(?:.*&)?q=cache:[^:]*:([^&+]*)", 1)
    return (F.when(q != "", F.try_url_decode(q))
            .when(cache != "", F.try_url_decode(cache))
            .otherwise(url))


def unwrap_bing_redirect(url: Column) -> Column:
    """SCL9: ``bing.com/ck/a?...u=a1<base64url>`` -> decoded target; a plain ``u=``
    value is URL-decoded."""
    u = F.regexp_extract(url, r"bing\.com/ck/a\?(?:.*&)?u=([^&]*)", 1)
    decoded = F.decode(F.unbase64(F.translate(F.substring(u, 3, 1 << 30), "-_", "+/")), "UTF-8")
    return (F.when(u.startswith("a1"), F.coalesce(decoded, url))
            .when(u != "", F.try_url_decode(u))
            .otherwise(url))


def unwrap_yahoo_redirect(url: Column) -> Column:
    """SCL10: ``.../RU=<enc>/RK=...`` or ``r.search.yahoo.com/?u=<enc>`` -> decoded."""
    ru = F.regexp_extract(url, r"/RU=([^/]*)/R[KS]=", 1)
    u = F.regexp_extract(url, r"r\.search\.yahoo\.com/.*[?&]u=([^&]*)", 1)
    return (F.when(ru != "", F.try_url_decode(ru))
            .when(u != "", F.try_url_decode(u))
            .otherwise(url))
