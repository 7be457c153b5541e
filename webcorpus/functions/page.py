"""Page extraction (EXT2-EXT19, PRJ1-4): the nested page record as native column
expressions.

Method: strip boilerplate once (``page_body``), slice the short remainder with
``regexp_extract_all`` into arrays, and clean array elements with ``transform``.
Each field is its own expression, so a query that selects only the title computes
only the title (Catalyst's column pruning), and the stripped body is one projected
column shared by every field (Spark does not collapse a non-trivial expression that
is used more than once).

Malformed HTML rule (our definition, the HTML standard's for these cases): a ``<p>``
ends at the next ``<p>``, at ``</p>``, or at any block start or end tag; unclosed
inline tags are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import elements as E
from .text import (ANY_TAG, clean_texts, decode_entities, inner_cells, inner_text, inner_texts,
                   spaced_text, strip_boilerplate, strip_comments)
from .urls import resolve_url

# --- fixed values -----------------------------------------------------------------
MIN_PARAGRAPH_LENGTH = 50
P_START = r"(?i)<p\b[^>]*>"
# End of an open paragraph: </p>, or the start or end tag of a block element.
P_END = (r"(?i)</p\s*>|</?(?:address|article|aside|blockquote|body|details|div|dl|dd|dt|"
         r"fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|"
         r"menu|nav|ol|pre|section|table|tbody|thead|tfoot|td|th|tr|ul)\b[^>]*>")
# Tokens of the SQL form of the paragraph context: whole headings, block container tags, <p> starts.
CONTEXT_TOKENS = ("(?is)" + "|".join(rf"<h{k}\b[^>]*>.*?</h{k}\s*>" for k in range(1, 7))
                  + r"|</?(?:address|article|aside|blockquote|body|details|div|dl|dd|dt|fieldset|figure|form|"
                    r"li|main|ol|section|table|tbody|thead|tfoot|td|th|tr|ul)\b[^>]*>|<p\b[^>]*>")
SEG_OPEN = "\u0001"
SEG_CLOSE = "\u0002"
SEGMENT = r"\x01([^\x01\x02]*)"
# Paragraphs of the marked page, and the block containers whose tags change its depth.
PARAGRAPH_PIECES = r"\x01(?:<[pP]\b[^>\x01\x02]*+>)?+([^\x01\x02]*+)"
# The same for Java, which tries names one by one: they are parted by their first characters.
P_START_JAVA = r"<[pP]\b[^>]*+>"
P_END_JAVA = (r"<(?:/[pP]\s*+>|/?+(?i:t(?:[rdh]|able|body|head|foot)|li|d(?:iv|[ldt]|etails)|h(?:[1-6r]|eader|group|tml)|ul|ol|"
              r"a(?:ddress|rticle|side)|b(?:lockquote|ody)|f(?:ieldset|ig(?:caption|ure)|ooter|orm)|m(?:ain|enu)|nav|pre|section)\b[^>]*+>)")
CONTAINER = (r"(?:t(?:[rdh]|able|body|head|foot)|li|d(?:iv|[ldt]|etails)|ul|ol|a(?:ddress|rticle|side)|b(?:lockquote|ody)|"
             r"f(?:ieldset|igure|orm)|main|section)\b")
# What changes the context: heading tags and containers, each as one control character (as SEG_OPEN is a paragraph).
HEAD_CUT = rf"(?i){SEG_CLOSE}(?=</?h[1-6]\b)"
MARKS = r"[\x01\x02](?:</?+[\p{L}\p{N}_]*+)?+"
LETTERS = ((r"\x01[^\x01\x02]*", "\u0003"), (r"(?i)\x02</h[1-6]\b", "\u0004"), (r"(?i)\x02<h[1-6]\b", "\u0005"),
           (rf"(?i)\x02</{CONTAINER}", "\u0006"), (rf"(?i)\x02<{CONTAINER}", "\u0007"), (r"[^\x03-\x07]+", ""))
# A container without a heading in it leaves the context as it was: as many levels are dropped before the fold.
FLAT_LEVELS = 6
# Classes searched, in order, for the main content block (a substring search).
CONTENT_CLASS_WORDS = ("content", "main-content", "article", "post", "entry-content")
CLASS_TAG = r"(?is)<[A-Za-z][A-Za-z0-9]*\b[^>]*\bclass\s*=[^>]*>"
BODY_INNER = r"(?i)<body\b[^>]*>([^<]*+(?:<(?!/body\s*>)[^<]*+)*+)"  # to the first close tag, or the end
DEFAULT_LANGUAGE = "en"
NESTED = r"(?is)<({})\b[^>]*>"
LINK_SKIP_PREFIXES = ("#", "javascript:", "mailto:")
HTML_TAG = r"(?is)(<html\b[^>]*>)"
META_LANG_TAG = r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?content-language[\"']?[^>]*>)"
ATTRIBUTED_TAG = r"<(?!/?+\w++>)[^>]*+>[^<]*+"
ATTR_VALUE = r"(?is)^<[A-Za-z][A-Za-z0-9]*\b(?:[^>]*?\s)?{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
# ---------------------------------------------------------------------------------


def attributed_tags(html: Column) -> Column:
    """The tags that are more than a name, each with the text after it, joined: a pattern that begins with a start
    tag with attributes and reaches no further than the text after it finds in them what it finds in the page."""
    return F.array_join(F.regexp_extract_all(html, F.lit(ATTRIBUTED_TAG), 0), "")


def page_body(html: Column, include_boilerplate: bool = False) -> Column:
    """EXT1 applied to a page: the html that every other field reads."""
    return strip_comments(html) if include_boilerplate else strip_boilerplate(html)


def attr(tag: Column, name: str) -> Column:
    """Value of attribute ``name`` in one start tag (entities decoded); null when the
    attribute is absent, ``""`` when present and empty."""
    pat = ATTR_VALUE.replace("{name}", name)
    present = tag.rlike(pat)
    value = F.concat(F.regexp_extract(tag, pat, 1), F.regexp_extract(tag, pat, 2),
                     F.regexp_extract(tag, pat, 3))
    bare = tag.rlike(r"(?is)^<[A-Za-z][A-Za-z0-9]*\b(?:[^>]*?\s)" + name + r"(?:\s|/?>|$)")
    return F.when(present, decode_entities(value)).when(bare, F.lit(""))


def element_inner(body: Column, tag: str) -> Column:
    """Inner html of the first ``<tag>`` (to its first close tag, or the end)."""
    return F.regexp_extract(body, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|$)", 1)


def has_tag(body: Column, tag: str) -> Column:
    return body.rlike(rf"(?i)<{tag}\b")


def all_inner(body: Column, tag: str) -> Column:
    """Inner html of every ``<tag>...</tag>`` in document order (non-nested)."""
    return F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), 1)


def title(body: Column) -> Column:
    """EXT2: ``<title>`` text when the tag exists (empty title -> ""), else the first
    h1, else ""."""
    return (F.when(has_tag(body, "title"), inner_text(element_inner(body, "title")))
            .when(has_tag(body, "h1"), inner_text(element_inner(body, "h1")))
            .otherwise(F.lit("")))


def heading_texts(body: Column, level: int) -> Column:
    """Non-empty cleaned texts of every ``h{level}`` in document order."""
    return F.filter(inner_texts(all_inner(body, f"h{level}")), lambda t: t != "")


def headings(body: Column) -> Column:
    """EXT4: map ``h1..h6 -> array`` with only non-empty levels."""
    def found(levels):
        """One scan says which levels there are; only those are read."""
        return F.map_from_arrays(F.array(*[F.lit(f"h{k}") for k in range(1, 7)]), F.array(*[
            F.when(F.array_contains(levels, F.lit(str(k))), heading_texts(body, k)).otherwise(F.array().cast("array<string>")) for k in range(1, 7)]))

    full = E.let(F.array_distinct(F.regexp_extract_all(body, F.lit(r"<[hH]([1-6])\b"), 1)), found)
    return F.map_filter(full, lambda k, v: F.size(v) > 0)


def heading_count(body: Column) -> Column:
    return sum((F.size(heading_texts(body, k)) for k in range(2, 7)), F.size(heading_texts(body, 1)))


def paragraph_segments(body: Column) -> Column:
    """Raw inner html of each paragraph under the malformed-HTML rule."""
    marked = F.regexp_replace(F.regexp_replace(body, P_START_JAVA, SEG_OPEN), P_END_JAVA, SEG_CLOSE)
    return F.regexp_extract_all(marked, F.lit(SEGMENT), 1)


def paragraph_texts(body: Column, min_length: int = MIN_PARAGRAPH_LENGTH) -> Column:
    """EXT5: cleaned paragraph texts of at least ``min_length`` characters."""
    return F.filter(inner_texts(paragraph_segments(body)), lambda t: F.length(t) >= min_length)


def paragraph_records(body: Column) -> Column:
    """EXT5 + EXT6: ``array<struct<text, context>>``, every ``<p>`` in order with the
    nearest preceding heading that is a sibling of the paragraph or of one of its
    ancestors (null when none).

    The page becomes a line of control characters: a paragraph, an opening or closing
    container, a heading's tags. A fold over the runs of equal characters keeps the depth, a
    stack of (depth, heading number) and the open heading; a closing container drops the
    headings recorded inside it, so the last entry of the stack is the context. The fold holds
    numbers only, since Spark copies what a fold holds at every step; texts are looked up by
    number afterwards. A heading ends at any heading tag, as in the HTML standard, or with its
    container; a paragraph inside it has the context of the heading before it."""
    marked = F.regexp_replace(F.regexp_replace(body, P_START_JAVA, SEG_OPEN + "$0"), P_END_JAVA, SEG_CLOSE + "$0")

    def contexts(page):
        """The context of every paragraph; only called for pages with a heading."""
        line = F.array_join(F.regexp_extract_all(page, F.lit(MARKS), 0), "")
        for pattern, to in LETTERS:
            line = F.regexp_replace(line, pattern, to)
        for _ in range(FLAT_LEVELS):
            line = F.regexp_replace(line, r"\x07(\x03*)\x06", "$1")
        runs = F.regexp_extract_all(line, F.lit(r"\x03+|\x06+|\x07+|[\x04\x05]"), 0)
        # a heading's text reaches to the next heading tag
        heads = F.transform(F.slice(F.split(page, HEAD_CUT, -1), 2, 1 << 30),
                            lambda t: F.when(~t.startswith("</"), inner_text(F.translate(t, SEG_OPEN + SEG_CLOSE, ""))))
        entry = "struct<d:int,h:int>"
        state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.array().cast(f"array<{entry}>").alias("stack"),
                         F.lit(None).cast(entry).alias("head"))

        def step(acc, run):
            d, seen, stack, head = acc["depth"], acc["seen"], acc["stack"], acc["head"]
            n = F.length(run)
            # an entry as deep as a later one is never the last again
            closed = F.when(head.isNull(), stack).otherwise(F.concat(F.filter(stack, lambda e: e["d"] < head["d"]), F.array(head)))

            def to(depth, seen, stack, head):
                return F.struct(depth.alias("depth"), seen.alias("seen"), stack.alias("stack"), head.alias("head"))

            return (F.when(run == "\u0005", to(d, seen + 1, closed, F.struct(d.alias("d"), seen.alias("h"))))
                    .when(run == "\u0004", to(d, seen + 1, closed, F.lit(None).cast(entry)))
                    .when(run.startswith("\u0006"), to(d - n, seen, F.filter(stack, lambda e: e["d"] <= d - n), F.when(head["d"] <= d - n, head)))
                    .when(run.startswith("\u0007"), to(d + n, seen, stack, head)).otherwise(acc))

        def emit(acc, run):
            return F.when(run.startswith("\u0003"), F.struct(F.length(run).alias("n"), F.try_element_at(acc["stack"], F.lit(-1))["h"].alias("h")))

        said = E.fold(runs, state, step, emit, "struct<n:int,h:int>")
        return E.let(heads, lambda hs: F.flatten(F.transform(said, lambda x: F.array_repeat(F.get(hs, x["h"]), x["n"]))))

    def records(page):
        texts = inner_texts(F.regexp_extract_all(page, F.lit(PARAGRAPH_PIECES), 1))
        # a page without headings has no contexts
        known = F.when(page.rlike(r"(?i)\x02<h[1-6]\b"), contexts(page)).otherwise(F.array().cast("array<string>"))
        return E.let(known, lambda cs: F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.get(cs, i).alias("context"))))

    return E.let(marked, records)


def paragraphs(body: Column, min_length: int = MIN_PARAGRAPH_LENGTH) -> Column:
    """EXT5 + EXT6 record form: ``array<struct<text, length, context>>``."""
    recs = F.transform(paragraph_records(body), lambda z: F.struct(
        z["text"].alias("text"), F.length(z["text"]).alias("length"), z["context"].alias("context")))
    return F.filter(recs, lambda r: r["length"] >= min_length)


def nested_inner(body: Column, start: str) -> Column:
    """Inner html of the first element whose start tag matches ``start`` (group 1 = tag
    name), up to its *matching* close tag: the text after the start tag is split at
    close tags of that name and a fold counts the same-name start tags in each piece
    (depth), so nested elements of the same name stay inside. Unclosed: to the end."""
    name = F.regexp_extract(body, start, 1)
    rest = F.regexp_extract(body, start + "(.*)$", 2)
    close_tag = F.concat(F.lit("</"), name, F.lit(">"))
    pieces = F.split(rest, F.concat(F.lit("(?i)</"), name, F.lit(r"\s*>")), -1)
    # the pieces and the name are made once, the lambdas below only read them
    marked = E.let(pieces, lambda ps: F.transform(ps, lambda p, i: F.struct(p.alias("p"), (i == F.size(ps) - 1).alias("last"))))
    init = F.struct(F.lit(1).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("out"))

    def folded(tag):
        opens = F.concat(F.lit("(?i)<"), tag["name"], F.lit(r"\b"))

        def step(acc, x):
            d = acc["depth"] + F.regexp_count(x["p"], opens) - 1
            more = F.when(~x["last"] & (d > 0), tag["close"]).otherwise(F.lit(""))
            return F.when(acc["done"], acc).otherwise(F.struct(
                d.alias("depth"), (d <= 0).alias("done"), F.concat(acc["out"], x["p"], more).alias("out")))

        return F.aggregate(tag["pieces"], init, step)["out"]

    return E.let(F.struct(name.alias("name"), close_tag.alias("close"), marked.alias("pieces")), folded)


def main_content(body: Column, tags: Column | None = None) -> Column:
    """EXT15: first of main, article, an element whose class contains content /
    article / post (each to its matching close tag, so an article inside the article
    stays inside), body, the whole document. Presence decides (an empty main gives "")."""
    # the tags with a class: a start tag below is part of one
    classes = F.array_join(F.regexp_extract_all(attributed_tags(body) if tags is None else tags, F.lit(CLASS_TAG), 0), "")

    def class_block(word):
        start = rf"(?is)<([A-Za-z][A-Za-z0-9]*)\b[^>]*\bclass\s*=\s*[\"']?[^\"'>]*{word}[^>]*>"
        return lambda tags: tags.rlike(start), inner_text(nested_inner(body, start))

    named = F.when(has_tag(body, "main"), inner_text(nested_inner(body, NESTED.format("main")))) \
        .otherwise(inner_text(nested_inner(body, NESTED.format("article"))))
    # substring search: a word that contains an earlier word can never match first
    words = [w for i, w in enumerate(CONTENT_CLASS_WORDS) if not any(o in w for o in CONTENT_CLASS_WORDS[:i])]
    blocks = [class_block(word) for word in words]
    rank = E.let(classes, lambda tags: F.array_position(F.array(*[found(tags) for found, _ in blocks]), True))
    whole = F.when(has_tag(body, "body"), inner_text(F.regexp_extract(body, BODY_INNER, 1))).otherwise(inner_text(body))
    of_class = E.let(rank, lambda r: reduce(lambda out, k: out.when(r == k + 1, blocks[k][1]), range(1, len(blocks)), F.when(r == 1, blocks[0][1])).otherwise(whole))
    return F.when(body.rlike(r"<(?i:main|article)\b"), named).otherwise(of_class)


def language(body: Column) -> Column:
    """EXT16: ``<html lang>``, else meta http-equiv content-language, else ``en``."""
    html_tag = F.regexp_extract(body, HTML_TAG, 1)
    lang = attr(html_tag, "lang")
    meta_tag = F.regexp_extract(body, META_LANG_TAG, 1)
    meta_lang = F.coalesce(attr(meta_tag, "content"), F.lit(DEFAULT_LANGUAGE))
    return (F.when(F.coalesce(lang, F.lit("")) != "", lang)
            .when(meta_tag != "", meta_lang)
            .otherwise(F.lit(DEFAULT_LANGUAGE)))


def text_content(body: Column) -> Column:
    """EXT17: visible text, pieces joined by one space, cleaned."""
    return spaced_text(body)


def raw_text(body: Column) -> Column:
    """Unjoined text (``get_text()``), entities decoded, not cleaned: contact input."""
    return decode_entities(F.regexp_replace(body, ANY_TAG, ""))


def _first_by(arr: Column, key: str) -> Column:
    """Keep the first element per ``key`` field, preserving order (no array grows)."""
    return E.let(arr, lambda xs: E.let(F.transform(xs, lambda x: x[key]), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, x[key]) == i + 1)))


def links(body: Column, base_url: Column) -> Column:
    """EXT10: ``a[href]`` except ``#``, ``javascript:``, ``mailto:`` prefixes, made
    absolute, first occurrence per URL, in page order."""
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), 1)
    recs = F.transform(anchors, lambda a: F.struct(
        attr(F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1), "href").alias("href"),
        inner_text(F.regexp_extract(a, r"(?is)^<a\b[^>]*>(.*)</a\s*>$", 1)).alias("text"),
        F.coalesce(attr(F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1), "title"), F.lit("")).alias("title")))
    def kept(r):
        ok = r["href"].isNotNull()
        for prefix in LINK_SKIP_PREFIXES:
            ok = ok & ~r["href"].startswith(prefix)
        return ok

    keep = F.filter(recs, kept)
    resolved = F.transform(keep, lambda r: F.struct(resolve_url(r["href"], base_url).alias("url"),
                                                    r["text"].alias("text"), r["title"].alias("title")))
    return _first_by(resolved, "url")


def images(body: Column, base_url: Column, tags: Column | None = None) -> Column:
    """EXT9: src (or data-src when src is empty or absent), made absolute, with
    alt/title/width/height as text; not de-duplicated."""
    # an image or meta tag without attributes gives nothing
    found = F.regexp_extract_all(attributed_tags(body) if tags is None else tags, F.lit(r"(?is)(<img\b[^>]*>)"), 1)
    recs = F.transform(found, lambda t: F.struct(
        F.when(F.coalesce(attr(t, "src"), F.lit("")) != "", attr(t, "src"))
        .otherwise(attr(t, "data-src")).alias("src"),
        F.coalesce(attr(t, "alt"), F.lit("")).alias("alt"),
        F.coalesce(attr(t, "title"), F.lit("")).alias("title"),
        F.coalesce(attr(t, "width"), F.lit("")).alias("width"),
        F.coalesce(attr(t, "height"), F.lit("")).alias("height")))
    kept = F.filter(recs, lambda r: F.coalesce(r["src"], F.lit("")) != "")
    return F.transform(kept, lambda r: r.withField("src", resolve_url(r["src"], base_url)))


def meta(body: Column, tags: Column | None = None) -> Column:
    """EXT3: ``name`` (or ``property``) -> ``content``, last wins; then description
    (name=description first, else og:description), keywords and author set from the
    first matching tag."""
    found = F.regexp_extract_all(attributed_tags(body) if tags is None else tags, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)
    read = F.transform(found, lambda t: F.struct(attr(t, "content").alias("value"), attr(t, "name").alias("name"), attr(t, "property").alias("property")))
    recs = F.transform(read, lambda r: r.withField(
        "key", F.when(F.coalesce(r["name"], F.lit("")) != "", r["name"]).otherwise(r["property"])))
    # the tags are read once, whatever is made of them
    return E.let(recs, _meta_map)


def _meta_map(recs: Column) -> Column:
    base = F.transform(F.filter(recs, lambda r: (F.coalesce(r["key"], F.lit("")) != "")
                                & (F.coalesce(r["value"], F.lit("")) != "")),
                       lambda r: F.struct(r["key"].alias("key"), r["value"].alias("value")))

    def first_content(cond):
        hit = F.filter(recs, cond)
        return F.when(F.size(hit) > 0, F.coalesce(hit[0]["value"], F.lit("")))

    desc = F.coalesce(first_content(lambda r: r["name"] == "description"),
                      first_content(lambda r: r["property"] == "og:description"))
    extras = F.filter(F.array(
        F.struct(F.lit("description").alias("key"), desc.alias("value")),
        F.struct(F.lit("keywords").alias("key"), first_content(lambda r: r["name"] == "keywords").alias("value")),
        F.struct(F.lit("author").alias("key"), first_content(lambda r: r["name"] == "author").alias("value")),
    ), lambda e: e["value"].isNotNull())
    entries = F.concat(base, extras)
    # last one wins: one fold, so the entry array is evaluated once
    last_wins = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"),
                            lambda acc, x: F.concat(F.filter(acc, lambda e: e["key"] != x["key"]), F.array(x)))
    return F.map_from_entries(last_wins)


def opengraph(body: Column, tags: Column | None = None) -> Column:
    """EXT12: og:* properties -> content (last wins)."""
    return F.map_filter(meta(body, tags), lambda k, v: k.startswith("og:"))


JSON_LD_BLOCK = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"


def json_ld_blocks(raw_html: Column) -> Column:
    """The texts of the ld+json blocks of the raw html."""
    return F.regexp_extract_all(raw_html, F.lit(JSON_LD_BLOCK), 1)


def json_ld(raw_html: Column, blocks: Column | None = None) -> Column:
    """EXT11: every ld+json block of the raw html, parsed; invalid JSON skipped."""
    blocks = json_ld_blocks(raw_html) if blocks is None else blocks
    return F.filter(F.transform(blocks, lambda b: F.try_parse_json(F.trim(b))), lambda v: v.isNotNull())


MICRODATA_PROP = r"(?is)(<[A-Za-z][A-Za-z0-9]*\b[^>]*\sitemprop\s*=[^>]*>)([^<]*)"
MICROFORMAT_PROP = (r"(?is)(<[A-Za-z][A-Za-z0-9]*\b[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?(?:p|u|dt|e)-[a-z0-9-]+"
                    r"[^>]*>)([^<]*)")

OPEN_CLASS = r"(?i)\sclass\s*=\s*[\"'][^\"'>]*>"


def _stripped(c: Column) -> Column:
    """Text as structured-data extractors report it: entities decoded, outer
    whitespace removed, nothing else changed."""
    from .text import WS_CLASS
    return F.regexp_replace(c, "^[" + WS_CLASS + "]+|[" + WS_CLASS + "]+$", "")


def microdata(raw_html: Column, tags: Column | None = None) -> Column:
    """EXT13, flat: item types and ``itemprop -> value`` pairs in page order; the value is
    content, href, src or datetime when present, else the element's own leading text
    (decoded and stripped, not cleaned). ``structured.nested_items`` keeps the nesting."""
    def pairs(of):
        tags = F.regexp_extract_all(of, F.lit(MICRODATA_PROP), 1)
        texts = F.regexp_extract_all(of, F.lit(MICRODATA_PROP), 2)
        return F.transform(F.arrays_zip(tags.alias("tag"), texts.alias("text")), lambda z: F.struct(
            attr(z["tag"], "itemprop").alias("prop"),
            F.coalesce(attr(z["tag"], "content"), attr(z["tag"], "href"), attr(z["tag"], "src"),
                       attr(z["tag"], "datetime"), _stripped(decode_entities(z["text"]))).alias("value")))

    types = F.regexp_extract_all(raw_html, F.lit(r"(?is)\sitemtype\s*=\s*[\"']([^\"']*)[\"']"), 1)
    return F.struct(types.alias("types"), E.let(attributed_tags(raw_html) if tags is None else tags, pairs).alias("properties"))


def microformats(raw_html: Column, tags: Column | None = None) -> Column:
    """EXT14, flat: root classes ``h-*`` and property pairs from ``p-* / u-* / dt-* / e-*``
    classes (``u-*`` takes href or src, others the text); ``structured.nested_items``
    keeps the nesting."""
    roots = F.array_distinct(F.regexp_extract_all(
        raw_html, F.lit(r"(?is)\sclass\s*=\s*[\"'](?:[^\"']*\s)?(h-[a-z0-9-]+)"), 1))
    def pair(z):
        prop = F.regexp_extract(F.coalesce(attr(z["tag"], "class"), F.lit("")), r"(?:^|\s)((?:p|u|dt|e)-[a-z0-9-]+)", 1)
        link = F.coalesce(attr(z["tag"], "href"), attr(z["tag"], "src"))
        value = F.when(prop.startswith("u-") & link.isNotNull(), link).otherwise(_stripped(decode_entities(z["text"])))
        return F.struct(prop.alias("prop"), value.alias("value"))

    def pairs(of):
        tags = F.regexp_extract_all(of, F.lit(MICROFORMAT_PROP), 1)
        texts = F.regexp_extract_all(of, F.lit(MICROFORMAT_PROP), 2)
        return F.transform(F.arrays_zip(tags.alias("tag"), texts.alias("text")), pair)

    # a class value that holds ">" reaches beyond what is a tag for the patterns: then the page itself is searched
    found = E.let(attributed_tags(raw_html) if tags is None else tags, lambda of: E.let(F.when(of.rlike(OPEN_CLASS), raw_html).otherwise(of), pairs))
    return F.struct(roots.alias("types"), found.alias("properties"))


# Tags that are no list tags are dropped first; what is left is list tags and the text between them.
OTHER_TAGS = r"(</?(?:[uUoO][lL]|[lL][iI])\b[^>]*+>)|<[^>]*+>"
LIST_TOKENS = r"(?:<[lL][iI]\b[^>]*+>[^<]*+</[lL][iI]\b[^>]*+>[^<]*+)++|</?(?:[uUoO][lL]|[lL][iI])\b[^>]*+>|[^<]++"
LIST_RUN = r"(?is)^<li\b[^>]*>[^<]*</li\b"  # items that hold no list, one after another, are one token
RUN_ITEMS = r"<[lL][iI]\b[^>]*+>([^<]*+)</[lL][iI]\b[^>]*+>"
_LIST_T = "struct<start:int,kind:string,open:int>"
_ITEM_T = "struct<start:int,until:int,since:int,kind:string,run:boolean>"


def lists(body: Column) -> Column:
    """EXT7: items of each ul / ol in document order of the list start tags; items are
    the direct ``li`` children (their text includes nested lists, as ``get_text``
    does); lists without items dropped.

    A fold over the page's list tags keeps a stack of open lists: a ``<li>`` starts an item
    of the innermost list, and the next ``<li>`` or ``</li>``, a closing list tag or the end of
    the page ends it. Items that hold no list are one token, as many as there are in a row. The
    fold holds token numbers only, since Spark copies what a fold holds at
    every step; an item's text is that of the tokens in its range, read afterwards."""
    toks = F.regexp_extract_all(F.regexp_replace(body, OTHER_TAGS, "$1"), F.lit(LIST_TOKENS), 0)

    def kind_of(tok):
        tag = F.regexp_extract(tok, r"(?i)^<(/?[uol][li])", 1)
        known = E.let(tag, lambda t: F.when(t.isin("li", "Li", "lI", "LI"), F.when(tok.rlike(LIST_RUN), F.lit("run")).otherwise(F.lit("li")))
                      .when(t.isin("/li", "/Li", "/lI", "/LI"), F.lit("/li")).when(t.isin("ul", "Ul", "uL", "UL"), F.lit("ul"))
                      .when(t.isin("ol", "Ol", "oL", "OL"), F.lit("ol")).otherwise(F.lit("/ul")))
        return F.when(~tok.startswith("<"), F.lit("text")).otherwise(known)

    def of(ts):
        marked = F.filter(F.transform(ts, lambda t, i: F.struct(kind_of(t).alias("is"), i.alias("at"))), lambda x: x["is"] != "text")
        # the end of the page closes every list that is open: as many closing tags follow
        ends = F.transform(F.filter(marked, lambda x: x["is"].isin("ul", "ol")), lambda x: F.struct(F.lit("/ul").alias("is"), F.size(ts).alias("at")))
        state = F.array().cast(f"array<{_LIST_T}>")

        def top_of(stack):
            return F.try_element_at(stack, F.lit(-1))

        def step(stack, x):
            top, kind, at = top_of(stack), x["is"], x["at"]
            rest = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
            new = F.struct(at.alias("start"), F.when(kind == "ol", F.lit("ordered")).otherwise(F.lit("unordered")).alias("kind"), F.lit(None).cast("int").alias("open"))

            def opened(at):
                return F.concat(rest, F.array(F.struct(top["start"].alias("start"), top["kind"].alias("kind"), at.alias("open"))))

            return (F.when(kind.isin("ul", "ol"), F.concat(stack, F.array(new))).when(F.size(stack) == 0, stack)
                    .when(kind == "li", opened(at)).when(kind.isin("/li", "run"), opened(F.lit(None).cast("int"))).otherwise(rest))

        def emit(stack, x):
            top = top_of(stack)
            run = (x["is"] == "run") & top.isNotNull()
            return F.when(~x["is"].isin("ul", "ol") & top["open"].isNotNull() | run, F.struct(
                top["start"].alias("start"), x["at"].alias("until"), top["open"].alias("since"), top["kind"].alias("kind"), run.alias("run")))

        def texts(item):
            """The item that ends here, and those of the run of items that begins here."""
            inside = F.slice(ts, item["since"] + 2, item["until"] - item["since"] - 1)
            words = F.transform(inside, lambda t: F.when(~t.startswith("<"), t).when(t.rlike(LIST_RUN), F.regexp_replace(t, r"(?is)</?li\b[^>]*>", "")).otherwise(F.lit("")))
            ended = F.when(item["since"].isNotNull(), F.array(F.array_join(words, ""))).otherwise(F.array().cast("array<string>"))
            row = F.when(item["run"], F.regexp_extract_all(F.get(ts, item["until"]), F.lit(RUN_ITEMS), 1)).otherwise(F.array().cast("array<string>"))
            return F.concat(ended, row)

        def grouped(items):
            first = F.filter(F.transform(items, lambda x, i: F.when((i == 0) | (F.get(items, i - 1)["start"] != x["start"]), i)), lambda i: i.isNotNull())
            return E.let(first, lambda fs: F.transform(fs, lambda i, k: F.struct(items[i]["kind"].alias("kind"), clean_texts(F.flatten(F.transform(
                F.slice(items, i + 1, F.coalesce(F.get(fs, k + 1), F.size(items)) - i), texts))).alias("items"))))

        items = E.let(F.concat(marked, ends), lambda ms: F.array_sort(E.fold(ms, state, step, emit, _ITEM_T)))
        return E.let(E.let(items, grouped), lambda ls: F.struct(*[
            F.transform(F.filter(ls, lambda l: l["kind"] == kind), lambda l: l["items"]).alias(kind) for kind in ("ordered", "unordered")]))

    empty = F.struct(F.array().cast("array<array<string>>").alias("ordered"),
                     F.array().cast("array<array<string>>").alias("unordered"))
    # most pages have no list once navigation is stripped: skip the fold for them
    return F.when(body.rlike(r"<[uUoO][lL]\b"), E.let(toks, of)).otherwise(empty)


def tables(body: Column) -> Column:
    """EXT8: headers from the ``th`` of the first ``thead``; rows = the ``td`` and ``th`` of
    each ``tr`` below the first ``tbody`` (or the table); tables without rows dropped. A
    table inside a cell is a table of its own, and its rows are rows of the outer table as
    well (the original searches all descendants); its text belongs to the outer cell.

    The tables are found in one pass over the tags; the texts of a table's cells are cleaned together."""
    def one(t):
        headers = F.when(t["headers"].isNull(), F.array().cast("array<string>")).otherwise(inner_cells(t["headers"])[0])
        cells = F.struct(F.transform(t["cells"][0], inner_text).alias("headers"),
                         F.transform(F.slice(t["cells"], 2, F.size(t["cells"])), lambda row: F.transform(row, inner_text)).alias("rows"))
        return F.when(t["cells"].isNotNull(), cells).otherwise(F.struct(headers.alias("headers"), inner_cells(t["rows"]).alias("rows")))

    return F.transform(E.table_index(body), one)
