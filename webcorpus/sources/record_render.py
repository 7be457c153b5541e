"""Rendered record pages: one html page per document, holding every structure that a page
record has fields for (meta tags, lists, a table, an image, JSON-LD, microdata,
microformats, contacts, paragraphs). The whole text of the document is in it, as runs of
eight words of ASCII letters, so an oracle can say from ``documents`` alone what the
extraction has to give back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

CHUNKS = """transform(
    filter(sequence(0, size(words), 8), i -> i < size(words)),
    i -> array_join(slice(words, i + 1, 8), ' '))"""

HTML = """concat(
    '<html lang="', coalesce(lang, 'en'), '"><head><title>Record ', id, '</title>',
    '<meta name="author" content="desk ', id, '"><meta property="og:title" content="Record ', id, '">',
    '<meta name="description" content="', coalesce(get(chunks, 0), ''), '">',
    '<script type="application/ld+json">{"@type": "Article", "position": ', id, ', "headline": "', coalesce(get(chunks, 0), ''),
    '", "author": {"email": "desk', id, '@example.org", "telephone": ["+1 202 555 ', lpad(id, 7, '0'), '"]}}</script>',
    '<script type="application/ld+json">{"broken": </script></head><body><h1>Record ', id, '</h1>',
    if(size(chunks) > 0, concat('<p>', array_join(chunks, '</p><p>'), '</p>'), ''),
    '<ul>', if(size(chunks) > 0, concat('<li>', array_join(chunks, '</li><li>'), '</li>'), ''), '</ul>',
    '<ol><li>first ', id, '</li><li>second</li></ol>',
    '<table><thead><tr><th>No</th><th>Words</th></tr></thead><tbody>',
    array_join(transform(chunks, (c, i) -> concat('<tr><td>', CAST(i AS STRING), '</td><td>', c, '</td></tr>')), ''),
    '</tbody></table><img src="/img/', id, '.png" alt="figure ', id, '" width="40"><img data-src="more.png"><img alt="none">',
    '<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">Desk ', id,
    '</span><a itemprop="email" href="desk', id, '@example.com">mail</a></div>',
    '<div class="h-card"><span class="p-name">Desk ', id, '</span><a class="u-url" href="/desk/', id, '">desk</a></div>',
    '<p>Write to info', id, '@example.net. Visit: ', id, ' Oak Street, Springfield, IL 62704.</p>',
    '<p>Follow https://twitter.com/desk', id, ' and www.facebook.com/desk.', id, ' now</p></body></html>')"""


def record_pages(spark, sf_dir: str) -> DataFrame:
    """(page_id, url, html): a rendered page per document."""
    docs = tables.documents(spark, sf_dir).select("doc_id", "lang", F.col("doc_id").cast("string").alias("id"),
                                                  F.expr("regexp_extract_all(coalesce(text, ''), '([A-Za-z]+)', 1)").alias("words"))
    docs = docs.select("doc_id", "lang", "id", F.expr(CHUNKS).alias("chunks"))
    return docs.select(F.col("doc_id").alias("page_id"), F.expr("concat('https://site.example.org/records/', id)").alias("url"),
                       F.expr(HTML).alias("html"))


# Hard pages: what a flat reading gets wrong. Articles in the article, a table in a cell, items in
# items, contact keys below contact keys, escapes. Words with digits and letters beyond ASCII.
NESTED = """concat(
    '<html><head><script type="application/ld+json">{"@type": "Organization", "name": "', coalesce(get(chunks, 0), ''),
    '", "contactPoint": [{"telephone": ["+1 404 555 ', id, '", ', id, ', true, null, 1.5]}, {"email": {"email": "hidden', id, '@example.org"}}, {"email": "caf\\\\u00e9', id, '@example.org"}],',
    ' "phone": {"telephone": "below a key"}, "location": "Caf\\\\u00e9 \\\\"', id, '\\\\"", "depth": [[{"a": {"address": ["', id, ' Elm", "x"]}}]]}</script>',
    '<script type="application/ld+json">{"email": "broken"</script></head><body><article><h1>Nested ', id, '</h1>',
    array_join(transform(chunks, c -> concat('<p>', c, '</p> ')), ''),
    '<section><article><p>comment ', id, '</p></article></section> after ', id, '</article> outside',
    '<table><thead><tr><th>H<b>', id, '</b></th></tr></thead><tbody><tr><td>outer ', id, '</td><td>',
    array_join(transform(chunks, c -> concat('<table><tr><td>', c, '</td><td><div>in</div></td></tr></table>')), ''), '</td></tr></tbody></table>',
    '<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name">Org <b>', id, '</b></span>',
    '<div itemprop="founder" itemscope itemtype="https://schema.org/Person"><span itemprop="name">Ann &eacute; ', id, '</span>',
    '<a itemprop="email" href="ann', id, '@example.org">mail</a><meta itemprop="email" content="second', id, '@example.org">',
    '<div itemprop="address" itemscope><span itemprop="streetAddress">', id, ' Inner St</span></div></div><span itemprop="telephone">+1 303 555 ', id, '</span></div>',
    '<div class="h-entry"><p class="p-name">Entry ', id, '</p><div class="p-author h-card"><a class="u-email" href="card', id, '@example.org">x</a>',
    '<span class="p-name">Card <i>', id, '</i></span></div><div class="h-cite"><span class="p-name">Cite ', id, '</span></div></div></body></html>')"""


def nested_pages(spark, sf_dir: str) -> DataFrame:
    """(page_id, url, html): a hard page per document."""
    docs = tables.documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("id"),
                                                  F.expr("regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9\\u00C0-\\u00FF]+)', 1)").alias("words"))
    docs = docs.select("doc_id", "id", F.expr(CHUNKS).alias("chunks"))
    return docs.select(F.col("doc_id").alias("page_id"), F.expr("concat('https://site.example.org/nested/', id)").alias("url"), F.expr(NESTED).alias("html"))
