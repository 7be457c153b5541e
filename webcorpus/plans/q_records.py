"""Page-record queries over rendered record pages (EXT3, EXT7-9, EXT11-14, EXT18-19,
EXT21b-e, PRJ1-4, SET2, SCL7, SNK1). The oracles state the expected records from
``documents`` alone, as literal SQL; they share no pattern with the code under test."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions import page as P
from ..operators import pages as OP
from ..session import ensure_checkpoint_dir, pages_per_batch
from ..sources import sinks
from ..functions import structured as ST
from ..sources.record_render import nested_pages, record_pages
from .catalog import register

CTE = """WITH w AS (SELECT doc_id, coalesce(lang, 'en') AS lang, CAST(doc_id AS VARCHAR) AS id,
                 regexp_extract_all(coalesce(text, ''), '([A-Za-z]+)', 1) AS words FROM documents),
     c AS (SELECT doc_id AS page_id, id, lang, list_transform(range(0, len(words), 8),
                  lambda i: array_to_string(words[i + 1:i + 8], ' ')) AS chunks FROM w),
     k AS (SELECT page_id, id, unnest(chunks) AS chunk, CAST(generate_subscripts(chunks, 1) AS BIGINT) AS pos FROM c)
"""
NESTED_CTE = CTE.replace("[A-Za-z]+", "[A-Za-z0-9\u00C0-\u00FF]+")
URL = "'https://site.example.org/records/' || id"
REQUEST = f"sha256('page|' || id || '|' || {URL})"


def _body(spark, sf_dir):
    return OP.with_body(record_pages(spark, sf_dir))


@register("record_meta", oracle=f"""{CTE}
SELECT page_id, 'author' AS key, 'desk ' || id AS value FROM c
UNION ALL SELECT page_id, 'og:title', 'Record ' || id FROM c
UNION ALL SELECT page_id, 'description', coalesce(chunks[1], '') FROM c""")
def record_meta(spark, sf_dir):
    return _body(spark, sf_dir).select("page_id", F.explode(P.meta(F.col("body"))).alias("key", "value"))


@register("record_opengraph", oracle=f"{CTE} SELECT page_id, 'og:title' AS key, 'Record ' || id AS value FROM c")
def record_opengraph(spark, sf_dir):
    return _body(spark, sf_dir).select("page_id", F.explode(P.opengraph(F.col("body"))).alias("key", "value"))


@register("record_lists", oracle=f"""{CTE}
SELECT page_id, 'unordered' AS kind, pos, chunk AS item FROM k
UNION ALL SELECT page_id, 'ordered', 1, 'first ' || id FROM c
UNION ALL SELECT page_id, 'ordered', 2, 'second' FROM c""")
def record_lists(spark, sf_dir):
    found = _body(spark, sf_dir).select("page_id", P.lists(F.col("body")).alias("l"))
    found = found.select("page_id", F.explode(F.create_map(F.lit("ordered"), F.col("l.ordered"), F.lit("unordered"), F.col("l.unordered"))).alias("kind", "lists"))
    items = found.select("page_id", "kind", F.explode("lists").alias("items")).select("page_id", "kind", F.posexplode("items").alias("pos", "item"))
    return items.withColumn("pos", (F.col("pos") + 1).cast("long"))


@register("record_tables", oracle=f"""{CTE}
SELECT page_id, 'No|Words' AS header, pos, CAST(pos - 1 AS VARCHAR) || '|' || chunk AS cells FROM k""")
def record_tables(spark, sf_dir):
    found = _body(spark, sf_dir).select("page_id", F.explode(P.tables(F.col("body"))).alias("t"))
    return found.select("page_id", F.array_join("t.headers", "|").alias("header"), F.posexplode("t.rows").alias("pos", "row")) \
        .select("page_id", "header", (F.col("pos") + 1).cast("long").alias("pos"), F.array_join("row", "|").alias("cells"))


@register("record_images", oracle=f"""{CTE}
SELECT page_id, CAST(1 AS BIGINT) AS pos, 'https://site.example.org/img/' || id || '.png' AS src, 'figure ' || id AS alt, '' AS title, '40' AS width, '' AS height FROM c
UNION ALL SELECT page_id, 2, 'https://site.example.org/records/more.png', '', '', '', '' FROM c""")
def record_images(spark, sf_dir):
    found = _body(spark, sf_dir).select("page_id", F.posexplode(P.images(F.col("body"), F.col("url"))).alias("pos", "i"))
    return found.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "i.src", "i.alt", "i.title", "i.width", "i.height")


@register("record_json_ld", oracle=f"""{CTE}
SELECT page_id, 'Article' AS type, page_id AS position, coalesce(chunks[1], '') AS headline, 'desk' || id || '@example.org' AS email FROM c""")
def record_json_ld(spark, sf_dir):
    found = record_pages(spark, sf_dir).select("page_id", F.explode(P.json_ld(F.col("html"))).alias("v"))
    return found.select("page_id", F.variant_get("v", "$['@type']", "string").alias("type"), F.variant_get("v", "$.position", "long").alias("position"),
                        F.variant_get("v", "$.headline", "string").alias("headline"), F.variant_get("v", "$.author.email", "string").alias("email"))


@register("record_microdata", oracle=f"""{CTE}
SELECT page_id, 'https://schema.org/Person' AS type, 'name' AS prop, 'Desk ' || id AS value FROM c
UNION ALL SELECT page_id, 'https://schema.org/Person', 'email', 'desk' || id || '@example.com' FROM c""")
def record_microdata(spark, sf_dir):
    found = record_pages(spark, sf_dir).select("page_id", P.microdata(F.col("html")).alias("m"))
    return found.select("page_id", F.array_join("m.types", "|").alias("type"), F.explode("m.properties").alias("p")).select("page_id", "type", "p.prop", "p.value")


@register("record_microformats", oracle=f"""{CTE}
SELECT page_id, 'h-card' AS type, 'p-name' AS prop, 'Desk ' || id AS value FROM c
UNION ALL SELECT page_id, 'h-card', 'u-url', '/desk/' || id FROM c""")
def record_microformats(spark, sf_dir):
    found = record_pages(spark, sf_dir).select("page_id", P.microformats(F.col("html")).alias("m"))
    return found.select("page_id", F.array_join("m.types", "|").alias("type"), F.explode("m.properties").alias("p")).select("page_id", "type", "p.prop", "p.value")


@register("contacts_social", oracle=f"""{CTE}
SELECT page_id, 'twitter' AS platform, 'https://twitter.com/desk' || id AS link FROM c
UNION ALL SELECT page_id, 'facebook', 'www.facebook.com/desk.' || id FROM c""")
def contacts_social(spark, sf_dir):
    found = _body(spark, sf_dir).select("page_id", F.explode(C.social_media(P.raw_text(F.col("body")))).alias("platform", "links"))
    return found.select("page_id", "platform", F.explode("links").alias("link"))


@register("contacts_addresses", oracle=f"{CTE} SELECT page_id, id || ' Oak Street, Springfield, IL 62704' AS address FROM c")
def contacts_addresses(spark, sf_dir):
    return _body(spark, sf_dir).select("page_id", F.explode(C.addresses(P.raw_text(F.col("body")))).alias("address"))


@register("contacts_structured", oracle=f"""{CTE}
SELECT page_id, 'email' AS kind, 'desk' || id || '@example.org' AS value FROM c
UNION ALL SELECT page_id, 'phone', '+1 202 555 ' || lpad(id, 7, '0') FROM c
UNION ALL SELECT page_id, 'microdata email', 'desk' || id || '@example.com' FROM c""")
def contacts_structured(spark, sf_dir):
    html = F.col("html")
    kinds = F.create_map(F.lit("email"), C.structured_values(html, C.STRUCTURED_EMAIL_KEYS), F.lit("phone"), C.structured_values(html, C.STRUCTURED_PHONE_KEYS),
                         F.lit("microdata email"), C.microdata_values(html, C.STRUCTURED_EMAIL_KEYS))
    return record_pages(spark, sf_dir).select("page_id", F.explode(kinds).alias("kind", "vs")).select("page_id", "kind", F.explode("vs").alias("value"))


@register("page_content_view", oracle=f"""{CTE}
SELECT page_id, {URL} AS url, 'Record ' || id AS title, 'Record ' || id AS h1,
       CAST(len(list_filter(chunks, lambda t: length(t) >= 50)) + 2 AS BIGINT) AS paragraphs,
       {REQUEST} AS request_id FROM c""")
def page_content_view(spark, sf_dir):
    return OP.content_view(record_pages(spark, sf_dir)).select(
        "page_id", "url", "title", F.array_join(F.col("headings")["h1"], "|").alias("h1"), F.size("paragraphs").cast("long").alias("paragraphs"), "request_id")


@register("page_metadata_view", oracle=f"""{CTE}
SELECT page_id, 'Record ' || id AS title, 'desk ' || id AS author, lang AS language, CAST(1 AS BIGINT) AS json_ld,
       CAST(2 AS BIGINT) AS microdata, CAST(2 AS BIGINT) AS microformat, CAST(1 AS BIGINT) AS opengraph FROM c""")
def page_metadata_view(spark, sf_dir):
    data = F.col("structured_data")
    return OP.metadata_view(record_pages(spark, sf_dir)).select(
        "page_id", "title", F.col("meta")["author"].alias("author"), "language", F.size(data["json_ld"]).cast("long").alias("json_ld"),
        F.size(data["microdata"]["properties"]).cast("long").alias("microdata"), F.size(data["microformat"]["properties"]).cast("long").alias("microformat"),
        F.size(data["opengraph"]).cast("long").alias("opengraph"))


@register("page_contacts_view", oracle=f"""{CTE}
SELECT page_id, 'desk' || id || '@example.com|desk' || id || '@example.org|info' || id || '@example.net' AS emails,
       '+1 202 555 ' || lpad(id, 7, '0') AS phones, id || ' Oak Street, Springfield, IL 62704' AS addresses FROM c""")
def page_contacts_view(spark, sf_dir):
    return OP.contacts_view(record_pages(spark, sf_dir)).select(
        "page_id", *[F.array_join(F.col("contacts")[k], "|").alias(k) for k in ("emails", "phones", "addresses")])


@register("page_record", oracle=f"""{CTE}
SELECT page_id, {URL} AS url, 'Record ' || id AS title, lang AS language, CAST(len(chunks) AS BIGINT) AS items,
       CAST(len(chunks) AS BIGINT) AS table_rows, CAST(2 AS BIGINT) AS images, CAST(3 AS BIGINT) AS emails, CAST(1 AS BIGINT) AS phones,
       CAST(2 AS BIGINT) AS social, true AS structured, true AS success, {REQUEST} AS request_id FROM c""")
def page_record(spark, sf_dir):
    """EXT19 written as a table partitioned by a bucket of the host and read again (SNK1)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/page_record-{uuid.uuid4().hex}"
    full = OP.extract_pages(record_pages(spark, sf_dir))
    # parsed JSON-LD is VARIANT, which is kept as JSON text in the table
    data = F.col("structured_data")
    full = full.withColumn("structured_data", data.withField("json_ld", F.transform(data["json_ld"], lambda v: F.to_json(v))))
    with pages_per_batch(spark):
        sinks.write_table(sinks.with_domain_bucket(full, "url"), path, ["domain_bucket"])
    stats = F.col("statistics")
    count = lambda nested: F.aggregate(nested, F.lit(0), lambda n, x: n + F.size(x)).cast("long")
    return spark.read.parquet(path).select(
        "page_id", "url", "title", "language", count(F.col("lists.unordered")).alias("items"), count(F.col("tables.rows")).alias("table_rows"),
        stats["total_images"].cast("long").alias("images"), stats["email_count"].cast("long").alias("emails"), stats["phone_count"].cast("long").alias("phones"),
        stats["social_media_count"].cast("long").alias("social"), stats["has_structured_data"].alias("structured"), "success", "request_id")


@register("record_nested_main", oracle=f"""{NESTED_CTE}
SELECT page_id, trim(regexp_replace('Nested ' || id || array_to_string(list_transform(chunks, lambda c: c || ' '), '') || 'comment ' || id || ' after ' || id, ' +', ' ', 'g')) AS main_content FROM c""")
def record_nested_main(spark, sf_dir):
    return OP.with_body(nested_pages(spark, sf_dir)).select("page_id", P.main_content(F.col("body")).alias("main_content"))


@register("record_nested_tables", oracle=f"""{NESTED_CTE}
SELECT page_id, 'H' || id AS header, 0 AS tab, 0 AS pos, 'outer ' || id || '|' || coalesce(array_to_string(list_transform(chunks, lambda x: x || 'in'), ''), '') ||
       CASE WHEN len(chunks) > 0 THEN '|' || array_to_string(list_transform(chunks, lambda x: x || '|in'), '|') ELSE '' END AS cells FROM c
UNION ALL SELECT page_id, 'H' || id, 0, CAST(pos AS INT), chunk || '|in' FROM k
UNION ALL SELECT page_id, '', CAST(pos AS INT), 0, chunk || '|in' FROM k""")
def record_nested_tables(spark, sf_dir):
    found = OP.with_body(nested_pages(spark, sf_dir)).select("page_id", F.posexplode(P.tables(F.col("body"))).alias("tab", "t"))
    return found.select("page_id", F.array_join("t.headers", "|").alias("header"), "tab", F.posexplode("t.rows").alias("pos", "row")) \
        .select("page_id", "header", "tab", "pos", F.array_join("row", "|").alias("cells"))


@register("record_nested_items", oracle=f"""{NESTED_CTE}
SELECT page_id, 'https://schema.org/Organization' AS type, 'Org ' || id AS name, 'https://schema.org/Person' AS founder_type, 'Ann é ' || id AS founder_name,
       'ann' || id || '@example.org' AS founder_email, 'second' || id || '@example.org' AS founder_email_2, id || ' Inner St' AS street, '+1 303 555 ' || id AS phone,
       'Entry ' || id AS entry, 'Card ' || id AS author, 'card' || id || '@example.org' AS author_email, 'h-cite' AS child, 'Cite ' || id AS child_name,
       CAST(1 AS BIGINT) AS top_items FROM c""")
def record_nested_items(spark, sf_dir):
    found = nested_pages(spark, sf_dir).select("page_id", ST.nested_items(F.col("html")).alias("i"))
    found = found.select("page_id", F.try_parse_json("i.microdata").alias("m"), F.try_parse_json("i.microformats").alias("f"))
    paths = {"type": ("m", "$[0].type"), "name": ("m", "$[0].properties.name"), "founder_type": ("m", "$[0].properties.founder.type"), "founder_name": ("m", "$[0].properties.founder.properties.name"),
             "founder_email": ("m", "$[0].properties.founder.properties.email[0]"), "founder_email_2": ("m", "$[0].properties.founder.properties.email[1]"),
             "street": ("m", "$[0].properties.founder.properties.address.properties.streetAddress"), "phone": ("m", "$[0].properties.telephone"),
             "entry": ("f", "$[0].properties.name[0]"), "author": ("f", "$[0].properties.author[0].properties.name[0]"), "author_email": ("f", "$[0].properties.author[0].properties.email[0]"),
             "child": ("f", "$[0].children[0].type[0]"), "child_name": ("f", "$[0].children[0].properties.name[0]")}
    top = F.size(F.variant_get("m", "$", "array<variant>")).cast("long")
    return found.select("page_id", *[F.variant_get(v, path, "string").alias(n) for n, (v, path) in paths.items()], top.alias("top_items"))


@register("record_nested_contacts", oracle=f"""{NESTED_CTE}
SELECT page_id, 'emails' AS kind, unnest(['café' || id || '@example.org', 'ann' || id || '@example.org', 'second' || id || '@example.org', 'card' || id || '@example.org']) AS value FROM c
UNION ALL SELECT page_id, 'phones', unnest(['+1 404 555 ' || id, id, 'True', 'None', '1.5', '+1 303 555 ' || id]) FROM c
UNION ALL SELECT page_id, 'addresses', unnest(['Café "' || id || '"', id || ' Elm', 'x']) FROM c""")
def record_nested_contacts(spark, sf_dir):
    found = nested_pages(spark, sf_dir).select("page_id", C.structured_contacts(F.col("html")).alias("s"))
    kinds = F.create_map(*[x for k in ("emails", "phones", "addresses") for x in (F.lit(k), F.col(f"s.{k}"))])
    return found.select("page_id", F.explode(kinds).alias("kind", "vs")).select("page_id", "kind", F.explode("vs").alias("value"))
