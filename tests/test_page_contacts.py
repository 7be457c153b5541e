from pyspark.sql import functions as F

from literal_rows import one
from webcorpus.functions import contacts as C
from webcorpus.functions import page as P

LONG = "This paragraph is long enough to pass the fifty character minimum, surely."


def body(spark, html, fn, base="http://h.example.com/dir/page"):
    df = spark.createDataFrame([(html, base)], "html string, url string")
    b = P.page_body(F.col("html"))
    return df.select(fn(b, F.col("url")).alias("r")).first()["r"]


def test_title_rules(spark):
    t = lambda b, u: P.title(b)
    assert body(spark, "<html><head><title>A &amp; B</title></head><body><h1>H</h1></body></html>", t) == "A  B"
    assert body(spark, "<html><head><title></title></head><body><h1>H</h1></body></html>", t) == ""
    assert body(spark, "<html><body><h1>Head <b>one</b></h1></body></html>", t) == "Head one"
    assert body(spark, "<html><body><p>x</p></body></html>", t) == ""


def test_headings_levels_and_containers(spark):
    html = "<div><h1>One</h1><section><h2>Two</h2><h2> </h2></section></div><h6>Six</h6><header><h3>gone</h3></header>"
    h = body(spark, html, lambda b, u: P.headings(b))
    assert h == {"h1": ["One"], "h2": ["Two"], "h6": ["Six"]}


def test_paragraphs_unclosed_and_script(spark):
    html = (f"<html><head><script>var t='</p>';</script></head><body><p><b>{LONG}<br><p>{LONG} two</p>"
            f"<p>short</p><div><p>{LONG} three</div></body></html>")
    ps = body(spark, html, lambda b, u: P.paragraph_texts(b))
    assert ps == [LONG, LONG + " two", LONG + " three"]


def test_lists_and_tables(spark):
    html = ("<ul><li>a</li><li>b <i>c</i></li></ul><ol><li>1</li></ol><ul></ul>"
            "<table><thead><tr><th>H1</th><th>H2</th></tr></thead><tbody><tr><td>x</td><td>y</td></tr></tbody></table>"
            "<table><tr><th>k</th></tr><tr><td>v</td></tr></table><table></table>")
    lists = body(spark, html, lambda b, u: P.lists(b))
    assert lists["unordered"] == [["a", "b c"]] and lists["ordered"] == [["1"]]
    tables = body(spark, html, lambda b, u: P.tables(b))
    assert [(t["headers"], t["rows"]) for t in tables] == [(["H1", "H2"], [["x", "y"]]), ([], [["k"], ["v"]])]


def test_images_links_meta(spark):
    html = ('<img src="/i.png" alt="A" width="10"><img data-src="j.png"><img alt="none">'
            '<a href="/x">X</a><a href="#top">T</a><a href="javascript:void(0)">J</a><a href="mailto:a@b.c">M</a>'
            '<a href="/x" title="again">X2</a><a href="https://o.example.org/">O</a>'
            '<meta name="description" content="D1"><meta property="og:description" content="D2">'
            '<meta property="og:title" content="T1"><meta name="k" content="1"><meta name="k" content="2">')
    imgs = body(spark, html, P.images)
    assert [i["src"] for i in imgs] == ["http://h.example.com/i.png", "http://h.example.com/dir/j.png"]
    assert imgs[0]["alt"] == "A" and imgs[0]["width"] == "10" and imgs[1]["alt"] == ""
    links = body(spark, html, P.links)
    assert [(l["url"], l["text"]) for l in links] == [("http://h.example.com/x", "X"), ("https://o.example.org/", "O")]
    meta = body(spark, html, lambda b, u: P.meta(b))
    assert meta["description"] == "D1" and meta["k"] == "2" and meta["og:title"] == "T1"
    assert body(spark, html, lambda b, u: P.opengraph(b)) == {"og:description": "D2", "og:title": "T1"}


def test_main_content_and_language(spark):
    mc = lambda b, u: P.main_content(b)
    assert body(spark, "<body><main></main><article>A</article></body>", mc) == ""
    assert body(spark, "<body><div class='x entry-content'>E<b>F</b></div><p>z</p></body>", mc) == "EF"
    assert body(spark, "<body>B <i>C</i></body>", mc) == "B C"
    lang = lambda b, u: P.language(b)
    assert body(spark, '<html lang="de"><body></body></html>', lang) == "de"
    assert body(spark, '<html><head><meta http-equiv="content-language" content="fr"></head></html>', lang) == "fr"
    assert body(spark, "<html><body></body></html>", lang) == "en"


def test_json_ld_from_raw_html(spark):
    html = ('<script type="application/ld+json">{"@type": "Org", "telephone": ["555-123-4567"], "email": "x@y.org"}'
            '</script><script type="application/ld+json">not json</script>')
    df = spark.createDataFrame([(html,)], "html string")
    n = df.select(F.size(P.json_ld(F.col("html"))).alias("n")).first()["n"]
    assert n == 1
    c = df.select(C.contacts(F.lit(""), F.col("html")).alias("c")).first()["c"]
    assert c["emails"] == ["x@y.org"] and c["phones"] == ["555-123-4567"]


def test_emails(spark):
    x = F.col("x")
    text = "Mail A.B@Example.COM, x@logo.png, bad..dot@a.org, pipe@a.c|m and z@s.io."
    assert one(spark, C.emails(x), text) == ["A.B@example.com", "z@s.io"]


def test_phones_spellings_and_lengths(spark):
    x = F.col("x")
    got = one(spark, C.phones(x), "Call (555) 123-4567 or +1 555 123 4567; short 12345678 9; long 1234567890123456")
    assert "555-123-4567" in got and "(555) 123-4567" in got
    assert all(10 <= sum(ch.isdigit() for ch in p) <= 15 for p in got)
    assert one(spark, C.phone_digits(x), "(555) 123-4567 and 555.123.4567") == ["5551234567"]


def test_social_and_address(spark):
    x = F.col("x")
    text = ("see https://www.facebook.com/acme.co and twitter.com/acme, linkedin.com/company/acme-inc, "
            "instagram.com/acme, youtube.com/c/acme. Visit 12 Main Street, Springfield, IL 62704 today")
    s = one(spark, C.social_media(x), text)
    assert set(s) == {"facebook", "twitter", "linkedin", "instagram", "youtube"}
    assert one(spark, C.addresses(x), text) == ["12 Main Street, Springfield, IL 62704"]


def test_paragraph_context(spark):
    html = (f"<body><h1>Top</h1><div><h2>Inner</h2><p>{LONG}</p></div>"
            f"<div><section><h3>Gone</h3></section><p>{LONG} b</p></div><p>{LONG} c</p></body>")
    ps = body(spark, html, lambda b, u: P.paragraphs(b))
    assert [(p["text"][-2:], p["context"]) for p in ps] == [("y.", "Inner"), (" b", "Top"), (" c", "Top")]
    none = body(spark, f"<body><p>{LONG}</p><h2>After</h2></body>", lambda b, u: P.paragraphs(b))
    assert none[0]["context"] is None


def test_paragraph_context_of_headings_that_hold_paragraphs(spark):
    def got(html):
        return [(p["text"][-2:], p["context"]) for p in body(spark, f"<body>{html}</body>", lambda b, u: P.paragraphs(b))]

    inside = f"<h1>Top</h1><p>{LONG} a</p><h2 class='x'>Head<p>{LONG} b</p></h2><p>{LONG} c</p>"
    found = got(inside)
    assert found[:2] == [(" a", "Top"), (" b", "Top")]
    assert found[2][0] == " c" and found[2][1].startswith("Head")
    unclosed = f"<h1>Top</h1><div><h2>Open<p>{LONG} a</p><p>{LONG} b</p><h2>Two</h2><p>{LONG} c</p></div><p>{LONG} d</p>"
    assert got(unclosed) == [(" a", "Top"), (" b", "Top"), (" c", "Two"), (" d", "Top")]
    left = f"<h1>Top</h1><section><h2>Open<p>{LONG} a</p></section></h2><p>{LONG} b</p>"
    assert got(left) == [(" a", "Top"), (" b", "Top")]


def test_microdata_and_microformats(spark):
    html = ('<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">Ann &amp; Bo</span>'
            '<a itemprop="url" href="https://a.org/">home</a><meta itemprop="telephone" content="555-1234"></div>'
            '<div class="h-card"><span class="p-name">Cy</span><a class="u-url" href="https://c.org/">c</a></div>')
    df = spark.createDataFrame([(html,)], "html string")
    md = df.select(P.microdata(F.col("html")).alias("m")).first()["m"]
    assert md["types"] == ["https://schema.org/Person"]
    assert [(p["prop"], p["value"]) for p in md["properties"]] == [
        ("name", "Ann & Bo"), ("url", "https://a.org/"), ("telephone", "555-1234")]
    mf = df.select(P.microformats(F.col("html")).alias("m")).first()["m"]
    assert mf["types"] == ["h-card"]
    assert [(p["prop"], p["value"]) for p in mf["properties"]] == [("p-name", "Cy"), ("u-url", "https://c.org/")]


def test_nested_lists(spark):
    html = ("<ul><li>a</li><li>b<ul><li>c</li><li>d</li></ul></li><li>e<li>f</ul>"
            "<ol><li>1</li></ol><ul></ul><ul><li></li></ul>")
    got = body(spark, html, lambda b, u: P.lists(b))
    assert got["unordered"] == [["a", "bcd", "e", "f"], ["c", "d"], [""]]
    assert got["ordered"] == [["1"]]


def test_main_content_nested_class_block(spark):
    html = ('<body><div class="post-body"><div>one</div><div>two <div>three</div></div></div>'
            '<div>outside</div></body>')
    assert body(spark, html, lambda b, u: P.main_content(b)) == "onetwo three"


def test_microdata_contacts(spark):
    html = '<div itemscope><span itemprop="telephone">+1 555 000 1111</span><a itemprop="email" href="mailto:a@b.org">mail</a></div>'
    df = spark.createDataFrame([(html,)], "html string")
    c = df.select(C.contacts(F.lit(""), F.col("html")).alias("c")).first()["c"]
    assert c["phones"] == ["+1 555 000 1111"] and c["emails"] == ["mailto:a@b.org"]
