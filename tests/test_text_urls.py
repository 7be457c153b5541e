from pyspark.sql import functions as F

from literal_rows import one
from webcorpus.functions import text as T
from webcorpus.functions import urls as U


def test_clean_text_order_and_classes(spark):
    x = F.col("x")
    assert one(spark, T.clean_text(x), "a & b") == "a  b"
    assert one(spark, T.clean_text(x), "  héllo \n wörld!  ") == "héllo wörld!"
    assert one(spark, T.clean_text(x), "x€y (ok) 'q' \"d\" a@b;c:-") == "xy (ok) 'q' \"d\" a@b;c:-"
    assert one(spark, T.clean_text(x), None) == ""


def test_truncate(spark):
    x = F.col("x")
    assert one(spark, T.truncate_text(x, 5), "abcdefgh") == "abcde..."
    assert one(spark, T.truncate_text(x, 5), "abcde") == "abcde"


def test_decode_entities(spark):
    x = F.col("x")
    assert one(spark, T.decode_entities(x), "a&amp;lt;b &lt;p&gt; &quot;q&quot; &#39;s&copy;") == "a&lt;b <p> \"q\" 's"
    assert one(spark, T.decode_entities(x), "caf&#233; &#xE9;t&#xe9; &amp;#233; &#x1F600;") == "café été &#233; \U0001F600"
    assert one(spark, T.decode_entities(x), "a &#38;lt; b") == "a &lt; b"


def test_sanitize_and_validity(spark):
    x = F.col("x")
    assert one(spark, U.sanitize_url(x), "  example.com/a ") == "https://example.com/a"
    assert one(spark, U.sanitize_url(x), "http://a.org") == "http://a.org"
    assert one(spark, U.is_valid_url(x), "https://a.org/x") is True
    assert one(spark, U.is_valid_url(x), "https:///x") is False
    assert one(spark, U.is_valid_url(x), "mailto:x@y.z") is False


def test_resolve_url(spark):
    base = "http://h.example.com/a/b/c.html?x=1#f"
    cases = {
        "/x": "http://h.example.com/x",
        "?q=1": "http://h.example.com/a/b/c.html?q=1",
        "#a": "http://h.example.com/a/b/c.html?x=1#a",
        "d.html": "http://h.example.com/a/b/d.html",
        "../d": "http://h.example.com/a/d",
        "../../../d": "http://h.example.com/d",
        ".": "http://h.example.com/a/b/",
        "//cdn.example.org/z": "//cdn.example.org/z",
        "https://o.example.net/p": "https://o.example.net/p",
    }
    df = spark.createDataFrame([(h, base) for h in cases], "h string, b string")
    got = {r["h"]: r["r"] for r in df.select("h", U.resolve_url(F.col("h"), F.col("b")).alias("r")).collect()}
    assert got == cases


def test_registrable_domain(spark):
    cases = {"https://a.b.example.co.uk/x": "example.co.uk", "http://www.example.com": "example.com",
             "http://localhost:8080/": "localhost.", "http://co.uk/": ".co.uk", "http://x.y.invalid/": "invalid."}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r["u"]: r["d"] for r in df.select("u", U.registrable_domain(F.col("u")).alias("d")).collect()}
    assert got == cases


def test_redirect_unwrap(spark):
    x = F.col("x")
    assert one(spark, U.unwrap_google_redirect(x), "/url?q=https%3A%2F%2Fa.org%2Fp&sa=U") == "https://a.org/p"
    assert one(spark, U.unwrap_google_redirect(x), "/url?url=https://b.org/&x=1") == "https://b.org/"
    # base64url of https://c.org/page
    assert one(spark, U.unwrap_bing_redirect(x),
               "https://www.bing.com/ck/a?!&&p=1&u=a1aHR0cHM6Ly9jLm9yZy9wYWdl&ntb=1") == "https://c.org/page"
    assert one(spark, U.unwrap_yahoo_redirect(x),
               "https://r.search.yahoo.com/_ylt=A/RV=2/RE=1/RO=10/RU=https%3a%2f%2fd.org%2f/RK=2/RS=x") == "https://d.org/"
    assert one(spark, U.unwrap_yahoo_redirect(x), "https://r.search.yahoo.com/?u=https%3A%2F%2Fe.org") == "https://e.org"
