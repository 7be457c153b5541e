"""The DuckDB oracle fragments and the Spark column functions agree on edge-case html
that the given pages do not contain (nested blocks, entities, missing tags)."""

import duckdb
import pytest
from pyspark.sql import functions as F

from webcorpus.functions import page as P
from webcorpus.functions import text as T
from webcorpus.plans import duck as D

SNIPPETS = [
    "<html lang='de'><head><title>A &amp; B &lt;c&gt;</title></head><body><main><p>x</p></main></body></html>",
    "<body><div class=\"post-body\"><div>one</div><div>two <div>three</div></div></div><div>out</div></body>",
    "<body><div class='content'>a<div>b</div>c",
    "<html><head><meta http-equiv=\"content-language\" content=\"fr\"></head><body><h1>H1 &nbsp; t</h1>"
    "<p>para one is long enough to pass the fifty character minimum easily<br><p>short</p></body></html>",
    "<article><script>var t='</p>';</script><p>" + "word " * 12 + "</p><nav><p>" + "menu " * 12 + "</p></nav></article>",
    "<body><article>one <article>a comment</article> two <section><article>b</article></section> three</article> out</body>",
    "<body><main><p>x</p><div><main>inner</main> y</div> z</main> out</body>",
    "plain text &#39;quoted&#39; &copy; 2024 <b>bold",
    "<title>caf&#233; &#xE9;t&#xe9; &amp;#233; &#0; &#x110000; x</title><p>" + "&#8364; " * 12 + "end of it</p>",
    "<title>a &#38;lt; b &#38;#39; c</title>",
]


@pytest.fixture(scope="module")
def con():
    return duckdb.connect()


@pytest.mark.parametrize("html", SNIPPETS)
def test_fragments_agree(spark, con, html):
    df = spark.createDataFrame([(html,)], "html string").select(P.page_body(F.col("html")).alias("b"))
    b = F.col("b")
    row = df.select(P.title(b).alias("title"), P.language(b).alias("language"),
                    P.main_content(b).alias("main"), T.spaced_text(b).alias("text"),
                    P.paragraph_texts(b).alias("paras"), P.heading_texts(b, 1).alias("h1")).first()
    body = D.body(D.q(html))
    sql = (f"WITH x AS (SELECT {body} AS b) SELECT {D.title('b')}, {D.language('b')}, {D.main_content('b')}, "
           f"{D.spaced_text('b')}, {D.paragraph_texts('b')}, {D.heading_texts('b', 1)} FROM x")
    got = con.sql(sql).fetchall()[0]
    assert (row["title"], row["language"], row["main"], row["text"], list(row["paras"]), list(row["h1"])) == \
        (got[0], got[1], got[2], got[3], list(got[4]), list(got[5]))
