"""Property-style invariants with hypothesis-generated rows."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webcorpus.functions import text as T
from webcorpus.operators import federate as FE

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
KEPT = re.compile(r"[^\w .,!?;:()'\"@-]")


@SETTINGS
@given(st.lists(st.text(min_size=0, max_size=40), min_size=1, max_size=20))
def test_clean_text_keeps_only_allowed_characters(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select(T.clean_text(F.col("x")).alias("c")).collect():
        c = r["c"]
        assert not KEPT.search(c), c
        assert c == c.strip()
        assert "\n" not in c and "\t" not in c


urls = st.sampled_from([f"http://h{i}.example.com/" for i in range(6)] + [None])
rows = st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["google", "duckduckgo", "bing", "yahoo"]),
                          st.integers(1, 12), urls), min_size=1, max_size=40)


@SETTINGS
@given(rows)
def test_merge_is_idempotent_and_keeps_first_engine(spark, data):
    df = spark.createDataFrame([(q, e, r, "web", "t", u, None, "s") for q, e, r, u in data],
                               "query_id long, engine string, rank int, type string, title string, url string, "
                               "image_url string, snippet string")
    once = FE.merge_results(df, spark)
    again = FE.merge_results(once.withColumn("type", F.lit("web")).withColumn("image_url", F.lit(None).cast("string"))
                             .withColumn("snippet", F.lit("s")).drop("engine_no"), spark)
    a = sorted((r["query_id"], r["url"], r["engine"], r["rank"]) for r in once.collect())
    b = sorted((r["query_id"], r["url"], r["engine"], r["rank"]) for r in again.collect())
    assert a == b
    prio = {e: i for e, i, *_ in FE.ENGINE_CONFIG}
    for q, url, engine, rank in a:
        best = min((prio[e], rk) for qq, e, rk, u in data if qq == q and u == url)
        assert (prio[engine], rank) == best


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from(["google", "bing", "duckduckgo"]),
                          st.integers(1, 60), st.booleans()), min_size=1, max_size=60))
def test_pagination_output_is_a_prefix(spark, data):
    df = spark.createDataFrame([(q, e, r, "web", "t", f"http://x/{r}" if has else None, None, "s")
                                for q, e, r, has in data],
                               "query_id long, engine string, rank int, type string, title string, url string, "
                               "image_url string, snippet string").dropDuplicates(["query_id", "engine", "rank"])
    kept = {}
    for r in FE.pagination_cut(df, spark).collect():
        kept.setdefault((r["query_id"], r["engine"]), []).append(r["page_no"])
    cfg = {e: (size, cap, stop) for e, _, size, cap, stop in FE.ENGINE_CONFIG}
    counts = {}
    for r in df.filter("url IS NOT NULL").collect():
        size = cfg[r["engine"]][0]
        key = (r["query_id"], r["engine"], (r["rank"] - 1) // size)
        counts[key] = counts.get(key, 0) + 1
    for q, e in {(q, e) for q, e, _, _ in data}:
        size, cap, stop = cfg[e]
        want = []
        for page in range(min(-(-100 // size), cap)):  # pages in order, the original's loop
            n = counts.get((q, e, page), 0)
            if n == 0:
                break
            want.append(page)
            if n < stop:
                break
        assert sorted(kept.get((q, e), [])) == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(1, 3), st.integers(0, 14)), min_size=1, max_size=40))
def test_crawl_depth_is_minimal(spark, edges):
    from collections import deque

    from webcorpus.operators import crawl as CR
    pages = spark.createDataFrame([(i, f"http://www.example.com/{i}") for i in range(15)], "page_id long, url string")
    e = spark.createDataFrame(edges, "src_id long, pos int, dst_id long")
    seeds = spark.createDataFrame([(0, 0)], "seed_id long, page_id long")
    got = {r["page_id"]: r["depth"] for r in CR.crawl(seeds, pages, e, max_depth=5, max_pages=1000,
                                                      checkpoint=False).collect()}
    adj = {}
    for s, _, d in edges:
        adj.setdefault(s, set()).add(d)
    dist, q = {0: 0}, deque([0])
    while q:
        u = q.popleft()
        for v in adj.get(u, ()):
            if v not in dist:
                dist[v] = dist[u] + 1
                q.append(v)
    assert got == {p: d for p, d in dist.items() if d < 5}


def test_statistics_equal_array_sizes(spark):
    from literal_rows import SMALL
    from webcorpus.operators import pages as OP
    from webcorpus.sources import tables
    rec = OP.extract_pages(tables.pages(spark, SMALL))
    bad = rec.filter(
        (F.col("statistics.total_paragraphs") != F.size("paragraphs"))
        | (F.col("statistics.total_images") != F.size("images"))
        | (F.col("statistics.total_links") != F.size("links"))
        | (F.col("statistics.email_count") != F.size("contacts.emails"))
        | (F.col("statistics.phone_count") != F.size("contacts.phones"))
        | (F.col("statistics.content_length") != F.length("text_content"))).count()
    assert bad == 0
