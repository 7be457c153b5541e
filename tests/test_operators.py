import datetime as dt
import random

from pyspark.sql import functions as F

from webcorpus.functions import quality as Q
from webcorpus.operators import crawl as CR
from webcorpus.operators import federate as FE
from webcorpus.operators import service as S

T0 = dt.datetime(2024, 1, 1)


def test_error_classification_misfires(spark):
    rows = [("Blocked or captcha detected", 0, "captcha_detected"),
            ("No results found - selectors may be outdated or page layout changed", 0, "selector_mismatch"),
            ("No results found - Bing may have changed its layout or request was blocked", 0, "blocked"),
            ("All search strategies failed", 0, "rate_limited"),
            ("Engine timed out after 30.0s", 0, "timeout"),
            ("engine unavailable", 0, "engine_unavailable"),
            (None, 0, "no_results"), (None, 5, "unknown_error")]
    df = spark.createDataFrame(rows, "e string, n int, want string")
    got = df.select(Q.error_type(F.col("e"), F.col("n")).alias("t"), "want").collect()
    assert [r["t"] for r in got] == [r["want"] for r in got]


def test_block_and_challenge_labels(spark):
    df = spark.createDataFrame([("short",), ("<div class='g-recaptcha'>" + "x" * 200,),
                                ("<p>Just a moment... checking your browser</p>" + "y" * 200,), ("z" * 300,)], "h string")
    got = df.select(Q.is_blocked_page(F.col("h")).alias("b"), Q.challenge_type(F.col("h")).alias("c")).collect()
    assert [(r["b"], r["c"]) for r in got] == [(True, None), (True, "recaptcha_v2"), (False, "cloudflare"), (False, None)]


def test_priority_fallback(spark):
    rows = [  # query 1: google fails, bing answers; query 2: all fail, last error wins
        (1, "google", 1, T0, 1, False, 0, "403 Forbidden"),
        (1, "bing", 3, T0, 2, True, 4, None),
        (1, "yahoo", 4, T0, 3, True, 9, None),
        (2, "google", 1, T0, 4, True, 0, None),
        (2, "yahoo", 4, T0, 5, False, 0, "All search strategies failed"),
    ]
    df = spark.createDataFrame(rows, "q long, engine string, engine_no int, ts timestamp, request_id long, "
                                     "success boolean, n_results int, error string")
    got = {r["q"]: r for r in FE.priority_fallback(df, ["q"]).collect()}
    assert got[1]["success"] and got[1]["engine"] == "bing" and got[1]["n_results"] == 4
    assert not got[2]["success"] and got[2]["error"] == "All search strategies failed"
    assert got[2]["error_type"] == "rate_limited"
    only_first = {r["q"]: r for r in FE.priority_fallback(df, ["q"], enable_fallback=False).collect()}
    assert not only_first[1]["success"] and only_first[1]["error"] == "403 Forbidden"


def test_alternative_provider_comes_last(spark):
    rows = [(1, "google", 1, T0, 1, False, 0, "403 Forbidden"), (1, "bing", 3, T0, 2, False, 0, "timeout"),
            (1, "alternative", 5, T0, 3, True, 7, None),
            (2, "google", 1, T0, 4, True, 3, None), (2, "alternative", 5, T0, 5, True, 9, None)]
    df = spark.createDataFrame(rows, "q long, engine string, engine_no int, ts timestamp, request_id long, "
                                     "success boolean, n_results int, error string")
    for fallback in (True, False):
        got = {r["q"]: r["engine"] for r in FE.priority_fallback(df, ["q"], enable_fallback=fallback).collect()}
        assert got == {1: "alternative", 2: "google"}


def test_merge_drops_urlless_and_keeps_engine_order(spark):
    rows = [(1, "bing", 1, "web", "t1", "http://a", None, "s"), (1, "google", 2, "web", "t2", "http://a", None, "s"),
            (1, "yahoo", 1, "images", "t3", None, "http://img", "s"), (1, "duckduckgo", 1, "web", "t4", "http://b", None, "s")]
    df = spark.createDataFrame(rows, "query_id long, engine string, rank int, type string, title string, url string, "
                                     "image_url string, snippet string")
    got = sorted((r["url"], r["engine"]) for r in FE.merge_results(df, spark).collect())
    assert got == [("http://a", "google"), ("http://b", "duckduckgo")]


def test_pagination_cut(spark):
    # google pages of 10: page 0 full, page 1 has 2 rows (< 3: last kept), page 2 dropped
    rows = [(1, "google", r, "web", "t", f"http://x/{r}", None, "s") for r in list(range(1, 11)) + [11, 12, 21, 22, 23]]
    df = spark.createDataFrame(rows, "query_id long, engine string, rank int, type string, title string, url string, "
                                     "image_url string, snippet string")
    got = sorted((r["page_no"], r["n_rows"]) for r in FE.pagination_cut(df, spark).collect())
    assert got == [(0, 10), (1, 2)]


def reference_bucket(times, capacity, rate):
    tokens, last, out = capacity, times[0], []
    for t in times:
        tokens = min(capacity, tokens + (t - last) * rate)
        last = t
        ok = tokens >= 1
        if ok:
            tokens -= 1
        out.append(ok)
    return out


def test_source_health_matches_fold(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        rows.append((f"p{rnd.randint(0, 4)}", i, T0 + dt.timedelta(minutes=rnd.randint(0, 600)),
                     rnd.random() < 0.6, round(rnd.uniform(0, 12), 2)))
    df = spark.createDataFrame(rows, "proxy string, request_id long, ts timestamp_ntz, success boolean, response_time double")
    got = {r["proxy"]: r for r in S.source_health(df).collect()}
    for p in got:
        f = s = 0
        working, rt = True, 0.0
        for _, _, _, ok, r in sorted((x for x in rows if x[0] == p), key=lambda x: (x[2], x[1])):
            if ok:
                s += 1
                f = max(0, f - 1)
                working = True
                rt = r if r > 0 else rt
            else:
                f += 1
                working = working and f < 3
        assert (got[p]["failures"], got[p]["successes"], got[p]["is_working"], got[p]["response_time"]) == (f, s, working, rt)


def test_crawl_matches_fifo_queue(spark):
    rnd = random.Random(11)
    n = 40
    urls = [(i, f"http://www.example.{'com' if i % 3 else 'org'}/{i}") for i in range(n)]
    edges = [(s, k, rnd.randrange(n)) for s in range(n) for k in range(1, rnd.randint(1, 4))]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    e = spark.createDataFrame(edges, "src_id long, pos int, dst_id long")
    seeds = pages.select(F.col("page_id").alias("seed_id"), "page_id")
    got = {}
    for r in CR.crawl(seeds, pages, e, max_depth=4, max_pages=7).collect():
        got.setdefault(r["seed_id"], []).append((r["crawl_order"], r["page_id"], r["depth"]))
    dom = {i: u.split("/")[2].split(".", 1)[1] for i, u in urls}  # registrable domain
    links = {}
    for s, k, d in sorted(edges, key=lambda x: (x[0], x[1], x[2])):
        if d not in links.setdefault(s, []):
            links[s].append(d)
    for seed in range(n):
        queue, seen, order = [(seed, 0)], set(), []
        while queue and len(seen) < 7:
            u, depth = queue.pop(0)
            if u in seen or depth >= 4 or dom[u] != dom[seed]:
                continue
            seen.add(u)
            order.append((u, depth))
            if depth < 3:
                queue += [(v, depth + 1) for v in links.get(u, [])[:20] if v not in seen]
        assert [(p, d) for _, p, d in sorted(got[seed])] == order


def test_query_envelopes_are_bounded_and_ordered(spark):
    rows = [(1, e, r, "web", f"t{r}", f"http://{e}/{r % 3}", None, "s") for e in ("google", "bing") for r in range(1, 8)]
    df = spark.createDataFrame(rows, "query_id long, engine string, rank int, type string, title string, url string, "
                                     "image_url string, snippet string")
    env = FE.query_envelopes(df, spark, max_per_engine=5).collect()[0]
    assert [x["rank"] for x in env["engines"]["google"]] == [1, 2, 3, 4, 5]
    assert [(x["engine"], x["url"]) for x in env["all_results"]] == [
        ("google", "http://google/1"), ("google", "http://google/2"), ("google", "http://google/0"),
        ("bing", "http://bing/1"), ("bing", "http://bing/2"), ("bing", "http://bing/0")]
    assert env["total_results"] == 6 and env["engines_succeeded"] == 2 and env["success"]


def test_request_validation_rules(spark):
    from webcorpus.operators import batch as BA
    reqs = spark.createDataFrame([(1, "ok", "maps", 10), (2, "", "all", 10), (3, "x" * 501, "all", 0)],
                                 "query_id long, query string, search_type string, num_results int")
    got = {r["query_id"]: r["reasons"] for r in BA.validate_requests(reqs).collect()}
    assert got == {1: [], 2: ["query_empty"], 3: ["query_too_long", "num_results_out_of_range"]}
    crawl = spark.createDataFrame([("http://a", 2, 50), (" ", 0, 201)], "url string, max_depth int, max_pages int")
    reasons = [r["reasons"] for r in BA.validate_crawl_requests(crawl).collect()]
    assert reasons == [[], ["url_missing", "max_depth_out_of_range", "max_pages_out_of_range"]]
