import json

from pyspark.sql import functions as F

from webcorpus.operators import serp as SX
from webcorpus.sources import providers as PV


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("r")).first()["r"]


def test_searxng_and_invalid_json(spark):
    doc = json.dumps({"results": [{"title": "A", "url": "http://a", "content": "c", "engines": ["x"]},
                                  {"title": "B", "url": "http://b", "pretty_url": "b"}]})
    rows = one(spark, PV.searxng_results(F.col("x"), 1), doc)
    assert [(r["title"], r["displayed_url"], r["engine_sources"]) for r in rows] == [("A", "http://a", ["x"])]
    assert one(spark, PV.searxng_results(F.col("x"), 5), "{not json") == []


def test_brave_layouts_and_videos_quirk(spark):
    web = json.dumps({"web": {"results": [{"title": "W", "url": "http://w", "description": "d",
                                           "meta_url": {"netloc": "w"}}]},
                      "results": [{"title": "V", "url": "http://v"}]})
    assert [r["url"] for r in one(spark, PV.brave_results(F.col("x"), "videos", 10), web)] == ["http://w"]
    only_results = json.dumps({"results": [{"title": "V", "url": "http://v"}]})
    assert one(spark, PV.brave_results(F.col("x"), "videos", 10), only_results) == []
    img = json.dumps({"results": [{"title": "I", "url": "http://i.png", "thumbnail": {"src": "t"}, "source": "p"}]})
    r = one(spark, PV.brave_results(F.col("x"), "images", 10), img)[0]
    assert (r["type"], r["image_url"], r["thumbnail_url"], r["page_url"]) == ("image", "http://i.png", "t", "p")


def test_library_alternate_keys(spark):
    doc = json.dumps([{"title": "a", "href": "http://a", "body": "x"}, {"title": "b", "link": "http://b", "snippet": "y"},
                      {"title": "c"}])
    rows = one(spark, PV.library_text_results(F.col("x")), doc)
    assert [(r["url"], r["snippet"]) for r in rows] == [("http://a", "x"), ("http://b", "y")]


def test_instant_answer_topics(spark):
    topics = [{"Text": f"t{i}", "FirstURL": f"http://{i}"} for i in range(11)]
    topics.insert(3, {"FirstURL": "http://no-text"})
    topics.insert(5, {"Name": "group", "Topics": []})
    doc = json.dumps({"Heading": "H", "AbstractURL": "http://abs", "RelatedTopics": topics,
                      "Results": [{"Text": "r", "FirstURL": "http://r"}]})
    ia = one(spark, PV.instant_answer(F.col("x"), topic_limit=10), doc)
    assert len(one(spark, PV.instant_answer(F.col("x")), doc)["related_topics"]) > 10  # no limit of its own
    assert ia["heading"] == "H" and ia["abstract_url"] == "http://abs" and ia["answer"] == ""
    assert [t["text"] for t in ia["related_topics"]] == [f"t{i}" for i in range(10)]
    assert ia["results"][0]["url"] == "http://r"


def test_serp_quirks(spark):
    google = ('<div class="g"><a href="/url?q=https%3A%2F%2Fa.org%2Fx&amp;sa=U"><h3>Alpha result</h3></a>'
              '<div class="VwiC3b">short</div><p>This fallback paragraph is longer than thirty characters.</p></div>'
              '<div class="g"><a href="https://a.org/x"><h3>Dup</h3></a></div>'
              '<div class="g header"><a href="https://h.org/"><h3>Header is an ad class</h3></a></div>'
              '<div class="g"><a href="https://www.google.com/search?q=x"><h3>Internal</h3></a></div>'
              '<div class="g"><a href="https://b.org/"><h3>ab</h3></a></div>')
    bing = ('<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9jLm9yZw">Redirected</a></h2></li>'
            '<li class="b_algo"><h2><a href="https://d.org/">Direct one</a></h2><div class="b_caption">'
            '<p>Snippet text long enough here</p></div></li>')
    ddg = ('<div class="result"><a class="result__a" href="https://e.org/">E</a></div>'
           '<div class="result"><a class="result__a" href="https://e.org/">E</a></div>')
    caps = spark.createDataFrame([(1, "google", 0, google), (1, "bing", 0, bing), (1, "duckduckgo", 0, ddg)],
                                 "query_id long, engine string, page_no int, html string")
    got = {}
    for r in SX.extract_results(caps).collect():
        got.setdefault(r["engine"], []).append((r["pos"], r["title"], r["url"], r["snippet"]))
    # google: redirect unwrapped, snippet <= 20 chars kept (no fallback), duplicate url,
    # 'header' contains 'ad', internal link and a 2-character title all dropped
    assert got["google"] == [(1, "Alpha result", "https://a.org/x", "short")]
    # bing: bing.com links are skipped before unwrapping
    assert got["bing"] == [(1, "Direct one", "https://d.org/", "Snippet text long enough here")]
    # duckduckgo html results are not de-duplicated
    assert [g[2] for g in got["duckduckgo"]] == ["https://e.org/", "https://e.org/"]


def test_sinks_round_trip(spark, tmp_path):
    from webcorpus.sources import sinks
    df = spark.createDataFrame([(1, "google", "a.org"), (2, "bing", "b.org")], "id long, engine string, domain string")
    sinks.write_table(sinks.with_domain_bucket(df), str(tmp_path / "t"), ["engine"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["id"] for r in back.collect()) == [1, 2] and "domain_bucket" in back.columns
    docs = sinks.as_documents(df, ["id"]).collect()
    assert json.loads(docs[0]["document"])["engine"] in ("google", "bing")


def test_google_images(spark):
    script = ('<script>AF_initDataCallback({data: ["https://a.example.com/x.jpg", "https://encrypted-tbn0.x/y.png",'
              ' "http://b.example.org/z.webp"]});</script>')
    imgs = '<img src="https://c.example.net/i.png" alt="C"><img src="https://www.google.com/logo.png">'
    got = one(spark, PV.google_image_results(F.col("x")), script + imgs)
    assert [r["image_url"] for r in got] == ["https://a.example.com/x.jpg", "http://b.example.org/z.webp"]
    fallback = one(spark, PV.google_image_results(F.col("x")), imgs)
    assert [(r["image_url"], r["title"]) for r in fallback] == [("https://c.example.net/i.png", "C")]


def test_bing_images(spark):
    html = ('<a class="iusc" m="{&quot;murl&quot;:&quot;https://m/1.jpg&quot;,&quot;t&quot;:&quot;T&quot;}" href="/p">'
            '<img src="s"></a><a class="iusc" href="https://page/"><img src="https://t/2.jpg" alt="A"></a>'
            '<a class="iusc" m="{broken"><img src="z"></a>')
    got = one(spark, PV.bing_image_results(F.col("x")), html)
    assert [(r["image_url"], r["title"], r["page_url"]) for r in got] == [
        ("https://m/1.jpg", "T", ""), ("https://t/2.jpg", "A", "https://page/")]


def test_bing_videos(spark):
    html = ('<div class="mc_vtvc"><a href="/videos/watch?v=1" title="First clip"><img src="https://t/1.jpg"></a>'
            '<span class="mc_vtvc_meta_dur">3:05</span><span class="mc_vtvc_meta_row_pri">1.2M views</span></div>'
            '<div class="dg_u"><a href="https://v.example.org/2">Second <b>clip</b></a></div>'
            '<div class="dg_u"><a href="https://v.example.org/3"></a></div><div class="dg_u">no link</div>')
    got = one(spark, PV.bing_video_results(F.col("x")), html)
    assert [(r["title"], r["url"], r["duration"], r["views"], r["thumbnail"]) for r in got] == [
        ("First clip", "https://www.bing.com/videos/watch?v=1", "3:05", "1.2M views", "https://t/1.jpg"),
        ("Second clip", "https://v.example.org/2", "", "", "")]


def test_title_rule_and_news_keep_duplicates(spark):
    google = ('<div class="g"><a href="https://a.org/1"><h3>abc</h3></a></div>'
              '<div class="g"><a href="https://a.org/2"><h3>ab</h3></a></div>')
    news = ('<div class="SoaBEf"><a href="https://n.org/x"><div role="heading">Same story</div></a></div>'
            '<div class="SoaBEf"><a href="https://n.org/x"><div role="heading">Same story</div></a></div>')
    caps = spark.createDataFrame([(1, "google", 0, google)], "query_id long, engine string, page_no int, html string")
    web = [(r["title"], r["url"]) for r in SX.extract_results(caps).collect()]
    assert web == [("abc", "https://a.org/1")]  # a 3-character title is kept, 2 characters are not
    ncaps = spark.createDataFrame([(1, "google", 0, news)], "query_id long, engine string, page_no int, html string")
    assert [r["url"] for r in SX.extract_news(ncaps).collect()] == ["https://n.org/x", "https://n.org/x"]


def test_library_news_images_videos(spark):
    news = json.dumps([{"title": "N", "link": "http://n", "excerpt": "e", "source": "S", "date": "d"}])
    n = one(spark, PV.library_news_results(F.col("x")), news)[0]
    assert (n["type"], n["url"], n["snippet"], n["source"], n["date"]) == ("news", "http://n", "e", "S", "d")
    imgs = json.dumps([{"title": "I", "image": "http://i.png", "url": "http://p", "width": 640}])
    i = one(spark, PV.library_image_results(F.col("x")), imgs)[0]
    assert (i["thumbnail_url"], i["page_url"], i["width"], i["height"]) == ("http://i.png", "http://p", 640, 0)
    vids = json.dumps([{"title": "V", "content": "http://v", "images": {"large": "http://t"},
                        "statistics": {"viewCount": 12}, "duration": "1:00"}, {"title": "W", "url": "http://w"}])
    v = one(spark, PV.library_video_results(F.col("x")), vids)
    assert [(x["url"], x["thumbnail_url"], x["views"], x["duration"]) for x in v] == [
        ("http://v", "http://t", 12, "1:00"), ("http://w", "", 0, "")]


def test_yahoo_images_and_google_videos(spark):
    yimg = ('<ul><li class="ld"><a href="https://r.search.yahoo.com/_ylt=A/RU=https%3a%2f%2fp.org%2f/RK=2/RS=x">'
            '<img data-src="https://i/1.jpg" alt="one"></a></li>'
            '<li class="ld"><img src="https://i/spacer.gif"></li><li class="ld"><img src="https://i/2.png"></li></ul>')
    got = one(spark, PV.yahoo_image_results(F.col("x")), yimg)
    assert [(r["image_url"], r["title"], r["page_url"]) for r in got] == [
        ("https://i/1.jpg", "one", "https://p.org/"), ("https://i/2.png", "", "")]
    gvid = ('<div class="g"><h3>Clip one</h3><a href="https://site.org/a">site</a>'
            '<a href="/url?q=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3D1&amp;sa=U">yt</a>'
            '<div class="J1mWY">4:20</div><div class="VwiC3b">About the clip</div></div>'
            '<div class="g"><a href="https://x.org/">no title</a></div>')
    v = one(spark, PV.google_video_results(F.col("x")), gvid)
    assert [(r["title"], r["url"], r["duration"], r["snippet"]) for r in v] == [
        ("Clip one", "https://www.youtube.com/watch?v=1", "4:20", "About the clip")]


def test_yahoo_videos_and_duckduckgo_news(spark):
    yv = ('<li class="vr"><a class="vr-title" href="https://v.org/1">First</a><img src="https://t/1.jpg">'
          '<span class="v-time">2:00</span><span class="v-source">Tube</span></li>'
          '<li class="vr"><a href="https://v.org/2" title="Only attr"></a></li>')
    v = one(spark, PV.yahoo_video_results(F.col("x")), yv)
    assert [(r["title"], r["url"], r["duration"], r["video_source"], r["thumbnail_url"]) for r in v] == [
        ("First", "https://v.org/1", "2:00", "Tube", "https://t/1.jpg"), ("Only attr", "https://v.org/2", "", "", "")]
    dn = ('<div class="result"><h2><a class="result__a" href="https://n.org/1">Story</a></h2>'
          '<a class="result__snippet">Text</a><span class="result__extras__url">n.org</span></div>'
          '<div class="result"><a class="result__a" href="https://n.org/1">Story</a></div>')
    n = one(spark, PV.duckduckgo_news_results(F.col("x")), dn)
    assert [(r["title"], r["url"], r["snippet"], r["source"], r["type"]) for r in n] == [
        ("Story", "https://n.org/1", "Text", "n.org", "news"), ("Story", "https://n.org/1", "", "duckduckgo", "news")]
