"""Result sizes follow the request alone, patterns end on hostile input, null keys keep
their own group, streams are right over several files."""

import time

import pytest
from pyspark.sql import functions as F

from literal_rows import SMALL, one
from webcorpus.functions import contacts as C
from webcorpus.functions import urls as U
from webcorpus.operators import federate as FE
from webcorpus.operators import search as SE
from webcorpus.operators import service as SV
from webcorpus.streaming import service as ST


def test_250_results_asked_250_given(spark):
    rows = spark.range(400).selectExpr("1 AS query_id", "'google' AS engine", "cast(id + 1 AS int) AS rank",
                                       "concat('https://x.org/', id) AS url", "'t' AS title", "'s' AS snippet")
    limits = spark.createDataFrame([(1, 250)], "query_id int, num_results int")
    assert FE.limit_per_query(rows, limits).count() == 250
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('word ', id) AS text", "'en' AS lang", "'s' AS source")
    asked = spark.createDataFrame([(1, "word", "en", 250)], "query_id int, query string, language string, num_results int")
    assert SE.bm25_search(docs, asked).count() == 250
    assert SE.federated_search(docs, asked).count() == 250
    env = FE.query_envelopes(rows, spark).first()
    assert env["total_results"] == 400 and len(env["engines"]["google"]) == 400


def test_envelope_without_an_answer_has_the_error(spark):
    none = spark.createDataFrame([], "query_id int, engine string, rank int, url string, title string, snippet string")
    tried = spark.createDataFrame([(1, "google", "timeout"), (1, "bing", None)], "query_id int, engine string, error string")
    got = FE.query_envelopes(none, spark, attempts=tried).first()
    assert (got["success"], got["error"], got["engines_failed"], got["total_results"]) == (False, "timeout", 2, 0)
    assert got["engines"] == {"google": [], "bing": []} and got["error_type"] is not None


@pytest.mark.parametrize("expr, value", [
    (lambda c: C.structured_values(c, C.STRUCTURED_PHONE_KEYS), '<script type="application/ld+json">{"telephone": "' + "1" * 1_000_000 + '"}</script>'),
    (C.emails, "a@" + "b." * 20000 + "org"),
    (C.addresses, "12 oak st " * 800),
    (C.addresses, "12 oak st, Lima, CA 90210 " + "12 oak st " * 800),
])
def test_patterns_end_on_hostile_input(spark, expr, value):
    t0 = time.time()
    one(spark, expr(F.col("x")), value)
    assert time.time() - t0 < 20


def test_addresses_still_found(spark):
    assert one(spark, C.addresses(F.col("x")), "Visit 12 Oak Street, Lima, OH 45801! Or: 5 Elm Rd, Rome, NY 13440.") == ["12 Oak Street, Lima, OH 45801", "5 Elm Rd, Rome, NY 13440"]


def test_null_keys_keep_their_group(spark):
    health = spark.createDataFrame([("a", True), ("b", False)], "proxy string, is_working boolean")
    of = spark.createDataFrame([("a", None, "l"), ("b", "http", "l")], "proxy string, protocol string, proxy_source string")
    got = sorted(((r["dimension"], r["value"], r["total"]) for r in SV.source_scorecard(health, of).collect()), key=repr)
    assert got == sorted([("all", "all", 2), ("protocol", None, 1), ("protocol", "http", 1), ("source", "l", 2)], key=repr)


def test_second_level_suffixes(spark):
    for url, want in (("http://a.b.com.tr/", "b.com.tr"), ("http://x.gov.in/", "x.gov.in"), ("http://foo.co.kr/", "foo.co.kr"), ("http://foo.com.sg/", "foo.com.sg")):
        assert one(spark, U.registrable_domain(F.col("x")), url) == want


def test_first_seen_once_over_shuffled_files(spark, tmp_path):
    log = spark.range(900).selectExpr("id AS request_id", "concat('p', id % 150) AS proxy", "timestampadd(HOUR, cast((id * 7) % 900 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts",
                                      "id % 4 > 0 AS success", "0.5D AS response_time")
    log.repartition(3).write.parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    assert ST.run_to_table(ST.first_seen_stream(stream()), "seen").count() == 150
    got = ST.run_health(stream())
    assert got.agg(F.sum("successes")).first()[0] == log.where("success").count()


def test_addresses_keep_their_first_and_last_digits(spark):
    text = "Visit 10 Oak Street, Lima, OH 45800! Or: 11 Elm Rd, Rome, NY 13441. Or: 2 Ash Ave, Troy, MI 48082!"
    assert one(spark, C.addresses(F.col("x")), text) == ["10 Oak Street, Lima, OH 45800", "11 Elm Rd, Rome, NY 13441", "2 Ash Ave, Troy, MI 48082"]
