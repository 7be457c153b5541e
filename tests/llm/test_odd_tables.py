"""Empty tables, columns whose names clash with the operators' own, and very long texts,
through every dealt operator and every pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webcorpus.llm import (decontaminate, embedding_dedup, hard_negatives, jaccard, language, mixing, quality, secret_scan, simhash, spelling, suffix_dedup,
                           token_codec, url_rules)
from webcorpus.llm.queries import TARGETS, tokenizer_path

CLASH = ("k1", "k2", "id", "node", "word", "n", "c", "fp", "part", "host", "path", "q", "label", "grp", "key", "row", "rate", "copies")


def clashing(df):
    """The table with columns of the names that operators use inside."""
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


def operators(spark, sf_dir):
    bench, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    return {
        "op1": ("documents", lambda d: suffix_dedup.dedup(d)), "op2": ("documents", lambda d: secret_scan.scan(d)), "op3": ("pages", lambda d: url_rules.judge(d, rules)),
        "op4": ("documents", lambda d: language.identify(d)), "op5": ("documents", lambda d: decontaminate.contaminated(d, bench)), "op6": ("documents", lambda d: quality.score(d, labels)),
        "op7": ("documents", lambda d: jaccard.near_duplicates(d)), "op8": ("embeddings", lambda d: embedding_dedup.near_duplicates(d)), "op9": ("documents", lambda d: mixing.mix(d, labels, TARGETS)),
        "op10": ("documents", lambda d: token_codec.read_files(spark, token_codec.write_files(d, tokenizer_path()), digest=True)),
        "op11": ("documents", lambda d: spelling.variants(d)), "op12": ("embeddings", lambda d: hard_negatives.mine(d, F.col("vec_id") % 100 == 0)), "op13": ("documents", lambda d: simhash.compared(d)),
    }


@pytest.mark.filterwarnings("ignore:target shares")
@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 14)])
def test_empty_tables_and_clashing_names(spark, sf_dir, name):
    table, operator = operators(spark, sf_dir)[name]
    given = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    assert operator(clashing(given.limit(0))).count() == 0
    if name in ("op11", "op12"):  # these have rows of their own kind
        assert operator(clashing(given)).count() == operator(given).count() > 0
    else:
        assert operator(clashing(given)).count() == given.count()


@pytest.mark.filterwarnings("ignore:target shares")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table_and_a_very_long_text(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    long = spark.createDataFrame([(10**9, "the long words of one text go on and on, " * 60_000, "en", "long.example.org", 1)], docs.schema)
    out = stage(spark, docs.limit(20).unionByName(long).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema)), sf_dir)
    rows = out.select("doc_id").collect()
    assert 0 < len(rows) <= 80
    if name != "token_output":
        assert out.columns == docs.columns
