"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination,
mixing to target weights, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm import decontaminate, jaccard, language, mixing, token_codec
from webcorpus.llm.common import row_keys, write_shared
from webcorpus.llm.queries import TARGETS, table, tokenizer_path


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose keys are not among ``gone``, with all their columns."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = named.select("row", *row_keys(F.col("row.doc_id").cast("long"), F.col("row.text").cast("string")))
    return named.join(gone.select("k1", "k2").distinct(), ["k1", "k2"], "left_anti")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence settles.

    Null and empty texts and texts without letters have no language and go; a text of any
    length is judged whole; equal posteriors go to the first language by name; repeated rows
    are judged, and kept or not, alike; an empty table stays empty; all columns of ``docs``
    are returned whatever their names."""
    return _without(docs, language.identify(docs).where("not kept")).select("row.*")


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of equal rows, one.

    The row with the least id of a group stays (a null id is the least key); texts without
    words link with nothing and stay, of equal ones one; texts of any length are compared
    whole; an empty table stays empty; all columns are returned whatever their names."""
    own = _without(docs, jaccard.near_duplicates(docs).where("not kept"))
    return own.dropDuplicates(["k1", "k2"]).select("row.*")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows do not contaminate.

    Null and empty texts have no words and stay; texts of any length are searched whole;
    repeated rows are judged alike; an empty table, or an empty benchmark, drops nothing;
    all columns are returned whatever their names."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated")).select("row.*")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate asks (none, once or several times).

    Null and empty texts have the prior's rate; rows with equal id and text get the same
    number of copies; texts of any length are read whole; an empty table stays empty, without
    labelled rows every document stays once; all columns are returned whatever their names."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), TARGETS)


def token_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents, read back: a row per document.

    Null and empty texts have the end id alone; documents stand in ascending id order, null
    ids first, equal ids by a hash of the text, repeated rows as documents of their own; a
    text of any length is one document; an empty table gives no rows."""
    return token_codec.read_files(spark, token_codec.write_files(docs, tokenizer_path()), digest=True)


STAGES = [("language_id", language_stage), ("ngram_jaccard", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("token_output", token_stage)]

# A language model, MinHash candidates and a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
