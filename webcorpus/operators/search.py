"""Keyword retrieval over a stored corpus (SRCH1-3).

The original service sends a query to remote engines, which do the ranking. Here the
stored corpus is the index: documents are tokenised, scored with BM25 (the published
Okapi formula with Lucene's idf, k1 = 1.2, b = 0.75; the scoring is ours) per
language, and the top ``num_results`` per query are returned. A batch of queries is a
DataFrame (SRCH2), so one plan answers all of them.

Plan shape:
* two passes over the corpus: one for the per-language statistics (N, average
  length), one for the postings, where (doc, term) pairs carry the document length
  and are semi-joined with the batch's query terms *before* the term-frequency
  aggregate, so only terms someone asked for are counted;
* corpus statistics per language (N, average length) and document frequency per
  (language, term) are aggregates; every posting carries its weight. Documents of a
  language are dealt into blocks, and every query of that language goes to each of its
  blocks: a task sums the weights of its block's postings per query and returns the
  block's best documents of each query, so (query, document) pairs are never exchanged
  and what is exchanged grows with postings, and with queries times blocks;
* top-n: ``row_number() <= n`` with the largest ``num_results`` of the batch as a literal
  lets Spark keep only n rows per query and map partition before the exchange; the
  per-request ``num_results`` applies after.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T

# --- fixed values -----------------------------------------------------------------
K1 = 1.2
B = 0.75
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"
#: documents of one language that one task scores together
BLOCK_DOCS = 20_000
# ---------------------------------------------------------------------------------


def tokens(text_col) -> "F.Column":
    """Lower-cased word tokens (letters, digits, underscore), empty pieces removed."""
    return F.filter(F.split(F.lower(text_col), TOKEN_SPLIT), lambda t: t != "")


def _best_of_block(queries: pa.Table, postings: pa.Table) -> pa.Table:
    """The block's (query_id, doc, score) that can be among a query's first ``n``: of equal
    scores the first ``n`` documents, and whatever rounding could raise to the last place."""
    terms = pc.dictionary_encode(postings["term"].combine_chunks())
    docs = pc.dictionary_encode(postings["doc"].combine_chunks(), null_encoding="encode")
    place = np.empty(len(docs.dictionary), np.int64)  # documents numbered in their order
    place[pc.array_sort_indices(docs.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
    term = terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(terms.dictionary) + 1))
    doc, weight = place[docs.indices.to_numpy(zero_copy_only=False)][order], postings["w"].to_numpy()[order]
    code = {t: k for k, t in enumerate(terms.dictionary.to_pylist())}
    asked, wished = queries["terms"].combine_chunks(), queries["n"].to_numpy()
    whose, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, n in enumerate(wished.tolist()):
        spans = [(starts[code[t]], starts[code[t] + 1]) for t in asked[i].as_py() if t in code]
        if n < 1 or not spans:
            continue
        sums = np.bincount(np.concatenate([doc[a:b] for a, b in spans]), np.concatenate([weight[a:b] for a, b in spans]), len(place))
        hits = np.flatnonzero(sums)
        if len(hits) > n:
            hits = hits[sums[hits] >= np.partition(sums[hits], -n)[-n] - 2e-6]
            hits = hits[np.lexsort((hits, -sums[hits]))]
            run = np.flatnonzero(np.append(True, np.diff(sums[hits]) != 0))
            hits = hits[np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits)))) < n]
        whose.append(np.full(len(hits), i))
        found.append(hits)
        scores.append(sums[hits])
    back = np.argsort(place)
    return pa.table({"query_id": queries["query_id"].combine_chunks().take(pa.array(np.concatenate(whose))),
                     "doc": docs.dictionary.take(pa.array(back[np.concatenate(found)])), "score": np.concatenate(scores)})


def bm25_search(corpus: DataFrame, queries: DataFrame, doc_key: str = "doc_id", text: str = "text",
                lang: str = "lang", max_results: int | None = None) -> DataFrame:
    """Top ``num_results`` documents per query by BM25 within the query's language.

    ``corpus(doc_key, text, lang)``; ``queries(query_id, query, language, num_results)``.
    ``max_results`` is an explicit wish of the caller; by default only ``num_results``
    bounds a query (its largest value is read first, as the literal of the group limit).
    Returns ``(query_id, rank, doc_key, score)`` with ``score`` rounded to 6 places."""
    docs = corpus.select(F.col(doc_key).alias("doc"), F.col(lang).alias("lang"), tokens(F.col(text)).alias("toks"))
    # pass 1: corpus statistics from document lengths (partial aggregates, tiny shuffle)
    stats = (docs.select("lang", F.size("toks").alias("dl")).groupBy("lang")
             .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
             .withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("int")))
    q_terms = (queries.select("query_id", F.col("language").alias("lang"),
                              F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
               .distinct())
    wanted = q_terms.select("lang", "term").distinct()
    # pass 2: postings of wanted terms only, each carrying its document's length.
    # explode_outer: no inferred non-empty filter (it would tokenise every text twice);
    # occurrences are counted before the exchange as well as after it
    postings = (docs.select("doc", "lang", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
                .join(wanted, ["lang", "term"], "left_semi")
                .groupBy("doc", "lang", "term", "dl").agg(F.count(F.lit(1)).alias("tf")))
    df_t = postings.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (postings.join(df_t, ["lang", "term"]).join(stats, "lang")
                .select("lang", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "doc", "term",
                        (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))).alias("w")))
    # each query goes to the blocks of its language; a query id that asks in several languages is
    # not cut in them, since a document id that occurs in several has the sum of its scores
    wishes = queries.groupBy("query_id").agg(F.when(F.count_distinct("language") > 1, F.lit(2**31 - 1))
                                             .otherwise(F.coalesce(F.max("num_results"), F.lit(0))).cast("int").alias("n"))
    asked = (q_terms.groupBy("query_id", "lang").agg(F.collect_list("term").alias("terms")).join(wishes, "query_id").join(stats, "lang")
             .select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "n", "terms"))
    kind = ST.StructType([ST.StructField("query_id", queries.schema["query_id"].dataType), ST.StructField("doc", corpus.schema[doc_key].dataType),
                          ST.StructField("score", ST.DoubleType())])
    scores = (asked.groupBy("lang", "block").cogroup(weighted.groupBy("lang", "block")).applyInArrow(_best_of_block, kind)
              .groupBy("query_id", "doc").agg(F.round(F.sum("score"), 6).alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc"))
    if max_results is None:
        max_results = queries.agg(F.max("num_results")).first()[0] or 0
    limits = queries.select("query_id", "num_results")
    return (scores.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= max_results)
            .join(limits, "query_id")
            .filter(F.col("rank") <= F.col("num_results"))
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_key), "score"))


def federated_search(corpus: DataFrame, queries: DataFrame, partition_col: str = "source",
                     per_source: int | None = None) -> DataFrame:
    """SRCH3: every ``partition_col`` value is its own index (own statistics); each
    returns its top ``num_results`` of the request (or ``per_source``, if the caller gives
    one); the lists are merged in source order then rank and
    de-duplicated on a content key (cleaned text hash), first occurrence kept (DEDUP2).
    Output: ``(query_id, source, rank, doc_id, score)`` for the kept rows."""
    q = queries.select("query_id", "query", "language", "num_results")
    if per_source is not None:
        q = q.withColumn("num_results", F.lit(per_source))
    parts = corpus.withColumn("_lang_src", F.concat_ws("\u0000", F.col("lang"), F.col(partition_col)))
    sources = corpus.select(F.col("lang").alias("language"), F.col(partition_col).alias("src")).distinct()
    q_src = q.join(sources, "language").withColumn(
        "language", F.concat_ws("\u0000", F.col("language"), F.col("src"))).withColumn(
        "query_id", F.struct(F.col("query_id").alias("qid"), F.col("src").alias("src")))
    # the bound is read from the requests alone, not from their join with the corpus's sources
    most = per_source if per_source is not None else q.agg(F.max("num_results")).first()[0] or 0
    hits = bm25_search(parts, q_src, doc_key="doc_id", lang="_lang_src", max_results=most)
    # texts are cleaned and hashed where they are read: the join exchanges their keys only
    keyed = (hits.join(corpus.select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("content_key")), "doc_id")
             .select(F.col("query_id.qid").alias("query_id"), F.col("query_id.src").alias("source"),
                     "rank", "doc_id", "score", "content_key"))
    first = F.min(F.struct("source", "rank", "doc_id", "score")).alias("b")
    return (keyed.groupBy("query_id", "content_key").agg(first)
            .select("query_id", "b.source", "b.rank", "b.doc_id", "b.score"))
