"""Keyword search over the stored documents (SRCH1-3)."""

from __future__ import annotations

from ..operators import batch as BA
from ..operators import search as SE
from ..sources import derived, tables
from . import duck as D
from .catalog import register


def _tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), {D.q(SE.TOKEN_SPLIT)}), lambda t: t <> '')"


VALID_REQUESTS = f"""
vq AS (SELECT * FROM requests WHERE length(coalesce(query, '')) BETWEEN 1 AND {BA.QUERY_MAX_CHARS}
       AND coalesce(num_results BETWEEN {BA.NUM_RESULTS_RANGE[0]} AND {BA.NUM_RESULTS_RANGE[1]}, false))"""


def bm25_sql(corpus: str, queries: str) -> str:
    """``corpus(doc, lang, text)``, ``queries(qk, lang, query, num_results)`` -> CTEs + final select
    of (qk, rank, doc, score)."""
    k1, b = SE.K1, SE.B
    return f"""
docs AS (SELECT doc, lang, {_tokens('text')} AS toks FROM {corpus}),
dl AS (SELECT doc, lang, len(toks) AS dl FROM docs),
st AS (SELECT lang, count(*) AS n_docs, avg(dl) AS avgdl FROM dl GROUP BY 1),
qt AS (SELECT DISTINCT qk, lang, unnest(list_distinct({_tokens('query')})) AS term FROM {queries}),
wanted AS (SELECT DISTINCT lang, term FROM qt),
post AS (SELECT doc, lang, term, count(*) AS tf FROM (SELECT doc, lang, unnest(toks) AS term FROM docs) x
         SEMI JOIN wanted USING (lang, term) GROUP BY ALL),
dft AS (SELECT lang, term, count(*) AS df FROM post GROUP BY ALL),
wt AS (SELECT p.doc, p.lang, p.term,
              ln(1 + (CAST(n_docs - df AS DOUBLE) + 0.5) / (CAST(df AS DOUBLE) + 0.5)) * tf * {k1 + 1}::DOUBLE
              / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * dl / avgdl)) AS w
       FROM post p JOIN dft USING (lang, term) JOIN dl USING (doc, lang) JOIN st USING (lang)),
sc AS (SELECT qk, doc, round(sum(w), 6) AS score FROM qt JOIN wt USING (lang, term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY score DESC, doc) AS rank FROM sc),
hits AS (SELECT rk.qk, CAST(rank AS INT) AS rank, doc, score FROM rk JOIN {queries} q USING (qk)
         WHERE rank <= q.num_results)"""


@register("keyword_search_bm25", oracle=f"""
{derived.duck_cte('requests')}, {VALID_REQUESTS},
c AS (SELECT doc_id AS doc, lang, text FROM documents),
qq AS (SELECT query_id AS qk, language AS lang, query, num_results FROM vq),
{bm25_sql('c', 'qq')}
SELECT qk AS query_id, rank, doc AS doc_id, score FROM hits""")
def keyword_search_bm25(spark, sf_dir):
    valid, _ = BA.split_valid(derived.view(spark, sf_dir, "requests"))
    return SE.bm25_search(tables.documents(spark, sf_dir), valid)


@register("federated_search", oracle=f"""
{derived.duck_cte('requests')}, {VALID_REQUESTS},
c AS (SELECT doc_id AS doc, lang || chr(0) || source AS lang, text FROM documents),
srcs AS (SELECT DISTINCT lang, source FROM documents),
qq AS (SELECT {{'qid': query_id, 'src': s.source}} AS qk, vq.language || chr(0) || s.source AS lang, query, num_results
       FROM vq JOIN srcs s ON s.lang = vq.language),
{bm25_sql('c', 'qq')},
keyed AS (SELECT qk.qid AS query_id, qk.src AS source, rank, doc AS doc_id, score,
                 sha256({D.clean('d.text')}) AS content_key FROM hits JOIN documents d ON d.doc_id = hits.doc),
m AS (SELECT query_id, content_key, min({{'source': source, 'rank': rank, 'doc_id': doc_id, 'score': score}}) AS b
      FROM keyed GROUP BY ALL)
SELECT query_id, b.source AS source, b.rank AS rank, b.doc_id AS doc_id, b.score AS score FROM m""")
def federated_search(spark, sf_dir):
    valid, _ = BA.split_valid(derived.view(spark, sf_dir, "requests"))
    return SE.federated_search(tables.documents(spark, sf_dir), valid)
