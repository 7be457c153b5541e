"""Language identification by fusing evidence in Bayes' rule.

* Text: hashed byte trigrams of the letters (other bytes count as one space). Their
  likelihoods per language are counted over all documents under the declared tags (a
  text counts as at most ``model_weight`` trigrams, so no one text makes a model).
  Trigrams overlap, so at most ``text_weight`` of them count in full.
* Declared tag (a page's markup language): how often each tag is declared for each
  language, from soft counts over the corpus.
* Host, and the address suffix after its last dot: share of each language, by grouped
  sums smoothed down a hierarchy: host to suffix to corpus.

The languages are the primary subtags declared in the corpus, the ``max_languages``
most frequent at most; so every collected model table has a fixed bound
(languages x buckets). Null or malformed tags and null hosts are no evidence. A
document is kept if it has letters and its best language has a posterior of at least
``least``; a text without letters has a null language. With no declared tag in the
whole table there is no model: language null, kept if there are letters.
One row per input row; equal posteriors go to the first language by name.

A text of any length is read whole; repeated rows count as evidence each; an empty table
gives no rows; only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, parts, row_keys, write_shared

BUCKET_BITS = 13
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_PLAIN = np.where(_LETTER, LOWER, 0x20).astype(np.uint32)


def trigrams(data: np.ndarray, offsets: np.ndarray):
    """Bucket of the trigram at each byte and whether it counts (inside one row, with a
    letter)."""
    c = _PLAIN[data]
    n = len(c) - 2
    if n <= 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    live = code != 0x202020
    for back in (1, 2):
        edge = offsets[1:-1] - back
        live[edge[(edge >= 0) & (edge < n)]] = False
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), live


def _count(languages: list[str], weight: float):
    def run(batches):
        place = {lang: k for k, lang in enumerate(languages)}
        total = np.zeros((len(languages), 1 << BUCKET_BITS))
        for batch in batches:
            tag = np.array([place.get(t, -1) for t in batch.column(batch.schema.get_field_index("tag")).to_pylist()])
            for a, b, data, offsets in parts(batch, "text"):
                bucket, live = trigrams(data, offsets)
                if not len(bucket):
                    continue
                row = np.repeat(np.arange(b - a), np.diff(offsets))[:len(bucket)]
                live &= tag[a:b][row] >= 0
                row = row[live]
                share = np.minimum(1.0, weight / np.maximum(np.bincount(row, minlength=b - a), 1))
                index = (tag[a:b][row] << BUCKET_BITS) + bucket[live]
                total += np.bincount(index, weights=share[row], minlength=total.size).reshape(total.shape)
        for k, lang in enumerate(languages):
            at = np.flatnonzero(total[k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["tag", "bucket", "c"])
    return run


def _likelihoods(table: np.ndarray, weight: float):
    """Per row: number of trigrams that count and the log likelihood per language."""
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in parts(batch, "text"):
                bucket, live = trigrams(data, offsets)
                at = np.minimum(offsets, len(bucket))
                held = np.append(0, np.cumsum(live))
                n = held[at[1:]] - held[at[:-1]]
                out = np.zeros((b - a, len(table)))
                for k in range(len(table)):
                    total = np.append(0.0, np.cumsum(np.where(live, table[k][bucket], 0.0)))
                    out[:, k] = total[at[1:]] - total[at[:-1]]
                out *= (np.minimum(n, weight) / np.maximum(n, 1))[:, None]
                edges = np.arange(0, out.size + 1, len(table), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(6)), pa.array(n.astype(np.int64)),
                                                  pa.ListArray.from_arrays(pa.array(edges), pa.array(out.ravel()))],
                                                 ["k1", "k2", "id", "tag", "host", "suffix", "n", "ll"])
    return run


def _posterior(logs):
    """Normalise an array column of logs."""
    top = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(top, lambda x: x / F.aggregate(top, F.lit(0.0), lambda s, y: s + y))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source",
             text_weight: float = 60.0, model_weight: float = 2000.0, strength: float = 20.0, least: float = 0.5, max_languages: int = 256) -> DataFrame:
    """k1, k2 (row keys), doc_id, lang, declared, confidence, kept per row of ``docs``."""
    tag = F.nullif(F.regexp_extract(F.lower(F.col(declared_col).cast("string")), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1), F.lit(""))
    host = F.nullif(F.lower(F.trim(F.col(host_col).cast("string"))), F.lit(""))
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(*row_keys(ident, text), ident.alias("id"), tag.alias("tag"), host.alias("host"), text.alias("text"))
    rows = rows.select("k1", "k2", "id", "tag", "host", F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), "text")
    top = rows.where("tag is not null").groupBy("tag").count().orderBy(F.desc("count"), "tag").limit(max_languages).collect()
    languages = sorted(r["tag"] for r in top)
    if not languages:
        letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return rows.select("k1", "k2", F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.col("tag").alias("declared"),
                           F.lit(None).cast("double").alias("confidence"), letters.alias("kept"))
    counts = np.full((len(languages), 1 << BUCKET_BITS), 0.5)
    place = {lang: k for k, lang in enumerate(languages)}
    counted = rows.where("tag is not null").select("tag", "text").mapInArrow(_count(languages, model_weight), "tag string, bucket int, c double")
    for r in counted.groupBy("tag", "bucket").agg(F.sum("c").alias("c")).toLocalIterator():
        counts[place[r["tag"]], r["bucket"]] += r["c"]
    table = np.log(counts / counts.sum(axis=1, keepdims=True))
    scored = write_shared(rows.mapInArrow(_likelihoods(table, text_weight), "k1 long, k2 long, id long, tag string, host string, suffix string, n long, ll array<double>"), "likelihoods")
    soft = scored.where("n > 0").select("tag", "host", "suffix", _posterior(F.col("ll")).alias("p"))
    size = len(languages)
    shares = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(size)]
    flat = F.array(*[F.lit(1.0 / size)] * size)

    def smoothed(sums, above):
        total = F.aggregate(sums, F.lit(0.0), lambda s, y: s + y)
        return F.transform(F.arrays_zip(sums.alias("s"), above.alias("a")), lambda z: (z["s"] + z["a"] * strength) / (total + strength))

    def gathered():
        return F.array(*[F.col(f"s{k}") for k in range(size)])

    whole = soft.agg(*shares).first()
    corpus = [((whole[f"s{k}"] or 0.0) + strength / size) / (sum(whole[f"s{j}"] or 0.0 for j in range(size)) + strength) for k in range(size)]
    level = F.array(*[F.lit(c) for c in corpus])
    suffixes = soft.where("suffix is not null").groupBy("suffix").agg(*shares).select("suffix", gathered().alias("s")).withColumn("a", level)
    suffixes = suffixes.select("suffix", smoothed(F.col("s"), F.col("a")).alias("a"))
    hosts = soft.where("host is not null").groupBy("host").agg(*shares, F.first("suffix").alias("suffix"))
    hosts = hosts.select("host", "suffix", gathered().alias("s")).join(suffixes, "suffix", "left").withColumn("a", F.coalesce("a", level))
    hosts = hosts.select("host", smoothed(F.col("s"), F.col("a")).alias("prior"))
    # P(tag | language): column sums over the languages' totals
    declared = {r["tag"]: [r[f"s{k}"] for k in range(size)] for r in soft.where(F.col("tag").isin(languages)).groupBy("tag").agg(*shares).collect()}
    grid = np.array([declared.get(t, [0.0] * size) for t in languages]) + 1.0
    grid = np.log(grid / grid.sum(axis=0, keepdims=True))
    logs = F.create_map(*[x for k, t in enumerate(languages) for x in (F.lit(t), F.array(*[F.lit(float(v)) for v in grid[k]]))])
    joined = scored.join(hosts, "host", "left").withColumn("prior", F.coalesce("prior", level)).withColumn("d", F.coalesce(F.try_element_at(logs, F.col("tag")), F.array_repeat(F.lit(0.0), size)))
    fused = F.transform(F.arrays_zip("ll", "prior", "d"), lambda z: z["ll"] + F.log(z["prior"]) + z["d"])
    out = joined.withColumn("p", _posterior(fused)).withColumn("confidence", F.array_max("p"))
    best = F.element_at(F.array(*[F.lit(t) for t in languages]), F.array_position("p", F.col("confidence")).cast("int"))
    some = F.col("n") > 0
    return out.select("k1", "k2", F.col("id").alias("doc_id"), F.when(some, best).alias("lang"), F.col("tag").alias("declared"),
                      F.when(some, F.col("confidence")).alias("confidence"), (some & (F.col("confidence") >= least)).alias("kept"))
