"""Mixing documents to target domain weights with soft membership. Native DataFrame
functions only.

* The labelled table names the domains (its label columns together, such as
  ``quality=1,toxic=0``). A naive Bayes model over ``1 << bits`` hashed words is
  counted from at most ``fit_rows`` labelled documents (those of the least id hash; the
  bound of what is broadcast), and gives every document a posterior over the domains,
  from its mean log likelihood per word times ``evidence`` words at most.
* Rates 0 <= r <= most per document are those nearest to 1, in sum_i w_i (r_i - 1)^2,
  that give every domain d its target, sum_i w_i r_i p_id = t_d, where w_i is the
  document's share of all tokens. Then r_i is 1 - sum_d c_d p_id, cut to its bounds, for
  one multiplier c_d per domain; these are found by Newton steps on the dual, each one
  distributed sum of a number per domain and per pair of domains, so no state per
  document is kept. ``damping`` holds the multipliers near their last value and is lowered
  until the shares are within ``close`` of the targets or stop moving. In the latter case
  no rates in the bounds reach the targets: the shares are the nearest that can be
  reached, ``mix`` warns, and ``mix_fit`` returns the residual with the rows.
* ``copies`` turns the rate into whole copies: its floor, and one more with the
  probability of its fraction, drawn by a hash of id and text. ``resample`` repeats or
  drops the rows accordingly.

Tokens are white-space separated words. Null or empty texts have no tokens, a posterior
of the prior and a rate like others. Targets are normalised over the domains that occur;
without labelled rows every rate is 1. One row per input row.

A text of any length is read whole; rows with equal id and text have equal posteriors, rates
and copies; an empty table gives no rows; only the named columns are read, so others may
have any name.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, row_keys, write_shared


def _literal(values: list[float]) -> Column:
    """A constant array of doubles; Catalyst folds the parse."""
    return F.from_json(F.lit(json.dumps([round(v, 6) for v in values])), "array<double>")


def word_buckets(text: Column, bits: int) -> Column:
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(split, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << bits)).cast("int"))


def domain_model(docs: DataFrame, labels: DataFrame, label_cols: list[str], bits: int, fit_rows: int):
    """(domains, prior, log weights by domain and bucket), from bounded samples."""
    name = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in label_cols])
    marks = labels.select(F.col("doc_id").cast("long").alias("mark"), *label_cols).dropna().select("mark", name.alias("domain"))
    marks = marks.groupBy("mark").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["n"] for r in marks.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(64).collect()}
    domains = sorted(sizes)
    if not domains:
        return [], [], []
    sample = marks.where(F.col("domain").isin(domains)).orderBy(F.xxhash64("mark"), "mark").limit(fit_rows)
    words = docs.join(F.broadcast(sample), F.col("id") == F.col("mark")).select("domain", F.explode(word_buckets(F.col("text"), bits)).alias("bucket"))
    counts = {d: [0.5] * (1 << bits) for d in domains}
    for r in words.groupBy("domain", "bucket").count().collect():  # domains x buckets at most
        counts[r["domain"]][r["bucket"]] += r["count"]
    logs = []
    for d in domains:
        total = sum(counts[d])
        logs.append([math.log(c / total) for c in counts[d]])
    every = sum(sizes.values())
    return domains, [sizes[d] / every for d in domains], logs


def memberships(docs: DataFrame, prior: list[float], logs: list[list[float]], bits: int, evidence: float) -> DataFrame:
    """(id, k1, k2, tokens, p): posterior per domain for each row."""
    size = len(prior)
    middle = [sum(row[k] for row in logs) / size for k in range(1 << bits)]
    weights = [_literal([row[k] - middle[k] for k in range(1 << bits)]) for row in logs]
    start = F.struct(*[F.lit(0.0).alias(f"s{d}") for d in range(size)])
    found = docs.select("id", "k1", "k2", word_buckets(F.col("text"), bits).alias("words"))
    summed = F.aggregate("words", start, lambda s, b: F.struct(*[(s[f"s{d}"] + F.get(weights[d], b)).alias(f"s{d}") for d in range(size)]))
    found = found.select("id", "k1", "k2", F.size("words").cast("long").alias("tokens"), summed.alias("s"))
    scale = F.least(F.lit(evidence), F.col("tokens")) / F.greatest(F.lit(1), F.col("tokens"))
    found = found.withColumn("l", F.array(*[F.lit(math.log(prior[d])) + F.col("s")[f"s{d}"] * scale for d in range(size)]))
    found = found.withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return found.select("id", "k1", "k2", "tokens", F.transform("e", lambda x: x / total).alias("p"))


def rate_of(pulls: list[float], most: float) -> Column:
    """The rate under the given multipliers, as an expression of p."""
    u = sum((F.col("p")[d] * F.lit(float(c)) for d, c in enumerate(pulls)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), 1.0 - u))


@dataclass
class Fit:
    """What the rates reach. ``residual``: reached less asked share of the present tokens,
    by domain; ``reached``: all are below ``close``; ``passes``: sums over the table."""
    domains: list[str]
    targets: list[float]
    residual: list[float]
    reached: bool
    passes: int

    def told(self) -> str:
        missed = [f"{d}: asked {t:.4f}, nearest {t + e:.4f}" for d, t, e in zip(self.domains, self.targets, self.residual)]
        return "target shares out of reach of rates in bounds: " + "; ".join(missed)


def fit_rates(members: DataFrame, targets: list[float], most: float, damping: float, close: float) -> tuple[Column, list[float], int]:
    """The rate expression, the residual shares at its end and the number of passes."""
    size = len(targets)
    asked = np.array(targets)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    passes = 0

    def sums(pulls):
        """Per token: reached shares, their derivative by the multipliers, dual value."""
        nonlocal passes
        passes += 1
        at = members.withColumn("r", rate_of(list(pulls), most))
        at = at.withColumn("u", sum((F.col("p")[d] * F.lit(float(c)) for d, c in enumerate(pulls)), F.lit(0.0)))
        at = at.withColumn("f", F.when((F.col("u") < 1.0) & (F.col("u") > 1.0 - most), F.col("tokens")).otherwise(0))
        row = at.agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * (F.col("r") * (1.0 - F.col("u")) - F.col("r") * F.col("r") / 2)).alias("v"),
                     *[F.sum(F.col("tokens") * F.col("r") * F.col("p")[d]).alias(f"t{d}") for d in range(size)],
                     *[F.sum(F.col("f") * F.col("p")[i] * F.col("p")[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
        if not row["n"]:
            return None
        bend = np.zeros((size, size))
        for i, j in pairs:
            bend[i, j] = bend[j, i] = row[f"h{i}_{j}"] / row["n"]
        return np.array([row[f"t{d}"] for d in range(size)]) / row["n"], bend, row["v"] / row["n"] + float(asked @ pulls)

    pulls = np.zeros(size)
    now = sums(pulls)
    if now is None:
        return F.lit(1.0), [0.0] * size, passes
    scale = np.maximum(now[0], 1e-9)
    while True:
        centre, start = pulls, now[0] - asked
        if np.abs(start).max() < close:
            break
        while True:  # Newton steps to this centre's optimum
            off = pulls - centre
            slope = asked - now[0] + damping * scale * off
            if np.abs(slope).max() < close / 100:
                break
            step = -np.linalg.solve(now[1] + damping * np.diag(scale), slope)
            value, length = now[2] + damping * float(scale @ off ** 2) / 2, 1.0
            while length > 1e-9:
                further = sums(pulls + length * step)
                if further[2] + damping * float(scale @ (off + length * step) ** 2) / 2 <= value + 1e-4 * length * float(slope @ step):
                    break
                length /= 4
            else:
                break  # the value is at its rounding
            pulls, now = pulls + length * step, further
        if np.abs(now[0] - asked - start).max() < close / 10:
            break
        damping /= 10
    return rate_of(list(pulls), most), list(map(float, now[0] - asked)), passes


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
        label_cols: tuple = ("quality", "toxic"), bits: int = 11, fit_rows: int = 20_000, evidence: float = 40.0,
        most: float = 4.0, damping: float = 1e-3, close: float = 1e-4) -> DataFrame:
    """k1, k2 (row keys), doc_id, n_tokens, domain (likeliest), posterior, rate, copies
    per row of ``docs``."""
    out, fit = mix_fit(docs, labels, targets, id_col, text_col, label_cols, bits, fit_rows, evidence, most, damping, close)
    if not fit.reached:
        warnings.warn(fit.told(), stacklevel=2)
    return out


def mix_fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
            label_cols: tuple = ("quality", "toxic"), bits: int = 11, fit_rows: int = 20_000, evidence: float = 40.0,
            most: float = 4.0, damping: float = 1e-3, close: float = 1e-4) -> tuple[DataFrame, Fit]:
    """The rows of ``mix``, and what their rates reach."""
    rows = keyed(docs, id_col, text_col)
    domains, prior, logs = domain_model(rows, labels, list(label_cols), bits, fit_rows)
    if not domains:
        blank = rows.select("k1", "k2", F.col("id").alias("doc_id"), F.size(word_buckets(F.col("text"), bits)).cast("long").alias("n_tokens"))
        blank = blank.select("*", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
        return blank, Fit([], [], [], True, 0)
    members = write_shared(memberships(rows, prior, logs, bits, evidence), "memberships")
    asked = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if not sum(asked):
        asked = prior
    wanted = [a / sum(asked) for a in asked]
    rate, residual, passes = fit_rates(members, wanted, most, damping, close)
    draw = F.pmod(F.xxhash64("k1", "k2", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    whole = F.floor("rate")
    best = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("p", F.array_max("p")).cast("int"))
    out = members.select("k1", "k2", F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), best.alias("domain"), F.col("p").alias("posterior"), rate.alias("rate"))
    out = out.withColumn("copies", (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int"))
    return out, Fit(domains, wanted, residual, max(map(abs, residual)) < close, passes)


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, as often as ``mix`` says."""
    asked = mix(docs, labels, targets, id_col, text_col, **options).where("copies > 0").groupBy("k1", "k2").agg(F.first("copies").alias("copies"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = named.select("row", *row_keys(F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col).cast("string")))
    found = named.join(asked.hint("shuffle_hash"), ["k1", "k2"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return found.select("row.*")
