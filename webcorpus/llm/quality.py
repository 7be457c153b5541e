"""Document quality scores: kernel ridge regression in random Fourier features.

* Statistics of every whole text (byte classes, words, repetition, compressibility),
  standardised by their mean and deviation over all documents.
* ``features`` random Fourier features approximate a Gaussian kernel over them.
* Normal equations summed per partition and fold of the labelled documents; ridge
  solution on the driver (its size is fixed by ``features``). Rows whose
  crc32(id) mod 5 is 0 are held out and never used.
* Isotonic calibration: each labelled row is scored by the equations of the other
  folds; pool-adjacent-violators over ``bins`` bins of these scores gives the map from
  raw score to probability.

The score depends on the text alone. Null text is empty. A document with several labels
has their mean; null labels are none. Without labels every score is 0.5. One row per
input row; a null id is not held out.

A text of any length is read whole; equal texts have equal scores, repeated rows a row each;
an empty table gives no rows; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, longs, parts, shingles, words, write_shared

CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "|", "#*$%&@~^", "\"'`()[]{}<>", "-_/\\=+")
_GROUP = np.zeros((256, len(CLASSES) + 1))
for _k, _c in enumerate(CLASSES):
    _GROUP[[ord(x) for x in _c], _k] = 1
_GROUP[0x80:, len(CLASSES)] = 1
NAMES = [*(f"c{k}" for k in range(len(CLASSES) + 1)), "size", "words", "length", "longest", "distinct", "fresh", "packed", "line"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{n} double" for n in NAMES)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    some = np.maximum(size, 1)
    share = counts @ _GROUP / some[:, None]
    h, s, e, of = words(data, offsets)
    m = np.bincount(of, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, of, (e - s).astype(float))
    order = np.lexsort((h, of))
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][first], minlength=n)
    sh, at = shingles(h, of, 3)
    r = of[at]
    order = np.lexsort((sh, r))
    first = np.ones(len(sh), dtype=bool)
    first[1:] = (sh[order][1:] != sh[order][:-1]) | (r[order][1:] != r[order][:-1])
    fresh = np.bincount(r[order][first], minlength=n) / np.maximum(np.bincount(r, minlength=n), 1)
    packer = zstandard.ZstdCompressor(level=1)
    raw = memoryview(data.tobytes())
    packed = np.array([len(packer.compress(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
    return np.column_stack([share, np.log1p(size), np.log1p(m), np.bincount(of, weights=e - s, minlength=n) / np.maximum(m, 1), np.log1p(longest),
                            distinct / np.maximum(m, 1), fresh, packed / (some + 16), size / (counts[:, 10] + 1.0) / some])


def _statistics(batches):
    for batch in batches:
        for a, b, data, offsets in parts(batch, "text"):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], ["doc_id", *NAMES])


class Features:
    """The fixed random map from statistics to features, with a constant."""

    def __init__(self, mean, dev, count: int, width: float, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.mean, self.dev = np.array(mean), np.maximum(np.array(dev), 1e-6)
        self.turn = rng.normal(size=(len(NAMES), count)) / width
        self.shift = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -6, 6) @ self.turn + self.shift
        return np.column_stack([np.cos(z) * np.sqrt(2.0 / len(self.shift)), np.ones(len(x))])


def _matrix(batch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in NAMES])


def _equations(phi: Features):
    """Sums of the normal equations of one partition, a row per fold and equation."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = phi(_matrix(batch))
            fold = longs(batch.column(batch.schema.get_field_index("fold")))
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            for f in np.unique(fold).tolist():
                own = x[fold == f]
                total[f] = total.get(f, 0) + own.T @ np.column_stack([own, y[fold == f]])
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(m), pa.int32()), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))], ["fold", "i", "r"])
    return run


def _raw(phi: Features, models: dict[int, np.ndarray], keep: list[str]):
    """Raw score of each row by the model of its fold (0: the model of all folds)."""
    def run(batches):
        for batch in batches:
            fold = longs(batch.column(batch.schema.get_field_index("fold")))
            x = phi(_matrix(batch))
            raw = np.zeros(batch.num_rows)
            for f in np.unique(fold).tolist():
                raw[fold == f] = x[fold == f] @ models[f]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(raw)], [*keep, "raw"])
    return run


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the nondecreasing fit to (x, y)."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          features: int = 192, width: float = 6.0, ridge: float = 1e-3, bins: int = 400, threshold: float = 0.3, fit_tasks: int = 32) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = write_shared(rows.mapInArrow(_statistics, STATS_SCHEMA), "statistics")
    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)), F.lit(1)).cast("int")
    moments = stats.agg(*[F.avg(c).alias(c) for c in NAMES], *[F.stddev_pop(c).alias(f"d_{c}") for c in NAMES]).first()
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.avg("y").alias("y"))
    fit = stats.join(marks, "doc_id").withColumn("fold", rest).where("fold > 0")
    phi = Features([moments[c] or 0.0 for c in NAMES], [moments[f"d_{c}"] or 0.0 for c in NAMES], features, width)
    sums = (fit.repartition(fit_tasks).mapInArrow(_equations(phi), "fold int, i int, r array<double>")
            .select("fold", "i", F.posexplode("r").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v")))
    size = features + 1
    total = {}
    for f, i, j, v in sums.toPandas().itertuples(index=False):
        total.setdefault(f, np.zeros((size, size + 1)))[i, j] = v
    out = stats.withColumn("fold", F.lit(0))
    held = (rest == 0).alias("held_out")
    if not total:
        return out.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1 if 0.5 >= threshold else 0).alias("predicted"))

    def solve(m):
        weight = max(m[-1, size - 1], 1.0)
        return np.linalg.solve(m[:, :size] + ridge * weight * np.eye(size), m[:, size])

    every = sum(total.values())
    models = {f: solve(every - m) if len(total) > 1 else solve(every) for f, m in total.items()}
    models[0] = solve(every)
    step = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) * (bins / 2.0))
    own = fit.mapInArrow(_raw(phi, models, ["y"]), "y double, raw double").groupBy(step.alias("bin"))
    seen = own.agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("w")).orderBy("bin").toPandas()
    x, y = isotonic(seen["x"].to_numpy(), seen["y"].to_numpy(), seen["w"].to_numpy())
    score_of = _calibrated(phi, models[0], x, np.clip(y, 0.0, 1.0))
    return (out.select("doc_id", (rest == 0).alias("held_out"), *NAMES).mapInArrow(score_of, "doc_id long, held_out boolean, score double")
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def _calibrated(phi: Features, model: np.ndarray, x: np.ndarray, y: np.ndarray):
    def run(batches):
        for batch in batches:
            value = np.interp(phi(_matrix(batch)) @ model, x, y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["doc_id", "held_out", "score"])
    return run
