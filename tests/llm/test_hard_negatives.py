import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from webcorpus.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>, row string, cell int"
SMALL = {"sample": 60, "cell_rows": 4, "probe": 10, "anchor_block": 7, "piece_rows": 16, "anchors_at": 3, "rows_at": 5}


def brute(rows, positives=5, negatives=10):
    """Every pair in plain Python integers."""
    good = [(i, lab, [max(-H.BOUND, min(H.BOUND, math.floor(256 * x))) for x in v]) for i, lab, v in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (ident, label, q) in enumerate(good):
        if ident is None or ident % 10:
            continue
        score = sorted(((-sum(x * y for x, y in zip(q, v)), i is None, i or 0, n) for n, (i, _, v) in enumerate(good) if n != a))
        for s, none, i, n in [x for x in score if good[x[3]][1] == label][:positives]:
            fit = [x for x in score if good[x[3]][1] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(ident, None if none else i, r + 1, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(map(repr, out))


def mined(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = H.mine(frame, F.col("vec_id") % 10 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(repr(tuple(r)) for r in got.collect())


def vectors(n, seed=12, hot=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, 6))
    rows = []
    for i in range(n):
        v = centre[rng.integers(4)] + rng.normal(size=6) * 0.6
        rows.append((i, int(rng.integers(4)), [float(x) for x in np.round(v, 2)]))
    return rows + [(1000 + i, i % 3, [0.5] * 6) for i in range(hot)]


@pytest.mark.parametrize("kw", [{}, SMALL])
def test_mining_against_brute_force(spark, kw):
    rows = vectors(200, hot=60)
    rows += [(2000, None, [1.0] * 6), (2010, 1, None), (2020, 1, [1.0, None, 2.0]), (2030, 1, [float("nan")] * 6), (2040, 2, [float("inf")] * 6), (2050, 1, []), (2060, 1, [2.0, 1.0]),
             (None, 2, [0.5] * 6), (None, 1, [0.6] * 6), (30, 1, [0.4] * 6), (30, 1, [0.4] * 6), (2070, 77, [1.0] * 6)]
    assert mined(spark, rows, **kw) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(2)), [float(x) for x in rng.integers(-10**5, 10**5, size=5)]) for i in range(80)]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(10, 1, [1.0, 2.0])], [(10, 1, None)], [(10, 1, []), (11, 1, []), (12, 2, [])], [(10, 1, [1.0]), (11, 1, [2.0]), (12, 2, [0.8])]])
def test_small_tables(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_multi_sequence_visits_every_pair_in_order():
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=7).round(1), rng.normal(size=9).round(1)
    got = list(H.multi_sequence(u, v))
    assert sorted((i, j) for _, i, j in got) == list(itertools.product(range(7), range(9)))
    assert [b for b, _, _ in got] == sorted((b for b, _, _ in got), reverse=True)
    assert all(abs(b - u[i] - v[j]) < 1e-9 for b, i, j in got)


def test_bounds_hold_and_cells_are_passed_over():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(rng.normal(size=(20, 8)) * 4, 40, axis=0) + rng.normal(size=(800, 8)) * 0.1))
    index = H.Index(x[rng.permutation(800)[:200]], 20)
    share = []
    cell, far = index.place(x)
    for c, a, b in zip(cell, *far):
        i, j = divmod(int(c), len(index.books[1]))
        index.count[i, j] += 1
        index.radius[0][i], index.radius[1][j] = max(index.radius[0][i], a), max(index.radius[1][j], b)
    for q in x[::97]:
        score = x @ q
        floor = np.sort(score)[-10]
        seen = index.visit(q, [(int(floor), H.FAR)], None)
        assert set(cell[score >= floor]) <= set(seen)
        share.append(len(seen) / (index.count > 0).sum())
        probed = index.visit(q, [(-H.FAR, H.FAR)], 100)
        assert np.isin(cell, probed).sum() >= 100 and len(probed) < (index.count > 0).sum()
    assert np.mean(share) < 0.5  # the certificate stops the heap early


def test_dealing_packs_small_cells_and_cuts_large_ones():
    assert H.dealt({5: 3, 1: 4, 2: 100, 9: 2}, 10) == [(1, 0, 1), (2, 1, 10), (5, 11, 1), (9, 11, 1)]
