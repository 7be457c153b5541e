"""Distributed percentile selection and outages against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from webcorpus.operators import service as SV


def plain_percentile(values, p):
    return float(np.percentile(np.array(values, dtype=float), p * 100))


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("accuracy", [3, 50, 10_000])
def test_percentile_is_exact_whatever_the_sketch(spark, p, accuracy):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=2000).tolist(), "b": [1.0] * 50, "c": [3.0], "d": (rng.pareto(1, size=700) * 1e6).tolist(), None: [1.0, 2.0], "e": rng.integers(5, size=300).astype(float).tolist()}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r[1] for r in SV.exact_percentile(df, ["g"], "v", p, accuracy).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(plain_percentile(vs, p), rel=1e-12, abs=1e-12)
    assert SV.exact_percentile(df.limit(0), ["g"], "v", p).collect() == []


def test_percentile_sorts_a_small_part_of_a_hot_group(spark):
    """A day of all-distinct doubles in one engine: what reaches the window is what lies
    between the two sketch values, spread over the tasks that counted it."""
    df = spark.range(0, 200_000, numPartitions=8).select(F.lit("x").alias("g"), (F.xxhash64("id") / 1e18).alias("v"))
    out = SV.exact_percentile(df, ["g"], "v", 0.95)
    want = sorted(r["v"] for r in df.select("v").collect())
    pos = 0.95 * (len(want) - 1)
    lo = int(pos)
    assert out.first()["p95"] == pytest.approx(want[lo] + (pos - lo) * (want[lo + 1] - want[lo]), rel=1e-12)
    bounds = df.groupBy("g").agg(F.percentile_approx("v", F.array(F.lit(0.9498), F.lit(0.9502)), F.lit(10_000)).alias("b"))
    assert df.join(bounds, "g").where("v between b[0] and b[1]").count() < 400


def plain_outages(rows, longer=60.0):
    out = []
    for engine in {r[0] for r in rows}:
        run = []
        for _, ts, _, ok in sorted((r for r in rows if r[0] == engine), key=lambda r: (r[1], r[2])) + [(engine, None, None, True)]:
            if ok:
                if run and (run[-1] - run[0]).total_seconds() > longer:
                    out.append((engine, run[0], run[-1], len(run), (run[-1] - run[0]).total_seconds()))
                run = []
            else:
                run.append(ts)
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 40, 3600, 10**7])
def test_outages_against_plain_runs(spark, chunk):
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows, rid = [], 0
    for engine, n, rate in (("google", 300, 0.7), ("bing", 300, 0.97), ("yahoo", 40, 1.0), ("duckduckgo", 40, 0.0)):
        for s in np.sort(rng.integers(0, 9000, size=n)).tolist():  # ties in time on purpose
            rows.append((engine, start + dt.timedelta(seconds=s), rid, bool(rng.random() > rate)))
            rid += 1
    log = spark.createDataFrame([(*r, None if r[3] else "timeout", 1, 0.5, 200) for r in rows],
                                "engine string, ts timestamp_ntz, request_id long, success boolean, error string, n_results int, response_time double, status_code int")
    got = sorted((r["engine"], r["start"], r["end"], r["failures"], r["seconds"]) for r in SV.outages(log, chunk_seconds=chunk).collect())
    want = plain_outages(rows)
    assert want and got == want
    assert SV.outages(log.limit(0)).collect() == []
