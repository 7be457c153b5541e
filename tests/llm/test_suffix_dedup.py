"""Suffix dedup and induced sorting against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from webcorpus.llm.induced import Scratch, suffix_order
from webcorpus.llm.suffix_dedup import dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        n = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direct", [0, 16, 1 << 19])
def test_suffix_order_matches_plain_sort(direct):
    rng = np.random.default_rng(direct)
    for case in range(150):
        text = rng.integers(1, rng.integers(2, 6), rng.integers(1, 90))
        if case % 3 == 0:
            text = np.tile(text[:max(1, len(text) // 4)], 4)
        text = np.append(text, 0)
        order, same = suffix_order(text, int(text.max()) + 1, 200, Scratch(0 if case % 25 == 0 else 1 << 20), direct)
        plain = sorted(range(len(text)), key=lambda k: tuple(text[k:]))
        assert list(order) == plain
        for k in range(1, len(plain)):
            a, b = text[plain[k - 1]:], text[plain[k]:]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            assert same[k] == (differ[0] if len(differ) else n)


@pytest.mark.parametrize("hot", [2, 256])
def test_dedup_matches_brute_force(spark, hot):
    rng = random.Random(hot)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = []
    for k in range(40):
        t = "".join(rng.choice("abé\n") for _ in range(rng.randrange(0, 50)))
        rows.append((k, t + passage[rng.randrange(0, 9):rng.randrange(40, 60)] + t[::-1]))
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, passage), (103, passage), (None, passage[:40]), (None, "zz")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, g string, k1 int").repartition(5)
    got = sorted([tuple(r) for r in dedup(df, length=24, gram=5, hot=hot, shard_bytes=500).collect()], key=repr)
    assert got == brute(rows, 24)


def test_dedup_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup(df).collect() == []
