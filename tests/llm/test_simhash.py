import hashlib

import numpy as np
import pytest

from webcorpus.llm import simhash
from webcorpus.llm.common import mix, shingles, words

def plain_print(text: str) -> str:
    """Votes of the terms one by one."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    h, _, _, row = words(data, np.array([0, len(data)]))
    terms = [int(x) for x in (shingles(h, row, 2)[0] if len(h) != 1 else mix(h))]
    if not terms:
        return "00" * 16
    bits = {t: simhash._bits(np.array([t], dtype=np.uint64))[0] for t in terms}
    votes = [sum(1 if bits[t][k] else -1 for t in terms) for k in range(128)]
    out = [bool(bits[min(terms)][k]) if v == 0 else v > 0 for k, v in enumerate(votes)]
    return np.packbits(out).tobytes().hex()


def like(a: str, b: str) -> float:
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


def check(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "fp", 1) for r in rows], "doc_id long, text string, fp string, part int")
    got = simhash.compared(frame, **kw).collect()
    assert len(got) == len(rows)
    order = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    prints = [plain_print(t) for t in order]
    want = []
    for i, t in enumerate(order):
        after = order[(i + 1) % len(order)]
        made = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        fp = plain_print(made)
        want.append((len(t), hashlib.sha256(made.encode()).hexdigest(), prints[i], fp, like(prints[i], fp), like(prints[i], prints[(i + 1) % len(order)]),
                     sum(like(prints[i], p) >= 1 - kw.get("radius", 6) / 128 for p in prints) - 1))
    assert sorted((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"], r["n_near"]) for r in got) == sorted(want)
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, (r[0] for r in rows)))


def texts():
    rng = np.random.default_rng(13)
    word = ["alpha", "Beta", "γάμμα", "déjà", "一二三", "x1", "the", "of", "😀"]
    rows = []
    for i in range(150):
        rows.append((int(i * 7 - 50), " ".join(word[k] for k in rng.integers(len(word), size=rng.integers(1, 60)))))
    for i in range(40):  # near copies: one word of many changed
        body = [f"w{k}" for k in range(80)]
        body[i] = "other"
        rows.append((5000 + i, " ".join(body)))
    rows += [(6000 + i, "the same text over and over") for i in range(30)]
    return rows + [(7000, None), (7001, ""), (7002, "..."), (7003, "word"), (7004, "one two " * 30000), (None, "without an id")]


@pytest.mark.parametrize("kw", [{}, {"radius": 12, "blocks": 14}])
def test_compared_against_brute_force(spark, kw):
    check(spark, texts(), **kw)


def test_small_and_repeated_rows(spark):
    check(spark, [(1, "alone on the table")])
    check(spark, [(1, "a b"), (1, "a b"), (1, "a b"), (0, None)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.compared(empty).collect() == []


def test_given_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_edited_texts_are_nearer_than_other_ones(spark):
    got = simhash.compared(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.97
    assert got["near_edited"].mean() - got["near_next"].mean() > 0.15


def test_a_hot_bucket_is_cut_into_block_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(256, size=16, dtype=np.uint8)
    prints = []
    for _ in range(300):  # all within a few bits of one fingerprint
        x = np.unpackbits(base)
        x[rng.integers(128, size=rng.integers(0, 6))] ^= 1
        prints.append(np.packbits(x).tobytes())
    frame = spark.createDataFrame([(bytearray(p),) for p in prints], "fp binary")
    got = {bytes(r["fp"]): r["n_near"] for r in simhash.neighbours(frame, block=32, pairs=100).collect()}
    x = np.stack([np.frombuffer(p, dtype=np.uint8) for p in prints])
    near = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2) <= 6
    assert got == {p: int(n) - 1 for p, n in zip(prints, near.sum(axis=1))}


def test_many_terms_do_not_overflow():
    text = ("a b " * 70000 + "c").encode()
    data = np.frombuffer(text, dtype=np.uint8)
    a = simhash.fingerprints(data, np.array([0, len(data)]))
    assert a.tobytes().hex() == simhash.fingerprints(data, np.array([0, len(data)]), run=100, terms=1 << 12).tobytes().hex()
