"""Near-duplicate texts and vectors against brute force."""

import random
import re

import numpy as np
import pytest

from webcorpus.llm import embedding_dedup, jaccard
from webcorpus.llm.components import components

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def group(n, links):
    up = list(range(n))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_least_matches_grows_with_the_prefix():
    need = [jaccard.least_matches(n, 0.8, 1e-6) for n in (16, 32, 64, 128)]
    assert need == sorted(need) and 0 < need[-1] < 0.8 * 128


@pytest.mark.parametrize("block", [3, 250])
def test_jaccard_matches_brute_force(spark, block):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(120)] for _ in range(8)]
    texts = []
    for words in base:
        for _ in range(12):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "é"])
            texts.append(rng.choice([" ", "\n", ", "]).join(w).replace("ak", "AK"))
    texts += [None, "", "...", "one two", "one  Two", "one two three", "w " * 20000, texts[0], texts[0]]
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        n = min(5, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    count = [sum(k in x for x in links) for k in range(len(texts))]
    root = group(len(texts), links)
    df = spark.createDataFrame([(k, t, "n", 1) for k, t in enumerate(texts)], "doc_id long, text string, node string, c int").repartition(5)
    got = {r["id"]: r for r in jaccard.near_duplicates(df, block=block, verify_block=block).collect()}
    assert [(got[k]["class_id"], got[k]["n_links"], got[k]["kept"]) for k in range(len(texts))] == [(root[k], count[k], root[k] == k) for k in range(len(texts))]


def test_jaccard_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text + " end"), (9, None)], "doc_id long, text string")
    got = sorted([tuple(r)[2:] for r in jaccard.near_duplicates(df).collect()], key=repr)
    assert got == sorted([(5, None, 2, False), (5, None, 2, False), (None, None, 2, True), (9, 9, 0, True)], key=repr)
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    rows = [(c + rng.normal(size=16) * s).astype(np.float32).tolist() for c in centres for s in (0.05, 0.1, 0.2, 0.3) for _ in range(12)]
    rows += [rows[0], rows[0], [0.0] * 16, None, [], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0, 2.0], [2.0, 4.0], [1.0] * 15 + [None]]
    ok = [bool(r) and None not in r and np.isfinite(r).all() and np.any(r) for r in rows]
    unit = [np.array(r, dtype=float) / np.linalg.norm(r) if o else None for r, o in zip(rows, ok)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and len(rows[a]) == len(rows[b]) and unit[a] @ unit[b] >= 0.9]
    root = group(len(rows), links)
    df = spark.createDataFrame([(k, r, "x") for k, r in enumerate(rows)], "vec_id long, embedding array<float>, id string").repartition(3)
    for block, per in ((7, 50), (400, 2048)):
        got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, rows=per, window=40, block=block).collect()}
        assert [got[k] for k in range(len(rows))] == [(sum(k in x for x in links), root[k], root[k] == k) for k in range(len(rows))]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_vector_recall_on_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/../sf0.01/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i] <= n for (i, _), n in zip(rows, near))
    assert sum(got.values()) >= 0.9 * near.sum()


def test_vector_recall_in_a_dense_group(spark):
    """Planted partners in a hot group of mutual cosine near 0.8, far larger than a block."""
    rng, n, planted = np.random.default_rng(1), 9000, 300

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit(rng.normal(size=(1, 64)))[0]
    own = unit((r := rng.normal(size=(n, 64))) - (r @ mean)[:, None] * mean)
    other = rng.normal(size=(planted, 64))
    other = unit(other - (other @ mean)[:, None] * mean - (other * own[:planted]).sum(axis=1, keepdims=True) * own[:planted])
    near = 0.55 * own[:planted] + np.sqrt(1 - 0.55**2) * other
    v = unit(np.sqrt(0.8) * mean + np.sqrt(0.2) * np.concatenate([own, near]))
    want = (v @ v.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, [float(t) for t in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(8)
    got = embedding_dedup.near_duplicates(df, rows=512, block=200).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() and want.sum() > 2 * planted


def test_linked_rows_of_an_adjacency_matrix():
    rng = np.random.default_rng(2)
    near = rng.random((60, 60)) < 0.02
    near = near | near.T
    np.fill_diagonal(near, False)
    a, b = embedding_dedup._linked(near)
    label = np.arange(60)
    for _ in range(60):
        label = np.minimum(label, np.where(near, label[None], 60).min(axis=1))
    assert {*zip(a, b)} == {(label[i], i) for i in range(60) if label[i] != i}
