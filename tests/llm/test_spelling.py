import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from webcorpus.llm import spelling
from webcorpus.llm.common import text_parts


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute(rows, every, least=6, least_n=5, factor=5):
    count = Counter()
    for ident, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= least_n}
    form, out = {}, {}
    for w in n:
        near = sorted((x for x in n if one_edit(w, x)), key=lambda x: (-n[x], x))
        form[w] = near[0] if near and n[near[0]] >= factor * n[w] else None
        out[w] = [form[w], n[w], len(near), n[near[0]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")


def got(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]] for r in frame.collect()}


def test_variants_against_brute_force(spark):
    rng = np.random.default_rng(11)
    stems = ["anchor", "étranger", "abababab", "aaaaaa", "aaaaaaa", "baaaaaa", "receive", "recieve", "reciev", "receiver", "ÀÿÀÿÀÿ", "×÷×÷×÷x"]
    rows = []
    for i in range(60):
        words = []
        for _ in range(120):
            w = stems[int(rng.integers(len(stems)) ** 2 / len(stems))]
            if rng.random() < 0.3:
                at = int(rng.integers(len(w)))
                w = w[:at] + "aÿZ"[int(rng.integers(3))] + w[at + int(rng.integers(2)):]
            words.append(w)
        rows.append((i, "1 ".join(words)))
    rows += [(None, None), (None, ""), (None, "receive " * 7), (3, "receive, " * 4), (3, "receive, " * 4), (99, "q" * 100_000), (99, "q" * 100_000), (100, ("q" * 100_000 + " ") * 3), (101, "q" * 99_999 + " ")]
    for every in (0, 7):
        assert got(spelling.variants(table(spark, rows), edit_every=every)) == brute(rows, every)


def test_a_hot_key_is_cut_into_block_pairs(spark):
    words = [("anchor" + chr(97 + i // 26) + chr(97 + i % 26)).encode() for i in range(300)]
    frame = spark.createDataFrame([(bytearray(w), i + 5) for i, w in enumerate(words)], "word binary, n long")
    want = {(a, b) for a in words for b in words if one_edit(a.decode(), b.decode())}
    found = [(bytes(r["word"]), bytes(r["near"])) for r in spelling.near_words(frame, block=16, pairs=100, slice_bytes=50).collect()]
    assert len(found) == len(set(found)) and set(found) == want


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=2, max_size=9), st.text("abé", min_size=2, max_size=9))
def test_pairs_meet_and_are_verified(a, b):
    data, offsets = text_parts(pa.array([a.encode("latin-1"), b.encode("latin-1")]))
    row, side, chunk, key = spelling.keys_of(data, offsets)
    met = [c for c in (0, 1) if set(key[(row == 0) & (side == spelling.CHUNK) & (chunk == c)]) & set(key[(row == 1) & (side == spelling.GRAM) & (chunk == c)])]
    seen = sum(bool(spelling.verified(data, offsets, np.array([0]), np.array([1]), np.array([c == 0]))[0]) for c in met)
    assert seen == one_edit(a, b)  # once, through one chunk
    if one_edit(a, b):
        letters, pairs = spelling._marks(data, offsets)
        assert np.bitwise_count(letters[0] ^ letters[1]) <= 2 and np.bitwise_count(pairs[0] ^ pairs[1]) <= 4


def test_crc_of_spans():
    data = np.frombuffer(b"anchor" + b"z" * 300 + b"x", dtype=np.uint8)
    s, e = np.array([0, 6, 306, 0, 3]), np.array([6, 306, 307, 307, 3])
    seed = np.array([zlib.crc32(b"%d:" % i) for i in range(5)], dtype=np.uint32)
    want = [zlib.crc32(b"%d:" % i + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(s, e))]
    assert spelling.crc32s(data, s, e, seed).tolist() == want


def test_chains_and_empty_tables(spark):
    # each step of the chain has five times the count of the one before
    chain = ["aaaaaabb", "aaaaaabc", "aaaaaacc", "aaaaadcc"]
    rows = [(1, " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (k + 1))))]
    told = got(spelling.variants(table(spark, rows)))
    assert told == brute(rows, 0) and [told[w][4] for w in chain] == [chain[-1]] * 4
    for rows in ([], [(1, None), (2, "")], [(1, "short words only")]):
        assert got(spelling.variants(table(spark, rows))) == {}
