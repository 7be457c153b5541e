"""Language, quality, mixing, token files and the pipeline."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from webcorpus.llm import language, mixing, quality, queries, token_codec


# ---------------------------------------------------------------- language

def test_language_on_the_given_table(spark, sf_dir):
    got = queries.op4_language_id(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert np.mean([r["lang"] == r["declared"] for r in got]) > 0.97
    assert np.mean([r["kept"] for r in got]) > 0.97


def test_language_corrects_wrong_tags_and_handles_odd_rows(spark):
    rng = random.Random(4)
    vocabulary = {"en": ["the", "and", "with", "thing", "which"], "fr": ["les", "être", "nous", "avec", "déjà"]}
    rows = [(k, " ".join(rng.choice(vocabulary[t]) for _ in range(80)), t, f"{t}{k % 3}.example.{'fr' if t == 'fr' else 'com'}") for k, t in enumerate(["en", "fr"] * 40)]
    rows += [(100, rows[0][1], "fr", None), (101, rows[1][1], None, None), (102, None, "en", "x"), (103, "", "en", "x"), (104, "123 !!", "en", None),
             (105, rows[1][1] * 400, "EN-us", "h"), (106, rows[0][1], "not a tag!", ""), (0, *rows[0][1:]), (None, *rows[1][1:])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n long").repartition(3)
    rows_got = language.identify(df).collect()
    got = {r["doc_id"]: r for r in rows_got}
    assert len(rows_got) == len(rows)
    assert all(got[k]["lang"] == ["en", "fr"][k % 2] and got[k]["kept"] for k in range(80))
    assert [got[k]["lang"] for k in (100, 101, 105, 106)] == ["en", "fr", "fr", "en"]
    assert [(got[k]["lang"], got[k]["kept"]) for k in (102, 103, 104)] == [(None, False)] * 3
    bare = language.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source")).collect()
    assert {r["doc_id"]: r["kept"] for r in bare}[102] is False and {r["doc_id"]: r["kept"] for r in bare}[1] is True
    assert language.identify(df.limit(0)).collect() == []


# ---------------------------------------------------------------- quality

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op6_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 200
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() > 0.93


def test_quality_holds_out_and_handles_odd_rows(spark):
    rows = [(k, ("fine words in a calm line. " * 9) if k % 2 else "BUY!! NOW!! " * 9) for k in range(200)] + [(500, None), (501, ""), (502, "x" * 100000), (None, "fine words"), (0, "BUY!! NOW!! ")]
    labels = [(k, k % 2, 0) for k in range(200)] + [(1, None, 0), (None, 1, 0), (3, 1, 1), (9999, 1, 0)]
    docs = spark.createDataFrame([(i, t, 1.0, "s") for i, t in rows], "doc_id long, text string, size double, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    of = {r["doc_id"]: r["predicted"] for r in got}
    assert np.mean([of[k] == k % 2 for k in range(200)]) > 0.97
    # labels of held-out rows change nothing
    held = [(i, 1 - q if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = quality.score(docs, spark.createDataFrame(held, "doc_id long, quality int, toxic int")).collect()
    assert sorted([(str(r["doc_id"]), round(r["score"], 9)) for r in got]) == sorted([(str(r["doc_id"]), round(r["score"], 9)) for r in again])
    assert {r["score"] for r in quality.score(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), marks).collect() == []


def test_isotonic_is_the_monotone_mean():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.9, 0.3, 1.0]), np.array([1.0, 1, 2, 1]))
    assert np.allclose(y, [0, 0.5, 1.0]) and np.allclose(x, [0, 5 / 3, 3])


# ---------------------------------------------------------------- mixing

def test_mixing_reaches_targets(spark):
    rows = [(k, (["calm", "quiet", "fine"] if k % 4 else ["loud", "buy", "now"])[k % 3] + " filler" * 1 + [" calm fine", " loud now"][k % 4 == 0] * 6) for k in range(400)]
    rows += [(900, None), (901, ""), (902, "calm " * 30000), (None, "loud"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1, "d") for i, t in rows], "doc_id long, text string, tokens int, domain string")
    marks = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 400)] + [(5, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    targets = {"quality=1,toxic=0": 0.5, "quality=0,toxic=0": 0.5}
    short = docs.where("doc_id is null or doc_id <> 902")
    got = mixing.mix(short, marks, targets).collect()
    assert len(got) == len(rows) - 1 and all(0 <= r["rate"] <= 4 for r in got)
    total = sum(r["n_tokens"] for r in got)
    share = [sum(r["rate"] * r["n_tokens"] * r["posterior"][d] for r in got) / total for d in range(2)]
    assert np.allclose(share, [0.5, 0.5], atol=2e-3)
    assert abs(sum(r["copies"] * r["n_tokens"] for r in got) / total - 1) < 0.15
    kept = mixing.resample(short, marks, targets)
    assert kept.columns == short.columns and kept.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs, marks, targets).count() == len(rows)
    assert {r["rate"] for r in mixing.mix(docs, marks.limit(0), targets).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), marks, targets).collect() == []


def test_mixing_reaches_the_registered_targets_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = mixing.mix(docs, labels, queries.TARGETS).select("n_tokens", "rate", "posterior").toPandas()
    w, r, p = got["n_tokens"].to_numpy() / got["n_tokens"].sum(), got["rate"].to_numpy(), np.array(got["posterior"].tolist())
    targets = np.array([queries.TARGETS.get(d, 0.0) for d in ("quality=0,toxic=0", "quality=0,toxic=1", "quality=1,toxic=0", "quality=1,toxic=1")])
    off = (w * r) @ p - targets
    assert np.abs(off).max() < 0.002 and r.min() >= 0 and r.max() <= 4
    if np.abs(off).max() >= 1e-4:  # then no rates in the bounds reach the targets: the least pull along the residual is above what they ask
        pull = p @ (off / np.maximum(w @ p, 1e-9))
        assert 4 * (w * np.minimum(pull, 0)).sum() > targets @ (off / np.maximum(w @ p, 1e-9))


def test_mixing_says_when_targets_are_out_of_reach(spark):
    docs = spark.createDataFrame([(k, "calm quiet fine" if k % 10 else "loud buy now") for k in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 10 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    _, fit = mixing.mix_fit(docs, marks, {"quality=0,toxic=0": 0.5, "quality=1,toxic=0": 0.5}, evidence=4.0)
    assert fit.reached is False and fit.residual[0] < -0.05 and "quality=0,toxic=0: asked 0.5000" in fit.told()
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.mix(docs, marks, {"quality=0,toxic=0": 0.5, "quality=1,toxic=0": 0.5}, evidence=4.0)
    _, fit = mixing.mix_fit(docs, marks, {"quality=0,toxic=0": 0.3, "quality=1,toxic=0": 0.7}, evidence=4.0)
    assert fit.reached and max(map(abs, fit.residual)) < 1e-4


# ---------------------------------------------------------------- token files

def reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_pieces_equal_the_tokenizer():
    rng = random.Random(10)
    parts = ["don't", "I'LL", "x's", ".'s", "…", "é", "e\u0301", "ǅ", "漢字", "①", "１２", "12", "a1b", "\u00a0", "\u3000", "\x0b", "\x1c", "\x85", "=\u0338", "<|endoftext|>", "<|", "|>", "<|STARTOFTEXT|>",
             "Straße", "ΟΔΟΣ", "ΟΔΟΣ.", "word", "Word,", "#$%", "!!", "``", "\u200d", "👩\u200d🚀", "İ", "\u0301", "Thing", "x" * 70, "ﬁ", "_", "-", "\t", "\n", " ", "0", "\ufe0f"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", " ", "a" * 3000]
    pieces = token_codec.Pieces(queries.tokenizer_path(), most=500)
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        raw = [x.encode() for x in some]
        ids, count = pieces.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw]))
        want = [x[:-1] for x in reference_ids(some)]
        ends = np.cumsum(count)
        for k, w in enumerate(want):
            assert ids[ends[k] - count[k]:ends[k]].tolist() == w, some[k]


@pytest.mark.parametrize("skew", [0.0, 3.0])
def test_huffman_round_trip(skew):
    rng = np.random.default_rng(10)
    counts = (rng.pareto(1, 3000) ** skew * 10 + 1).astype(np.int64) * (rng.random(3000) < 0.8)
    lengths = token_codec.code_lengths(counts, 13)
    used = lengths > 0
    assert (used == (counts > 0)).all() and lengths.max() <= 13 and np.sum(0.5 ** lengths[used].astype(float)) <= 1 + 1e-9
    free = token_codec.code_lengths(counts, 40)
    assert (counts * free).sum() <= (counts * lengths.astype(int)).sum()
    ids = rng.choice(np.flatnonzero(used), 5000)
    for every in (1, 7, 128):
        parts = [ids[:1], ids[1:2000], ids[2000:]]
        packed = [token_codec.pack(p, token_codec.canonical(lengths), lengths, every) for p in parts]
        got = token_codec.Decoder(lengths)([p for p, _ in packed], [c for _, c in packed], [len(p) for p in parts], every)
        assert (got == ids).all()
    one = token_codec.code_lengths(np.array([0, 5, 0]), 20)
    assert one.tolist() == [0, 1, 0]


def test_token_files_round_trip(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(5000, None), (5001, ""), (5002, "long text " * 20000), (-3, "<|endoftext|> x"), (7, "again"), (None, "no id")], "doc_id long, text string")
    docs = given.unionByName(extra)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    folder = token_codec.write_files(docs.withColumn("part", docs.doc_id), queries.tokenizer_path(), block_ids=2000)
    got = token_codec.read_files(spark, folder)
    raw = {(r["doc_id"], r["n_tokens"]): np.frombuffer(r["ids"], dtype="<u4").tolist() for r in got.collect()}
    told = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_codec.read_files(spark, folder, digest=True).collect())
    at, order = 0, [r[1] for r in told]
    assert order == [i for i, _ in rows]
    want = {}
    for (i, _), ids in zip(rows, reference_ids([t for _, t in rows])):
        want.setdefault(i, []).append(ids)
    for start, i, n, crc in told:
        assert start == at
        ids = next(x for x in want[i] if len(x) == n and zlib.crc32(np.array(x, dtype="<u4").tobytes()) == crc)
        assert raw[i, n] == ids or len(want[i]) > 1
        at += n
    assert token_codec.read_files(spark, token_codec.write_files(docs.limit(0), queries.tokenizer_path())).collect() == []


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("row", queries.F.lit("extra"))
    odd = docs.limit(2).withColumn("text", queries.F.lit(None).cast("string"))
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "mixing", "token_output"]
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_shared(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == counts[-1]
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
