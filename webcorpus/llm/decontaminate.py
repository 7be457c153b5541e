"""Benchmark decontamination: exact windows of benchmark items inside documents, by a
prefix-filtered set join.

An item's windows are its runs of ``window`` words (the whole item if it has fewer).
A window is the set of its shingles (``size`` words each). To contain the window a
document must contain all of its shingles, so one necessary token per window is
enough for the join: its rarest shingle by document frequency over the corpus.

* One pass over the texts notes, per document, the places of shingles that some window
  holds (a fixed-size bitmap of hashed shingles decides; false passes are harmless).
* Their document frequencies give each window its rarest shingle; a window with a
  shingle that no document has is dropped.
* Documents and windows meet on that shingle (salted). Positional and length bounds:
  the window must fit around the place. The neighbouring shingles must then equal all
  of the window's, in order (64-bit values of ``size`` words each).

Words as in ``common``. Null text has no words. Null item ids are no items but their
windows still hit. Rows with equal id and text get equal results, one row each.

A text of any length is one row of the pass and read whole; a window with several equally
rare shingles takes one of them, which changes no result; an empty table of documents gives
no rows, one of items hits nothing; only the named columns are read, so others may have any
name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import U64, keyed, longs, mix, parts, shingles, signed, words, write_shared

BITS = 22
NOTED = "k1 long, k2 long, id long, n_words long, sh array<long>, pos array<int>, kind array<int>"
WINDOWS = "item string, n int, kind int, sh array<long>"
PLACES = "key long, k1 long, k2 long, pos int, before int, sh array<long>"


def _shingles(h, row, size):
    s, first = shingles(h, row, size)
    return mix(s + U64(size)), first


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind) -> pa.Array:
    """One list per row of 0..n-1; ``rows`` ascends."""
    edges = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values, type=kind))


def _windows(window: int, size: int):
    def run(batches):
        for batch in batches:
            items = batch.column(0).to_pylist()
            for a, _, data, offsets in parts(batch, "text"):
                h, _, _, row = words(data, offsets)
                edges = np.searchsorted(row, np.arange(len(offsets)))
                out = []
                for k in range(len(offsets) - 1):
                    own = h[edges[k]:edges[k + 1]]
                    if not len(own):
                        continue
                    n = min(window, len(own))
                    kind = min(size, n)
                    s, _ = _shingles(own, np.zeros(len(own), dtype=np.int64), kind)
                    s = signed(s)
                    out += [(items[a + k], n, kind, s[p:p + n - kind + 1].tolist()) for p in range(len(own) - n + 1)]
                if out:
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.list_(pa.int64()))], ["item", "n", "kind", "sh"])
    return run


def _note(bitmap: bytes, kinds: list[int]):
    def run(batches):
        bits = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for a, b, data, offsets in parts(batch, "text"):
                h, _, _, row = words(data, offsets)
                n = b - a
                found = []
                for kind in kinds:
                    s, first = _shingles(h, row, kind)
                    hit = np.flatnonzero(bits[(s & U64(len(bits) - 1)).astype(np.int64)])
                    found.append((signed(s[hit]), first[hit], np.full(len(hit), kind, dtype=np.int32)))
                sh, at, kind = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                r = row[at] if len(at) else at
                start = np.searchsorted(row, np.arange(n))
                order = np.lexsort((at, kind, r))
                sh, at, kind, r = sh[order], at[order], kind[order], r[order]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, n), batch.column(1).slice(a, n), batch.column(2).slice(a, n),
                    pa.array(np.bincount(row, minlength=n)), _lists(sh, r, n, pa.int64()),
                    _lists((at - start[r]).astype(np.int32) if len(at) else at.astype(np.int32), r, n, pa.int32()),
                    _lists(kind.astype(np.int32), r, n, pa.int32())], ["k1", "k2", "id", "n_words", "sh", "pos", "kind"])
    return run


def _places(bitmap: bytes, reach: int):
    """Places of shingles that are some window's rarest, with the unbroken noted
    shingles of up to ``reach`` places on either side."""
    def run(batches):
        bits = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little").view(bool)
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("sh", "pos", "kind")]
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
            sh, pos, kind = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            if not len(sh):
                continue
            k1, k2 = longs(batch.column(0)), longs(batch.column(1))
            at = np.flatnonzero(bits[sh & (len(bits) - 1)])
            broken = np.flatnonzero((row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
            edges = np.concatenate([[0], broken, [len(sh)]])
            block = np.searchsorted(edges, at, side="right") - 1
            lo, hi = np.maximum(at - reach, edges[block]), np.minimum(at + reach + 1, edges[block + 1])
            for c in range(0, len(at), 1 << 16):
                x, a, b = at[c:c + (1 << 16)], lo[c:c + (1 << 16)], hi[c:c + (1 << 16)]
                ends = np.cumsum(b - a)
                index = np.arange(int(ends[-1])) - np.repeat(ends - (b - a), b - a) + np.repeat(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    pa.array(sh[x]), pa.array(k1[row[x]]), pa.array(k2[row[x]]), pa.array(pos[x]), pa.array((x - a).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(sh[index]))], ["key", "k1", "k2", "pos", "before", "sh"])
    return run


def _bitmap(hashes: DataFrame) -> bytes:
    """Which of the 2**BITS low-bit values occur: at most 2**BITS / 8 bytes come back."""
    low = F.col("h").bitwiseAND((1 << BITS) - 1)
    rows = (hashes.select(F.bitmap_bucket_number(low + 1).alias("b"), F.bitmap_bit_position(low + 1).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())
    out = bytearray((1 << BITS) // 8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] = r["m"]
    return bytes(out)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = 13, size: int = 3, salts: int = 16) -> DataFrame:
    """k1, k2, id, n_words, n_hit, n_items, items_sha256, contaminated per row of docs."""
    texts = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    windows = write_shared(texts.mapInArrow(_windows(window, size), WINDOWS).distinct(), "windows")
    kinds = sorted(r[0] for r in windows.select("kind").distinct().collect())
    every = windows.select("item", "n", "sh", F.posexplode("sh").alias("o", "h"))
    noted = write_shared(keyed(docs, id_col, text_col).select("k1", "k2", "id", "text")
                         .mapInArrow(_note(_bitmap(every.select("h")), kinds), NOTED), "noted")
    counts = noted.select(F.explode(F.array_distinct("sh")).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    rarest = (every.join(counts, "h", "left").groupBy("item", "n", "sh")
              .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "o", "h")).alias("r"))
              .where("r.df > 0").select("item", "n", F.col("sh").alias("all"), F.col("r.o").alias("o"), F.col("r.h").alias("key")))
    rarest = write_shared(rarest, "rarest")
    places = noted.where(F.size("sh") > 0).mapInArrow(_places(_bitmap(rarest.select(F.col("key").alias("h"))), max(0, window - 1)), PLACES)
    places = places.withColumn("salt", F.pmod("k2", F.lit(salts)).cast("int"))
    keys = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = (places.join(keys, ["key", "salt"])
            .where((F.col("before") >= F.col("o")) & (F.slice(F.col("sh"), F.greatest(F.col("before") - F.col("o") + 1, F.lit(1)), F.size("all")) == F.col("all")))
            .select("k1", "k2", (F.col("pos") - F.col("o")).alias("start"), "n", "item").distinct())
    earlier = W.partitionBy("k1", "k2").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    cover = (hits.select("k1", "k2", "start", "n").distinct()
             .withColumn("reached", F.coalesce(F.max(end).over(earlier), F.lit(0)))
             .groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reached"))).alias("n_hit")))
    named = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_row = cover.join(named, ["k1", "k2"])
    out = noted.select("k1", "k2", "id", "n_words").join(per_row, ["k1", "k2"], "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("k1", "k2", "id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                      F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
                      ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))
