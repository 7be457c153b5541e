"""Near-duplicate texts: Jaccard similarity of word shingles at a threshold, by
Bayesian pruning of MinHash candidates (BayesLSH) and exact verification.

* Texts with equal shingle sets form one class; one member of it stands for all.
* Candidates share one of ``bands`` groups of MinHash values. With 32 bands of 4, a
  pair at similarity 0.8 is missed with probability (1 - 0.8^4)^32 < 5e-8.
* A pair's MinHash values are compared in growing prefixes. Under a uniform prior,
  m matches of n leave P(similarity >= threshold) = P(Bin(n+1, threshold) <= m); the
  pair is dropped as soon as that falls below ``tolerance``.
* The rest are verified on the shingle sets of the whole texts.

Pairs never become rows. A band group is cut into blocks of about ``block`` members by
a hash, two blocks meet in one task, and of the surviving pairs only a spanning forest
leaves it. Inside each connected component of these forests, again block by block, all
pairs are pruned and verified; the tasks give each class its number of links, copies
counted, and a forest of the verified links.

Words as in ``common``; a text of fewer than ``size`` words has one shingle, all its
words; a text without words (or null) links with nothing. Shingles are 64-bit values.
Rows with equal id and text are copies like any other.

A text of any length is read whole. Of a component the row with the least id (then keys) is
kept. An empty table gives no rows; only the id and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keyed, longs, parts, shingles, signed, text_parts, whole_groups, words, write_shared
from .components import components, forest

SKETCH = "k1 long, k2 long, id long, n int, d1 long, d2 long, sig binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row: values, and first index per row (rows + 1)."""
    h, _, _, row = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    value, at = shingles(h, row, size)
    of = row[at]
    begin = np.searchsorted(row, np.arange(n))
    for k in np.flatnonzero((count > 0) & (count < size)).tolist():  # all words of a short text
        own, _ = shingles(h[begin[k]:begin[k] + count[k]], np.zeros(count[k], dtype=np.int64), int(count[k]))
        value, of = np.append(value, own), np.append(of, k)
    order = np.argsort(value)
    order = order[np.argsort(of[order], kind="stable")]
    value, of = value[order], of[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[keep], np.searchsorted(of[keep], np.arange(n + 1))


def _sketch(size: int, hashes: int):
    turn = np.random.default_rng(7).integers(1, 2**62, hashes, dtype=np.uint64) * U64(2) + U64(1)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in parts(batch, "text", 2 << 20):
                value, edge = shingle_sets(data, offsets, size)
                n = np.diff(edge)
                some = np.flatnonzero(n)
                sig = np.zeros((b - a, hashes), dtype=np.uint32)
                if len(some):
                    first = edge[:-1][some]
                    for k in range(hashes):
                        sig[some, k] = np.minimum.reduceat(((value * turn[k]) >> U64(32)).astype(np.uint32), first)
                raw = memoryview(value.tobytes())
                digest = [xxhash.xxh3_128_intdigest(raw[8 * x:8 * y]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
                d1 = np.array([d >> 64 for d in digest], dtype=np.uint64)
                d2 = np.array([d & (2**64 - 1) for d in digest], dtype=np.uint64)
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, (b - a + 1) * hashes * 4, hashes * 4, dtype=np.int32)), pa.py_buffer(sig)])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(n.astype(np.int32)), pa.array(signed(d1)), pa.array(signed(d2)), packed],
                                                 ["k1", "k2", "id", "n", "d1", "d2", "sig"])
    return run


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n at which P(similarity >= threshold) reaches the tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def pair_index(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of two lists, or of one list with itself (each pair once)."""
    if left is right:
        i, j = np.triu_indices(len(left), 1)
        return left[i], left[j]
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _group_pairs(groups: np.ndarray, block: np.ndarray, same: np.ndarray, most: int = 1 << 18):
    """Pairs of row numbers, group by group: of one block with itself, or of two blocks."""
    edges = np.append(np.append(0, np.flatnonzero(groups[1:] != groups[:-1]) + 1), len(groups))
    first = edges[:-1][np.diff(edges) == 2]  # most groups
    first = first[same[first] == (block[first] == block[first + 1])]
    held_a, held_b, held = [first], [first + 1], len(first)
    for k in np.flatnonzero(np.diff(edges) > 2).tolist():
        rows = np.arange(edges[k], edges[k + 1])
        left = rows if same[rows[0]] else rows[block[rows] == block[rows[0]]]
        right = left if same[rows[0]] else rows[block[rows] != block[rows[0]]]
        for at in range(0, len(left), 512):
            if left is right:
                i = left[at:at + 512]
                a, b = pair_index(i, i)
                c, d = pair_index(i, right[at + 512:])
                a, b = np.append(a, c), np.append(b, d)
            else:
                a, b = pair_index(left[at:at + 512], right)
            held_a.append(a)
            held_b.append(b)
            held += len(a)
            if held >= most:
                yield np.concatenate(held_a), np.concatenate(held_b)
                held_a, held_b, held = [], [], 0
    if held:
        yield np.concatenate(held_a), np.concatenate(held_b)


class _Survivors:
    """The pairs of a table of whole groups that the Bayesian test keeps."""

    def __init__(self, hashes: int, threshold: float, tolerance: float):
        self.hashes = hashes
        self.steps = [n for n in (16, 32, 64) if n < hashes] + [hashes]
        self.need = [least_matches(n, threshold, tolerance) for n in self.steps]

    def __call__(self, table: pa.Table):
        sig, _ = text_parts(table.column("sig").combine_chunks())
        sig = sig.view(np.uint32).reshape(-1, self.hashes)
        columns = [table.column(c).to_numpy() for c in ("grp", "block", "same")]
        for a, b in _group_pairs(*columns):
            count, before = np.zeros(len(a), dtype=np.int64), 0
            for n, least in zip(self.steps, self.need):
                for at in range(0, len(a), 1 << 15):
                    s = slice(at, at + (1 << 15))
                    count[s] += (sig[a[s], before:n] == sig[b[s], before:n]).sum(axis=1)
                live = count >= least
                a, b, count, before = a[live], b[live], count[live], n
            if len(a):
                yield a, b


def _prune(survivors: _Survivors):
    """A forest of the surviving pairs of each table of band groups."""
    def run(batches):
        for table in whole_groups(batches, "grp", 2000):
            node = table.column("node").to_numpy()
            for a, b in survivors(table):
                x, y = forest(node, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
    return run


def _verify(survivors: _Survivors, size: int, threshold: float):
    """Exact similarity of the surviving pairs of each component block pair: rows
    (class, null, links) and the edges (class, class, null) of a forest."""
    def run(batches):
        for table in whole_groups(batches, "grp", 500):
            # equal rows (id and text) come once each; a class stands once in a group
            grp, node = table.column("grp").to_numpy(), table.column("node").to_numpy()
            order = np.lexsort((node, grp))
            again = np.append(False, (grp[order][1:] == grp[order][:-1]) & (node[order][1:] == node[order][:-1]))
            if again.any():
                table = table.take(pa.array(np.sort(order[~again])))
            node, copies = table.column("node").to_numpy(), table.column("c").to_numpy()
            value, edge = shingle_sets(*text_parts(table.column("text").combine_chunks()), size)
            n = np.diff(edge)
            links = np.zeros(len(node), dtype=np.int64)
            for a, b in survivors(table):
                fits = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
                a, b = a[fits], b[fits]
                both = np.empty(len(a), dtype=np.int64)
                for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
                    p, q = value[edge[i]:edge[i + 1]], value[edge[j]:edge[j + 1]]
                    both[k] = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
                near = both >= threshold * (n[a] + n[b] - both) - 1e-9
                a, b = a[near], b[near]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                x, y = forest(node, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.nulls(len(x), pa.int64())], ["a", "b", "links"])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], ["a", "b", "links"])
    return run


def block_pairs(members: DataFrame, key: str, count: str = "m", most: int = 250) -> DataFrame:
    """Cut each group ``key`` of ``count`` members into blocks by a hash of ``node`` and
    send every member to all block pairs of its block: adds grp, block and same."""
    blocks = F.ceil(F.col(count) / most).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
    return cut.withColumn("grp", pair).withColumn("same", F.col("block") == F.col("other")).drop("blocks", "other")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8,
                    bands: int = 32, rows_per_band: int = 4, tolerance: float = 1e-6, block: int = 250, verify_block: int = 100) -> DataFrame:
    """k1, k2, id, class_id (least id of the component), n_links, kept per row of docs;
    kept marks the first row of each component (and its equals in id and text)."""
    hashes = bands * rows_per_band
    rows = keyed(docs, id_col, text_col)
    sketches = write_shared(rows.select("k1", "k2", "id", "text").mapInArrow(_sketch(size, hashes), SKETCH), "sketches")
    classes = write_shared(sketches.where("n > 0").groupBy("d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("id", "k1", "k2", "sig")).alias("r"))
                           .select(F.col("d1").alias("node"), "c", F.col("r.id").alias("id"), F.col("r.k1").alias("k1"), F.col("r.k2").alias("k2"), F.col("r.sig").alias("sig")), "classes")
    width = 4 * rows_per_band
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(F.substring(F.col("sig"), k * width + 1, F.lit(width)), k))
    member = classes.select("node", F.posexplode(keys).alias("band", "key"))
    often = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = block_pairs(member.join(often, "key"), "key", most=block).select("node", "grp", "block", "same")
    survivors = _Survivors(hashes, threshold, tolerance)
    with_sig = met.join(classes.select("node", "sig"), "node").repartition("grp").sortWithinPartitions("grp")
    near = write_shared(with_sig.mapInArrow(_prune(survivors), "a long, b long").distinct(), "near")

    found = components(near)
    placed = found.join(found.groupBy("component").agg(F.count("*").alias("m")), "component")
    placed = block_pairs(placed, "component", most=verify_block).select("node", F.struct("grp", "block", "same").alias("at"))
    placed = placed.join(classes.select("node", "c", "sig", "k1", "k2"), "node")
    placed = placed.groupBy("k1", "k2").agg(F.collect_list("at").alias("ats"), F.first("node").alias("node"), F.first("c").alias("c"), F.first("sig").alias("sig"))
    texts = rows.select("k1", "k2", "text").join(placed.hint("shuffle_hash"), ["k1", "k2"])
    texts = texts.select("node", "c", "sig", "text", F.explode("ats").alias("at")).select("at.*", "node", "c", "sig", "text")
    checked = texts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_verify(survivors, size, threshold), "a long, b long, links long")
    return _summary(sketches, classes, write_shared(checked, "links"))


def _summary(sketches: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    linked = links.where("links is not null").groupBy("a").agg(F.sum("links").alias("others")).withColumnRenamed("a", "node")
    found = components(links.where("b is not null"))
    told = classes.select("node", "c", "id", "k1", "k2").join(found, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = told.groupBy("component").agg(F.min(F.struct("id", "k1", "k2")).alias("f"))
    told = told.join(first, "component").select(F.col("node").alias("d1"), "f", (F.coalesce("others", F.lit(0)) + F.col("c") - 1).alias("n_links"))
    told = write_shared(told, "classes")
    out = sketches.select("k1", "k2", "id", F.when(F.col("n") > 0, F.col("d1")).alias("d1")).join(told, "d1", "left")
    alone = F.col("f").isNull()
    return out.select("k1", "k2", "id", F.when(alone, F.col("id")).otherwise(F.col("f.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      (alone | (F.col("k1").eqNullSafe(F.col("f.k1")) & (F.col("k2") == F.col("f.k2")))).alias("kept"))
