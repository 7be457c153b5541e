"""Document fingerprints: SimHash.

The terms of a text are its adjacent word pairs (its word, if it has but one), weighted
by how often they occur. Each term's 128-bit hash votes with its weight on every bit; the
signs of the sums are the fingerprint. Where a sum is zero the least term hash of the text
decides, so that short texts with nothing in common do not share their ties. The likeness
of two fingerprints is the share of equal bits.

``neighbours`` finds all fingerprints within a Hamming radius by permuted block tables:
the bits are cut into ``blocks`` blocks, and fingerprints within ``radius`` agree in at
least ``blocks - radius`` of them, so each choice of that many blocks is a table, an
equi-join on the chosen blocks. A pair counts in the first table that holds it. Equal
fingerprints are one row with a count; buckets with many rows are cut into block pairs.

``edited`` is the check of the contract: a text whose last half (floor of code points / 2)
is replaced by the first as many code points of the next document, in descending order of
doc_id (nulls last, equal ids by text hash), after the last the first. One range shuffle
puts the texts in order; what crosses a range (one text each way) is written and joined.

Defined results: a null text is empty; a text without words has the fingerprint of zeros,
so two such texts are wholly alike; text that is not valid UTF-8 is cut where its bytes
that are not continuation bytes start; repeated rows are rows of their own; a single
document follows itself; texts may be as long as Spark allows (one slice then holds its
terms, about 30 bytes a word); an empty table gives no rows; only the id and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keyed, longs, mix, parts, range_pairs, row_slices, shingles, signed, text_parts, whole_groups, words, write_shared
from .jaccard import block_pairs

WIDTH = 128
SALTS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term, rows in order."""
    h, _, _, row = words(data, offsets)
    pair, first = shingles(h, row, 2)
    many = np.bincount(row, minlength=len(offsets) - 1)
    single = np.flatnonzero(many[row] == 1)
    if not len(single):
        return pair, row[first]
    rows = np.append(row[first], row[single])
    order = np.argsort(rows, kind="stable")
    return np.append(pair, mix(h[single]))[order], rows[order]


def _bits(h: np.ndarray) -> np.ndarray:
    """The 128 bits of each term, a byte each."""
    return np.unpackbits(np.stack([mix(h ^ s) for s in SALTS], axis=1).view(np.uint8), axis=1)


def fingerprints(data: np.ndarray, offsets: np.ndarray, run: int = 255, terms: int = 1 << 17) -> np.ndarray:
    """Fingerprint of each text laid end to end, 16 bytes a row."""
    out = np.zeros((len(offsets) - 1, WIDTH // 8), dtype=np.uint8)
    for a, b in row_slices(offsets):
        h, row = _terms(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        if not len(h):
            continue
        votes = np.zeros((b - a, WIDTH), dtype=np.int64)
        for at in range(0, len(h), terms):
            own = row[at:at + terms]
            # eight byte counters to a number: no sum of at most 255 votes leaves its byte
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            size = np.diff(np.append(starts, len(own)))
            steps = -(-size // run)
            cut = np.repeat(starts - (np.cumsum(steps) - steps) * run, steps) + np.arange(steps.sum()) * run
            packed = np.add.reduceat(_bits(h[at:at + terms]).view(np.uint64), cut, axis=0).view(np.uint8).astype(np.int64)
            np.add.at(votes, own[cut], packed)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        there, size = row[starts], np.diff(np.append(starts, len(row)))
        balance = 2 * votes[there] - size[:, None]
        least = _bits(np.minimum.reduceat(h, starts)).astype(bool)
        out[a + there] = np.packbits(np.where(balance == 0, least, balance > 0), axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / WIDTH


# ---------------------------------------------------------------- permuted block tables

def _tables(radius: int, blocks: int) -> np.ndarray:
    """A mask row per table: the bits of its chosen blocks."""
    edge = np.linspace(0, WIDTH, blocks + 1).round().astype(int)
    chosen = list(itertools.combinations(range(blocks), blocks - radius))
    masks = np.zeros((len(chosen), WIDTH), dtype=np.uint8)
    for t, some in enumerate(chosen):
        for k in some:
            masks[t, edge[k]:edge[k + 1]] = 1
    return np.packbits(masks, axis=1).view(np.uint64)


def _table_keys(masks: np.ndarray):
    def run(batches):
        for batch in batches:
            node, fp = batch.column(0), batch.column(1)
            x = text_parts(fp)[0].view(np.uint64).reshape(-1, WIDTH // 64)
            for t, mask in enumerate(masks):
                part = x & mask
                key = mix(mix(part[:, 0] + U64(t)) ^ part[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(np.full(len(x), t, dtype=np.int32)), node, fp, batch.column(2)], ["key", "tab", "node", "fp", "c"])
    return run


def _near(masks: np.ndarray, radius: int, pairs: int):
    """(node, others): how many documents each row's bucket partners stand for."""
    def run(batches):
        for table in whole_groups(batches, "grp", 50000):
            grp, key, tab, block, node, c = (table.column(x).to_numpy().astype(np.int64) for x in ("grp", "key", "tab", "block", "node", "c"))
            order = np.lexsort((block, key, grp))
            grp, key, tab, block, node, c = (x[order] for x in (grp, key, tab, block, node, c))
            x = text_parts(table.column("fp").combine_chunks())[0].view(np.uint64).reshape(-1, WIDTH // 64)[order]
            same = table.column("same").to_numpy()[order]
            new = np.append(True, (grp[1:] != grp[:-1]) | (key[1:] != key[:-1]))
            edge = np.append(np.flatnonzero(new), len(grp))
            end = np.repeat(edge[1:], np.diff(edge))
            turn = np.append(np.flatnonzero(np.append(True, new[1:] | (block[1:] != block[:-1]))), len(grp))
            after = np.repeat(turn[1:], np.diff(turn))  # where the next block or group begins
            others = np.zeros(len(grp), dtype=np.int64)
            for i, j in range_pairs(np.where(same, np.arange(1, len(grp) + 1), after), end, pairs):
                apart = x[i] ^ x[j]
                near = np.flatnonzero(np.bitwise_count(apart).sum(axis=1) <= radius)
                i, j, apart = i[near], j[near], apart[near]
                first = ((apart[:, None, :] & masks[None]) == 0).all(axis=2).argmax(axis=1)
                mine = first == tab[i]
                np.add.at(others, i[mine], c[j[mine]])
                np.add.at(others, j[mine], c[i[mine]])
            there = np.flatnonzero(others)
            yield pa.RecordBatch.from_arrays([pa.array(node[there]), pa.array(others[there])], ["node", "others"])
    return run


def neighbours(prints: DataFrame, radius: int = 6, blocks: int = 7, block: int = 2048, pairs: int = 1 << 18) -> DataFrame:
    """fp, n_near per distinct fingerprint of ``prints`` (fp): the number of other rows
    whose fingerprint is within ``radius`` bits. More ``blocks`` than ``radius + 1`` give
    more tables with longer keys, for larger tables."""
    masks = _tables(radius, blocks)
    count = prints.groupBy("fp").agg(F.count("*").alias("c"))
    nodes = write_shared(count.select(F.monotonically_increasing_id().alias("node"), "fp", "c"), "prints")
    member = nodes.mapInArrow(_table_keys(masks), "key long, tab int, node long, fp binary, c long")
    often = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = block_pairs(member.join(often, "key"), "key", most=block).select("grp", "key", "tab", "block", "same", "node", "fp", "c")
    near = met.repartition("grp").sortWithinPartitions("grp").mapInArrow(_near(masks, radius, pairs), "node long, others long")
    near = near.groupBy("node").agg(F.sum("others").alias("others"))
    return nodes.join(near, "node", "left").select("fp", (F.coalesce("others", F.lit(0)) + F.col("c") - 1).alias("n_near"))


# ---------------------------------------------------------------- edited texts

ROWS = "part int, id long, n_chars long, sha string, fp binary, edited_fp binary, near_edited double, near_next double"
EDGE = "tail binary, head binary, head_fp binary"


class _Texts:
    """Some texts in order, with their code points and fingerprints."""

    def __init__(self, ids: list, data: np.ndarray, offsets: np.ndarray, prints: np.ndarray | None = None):
        self.ids, self.data, self.offsets = ids, data, offsets
        self.points = np.flatnonzero((data & 0xC0) != 0x80)
        self.first = np.searchsorted(self.points, offsets)  # of each row among the code points
        self.prints = fingerprints(data, offsets) if prints is None else prints

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()

    def _byte(self, row: int, point: int) -> int:
        at = self.first[row] + point
        return int(self.points[at]) if at < self.first[row + 1] else int(self.offsets[row + 1])

    def head(self, row: int, points: int) -> bytes:
        return self.data[self.offsets[row]:self._byte(row, min(points, self.n(row)))].tobytes()

    def n(self, row: int) -> int:
        return int(self.first[row + 1] - self.first[row])


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in pieces])).astype(np.int64)


def _compared(part: int, texts: list[tuple[_Texts, int]]) -> list:
    """The columns of ROWS for each of ``texts`` but the last, the next one its successor."""
    made, count = [], []
    for (own, i), (after, j) in zip(texts, texts[1:]):
        n = own.n(i)
        made.append(own.head(i, n - n // 2) + after.head(j, n // 2))
        count.append(n)
    prints = np.stack([t.prints[i] for t, i in texts])
    edited = fingerprints(*_joined(made))
    m = len(made)
    return [pa.array([part] * m, pa.int32()), pa.array([t.ids[i] for t, i in texts[:-1]], pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in made]),
            pa.array([x.tobytes() for x in prints[:-1]], pa.binary()), pa.array([x.tobytes() for x in edited], pa.binary()),
            pa.array(likeness(prints[:-1], edited)), pa.array(likeness(prints[:-1], prints[1:]))]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _in_order(batches):
    """Rows of one range in order; of its last text and its first one, an edge row."""
    part, head, last = TaskContext.get().partitionId(), None, None
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, b, data, offsets in parts(batch, "text"):
            some = _Texts(ids[a:b], data, offsets)
            head = head or (some, 0)
            texts = ([last] if last else []) + [(some, i) for i in range(b - a)]
            if len(texts) > 1:
                m = len(texts) - 1
                yield pa.RecordBatch.from_arrays([*_compared(part, texts), *[pa.nulls(m, pa.binary())] * 3], _names(f"{ROWS}, {EDGE}"))
            keep = texts[-1]
            last = (_Texts([keep[0].ids[keep[1]]], *_joined([keep[0].text(keep[1])]), keep[0].prints[keep[1]:keep[1] + 1].copy()), 0)
            if head[0] is some:
                head = (_Texts([ids[a]], *_joined([some.text(0)]), some.prints[:1].copy()), 0)
    if last:
        (own, _), (first, _) = last, head
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([own.ids[0]], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string())), pa.array([own.prints[0].tobytes()], pa.binary()), pa.nulls(1, pa.binary()),
            *[pa.nulls(1, pa.float64())] * 2, pa.array([own.text(0)], pa.binary()), pa.array([first.text(0)], pa.binary()), pa.array([first.prints[0].tobytes()], pa.binary())], _names(f"{ROWS}, {EDGE}"))


def _across(batches):
    """The last text of each range with the first of the next."""
    for batch in batches:
        for r in batch.to_pylist():
            own = _Texts([r["id"]], *_joined([r["tail"]]), np.frombuffer(r["fp"], dtype=np.uint8)[None])
            after = _Texts([None], *_joined([r["head"]]), np.frombuffer(r["head_fp"], dtype=np.uint8)[None])
            yield pa.RecordBatch.from_arrays(_compared(r["part"], [(own, 0), (after, 0)]), _names(ROWS))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 6, blocks: int = 7) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited,
    near_next, n_near (other documents within the radius) per row of ``docs``."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).select("id", "text", "k2", F.monotonically_increasing_id().alias("seq"))
    order = [F.col("id").desc_nulls_last(), "k2", "seq"]  # seq parts equal rows, which are interchangeable
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    found = write_shared(ordered.mapInArrow(_in_order, f"{ROWS}, {EDGE}"), "ordered")
    edges = found.where("tail is not null")
    ranges = sorted(r["part"] for r in edges.select("part").collect())  # one row per range
    follow = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1])), "part int, next int")
    heads = edges.select(F.col("part").alias("next"), "head", "head_fp")
    last = edges.select("part", "id", "fp", "tail").join(follow, "part").join(heads, "next").select("part", "id", "fp", "tail", "head", "head_fp")
    told = found.where("tail is null").select(*_names(ROWS)).unionByName(last.mapInArrow(_across, ROWS))
    told = told.join(neighbours(found.select("fp"), radius, blocks), "fp")
    return told.select(F.col("id").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), F.lower(F.hex("fp")).alias("fingerprint"),
                       F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
