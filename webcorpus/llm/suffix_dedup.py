"""Removal of every byte that a long repeated string covers (suffix-array dedup).

A byte goes if a string of ``length`` bytes over it also starts anywhere else in the
table. Whether a string repeats is read off sorted suffixes: two neighbours with a
common prefix of ``length`` or more.

* Every string of ``length`` bytes is dealt to one shard by its anchor: the least hash
  among its ``gram``-byte substrings, leftmost first. Equal strings have equal anchors,
  so strings never have to be compared across shards. The consecutive strings of one
  document that share an anchor form a run, sent as one segment.
* Runs whose anchor occurs once in the corpus are done. Equal segments are counted
  before anything is sent; a segment that occurs twice is repeated throughout.
* The distinct segments of the other anchors are sorted shard by shard by external
  induced sorting (``induced``): suffix tuples and common prefixes pass through
  file-backed queues, recursively.
* An anchor with more than ``hot`` distinct segments (the edge of a passage that very
  many documents share) is split again: its strings go by classes of 16, 4 and 1
  neighbouring starts, keyed by all bytes that the strings of the class have in common.

Null text is empty; texts under ``length`` bytes lose nothing; equal rows count as
separate places; the result has a row per input row and no other input columns.

A text of any length is cut into runs; of equal strings none is kept (each is removed
everywhere); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, binary_array, keyed, longs, parts, powers, signed, sums, text_parts, whole_groups,
                     write_shared, mix)
from .induced import Scratch, suffix_order

CHUNK = 1 << 16
WIDTHS = (16, 4, 1)
RUN_SCHEMA = "k1 long, k2 long, anchor long, pack long, digest long"
SEGMENT_SCHEMA = "g long, digest long, occ long, d long, off int, n int, text binary"
SUB_SCHEMA = "g long, digest long, lo int, key long, sub long, occ long, off int, n int, text binary"
SPAN_SCHEMA = "g long, digest long, lo int, hi int"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of strings with one anchor: (row, start in the row, strings, place of the
    anchor in the segment, anchor hash, start in data), chunk by chunk."""
    wide = length - gram + 1
    mask = U64(CHUNK - 1)
    place = np.arange(CHUNK, dtype=U64)
    _, down = powers(CHUNK + 1)
    step = CHUNK - length
    for at in range(0, len(data), step):
        part = data[at:at + CHUNK]
        if len(part) < length:
            break
        total = sums(part)
        h = mix((total[gram:] - total[:-gram]) * down[:len(total) - gram])
        least = (h & ~mask) | place[:len(h)]
        width = 1
        while width * 2 <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if wide > width:
            least = np.minimum(least[:width - wide], least[wide - width:])
        anchor = (least[:step] & mask).astype(np.int32)
        lo, hi = np.searchsorted(offsets, [at + 1, at + len(anchor) + length])
        cuts = offsets[lo:hi] - at  # row ends; strings over one don't count
        for c in cuts:
            anchor[max(0, c - length + 1):max(0, c)] = -1
        start = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, cuts[cuts < len(anchor)])
        start = np.append(0, start) if not len(start) or start[0] else start
        end = np.append(start[1:], len(anchor))
        live = anchor[start] >= 0
        start, end = start[live], end[live]
        if len(start):
            a = anchor[start]
            row = np.searchsorted(offsets, start + at, side="right") - 1
            yield row, start + at - offsets[row], end - start, a - start, signed(h[a]), start + at


def _anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in parts(batch, "text"):
                for found in runs(data, offsets, length, gram):
                    yield pa.RecordBatch.from_arrays([pa.array(found[4])], ["anchor"])
    return run


def _runs(length: int, gram: int):
    def run(batches):
        for batch in batches:
            k1, k2 = longs(batch.column(0)), longs(batch.column(1))
            for first, _, data, offsets in parts(batch, "text"):
                raw = memoryview(data)
                for row, start, n, off, anchor, at in runs(data, offsets, length, gram):
                    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at.tolist(), (at + n + length - 1).tolist())), dtype=U64, count=len(at))
                    pack = (start << 16) | (off.astype(np.int64) << 8) | (n - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(k1[first + row]), pa.array(k2[first + row]), pa.array(anchor), pa.array(pack), pa.array(signed(digest))], ["k1", "k2", "anchor", "pack", "digest"])
    return run


def _segments(length: int):
    """Cut the wanted segments out of their documents."""
    def run(batches):
        for batch in batches:
            data, offsets = text_parts(batch.column(batch.schema.get_field_index("text")))
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            row = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            pack, g, digest, occ, d = (longs(flat.field(k)) for k in range(5))
            start = offsets[row] + (pack >> 16)
            n = (pack & 255) + 1
            off = (pack >> 8) & 255
            raw = data.tobytes()
            text = [raw[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(digest), pa.array(occ), pa.array(d), pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32)), binary_array(text)], ["g", "digest", "occ", "d", "off", "n", "text"])
    return run


def _split(length: int, width: int):
    """Segments of a hot anchor by classes of ``width`` neighbouring starts."""
    def run(batches):
        for batch in batches:
            out = []
            for g, digest, occ, off, n, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("g", "digest", "occ", "off", "n", "text"))):
                at = 0
                while at < n:
                    c = (at - off) // width
                    end = min(n, (c + 1) * width + off)
                    core = text[c * width + width - 1 + off:c * width + length + off]
                    key = xxhash.xxh3_64_intdigest(core, seed=(g ^ (c * 0x9E3779B97F4A7C15)) % 2**64)
                    piece = text[at:end + length - 1]
                    out.append((g, digest, at, key - 2**64 if key >= 2**63 else key, xxhash.xxh3_64_intdigest(piece) - 2**63, occ, off - at, end - at, piece))
                    at = end
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64()), pa.array(c[6], pa.int32()), pa.array(c[7], pa.int32()), binary_array(c[8])], [x.split()[0] for x in SUB_SCHEMA.split(", ")])
    return run


def repeated_strings(segments: list[bytes], length: int, memory_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, end) of the runs of starts whose ``length``-byte string occurs
    at two places of the segments, by the sorted suffixes of all of them."""
    sizes = np.fromiter((len(s) for s in segments), dtype=np.int64, count=len(segments))
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    text = np.empty(int(ends[-1]) + 1, dtype=np.int32)
    raw = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8)
    np.add(raw, 2, out=text[:-1], dtype=np.int32)
    text[ends - 1] = 1
    text[-1] = 0
    with Scratch(memory_bytes) as scratch:
        order, same = suffix_order(text, 258, length, scratch)
        high = np.asarray(same) >= length
        flag = np.zeros(len(text) + 1, dtype=bool)
        flag[order[high]] = True
        flag[order[np.flatnonzero(high) - 1]] = True
    # a suffix with less than ``length`` bytes left in its segment starts no string
    edge = np.zeros(len(flag), dtype=np.int8)
    edge[begin] = 1
    edge[begin + np.maximum(sizes - length + 1, 0)] -= 1
    flag &= np.cumsum(edge, dtype=np.int8).astype(bool)
    hit = np.diff(flag.astype(np.int8), prepend=0)
    first, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    segment = np.searchsorted(begin, first, side="right") - 1
    return segment, first - begin[segment], end - begin[segment]


def _sort(length: int, shard_bytes: int, memory_bytes: int):
    """Sort whole anchors, about ``shard_bytes`` at a time."""
    def emit(rows):
        where, lo, hi = repeated_strings([r[3] for r in rows], length, memory_bytes)
        live = [k for k, w in enumerate(where.tolist()) if rows[w][2] < 2]
        w = where[live].tolist()
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in w], pa.int64()), pa.array([rows[k][1] for k in w], pa.int64()), pa.array(lo[live].astype(np.int32)), pa.array(hi[live].astype(np.int32))], ["g", "digest", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for table in whole_groups(batches, "g", 1000):
            rows = list(zip(*(table.column(c).to_pylist() for c in ("g", "digest", "occ", "text"))))
            for k, r in enumerate(rows):
                if size >= shard_bytes and r[0] != held[-1][0]:
                    yield emit(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield emit(held)
    return run


def _solve(segments: DataFrame, length: int, hot: int, widths: tuple, shard_bytes: int, memory_bytes: int) -> DataFrame:
    """Repeated spans (g, digest, lo, hi) of distinct segments (g, digest, occ, d, ...);
    d is the number of distinct segments of g. ``segments`` is a written table."""
    whole = segments.where("occ >= 2").select("g", "digest", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    shards = segments.where((F.col("d") > 1) & (F.col("d") <= hot)).select("g", "digest", "occ", "text")
    found = whole.unionByName(shards.repartition("g").sortWithinPartitions("g").mapInArrow(_sort(length, shard_bytes, memory_bytes), SPAN_SCHEMA))
    large = segments.where(F.col("d") > hot)
    if not widths or large.isEmpty():
        return found
    rows = write_shared(large.mapInArrow(_split(length, widths[0]), SUB_SCHEMA), "split")
    subs = rows.groupBy("key", "sub").agg(F.sum("occ").alias("occ"), F.first("off").alias("off"), F.first("n").alias("n"), F.first("text").alias("text"))
    keys = rows.select("key", "sub").distinct().groupBy("key").agg(F.count("*").alias("d"))
    nested = write_shared(subs.join(keys, "key").where("d > 1 or occ > 1").select(F.col("key").alias("g"), F.col("sub").alias("digest"), "occ", "d", "off", "n", "text"), "classes")
    inner = _solve(nested, length, hot if len(widths) > 1 else 1 << 62, widths[1:], shard_bytes, memory_bytes)
    inner = inner.select(F.col("g").alias("key"), F.col("digest").alias("sub"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    back = rows.select("g", "digest", "lo", "key", "sub").join(inner, ["key", "sub"])
    return found.unionByName(back.select("g", "digest", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi")))


def _kept(length: int):
    """Per document: drop the covered bytes and digest the rest."""
    def run(batches):
        for batch in batches:
            raw, offsets = text_parts(batch.column(batch.schema.get_field_index("text")))
            raw = memoryview(raw.tobytes())
            out = []
            for k, (ident, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index("spans")).to_pylist())):
                a, b = int(offsets[k]), int(offsets[k + 1])
                sha, at, removed, n = hashlib.sha256(), a, 0, 0
                end = -1
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    stop = hi + length - 1
                    if lo > end:
                        n += 1
                        sha.update(raw[at:a + lo])
                    removed += max(0, stop - max(lo, end))
                    end = max(end, stop)
                    at = a + end
                sha.update(raw[at:b])
                out.append((ident, b - a, removed, n, sha.hexdigest()))
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 40,
                   hot: int = 256, shard_bytes: int = 1 << 20, memory_bytes: int = 64 << 20) -> DataFrame:
    """(k1, k2, lo, hi): the starts lo..hi-1 of row (k1, k2) begin repeated strings."""
    rows = keyed(docs, id_col, text_col)
    anchors = rows.select("text").mapInArrow(_anchors(length, gram), "anchor long")
    # written, so that both sides of the join below are plain exchanges that Spark can split
    often = write_shared(anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    all_runs = rows.select("k1", "k2", "text").mapInArrow(_runs(length, gram), RUN_SCHEMA)
    # ~anchor: a new key, so that the grouping below gets an exchange of its own after a map-side sum
    repeated = write_shared(all_runs.join(often, "anchor", "left_semi").select("k1", "k2", F.bitwise_not("anchor").alias("g"), "pack", "digest"), "runs")
    segments = repeated.groupBy("g", "digest").agg(F.count("*").alias("occ"), F.min(F.struct("k1", "k2", "pack")).alias("at"))
    groups = segments.groupBy("g").agg(F.count("*").alias("d"), F.max((F.col("occ") < 2)).alias("open"))
    wanted = segments.join(groups.where("d > 1 and open"), "g").select("at.k1", "at.k2", F.struct(F.col("at.pack").alias("pack"), "g", "digest", "occ", "d").alias("w"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    texts = rows.select("k1", "k2", "text").join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("text", "wanted")
    cut = write_shared(texts.mapInArrow(_segments(length), SEGMENT_SCHEMA), "segments")
    spans = write_shared(_solve(cut.where("occ < 2 or d > 1"), length, hot, WIDTHS, shard_bytes, memory_bytes), "spans")
    whole = repeated.groupBy("g", "digest").agg(F.count("*").alias("occ")).where("occ > 1").select("g", "digest", F.lit(0).alias("lo"), F.lit(-1).alias("hi"))
    places = repeated.join(spans.where("hi > lo").unionByName(whole).distinct(), ["g", "digest"])
    start = F.shiftright("pack", 16)
    count = F.col("pack").bitwiseAND(255) + 1
    return places.select("k1", "k2", (start + F.col("lo")).alias("lo"), (start + F.when(F.col("hi") < 0, count).otherwise(F.col("hi"))).alias("hi"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``. Options as
    in ``repeated_spans``, whose rows give the places."""
    spans = repeated_spans(docs, id_col, text_col, length, **options)
    per_row = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = keyed(docs, id_col, text_col).join(per_row.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", "spans")
    return joined.mapInArrow(_kept(length), RESULT_SCHEMA)
