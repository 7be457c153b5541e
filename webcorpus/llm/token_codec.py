"""Token ids in Huffman-coded block files.

Writing: documents in ascending id order (null ids first, equal ids by a hash of the
text), each followed by an end id; ids come from a public tokenizer. Global id counts
give length-limited code lengths (package-merge, ``max_bits``), canonical codes follow
from the lengths. A block holds the ids of whole documents, about ``block_ids`` of
them, as one bit string with the bit offset of every ``every``-th id; it can be decoded
alone. The files are Parquet (one folder per range of documents, in order): block
number, ids before it in the range, document ids and counts, checkpoints, payload; the
code lengths are a table of their own.

Reading: blocks are decoded by a table of 2**max_bits entries; all stretches between
checkpoints advance together, one id per step.

Null text is empty: its ids are the end id alone. Repeated rows are separate documents.

Tokenizing: white space separates pieces, and so do borders between ASCII letters,
digits and ASCII punctuation other than the apostrophe, all of which are borders of
the tokenizer's own split; equal pieces (64-bit hash, at most 64 bytes) are tokenized
once per worker and looked up after. Texts with ``<|`` go to the tokenizer whole, as
they may hold its special tokens.

A text of any length is one document, wholly inside one block. An empty table writes an empty
code book and no blocks, and reads back no rows; only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import binary_array, keyed, longs, new_folder, parts, span_hash, sums, write_shared

# ---------------------------------------------------------------- tokenizing

_KIND = np.full(256, 3, dtype=np.uint8)  # 3: never split from what stands beside it
for _c in b" \t\r\n":
    _KIND[_c] = 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
for _c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 2
_KIND[0x30:0x3A] = 4
_BORDER = np.zeros((5, 5), dtype=bool)
_BORDER[0, :] = _BORDER[:, 0] = True
for _a, _b in ((1, 2), (2, 1), (1, 4), (4, 1), (2, 4), (4, 2), (4, 4)):
    _BORDER[_a, _b] = True
_BORDER = _BORDER.ravel()
_LETTERS = re.compile(rb"[a-z]+")
_CACHES: dict[str, "Pieces"] = {}


class Pieces:
    """Ids of pieces by hash, kept by a worker across its tasks: sorted runs of keys,
    merged as they grow; emptied beyond ``most`` pieces."""

    def __init__(self, path: str, most: int = 2_000_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most = most
        self.clear()

    def clear(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        for run, index in self.runs:
            at = np.minimum(np.searchsorted(run, keys), len(run) - 1)
            hit = run[at] == keys
            out[hit] = index[at[hit]]
        return out

    def add(self, keys: np.ndarray, pieces: list[bytes]):
        """Tokenize new pieces; ``keys`` ascends."""
        lists: list = [None] * len(pieces)
        other = []
        for k, piece in enumerate(pieces):
            if _LETTERS.fullmatch(piece):
                lists[k] = [t.id for t in self.model.tokenize(piece.decode())]
            else:
                other.append(k)
        for k, e in zip(other, self.tokenizer.encode_batch_fast([pieces[k].decode("utf-8", "replace") for k in other], add_special_tokens=False)):
            lists[k] = e.ids
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        base, first = len(self.start), len(self.ids)
        self.start = np.append(self.start, first + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, np.fromiter((i for x in lists for i in x), dtype=np.uint32, count=int(size.sum())))
        self.runs.append((keys, base + np.arange(len(keys))))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (a, x), (b, y) = self.runs.pop(), self.runs.pop()
            k, v = np.append(a, b), np.append(x, y)
            order = np.argsort(k)
            self.runs.append((k[order], v[order]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the number of ids of each row."""
        n = len(offsets) - 1
        raw = data.tobytes()
        special = np.zeros(n, dtype=bool)
        at = raw.find(b"<|")
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            special[row] = True
            at = raw.find(b"<|", max(at + 1, int(offsets[row + 1]) - 1))
        kind = _KIND[data]
        if special.any():
            for row in np.flatnonzero(special).tolist():
                kind[offsets[row]:offsets[row + 1]] = 0
        border = np.ones(len(data), dtype=bool)
        if len(data):
            border[1:] = _BORDER[kind[:-1] * np.uint8(5) + kind[1:]]
            border[offsets[(offsets > 0) & (offsets < len(data))]] = True
        start = np.flatnonzero(border)
        end = np.append(start[1:], len(data))
        live = kind[start] != 0
        start, end = start[live], end[live]
        if len(self.start) > self.most:
            self.clear()
        h = np.empty(len(start), dtype=np.uint64)
        for lo in range(0, len(data), 1 << 18):  # hashes by blocks that stay in the cache
            a, b = np.searchsorted(start, [lo, lo + (1 << 18)])
            if a < b:
                block = sums(data[start[a]:end[b - 1]], lower=True)
                h[a:b] = span_hash(block, start[a:b] - start[a], end[a:b] - start[a])
        keys, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        index = self.find(keys)
        new = np.flatnonzero(index < 0)
        if len(new):
            lower = raw.lower()  # ASCII letters only
            self.add(keys[new], [lower[a:b] for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist())])
            index = self.find(keys)
        index = index[inverse]
        # long pieces: by their own bytes
        long = np.flatnonzero(end - start > 64)
        own = {int(k): self.whole(raw[start[k]:end[k]].decode("utf-8", "replace")) for k in long}
        size = self.size[index]
        begin = self.start[index]
        for k, ids in own.items():
            size[k] = len(ids)
        row = np.searchsorted(offsets, start, side="right") - 1
        count = np.bincount(row, weights=size, minlength=n).astype(np.int64)
        last = np.cumsum(size)
        place = np.arange(int(last[-1]) if len(last) else 0)
        place = np.repeat(begin - (last - size), size) + place
        np.minimum(place, max(len(self.ids) - 1, 0), out=place)
        ids = self.ids[place] if len(place) else np.zeros(0, dtype=np.uint32)
        for k, own_ids in own.items():
            ids[last[k] - size[k]:last[k]] = own_ids
        if special.any():
            ends = np.cumsum(count)
            pieces, at = [], 0
            for r in np.flatnonzero(special).tolist():
                pieces += [ids[at:ends[r]], np.array(self.whole(raw[offsets[r]:offsets[r + 1]].decode("utf-8", "replace")), dtype=np.uint32)]
                at, count[r] = int(ends[r]), len(pieces[-1])
            ids = np.concatenate([*pieces, ids[at:]])
        return ids, count


def with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each row."""
    out = np.full(len(ids) + len(count), end_id, dtype=np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(count + 1) - 1] = False
    out[keep] = ids
    return out, count + 1


def _tokenize(path: str, end_id: int, kind):
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = _CACHES.setdefault(path, None) or _CACHES.__setitem__(path, Pieces(path)) or _CACHES[path]
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offsets in parts(batch, "text", 2 << 20):
                ids, count = with_end(*pieces.encode(data, offsets), end_id)
                edges = np.append(0, np.cumsum(count)) * np.dtype(kind).itemsize
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, part, dtype=np.int32)), pa.array(np.arange(seq, seq + b - a)), batch.column(0).slice(a, b - a), packed], ["part", "seq", "id", "ids"])
                seq += b - a
    return run


# ---------------------------------------------------------------- codes

def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Package-merge: optimal code lengths of at most ``max_bits``; 0 for unused ids."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    levels, row = [], np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([coins, row])
        by = np.argsort(merged, kind="stable")
        levels.append(by < len(coins))
        merged = merged[by]
        row = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(coins) - 2
    for own in reversed(levels):
        coin = int(own[:take].sum())
        out[order[:coin]] += 1
        take = 2 * (take - coin)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, before = 0, 0
    own = lengths[order].astype(int)
    for bits in range(1, int(own.max(initial=0)) + 1):
        at = order[own == bits]
        code <<= bits - before
        codes[at] = np.arange(code, code + len(at), dtype=np.uint64)
        code, before = code + len(at), bits
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
    """Bit string of the ids (first bit highest) and the bit offset of every stretch."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros((int(end[-1]) >> 5) + 2, dtype=np.uint32)
    out[word[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first).astype(np.uint32)
    out[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first).astype(np.uint32)
    return out.astype(">u4").tobytes()[:(int(end[-1]) + 7) // 8], at[::every]


class Decoder:
    """All stretches of a set of blocks side by side."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(int(lengths.max(initial=0)), 1)
        codes = canonical(lengths)
        self.id = np.zeros(1 << self.bits, dtype=np.uint32)
        self.size = np.ones(1 << self.bits, dtype=np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(codes[used] << (self.bits - lengths[used]).astype(np.uint64))]
        width = 1 << (self.bits - lengths[used].astype(np.int64))
        self.id[:int(width.sum())] = np.repeat(used, width)
        self.size[:int(width.sum())] = np.repeat(lengths[used], width)

    def __call__(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int], every: int) -> np.ndarray:
        raw = np.frombuffer(b"".join(p + b"\0\0\0\0" for p in payloads), dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        base = np.cumsum([0] + [len(p) + 4 for p in payloads])[:-1]
        at = np.concatenate([c + b * 8 for c, b in zip(checkpoints, base)])
        stretch = np.concatenate([np.minimum(every, n - np.arange(0, n, every)) for n in counts])
        out = np.zeros((every, len(at)), dtype=np.uint32)
        order = np.argsort(-stretch, kind="stable")
        at, left = at[order], stretch[order]
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        for step in range(every):
            live = int(np.searchsorted(-left, -step, side="left"))  # stretches longer than step
            if not live:
                break
            p = at[:live]
            code = (window[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            out[step, :live] = self.id[code]
            p += self.size[code]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out.T[back][np.arange(every)[None, :] < stretch[:, None]]


# ---------------------------------------------------------------- files

def _counts(kind, vocabulary: int):
    def run(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for _, _, data, _ in parts(batch, "ids", 32 << 20):
                total += np.bincount(data.view(kind), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "c"])
    return run


BLOCK_SCHEMA = "part int, block long, n_ids long, doc_ids array<long>, counts array<long>, checkpoints array<long>, payload binary"


def _blocks(kind, lengths: np.ndarray, every: int, block_ids: int):
    """Blocks of whole documents that follow one another in one range."""
    def run(batches):
        codes = canonical(lengths)
        for batch in batches:
            part, seq = (longs(batch.column(batch.schema.get_field_index(c))) for c in ("part", "seq"))
            names = batch.column(batch.schema.get_field_index("id")).to_pylist()
            for a, b, data, offsets in parts(batch, "ids", 16 << 20):
                ids = data.view(kind)
                edge = offsets // np.dtype(kind).itemsize
                at, out = 0, []
                broken = np.append((part[a + 1:b] != part[a:b - 1]) | (seq[a + 1:b] != seq[a:b - 1] + 1), True)
                stops = (np.flatnonzero(broken) + 1).tolist()
                while at < b - a:
                    stop = stops[int(np.searchsorted(stops, at, side="right"))]
                    end = min(stop, max(at + 1, int(np.searchsorted(edge, edge[at] + block_ids, side="right")) - 1))
                    payload, check = pack(ids[edge[at]:edge[end]], codes, lengths, every)
                    out.append((int(part[a + at]), int(seq[a + at]), int(edge[end] - edge[at]), names[a + at:a + end], np.diff(edge[at:end + 1]).tolist(), check.tolist(), payload))
                    at = end
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in c[3:6]), binary_array(c[6])], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])
    return run


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text",
                max_bits: int = 20, every: int = 128, block_ids: int = 1 << 16) -> str:
    """Tokenize, count, encode; returns the folder of the files (``blocks`` and
    ``codebook``)."""
    spark = docs.sparkSession
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    rows = keyed(docs, id_col, text_col).select("id", "k2", "text")
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), "k2").sortWithinPartitions(F.col("id").asc_nulls_first(), "k2").select("id", "text")
    ids = write_shared(ordered.mapInArrow(_tokenize(tokenizer, end_id, kind), "part int, seq long, id long, ids binary"), "ids", "zstd")
    counts = np.zeros(vocabulary, dtype=np.int64)
    for r in ids.select("ids").mapInArrow(_counts(kind, vocabulary), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).toLocalIterator():
        counts[r["token"]] = r["c"]
    lengths = code_lengths(counts, max_bits)
    folder = new_folder(spark, "tokens")
    book = spark.createDataFrame([(int(t), int(lengths[t])) for t in np.flatnonzero(lengths)], "token long, bits int")
    book.coalesce(1).write.parquet(f"{folder}/codebook")
    ids.mapInArrow(_blocks(kind, lengths, every, block_ids), BLOCK_SCHEMA).write.partitionBy("part").parquet(f"{folder}/blocks")
    return folder


def _decode(lengths: np.ndarray, every: int, digest: bool):
    def run(batches):
        decode = Decoder(lengths)
        for batch in batches:
            rows = batch.to_pylist()
            while rows:
                take, size = 0, 0
                while take < len(rows) and (not take or size + rows[take]["n_ids"] <= 1 << 21):
                    size += rows[take]["n_ids"]
                    take += 1
                some, rows = rows[:take], rows[take:]
                ids = decode([r["payload"] for r in some], [np.array(r["checkpoints"], dtype=np.int64) for r in some], [r["n_ids"] for r in some], every)
                count = np.array([c for r in some for c in r["counts"]], dtype=np.int64)
                end = np.cumsum(count)
                if digest:
                    raw = memoryview(ids.tobytes())
                    last = pa.array([zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(end.tolist(), count.tolist())], pa.int64())
                else:
                    last = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(np.append(0, end * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["part"] for r in some for _ in r["counts"]], pa.int32()), pa.array([r["block"] for r in some for _ in r["counts"]], pa.int64()),
                    pa.array([d for r in some for d in r["doc_ids"]], pa.int64()),
                    pa.array(np.concatenate([np.cumsum(r["counts"]) - r["counts"] for r in some])), pa.array(count), last],
                    ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32" if digest else "ids"])
    return run


def read_files(spark, folder: str, every: int = 128, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit, as binary) per
    document; with ``digest`` ids_crc32 of these bytes in place of ids."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    lengths = np.zeros(int(book["token"].max()) + 1 if len(book) else 1, dtype=np.uint8)
    lengths[book["token"].to_numpy()] = book["bits"].to_numpy()
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    sizes = blocks.select("part", "block", "n_ids")
    ranges = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one per written range
    before, total = [], 0
    for part, n in ranges:
        before.append((part, total))
        total += n
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = sizes.select("part", "block", inside.alias("inside")).join(spark.createDataFrame(before, "part int, before long"), "part")
    last = "ids_crc32" if digest else "ids"
    out = blocks.mapInArrow(_decode(lengths, every, digest), f"part int, block long, doc_id long, within long, n_tokens long, {last} {'long' if digest else 'binary'}")
    return out.join(starts, ["part", "block"]).select("doc_id", (F.col("before") + F.col("inside") + F.col("within")).alias("start"), "n_tokens", last)
