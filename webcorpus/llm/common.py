"""Shared helpers: tables in the shared folder, Arrow text buffers, words, shingles.

Words are the runs of ASCII digits, ASCII letters (lower-cased) and bytes of 0x80 and
above, that is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Word and shingle hashes are 64-bit; every operator that relies on equal words compares
the words themselves, or states that it compares 64-bit values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

U64 = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---------------------------------------------------------------- tables

def new_folder(spark, label: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/webcorpus-llm/{label}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it
    back. The shuffle files of the write are dropped when it ends."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def row_keys(ident, text) -> list:
    """Two key columns that identify a row by its id and its whole text, so ids that
    repeat or are null still keep different texts apart."""
    return [F.coalesce(ident, F.lit(-1).cast("long")).alias("k1"), F.xxhash64(text, text.isNull(), ident.isNull()).alias("k2")]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2) of ``row_keys``."""
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return df.select(ident.alias("id"), text.alias("text"), *row_keys(ident, text))


# ---------------------------------------------------------------- Arrow buffers

def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column laid end to end, and the offset of each
    row (one more than rows). Null is empty."""
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def longs(column: pa.Array) -> np.ndarray:
    """A long column without nulls as numpy."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def row_slices(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, at least one row each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def parts(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """(first row, end row, bytes, offsets) for slices of one batch."""
    data, offsets = text_parts(batch.column(batch.schema.get_field_index(column)))
    for a, b in row_slices(offsets, most):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def binary_array(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, type=pa.binary())


def whole_groups(batches, key: str, rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups of the long column ``key``, by which the rows are sorted;
    each but the last has at least ``rows`` rows."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = longs(batch.column(batch.schema.get_field_index(key)))
        ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and longs(held[-1].column(held[-1].schema.get_field_index(key)))[-1] != keys[0]:
            ends = np.append(0, ends)
        cut = int(ends[-1]) if len(ends) and count + int(ends[-1]) >= rows else -1
        if cut >= 0:
            table = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if table.num_rows:
                yield table
            held, count = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def range_pairs(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair (row, partner) of rows whose partners are the positions lo..hi, in
    slices of at most ``most`` pairs."""
    end = np.cumsum(np.maximum(hi - lo, 0))
    for a in range(0, int(end[-1]) if len(end) else 0, most):
        b = min(a + most, int(end[-1]))
        first, last = int(np.searchsorted(end, a, "right")), int(np.searchsorted(end, b - 1, "right"))
        begin = np.append(end[first - 1] if first else 0, end[first:last])  # of the pairs of each row
        count = np.minimum(end[first:last + 1], b) - np.maximum(begin, a)
        start = lo[first:last + 1] + np.maximum(begin, a) - begin
        yield np.repeat(np.arange(first, last + 1), count), np.repeat(start - np.cumsum(count) + count, count) + np.arange(b - a)


# ---------------------------------------------------------------- words and hashes

WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x41:0x5B] = True
WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE[LOWER]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1..n of the odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.full(size, b, dtype=U64)) for b in (_ODD, pow(_ODD, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums for ``span_hash``."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes start..end of each span."""
    _, down = powers(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def spans(flags: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of true flags; no run crosses an edge."""
    if not len(flags):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inner = edges[(edges > 0) & (edges < len(flags))]
    before = np.empty(len(flags), dtype=bool)
    before[0], before[1:] = False, flags[:-1]
    before[inner] = False
    after = np.empty(len(flags), dtype=bool)
    after[-1], after[:-1] = False, flags[1:]
    after[inner - 1] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 18):
    """(hash, start, end, row) of every word, in order. Works through ``data`` in
    pieces that end between words."""
    found, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + piece)
        while end < n:
            back = np.flatnonzero(~WORD[data[max(at, end - 4096):end]])
            if len(back):
                end = max(at, end - 4096) + int(back[-1]) + 1
                break
            end = min(n, end + 4096)
        part = data[at:end]
        lo, hi = np.searchsorted(offsets, [at, end], side="left")
        s, e = spans(WORD[part], offsets[lo:hi] - at)
        found.append((span_hash(sums(part, lower=True), s, e), s + at, e + at))
        at = end
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), none, none, none
    h, s, e = (np.concatenate(x) for x in zip(*found))
    return h, s, e, np.searchsorted(offsets, s, side="right") - 1


def shingles(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``size`` words within a row."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    out = h[:m].copy()
    for k in range(1, size):
        out = out * U64(_ODD) + h[k:k + m]
    first = np.flatnonzero(row[:m] == row[size - 1:])
    return mix(out[first]), first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
