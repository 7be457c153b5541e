"""Spelling variants of the corpus vocabulary, grouped by asymmetric q-chunks.

Words are the maximal letter runs (ASCII letters and U+00C0 to U+00FF) of whole texts,
A-Z lower-cased; ``words_of`` counts them inside each task before anything is shuffled.
Two words are near when one inserted, deleted or replaced code point turns one into the
other. In each ordered pair one word gives two disjoint chunks, its first and its last
half (q = half its length, rounded down), the other all its grams of that size within
one place of either chunk. An edit spoils at most one chunk, so every near pair meets in
the equi-join on (length, chunk, gram). Inside a task the meeting pairs go through two
parity marks (one edit changes at most two letters and four letter pairs) and are then
verified by their common prefix and suffix, in slices of bounded size. A pair that meets through both chunks counts
through the first. Keys with many words are cut into block pairs (``block`` words each
way), so no key has to fit one task; nothing is capped.

Chunk keys are 64-bit hashes and only propose pairs; nearness is decided on the letters.

Defined results: a null or empty text, or one without such runs, gives no words; a null
doc_id counts as an empty one in the edit rule; repeated rows count each time; a run may
be as long as the text; among near words of equal count the smallest in code-point order
is the form; an empty table gives no rows; other columns of the input are not read, so
their names may clash with any used here.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, mix, parts, range_pairs, signed, span_hash, spans, sums, text_parts, whole_groups, write_shared

#: every letter is below U+0100, so a word in Latin-1 has one byte per code point, in code-point order
LETTERS = "latin-1"
CHUNK, GRAM = 0, 1
ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[0x41:0x5B] = ASCII_LETTER[0x61:0x7B] = True
LEAD = 0xC3  # the first UTF-8 byte of U+00C0 to U+00FF; the second has the low six bits


def _runs(data: np.ndarray, offsets: np.ndarray, least: int):
    """The lower-cased letter runs of ``least`` code points or more in Latin-1; the bytes
    with A-Z lower-cased, start and end of each run in them, and its row."""
    lead = data == LEAD
    tail = np.zeros(len(data), dtype=bool)
    tail[1:] = lead[:-1]
    low = LOWER[data]
    s, e = spans(ASCII_LETTER[data] | lead | tail, offsets)
    leads = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(lead, out=leads[1:])
    size = e - s - (leads[e] - leads[s])
    long = size >= least
    s, e, size = s[long], e[long], size[long]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[s] += 1
    inside[e] -= 1
    letters = np.where(tail, low | 0x40, low)[(np.cumsum(inside[:-1], dtype=np.int8) > 0) & ~lead]
    edge = np.append(0, np.cumsum(size)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(letters)])
    return runs, low, s, e, np.searchsorted(offsets, s, side="right") - 1


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc32s(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: np.ndarray, most: int = 64) -> np.ndarray:
    """crc32 of the bytes s..e of each span, carried on from its ``seed``."""
    order = np.argsort(s - e, kind="stable")  # the longest first
    size, at, state = (e - s)[order], s[order], ~seed[order]
    for step in range(min(int(size.max(initial=0)), most)):
        live = int(np.searchsorted(-size, -step, side="left"))
        now = state[:live]
        state[:live] = CRC[(now ^ data[at[:live] + step]) & 0xFF] ^ (now >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -most, side="left"))):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] + most:at[i] + size[i]].tobytes(), int(~state[i])))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _counted(least: int, every: int, held_rows: int = 1 << 20, held_bytes: int = 32 << 20):
    """(word, n) summed over many rows at a time."""
    def merged(held):
        return pa.Table.from_batches(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

    def run(batches):
        held = []
        for batch in batches:
            seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], dtype=np.uint32)
            for a, _, data, offsets in parts(batch, "text", 8 << 20):
                runs, low, s, e, row = _runs(data, offsets, least)
                if not len(runs):
                    continue
                hit, made = np.zeros(len(row), dtype=bool), []
                if every:
                    h = crc32s(low, s, e, seeds[a + row])
                    hit = h % every == 0
                    for i in np.flatnonzero(hit).tolist():
                        word = runs[i].as_py()
                        at = int(h[i]) % len(word)
                        made.append(word[:at] + word[at + 1:])
                    made = [w for w in made if len(w) >= least]
                runs = runs.dictionary_encode()
                n = np.bincount(runs.indices.to_numpy()[~hit], minlength=len(runs.dictionary))
                held.append(pa.RecordBatch.from_arrays([runs.dictionary, pa.array(n)], ["word", "n"]))
                held.append(pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(np.ones(len(made), dtype=np.int64))], ["word", "n"]))
                if sum(x.num_rows for x in held) > held_rows or sum(x.nbytes for x in held) > held_bytes:
                    held = merged(held).to_batches()
                    if sum(x.num_rows for x in held) > held_rows // 2 or sum(x.nbytes for x in held) > held_bytes // 2:
                        yield from held
                        held = []
        if held:
            yield from merged(held).to_batches()
    return run


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, least_n: int = 5, edit_every: int = 0) -> DataFrame:
    """(word, n): words in Latin-1 of at least ``least`` code points and ``least_n``
    occurrences. With ``edit_every`` a run whose crc32 of ``<doc_id>:<run>`` it divides
    first loses the code point at crc32 modulo its length (misspellings on purpose)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counted(least, edit_every), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_n) & (F.col("n") > 0))


def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, side, chunk, key) of the words laid end to end: the two chunks of each, and
    the grams that a chunk of a word one longer, as long or one shorter could be, within
    one place (each distinct key once)."""
    total, start, m = sums(data), offsets[:-1], np.diff(offsets)
    found = []

    def key(size, chunk, at, q, ok):
        rows = np.flatnonzero(ok)
        gram = span_hash(total, start[rows] + at[rows], start[rows] + at[rows] + q[rows])
        return rows, mix(gram + mix(size[rows].astype(np.uint64) * U64(2) + U64(chunk)))

    for d in (-1, 0, 1):
        size = m + d
        q = size // 2
        for chunk, place in ((0, np.zeros_like(m)), (1, size - q)):
            before = []
            for shift in (0, -1, 1):
                at = place + shift
                rows, k = key(size, chunk, at, q, (size >= 2) & (at >= 0) & (at + q <= m))
                if not d and not shift:
                    found.append((rows, np.full(len(rows), CHUNK), np.full(len(rows), chunk), k))
                wide = np.zeros(len(m), dtype=U64)
                wide[rows] = k
                new = np.ones(len(rows), dtype=bool)
                for had, old in before:
                    new &= ~(had[rows] & (old[rows] == k))
                there = np.zeros(len(m), dtype=bool)
                there[rows] = True
                before.append((there, wide))
                found.append((rows[new], np.full(new.sum(), GRAM), np.full(new.sum(), chunk), k[new]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _keys(batches):
    for batch in batches:
        for a, _, data, offsets in parts(batch, "word", 1 << 20):
            row, side, chunk, key = keys_of(data, offsets)
            row = pa.array(a + row)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(side.astype(np.int8)), pa.array(chunk.astype(np.int8)), batch.column(0).take(row), batch.column(1).take(row)],
                                             ["key", "side", "chunk", "word", "n"])


def _matrix(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, width: int, back: bool) -> np.ndarray:
    """The words of ``rows`` left-aligned, or reversed, padded with zeros."""
    size = (offsets[rows + 1] - offsets[rows])[:, None]
    step = np.arange(width)[None, :]
    at = offsets[rows + 1][:, None] - 1 - step if back else offsets[rows][:, None] + step
    return np.where(step < size, data[np.clip(at, 0, max(len(data) - 1, 0))], 0)


def _prefix(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def verified(data: np.ndarray, offsets: np.ndarray, s: np.ndarray, t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which pairs (rows s, t) are near and belong to their chunk: ``first`` tells that
    they met through the first one, to which a pair belongs that both propose."""
    ls, lt = offsets[s + 1] - offsets[s], offsets[t + 1] - offsets[t]
    width = int(max(ls.max(initial=0), lt.max(initial=0))) + 1
    a, b = _matrix(data, offsets, s, width, False), _matrix(data, offsets, t, width, False)
    low, high = np.minimum(ls, lt), np.maximum(ls, lt)
    same = _prefix(a, b, low)
    tail = _prefix(_matrix(data, offsets, s, width, True), _matrix(data, offsets, t, width, True), low)
    near = (high - low <= 1) & (same + tail >= high - 1) & ~((ls == lt) & (same == ls))
    q = ls // 2
    moved = _prefix(a[:, :-1], b[:, 1:], np.minimum(ls, np.maximum(lt - 1, 0))) >= q
    return near & (((same >= q) | moved) == first)


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the letters and of the letter pairs of each word, 64 bits each; one
    edit changes at most two letters and four pairs."""
    bit = U64(1) << (data & 63).astype(U64)
    pair = U64(1) << (mix(data[:-1].astype(U64) * U64(256) + data[1:].astype(U64)) >> U64(58)) if len(data) > 1 else np.zeros(0, dtype=U64)
    inner = np.zeros(len(pair), dtype=bool)
    inner[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = True
    pair[inner] = 0
    total = [np.append(U64(0), np.bitwise_xor.accumulate(x)) if len(x) else np.zeros(1, dtype=U64) for x in (bit, pair)]
    last = len(total[1]) - 1
    return total[0][offsets[1:]] ^ total[0][offsets[:-1]], total[1][np.clip(offsets[1:], 0, last)] ^ total[1][np.clip(offsets[:-1], 0, last)]


def _meetings(group: np.ndarray, side: np.ndarray, most: int):
    """Rows (chunk word, gram word) of every pair within a group, ``most`` at a time."""
    given, other = np.flatnonzero(side == CHUNK), np.flatnonzero(side == GRAM)
    lo, hi = (np.searchsorted(group[other], group[given], way) for way in ("left", "right"))
    for s, t in range_pairs(lo, hi, most):
        yield given[s], other[t]


def _links(pairs: int, slice_bytes: int):
    """(word, near, near_n) of the near pairs of each group, in slices of bounded size."""
    def run(batches):
        for table in whole_groups(batches, "grp", 20000):
            key, side, chunk, ss, ts = (table.column(c).to_numpy() for c in ("key", "side", "chunk", "ss", "ts"))
            order = np.lexsort((side, ts, ss, chunk, key))
            table = table.take(pa.array(order)).combine_chunks()
            key, side, chunk, ss, ts = (x[order] for x in (key, side, chunk, ss, ts))
            new = (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (ss[1:] != ss[:-1]) | (ts[1:] != ts[:-1])
            column, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
            data, offsets = text_parts(column)
            letters, bigrams = _marks(data, offsets)
            size = np.diff(offsets)
            for s, t in _meetings(np.append(0, np.cumsum(new)), side, pairs):
                fit = np.flatnonzero(np.bitwise_count(letters[s] ^ letters[t]) <= 2)
                fit = fit[np.bitwise_count(bigrams[s[fit]] ^ bigrams[t[fit]]) <= 4]
                s, t = s[fit], t[fit]
                s, t = (x[np.argsort(size[s], kind="stable")] for x in (s, t))  # like widths together
                at = 0
                while at < len(s):
                    end = at + max(1, slice_bytes // (int(size[s[min(at + (1 << 16), len(s)) - 1]]) + 2))
                    end = min(end, at + (1 << 16))
                    near = at + np.flatnonzero(verified(data, offsets, s[at:end], t[at:end], chunk[s[at:end]] == 0))
                    yield pa.RecordBatch.from_arrays([column.take(pa.array(s[near])), column.take(pa.array(t[near])), pa.array(n[t[near]])], ["word", "near", "near_n"])
                    at = end
    return run


def near_words(words: DataFrame, block: int = 4096, pairs: int = 1 << 20, slice_bytes: int = 4 << 20) -> DataFrame:
    """(word, near, near_n): each word with each word one edit away, for a table (word, n)
    of distinct words in Latin-1."""
    keys = write_shared(words.select("word", "n").mapInArrow(_keys, "key long, side byte, chunk byte, word binary, n long"), "keys")
    given = F.count(F.when(F.col("side") == CHUNK, 1))
    counts = keys.groupBy("key").agg(given.alias("given"), (F.count("*") - given).alias("other")).where("given > 0 and other > 1")
    met = keys.join(counts, "key")
    # block pairs of a key: each row in a block of its own side, repeated for every block of the other
    blocks = {c: F.ceil(F.col(c) / block).cast("int") for c in ("given", "other")}
    own = {c: F.pmod(F.xxhash64("word"), blocks[c]).cast("int") for c in blocks}
    every = {c: F.sequence(F.lit(0), blocks[c] - 1) for c in blocks}
    is_given = F.col("side") == CHUNK
    met = met.withColumn("ss", F.explode(F.when(is_given, F.array(own["given"])).otherwise(every["given"])))
    met = met.withColumn("ts", F.explode(F.when(is_given, every["other"]).otherwise(F.array(own["other"]))))
    met = met.select(F.xxhash64("key", "ss", "ts").alias("grp"), "key", "side", "chunk", "ss", "ts", "word", "n")
    dealt = met.repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(_links(pairs, slice_bytes), "word binary, near binary, near_n long")


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) for (word, form) chains of at most ``hops`` steps, by doubling."""
    reach = write_shared(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, hops - 1).bit_length()):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("over"))
        reach = write_shared(reach.join(onward, "root", "left").select("word", F.coalesce("over", "root").alias("root")), "forms")
    return reach


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, least_n: int = 5, factor: int = 5, edit_every: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n per word of the corpus: ``form`` is the near
    word of largest count where that is ``factor`` times the word's own or more, ``root``
    the end of the chain of forms."""
    words = write_shared(words_of(docs, id_col, text_col, least, least_n, edit_every), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    links = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(links, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best")).alias("best"))
    told = write_shared(told.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "variants")
    # each step multiplies the count, so the largest count bounds the chain
    most = told.agg(F.max("n")).first()[0] or 1
    reach = roots(told.where("form is not null"), math.ceil(math.log(max(most, 1), factor)) + 1)

    def letters(c):
        return F.decode(c, "ISO-8859-1")

    out = told.join(reach, "word", "left")
    return out.select(letters(F.col("word")).alias("word"), letters(F.col("form")).alias("form"), letters(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
