"""External induced suffix sorting with common-prefix values, for one shard of text.

``suffix_order`` sorts every suffix of a symbol string by induction: the suffixes at
the local minima of the string are named, the string of names is sorted by the same
function (the recursion), and one forward and one backward scan induce all other
suffixes from them. Each scan is a monotone priority queue: the tuples (symbol,
arrival, suffix, common prefix) of one symbol form an append-only run, runs are popped
in symbol order, and a popped suffix pushes its left neighbour into the run of that
neighbour's first symbol. The common prefix of two consecutive pushes to a run is one
more than the least common prefix popped between them.

The queues, the suffixes and the prefix values live in file-backed arrays once they
exceed ``memory_bytes`` (scratch files of one task attempt, removed at its end, like
Spark's own sort spills), so a shard may be far larger than memory. Pops are done in
blocks: a block ends before the first slot that one of its own pushes precedes.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class Scratch:
    """Arrays in memory up to ``memory_bytes`` each, in files of one folder beyond."""

    def __init__(self, memory_bytes: int = 64 << 20):
        self.memory_bytes = memory_bytes
        self.folder = None
        self.count = 0

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        if self.folder is not None:
            self.folder.cleanup()

    def array(self, n: int, dtype, fill) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory_bytes:
            return np.full(n, fill, dtype=dtype)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.count += 1
        out = np.memmap(os.path.join(self.folder.name, str(self.count)), dtype=dtype, mode="w+", shape=(n,))
        out[:] = fill
        return out


def _first_flags(sorted_values: np.ndarray) -> np.ndarray:
    out = np.ones(len(sorted_values), dtype=bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=out[1:])
    return out


def _names(text: np.ndarray, starts: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the substrings that run from each start to the next one (inclusive),
    their dense names, and the number of names. Tuples of packed symbols are compared
    chunk by chunk; only still equal groups go to the next chunk. A substring that
    ends sorts after one that goes on, hence the padding above every symbol."""
    n, m = len(text), len(starts)
    bits = int(symbols).bit_length()
    width = max(1, 63 // bits)
    ends = np.append(starts[1:], starts[-1])
    length = ends - starts + 1

    def chunk(of: np.ndarray, number: int) -> np.ndarray:
        key = np.zeros(len(of), dtype=np.int64)
        at, last = starts[of] + number * width, ends[of]
        for k in range(width):
            q = at + k
            key = (key << bits) | np.where(q <= last, text[np.minimum(q, n - 1)], symbols)
        return key

    key = chunk(np.arange(m), 0)
    order = np.argsort(key)
    first = _first_flags(key[order])
    number = 0
    while True:
        number += 1
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, m))
        longest = np.maximum.reduceat(length[order], begin)
        open_groups = (size > 1) & (longest > number * width)
        if not open_groups.any():
            break
        group = np.repeat(np.arange(len(begin)), size)
        slots = np.flatnonzero(open_groups[group])
        items = order[slots]
        key, of = chunk(items, number), group[slots]
        sub = np.lexsort((key, of))
        order[slots] = items[sub]
        key, of = key[sub], of[sub]
        first[slots] = _first_flags(of)
        first[slots[1:]] |= (key[1:] != key[:-1])
    dense = np.empty(m, dtype=np.int64)
    dense[order] = np.cumsum(first) - 1
    return order, dense, int(first.sum())


def _direct(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The recursion's base for short strings: order by the first 1, 2, 4, ... symbols
    until all differ or ``cap`` symbols agree; only tied groups are sorted again."""
    n = len(text)
    order = np.argsort(text)
    first = _first_flags(text[order])
    step = 1
    while step < cap:
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, n))
        if len(begin) == n:
            break
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.repeat(begin, size)
        slots = np.flatnonzero(np.repeat(size > 1, size))
        items = order[slots]
        key, of = rank[items + step], rank[items]
        both = of * n + key
        sub = np.argsort(both)
        order[slots] = items[sub]
        first[slots] = _first_flags(both[sub])
        step *= 2
    depth = np.zeros(n, dtype=np.int64)
    live = np.arange(1, n)
    while len(live):
        live = live[text[order[live] + depth[live]] == text[order[live - 1] + depth[live]]]
        depth[live] += 1
        live = live[depth[live] < cap]
    return order, depth.astype(np.uint8)


class _RangeMin:
    """Least value of any range of one block."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while step * 2 <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value at a..b, both included."""
        out = np.empty(len(a), dtype=self.levels[0].dtype)
        power = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        for p in np.flatnonzero(np.bincount(power)):
            w = np.flatnonzero(power == p)
            level = self.levels[p]
            out[w] = np.minimum(level[a[w]], level[b[w] - (1 << int(p)) + 1])
        return out


def _scan(queue, prefix, head, text, wanted, is_s, run, cap):
    """Pop ``queue`` from its first slot on; push left neighbours of the wanted type.

    queue: suffixes by slot, -1 where none is yet. prefix: common prefix with the item
    popped before. head: next free slot of each symbol's run. Both arrays are views
    (reversed for the backward scan)."""
    n = len(queue)
    started = np.zeros(len(head), dtype=bool)
    carry = np.full(len(head), 255, dtype=np.uint8)
    at, block = 0, 4096
    last = -1  # the item popped before
    while at < n:
        end = min(n, at + block)
        part = queue[at:end]
        present = np.flatnonzero(part >= 0)
        if not len(present):
            at = end
            continue
        pos = np.asarray(part[present], dtype=np.int64)
        slots = at + present
        low = np.asarray(prefix[slots])
        before = np.empty(len(pos), dtype=np.int64)
        before[0], before[1:] = last, pos[:-1]
        other = text[before] != text[pos]
        if last < 0:
            other[0] = True
        low[other] = 0
        seam = np.flatnonzero(~other & (is_s[before] != is_s[pos]))
        if len(seam):
            low[seam] = np.minimum(np.minimum(run(before[seam]), run(pos[seam])), cap)
        left = pos - 1
        give = np.flatnonzero((left >= 0) & wanted[left])
        taken = len(pos)
        if len(give):
            new = left[give]
            sym = text[new]
            by = np.argsort(sym, kind="stable")
            s = sym[by]
            first = _first_flags(s)
            begin = np.flatnonzero(first)
            size = np.diff(np.append(begin, len(s)))
            slot = np.empty(len(s), dtype=np.int64)
            slot[by] = head[s] + np.arange(len(s)) - np.repeat(begin, size)
            least = np.full(len(pos), n, dtype=np.int64)
            least[give] = slot
            np.minimum.accumulate(least, out=least)
            unsafe = slots[1:] > least[:-1]
            if unsafe.any():
                taken = int(np.argmax(unsafe)) + 1
                keep = int(np.searchsorted(give, taken))
                by = by[by < keep]
                give, new, slot, low = give[:keep], new[:keep], slot[:keep], low[:taken]
                s = sym[by]
                first = _first_flags(s)
                begin = np.flatnonzero(first)
                size = np.diff(np.append(begin, len(s)))
            at = end if least[taken - 1] >= end and taken == len(pos) else int(slots[taken - 1]) + 1
        else:
            at = end
        pre = np.minimum.accumulate(low)
        if len(give):
            t = give[by]
            value = np.empty(len(t), dtype=np.uint8)
            rest = np.flatnonzero(~first)
            if len(rest):
                value[rest] = _RangeMin(low).query(t[rest - 1] + 1, t[rest])
            group = s[begin]
            value[begin] = np.minimum(carry[group], pre[t[begin]])
            np.minimum(value + 1, cap, out=value, casting="unsafe")
            value[begin[~started[group]]] = 0
            queue[slot[by]] = new[by]
            prefix[slot[by]] = value
            head[group] += size
            started[group] = True
            np.minimum(carry, pre[-1], out=carry)
            post = np.append(np.minimum.accumulate(low[::-1])[::-1], np.uint8(255))
            carry[group] = post[t[begin + size - 1] + 1]
        else:
            np.minimum(carry, pre[-1], out=carry)
        last = int(pos[taken - 1])
        block = min(block * 2, 1 << 17) if taken == len(pos) else max(256, 2 * taken)


def suffix_order(text: np.ndarray, symbols: int, cap: int, scratch: Scratch,
                 direct: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in ascending order (those that agree in ``cap`` symbols in
    any order), and the common prefix of each with the one before, at most ``cap``
    (below 255). The last symbol of ``text`` must be 0 and occur nowhere else; all
    symbols are below ``symbols``. A string of names of at most ``direct`` symbols ends
    the recursion."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint8)
    kind = np.int32 if n < 2**31 else np.int64
    change = np.flatnonzero(text[1:] != text[:-1]).astype(kind)  # last position of each run of one symbol
    rising = text[change] < text[change + 1]
    is_s = np.empty(n, dtype=bool)
    is_s[:-1] = np.repeat(rising, np.diff(change, prepend=kind(-1)))
    is_s[-1] = True

    def run(p):
        """Length of the run of one symbol from p on."""
        k = np.searchsorted(change, p.astype(kind))
        return np.where(k < len(change), change[np.minimum(k, len(change) - 1)], n - 1) - p + 1

    minima = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int64)
    order, dense, names = _names(text, minima, symbols)
    m = len(minima)
    if names < m:
        order, same = _direct(dense, cap) if m <= direct else suffix_order(dense, names, cap, scratch, direct)
    else:
        same = np.zeros(m, dtype=np.uint8)
    low = np.zeros(m, dtype=np.uint8)  # of each minimum with the one before
    if m > 1:
        a, b, skip = order[:-1], order[1:], same[1:].astype(np.int64)
        depth = np.minimum(minima[a + skip] - minima[a], cap)
        left, right = minima[a], minima[b]
        live = np.flatnonzero(depth < cap)
        while len(live):
            live = live[text[left[live] + depth[live]] == text[right[live] + depth[live]]]
            depth[live] += 1
            live = live[depth[live] < cap]
        low[1:] = depth

    count = np.bincount(text, minlength=symbols).astype(np.int64)
    stop = np.cumsum(count)
    start = stop - count
    queue = scratch.array(n, kind, -1)
    prefix = scratch.array(n, np.uint8, 0)
    placed = minima[order]
    sym = text[placed]
    own = np.bincount(sym, minlength=symbols).astype(np.int64)
    slot = stop[sym] - (np.cumsum(own)[sym] - np.arange(m))
    queue[slot] = placed
    prefix[slot] = low

    head = start.copy()
    _scan(queue, prefix, head, text, ~is_s, is_s, run, cap)
    # Backward: L suffixes stay, S suffixes are induced anew. The prefix value of an
    # item is now the one with its larger neighbour.
    larger = scratch.array(n, np.uint8, 0)
    larger[:-1] = prefix[1:]
    gone = np.repeat(head, stop - head) + (np.arange(int((stop - head).sum())) - np.repeat(np.cumsum(stop - head) - (stop - head), stop - head))
    queue[gone] = -1
    queue[0] = n - 1
    back = n - stop
    back[0] = 1
    _scan(queue[::-1], larger[::-1], back, text, is_s, is_s, run, cap)
    out = prefix
    found = np.flatnonzero(is_s[queue])
    found = found[found > 0]
    out[found] = larger[found - 1]
    here, prior = queue[found], queue[found - 1]
    seam = ~is_s[prior] & (text[prior] == text[here])
    out[found[seam]] = np.minimum(np.minimum(run(prior[seam]), run(here[seam])), cap)
    out[start[(count > 0) & (start < n)]] = 0
    return queue, out
