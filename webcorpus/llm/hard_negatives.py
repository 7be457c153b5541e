"""Hard-negative mining over an inverted multi-index.

Vectors become integers, floor(scale * x); a score is the integer inner product. Each half
of the vector space has a codebook (k-means on a documented, bounded sample); a pair of
entries, one of each half, is a cell. Every row is put into its cell, and of every entry
the largest distance of a row to it (its radius) is kept, so the summed half scores
``q1.c1 + |q1| r1 + q2.c2 + |q2| r2`` bound the score of all rows of a cell. For each
anchor a multi-sequence heap visits the cells from the highest bound down:

1. probe: until ``probe`` rows are in the visited cells; the k-th best score of a window
   among them is a floor that the answer cannot fall below;
2. certified scan: on until no cell left can reach the floor of any window (cells that lie
   wholly above every window are passed over). Its best rows are the answer.

This runs once for the positives (window: everything) and once for the negatives (the
windows that the positives' scores give). Visits of neighbouring anchors are pooled in
blocks, cells in slices of bounded size (a large cell is cut by a hash of its rows); a
block meets the slices it visits in an equi-join and scores them as matrix products. The
answer is exact whatever the codebooks; they only decide how many cells can be passed
over. Codebooks have at most ``most_codes`` entries, so the tables of cells, which are
collected and broadcast, have at most ``most_codes`` squared rows.

Defined results: rows with a null label, a null vector, or a null or non-finite component
take no part; a null id is a row that is no anchor by the usual condition and sorts last
among ties; shorter vectors are padded with zeros (an empty one scores 0); integers beyond
+-2^24 are set to that bound, so sums of up to 2^15 components stay exact; equal scores go
by the smaller id, then by the row; rows that repeat an id are rows of their own, and
"other" rows means other than the anchor's own row; an anchor without positives, or a
window without rows, gives no rows; an empty table gives no rows; only the three named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_parts, whole_groups, write_shared

ROW = "id long, label long, anchor boolean, cell int, d1 double, d2 double, q binary"
FAR = 1 << 62
BOUND = 1 << 24


class Index:
    """Codebooks of both halves with their radii, and the number of rows of each cell."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.width = sample.shape[1]
        self.half = self.width // 2
        self.books = [_means(x, codes) for x in self.halves(sample)]
        self.radius = [np.zeros(len(b)) for b in self.books]
        self.count = np.zeros([len(b) for b in self.books], dtype=np.int64)

    def halves(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, :self.half], q[:, self.half:]]

    def place(self, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of each row, and its distance to the entry of each half."""
        codes, far = [], []
        for x, book in zip(self.halves(q), self.books):
            code = np.argmin((book * book).sum(axis=1)[None] - 2 * (x @ book.T), axis=1)
            codes.append(code)
            far.append(np.sqrt(((x - book[code]) ** 2).sum(axis=1)))
        return codes[0] * len(self.books[1]) + codes[1], far

    def half_bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and largest score that each entry's rows can add, per half."""
        low, high = [], []
        for x, book, r in zip(self.halves(q[None]), self.books, self.radius):
            mid, wide = book @ x[0], np.sqrt((x[0] ** 2).sum()) * r
            slack = 1e-9 * (np.abs(mid) + wide) + 1e-6
            low.append(mid - wide - slack)
            high.append(mid + wide + slack)
        return low, high

    def visit(self, q: np.ndarray, windows: list[tuple[int, int]], probe: int | None) -> list[int]:
        """Cells that may hold rows of the windows (floor, ceiling), by descending bound;
        with ``probe`` only until they hold that many rows."""
        windows = [w for w in windows if w[0] <= w[1]]
        if not windows:
            return []
        floor, top = min(w[0] for w in windows), max(w[1] for w in windows)
        low, high = self.half_bounds(q)
        found, rows = [], 0
        for bound, i, j in multi_sequence(*high):
            if bound < floor or (probe is not None and rows >= probe):
                break
            least = low[0][i] + low[1][j]
            if self.count[i, j] and least <= top and any(bound >= a and least <= b for a, b in windows):
                found.append(i * len(high[1]) + j)
                rows += int(self.count[i, j])
        return found


def multi_sequence(u: np.ndarray, v: np.ndarray):
    """(u[i] + v[j], i, j) of all pairs in descending order of the sum."""
    a, b = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    x, y = u[a].tolist(), v[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each vector, padded with zeros."""
    out = np.zeros((len(column), width))
    size = np.array([len(v) for v in column.to_pylist()]) if len(column) else np.zeros(0, dtype=int)
    if width and len(size) and size.any():
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return np.clip(np.floor(out * scale), -BOUND, BOUND)


def _means(x: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Codebook of the sample ``x`` (Lloyd's rounds from sampled rows)."""
    start = np.unique(x, axis=0)
    if not len(start):
        return np.zeros((1, x.shape[1]))
    book = start[np.random.default_rng(12).permutation(len(start))[:codes]].astype(np.float64)
    for _ in range(rounds):
        code = np.argmin((book * book).sum(axis=1)[None] - 2 * (x @ book.T), axis=1)
        size = np.bincount(code, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, code, x)
        book = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], book)
    return book


def _placed(index: Index, scale: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                q = _integers(some.column(3), index.width, scale)
                cell, far = index.place(q)
                data = q.astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(cell.astype(np.int32)), pa.array(far[0]), pa.array(far[1]),
                                                  pa.array([r.tobytes() for r in data], pa.binary())], ["id", "label", "anchor", "cell", "d1", "d2", "q"])
    return run


def dealt(counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(cell, first group, groups): neighbouring cells share a group of about ``most``
    rows, a cell of more has groups of its own."""
    out, group, held = [], 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if held and held + n > most:
            group, held = group + 1, 0
        groups = max(1, math.ceil(n / most))
        out.append((cell, group, groups))
        if groups > 1:
            group, held = group + groups, 0
        else:
            held += n
    return out


def _in_group(first: str, groups: str) -> Column:
    return (F.col(first) + F.pmod(F.xxhash64("row"), F.col(groups))).cast("long")


def _visits(index: Index, probe: int | None):
    """(block, cell) that the anchors of each batch visit."""
    def run(batches):
        for batch in batches:
            block, floor, top = (batch.column(k).to_pylist() for k in (0, 2, 3))
            q = text_parts(batch.column(1))[0].view(np.int32).reshape(-1, index.width) if index.width else np.zeros((len(block), 0))
            found = {(b, c) for b, x, lo, hi in zip(block, q, floor, top) for c in index.visit(x.astype(np.float64), list(zip(lo, hi)), probe)}
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int32())], ["block", "cell"])
    return run


def _first(who: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The k best of each ``who``: score down, then id and row up."""
    order = np.lexsort((row, ident, -score, who))
    starts = np.flatnonzero(np.append(True, who[order][1:] != who[order][:-1])) if len(order) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def _best(a, x, exact, a_label, a_row, floor, top, label, ident, row, same: bool, k: int, rows_at: int):
    """(anchor, window, score, id, row) of the k best rows ``x`` for each window of the
    anchors ``a``, in slices of ``rows_at`` rows."""
    windows = floor.shape[1]
    kept = [[np.zeros(0, dtype=np.int64) for _ in range(4)] for _ in range(windows)]
    for at in range(0, len(x), rows_at):
        part = slice(at, at + rows_at)
        score = a @ x[part].T if exact else (a.astype(np.int64) @ x[part].astype(np.int64).T)
        fit = (a_label[:, None] == label[part][None]) == same
        fit &= a_row[:, None] != row[part][None]
        for w in range(windows):
            mine = fit & (score >= floor[:, w, None]) & (score <= top[:, w, None])
            crowded = np.flatnonzero(mine.sum(axis=1) > k)
            if len(crowded):  # what is below the k-th of this slice cannot be among the k best
                value = np.where(mine[crowded], score[crowded], -FAR)
                kth = np.partition(value, value.shape[1] - k, axis=1)[:, value.shape[1] - k]
                mine[crowded] &= score[crowded] >= kth[:, None]
            who, col = np.nonzero(mine)
            have = [np.append(old, new) for old, new in zip(kept[w], (who, score[who, col].astype(np.int64), ident[part][col], row[part][col]))]
            first = _first(*have, k)
            kept[w] = have = [c[first] for c in have]
            size = np.bincount(have[0], minlength=len(a))
            full = np.flatnonzero(size == k)
            if len(full):  # rows come sorted by anchor, best first
                floor[full, w] = np.maximum(floor[full, w], have[1][np.cumsum(size)[full] - 1])
    return kept


def _scored(width: int, same: bool, k: int, anchors_at: int, rows_at: int):
    def run(batches):
        for table in whole_groups(batches, "g"):
            block, piece, kind, row = (table.column(c).to_numpy() for c in ("block", "piece", "kind", "row"))
            g = table.column("g").to_numpy()
            edge = np.append(np.append(0, np.flatnonzero((g[1:] != g[:-1]) | (block[1:] != block[:-1]) | (piece[1:] != piece[:-1])) + 1), len(g))
            data = text_parts(table.column("q").combine_chunks())[0]
            q = data.view(np.int32).reshape(-1, width).astype(np.float64) if width else np.zeros((len(g), 0))
            label = table.column("label").to_numpy()
            ident = table.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
            names, windows = table.column("id"), [table.column(c) for c in ("floor", "top")]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                asked, there = lo + np.flatnonzero(kind[lo:hi] == 0), lo + np.flatnonzero(kind[lo:hi] == 1)
                if not len(asked) or not len(there):
                    continue
                exact = np.abs(q[lo:hi]).max(initial=0) ** 2 * max(width, 1) < 2**52
                for at in range(0, len(asked), anchors_at):
                    some = asked[at:at + anchors_at]
                    floor, top = (np.array(c.take(pa.array(some)).to_pylist(), dtype=np.int64) for c in windows)
                    for w, (who, score, _, r) in enumerate(_best(q[some], q[there], exact, label[some], row[some], floor, top, label[there], ident[there], row[there], same, k, rows_at)):
                        back = there[np.argsort(row[there], kind="stable")]
                        place = back[np.searchsorted(row[back], r)]
                        yield pa.RecordBatch.from_arrays([pa.array(row[some][who]), pa.array(np.full(len(who), w, dtype=np.int32)), pa.array(score), names.take(pa.array(place)).combine_chunks(), pa.array(r)],
                                                         ["anchor_row", "w", "score", "id", "row"])
    return run


class _Search:
    def __init__(self, rows: DataFrame, index: Index, cells: DataFrame, anchors_at: int, rows_at: int):
        self.rows, self.index, self.cells, self.anchors_at, self.rows_at = rows, index, cells, anchors_at, rows_at

    def scan(self, asked: DataFrame, k: int, same: bool, probe: int | None) -> DataFrame:
        """The k best rows (anchor_row, w, score, id, row, place) of each window of
        ``asked`` (block, row, id, label, q, floor, top) in the visited cells."""
        visits = write_shared(asked.select("block", "q", "floor", "top").mapInArrow(_visits(self.index, probe), "block long, cell int").distinct(), "visits")
        cells = F.broadcast(self.cells)  # at most most_codes squared rows
        piece = _in_group("first_piece", "pieces").alias("piece")
        rows = self.rows.join(cells, "cell").select("cell", piece, "row", "id", "label", "q").join(visits, "cell")
        none = F.lit(None).cast("array<long>")
        rows = rows.select("block", "piece", F.lit(1).alias("kind"), "row", "id", "label", "q", none.alias("floor"), none.alias("top"))
        pieces = visits.join(cells, "cell").select("block", F.explode(F.sequence(F.col("first_piece"), F.col("first_piece") + F.col("pieces") - 1)).alias("piece")).distinct()
        asked = asked.join(pieces, "block").select("block", F.col("piece").cast("long").alias("piece"), F.lit(0).alias("kind"), "row", "id", "label", "q", "floor", "top")
        met = rows.unionByName(asked).withColumn("g", F.xxhash64("block", "piece"))
        met = met.repartition("g").sortWithinPartitions("g", "block", "piece", "kind", "row")
        found = met.mapInArrow(_scored(self.index.width, same, k, self.anchors_at, self.rows_at), "anchor_row long, w int, score long, id long, row long")
        place = F.row_number().over(Window.partitionBy("anchor_row", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
        return found.withColumn("place", place).where(F.col("place") <= k)

    def best(self, asked: DataFrame, k: int, same: bool, probe: int) -> DataFrame:
        """Probe, raise the floors, scan on to the certificate."""
        seen = self.scan(asked, k, same, probe)
        seen = seen.where(F.col("place") == k).groupBy("anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))  # an entry per window
        raised = F.transform("floor", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("kth", w.cast("int")), low)))
        asked = asked.join(seen.withColumnRenamed("anchor_row", "row"), "row", "left").withColumn("floor", F.when(F.col("kth").isNull(), F.col("floor")).otherwise(raised)).drop("kth")
        return self.scan(write_shared(asked, "asked"), k, same, None)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256,
         positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), sample: int = 20_000,
         cell_rows: int = 512, most_codes: int = 256, probe: int = 2048, anchor_block: int = 1024, piece_rows: int = 32_768, anchors_at: int = 512, rows_at: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    anchor (rows where ``anchor`` holds) and each of its ``positives`` best rows of the
    same label, the ``negatives`` best rows of other labels whose score is at least
    low[0]/low[1] and at most high[0]/high[1] of the positive's."""
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.alias("v"))
    count, width = given.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    every = max(1, count // sample)
    part = given.where(F.pmod(F.xxhash64("id", "v"), F.lit(every)) == 0).select("v").limit(sample).toArrow().column("v").combine_chunks()  # bounded; decides costs, not results
    codes = min(most_codes, max(2, math.ceil(math.sqrt(count / cell_rows))))
    index = Index(_integers(part, width, scale), codes)
    rows = write_shared(given.mapInArrow(_placed(index, scale), ROW).withColumn("row", F.monotonically_increasing_id()), "rows")
    stats = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2"), F.count(F.when(F.col("anchor"), 1)).alias("a")).collect()  # most_codes squared
    wide = len(index.books[1])
    for r in stats:
        i, j = divmod(r["cell"], wide)
        index.count[i, j] = r["n"]
        index.radius[0][i], index.radius[1][j] = max(index.radius[0][i], r["d1"]), max(index.radius[1][j], r["d2"])
    pieces = {c: (first, n) for c, first, n in dealt({r["cell"]: r["n"] for r in stats}, piece_rows)}
    blocks = {c: (first, n) for c, first, n in dealt({r["cell"]: r["a"] for r in stats if r["a"]}, anchor_block)}
    cells = spark.createDataFrame([(c, *pieces[c], *blocks.get(c, (0, 1))) for c in sorted(pieces)], "cell int, first_piece int, pieces int, first_block int, blocks int")
    search = _Search(rows, index, cells, anchors_at, rows_at)

    def asked(frame, floor, top):
        return frame.join(F.broadcast(cells), "cell").select(_in_group("first_block", "blocks").alias("block"), "row", "id", "label", "q", floor.alias("floor"), top.alias("top"))

    anchors = rows.where("anchor")
    whole = write_shared(asked(anchors, F.array(F.lit(-FAR)), F.array(F.lit(FAR))), "asked")
    positive = write_shared(search.best(whole, positives, True, probe).select("anchor_row", F.col("place").cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # integers n with low * p <= n <= high * p
    least = F.ceil(F.lit(low[0]) * F.col("positive_score").cast("decimal(38,0)") / low[1]).cast("long")
    most = F.floor(F.lit(high[0]) * F.col("positive_score").cast("decimal(38,0)") / high[1]).cast("long")
    windows = positive.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("p", least.alias("floor"), most.alias("top")))).alias("windows"))  # one per positive
    named = anchors.join(windows.withColumnRenamed("anchor_row", "row"), "row")
    windowed = write_shared(asked(named, F.col("windows.floor"), F.col("windows.top")), "asked")
    negative = search.best(windowed, negatives, False, probe)
    out = negative.join(positive.withColumn("w", (F.col("p") - 1).cast("int")), ["anchor_row", "w"]).join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
