"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

Base kinds (fixed patterns, leftmost non-overlapping per kind): ``assign``, ``access``
and ``hex``. The method adds ``novel``: a string of 12 or more token characters that
follows a sensitive word within ``reach`` characters and that zstandard can't shorten.
In runs such as ``KEY=value`` the string is what follows the '='.
The measure is marginal: compressed bytes of the surrounding text with the string, less
those of the surrounding text alone, under a dictionary of the corpus's identifiers;
it is reported from ``novelty`` of its alphabet's entropy on (``least_bytes``).

The identifier dictionary holds the words most often seen around sensitive words, counted
over all documents (whole words of two documents or more, lest it hold the secrets), up to ``dictionary_bytes`` (the bound of what is broadcast).

Places are code points, end exclusive. Null text is empty. One row per input row.

A text of any length is scanned whole (time grows with its length); spans that start at the
same place are listed in the order of the kinds; repeated rows keep a row each; an empty
table gives no rows; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, parts, spans

# Fixed values of the contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = (b"passw", b"secret", b"token", b"api_key", b"apikey", b"credential", b"private", b"auth", b"bearer", b"access", b"akia", b"key")
WORD = re.compile(r"passw(?:or)?d|secret|token|api_?key|credential|private|auth|bearer|access|key", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
PIECE = re.compile(r"[^=]+")
GLUED = re.compile(rf"(?:{WORD.pattern})[_./-]+", re.ASCII | re.IGNORECASE)
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{3,40}(?![A-Za-z0-9_])")
CLASSES = ((re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[0-9]"), 10), (re.compile(r"[+/_.=-]"), 6))
PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEX = np.zeros(256, dtype=bool)
_HEX[0x30:0x3A] = _HEX[0x61:0x67] = True


def _rows_with(raw: bytes, offsets: np.ndarray, wanted) -> np.ndarray:
    """Rows whose bytes hold one of the given strings."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    for w in wanted:
        at = raw.find(w)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(w) <= offsets[row + 1]:
                out[row] = True
                at = raw.find(w, int(offsets[row + 1]))
            else:
                at = raw.find(w, at + 1)
    return out


def _suspect(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a sensitive word, and those that hold it or a long hex run."""
    sensitive = _rows_with(LOWER[data].tobytes(), offsets, SENSITIVE)
    start, end = spans(_HEX[data], offsets)
    long = np.searchsorted(offsets, start[end - start >= 16], side="right") - 1
    some = sensitive.copy()
    some[long] = True
    return sensitive, some


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]


def least_bytes(string: str, novelty: float) -> float:
    """Marginal bytes from which a string is new: ``novelty`` of the entropy of its own
    alphabet (the classes of characters it uses) and length. A word of letters alone, or
    words joined by signs, has no such alphabet: there it is ``novelty`` bytes a character."""
    if all(PLAIN.fullmatch(w) for w in re.split(r"[+/_.=-]+", string) if w):
        return novelty * len(string)
    return novelty * len(string) * math.log2(sum(n for c, n in CLASSES if c.search(string))) / 8


def pieces(run: str):
    """Start and end of the strings between the '=' of a run of token characters; '=' at
    the end of the run belongs to the last one, as its padding."""
    body = run.rstrip("=")
    if not body:
        yield 0, len(run)
    for m in PIECE.finditer(body):
        yield m.start(), len(run) if m.end() == len(body) else m.end()


def candidates(text: str, ends: np.ndarray, reach: int):
    """Strings after a sensitive word: the pieces between '=' of a run of token
    characters ('=' at its end is padding), else what follows a sensitive word and a sign
    inside the piece."""
    for m in CANDIDATE.finditer(text):
        for x, y in pieces(m[0]):
            piece, a, b = m[0][x:y], m.start() + x, m.start() + y
            k = int(np.searchsorted(ends, a, side="right")) - 1
            glued = [g.end() for g in GLUED.finditer(piece)]
            if k >= 0 and a - ends[k] <= reach:
                lead = GLUED.match(piece)
                a += lead.end() if lead else 0
            elif glued:
                a += glued[-1]
            else:
                continue
            if b - a >= 12:
                yield a, b


def novel_spans(text: str, base: list, dictionary: bytes, packer, reach: int, around: int, novelty: float):
    """Candidates near a sensitive word, by their marginal compressed size."""
    ends = [m.end() for m in WORD.finditer(text)]
    if not ends:
        return []
    starts = sorted((x, y) for _, x, y in base)
    reached = list(itertools.accumulate((y for _, y in starts), max))  # the furthest end of the base spans so far
    out = []
    for a, b in candidates(text, np.array(ends), reach):
        k = bisect.bisect_left(starts, (b,))
        if k and reached[k - 1] > a:  # overlaps a base span
            continue
        before, after = text[max(0, a - around):a].encode(), text[b:b + around].encode()
        extra = len(packer.compress(before + text[a:b].encode() + after)) - len(packer.compress(before + after))
        if extra >= least_bytes(text[a:b], novelty):
            out.append(("novel", a, b))
    return out


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _identifiers(around: int):
    def run(batches):
        for batch in batches:
            count: dict[str, int] = {}
            for _, _, data, offsets in parts(batch, "text"):
                sensitive, _ = _suspect(data, offsets)
                for row in np.flatnonzero(sensitive).tolist():
                    text = data[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8", "replace")
                    near = set()
                    for m in WORD.finditer(text):
                        near.update(IDENTIFIER.findall(text[max(0, m.start() - around):m.end() + around]))
                    for w in near:
                        count[w] = count.get(w, 0) + 1
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["word", "c"])
    return run


def identifier_dictionary(texts: DataFrame, around: int, dictionary_bytes: int) -> bytes:
    """The most frequent identifiers around sensitive words, commonest last (zstandard
    reaches the end of a dictionary most cheaply)."""
    counts = texts.mapInArrow(_identifiers(around), "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 1")
    top = counts.orderBy(F.desc("c"), "word").limit(dictionary_bytes // 4).collect()
    out, size = [], 0
    for r in top:
        size += len(r["word"]) + 1
        if size > dictionary_bytes:
            break
        out.append(r["word"])
    return " ".join(reversed(out)).encode()


def _scan(dictionary: bytes, reach: int, around: int, novelty: float):
    def run(batches):
        primed = zstandard.ZstdCompressionDict(dictionary or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for a, b, data, offsets in parts(batch, "text"):
                n = b - a
                sensitive, some = _suspect(data, offsets)
                counts = np.zeros((3, n), dtype=np.int64)
                sha, listed = [empty] * n, [""] * n
                for row in np.flatnonzero(some).tolist():
                    text = data[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    for kind, _, _ in base:
                        counts[KINDS.index(kind), row] += 1
                    sha[row] = hashlib.sha256(joined(base).encode()).hexdigest()
                    new = novel_spans(text, base, dictionary, packer, reach, around, novelty) if sensitive[row] else []
                    listed[row] = joined(base + new)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), *(pa.array(c) for c in counts), pa.array(sha), pa.array(listed)],
                                                 ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 24, around: int = 128,
         novelty: float = 0.72, dictionary_bytes: int = 32 << 10) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = identifier_dictionary(rows.select("text"), around, dictionary_bytes)
    return rows.mapInArrow(_scan(dictionary, reach, around, novelty),
                           "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
