"""The element interval index of a page: for every element its start tag and the
positions where it opens, where its content begins and ends and where it is over, with
its depth and its parent.

One pass over the tags of a page keeps the stack of open elements, which regular
expressions cannot; that pass is a small Arrow function. Everything that reads the index
is a native column expression: an element matches a rule by name, class and attributes, an
element is inside another when its interval is, and its content is a ``substring``.

Tree rules (the HTML standard's, for what result pages and articles contain): void
elements have no content; the content of script, style, textarea and title is text; a
paragraph ends at a block start tag; list items, table parts, definition terms and options
end at the next of their kind within their list or table; an end tag closes the nearest
open element of its name and all inside it, but never reaches out of a table; other end
tags are ignored; the end of the page closes everything. Elements nested more than
``MOST_DEPTH`` deep are kept as if they were empty (browsers flatten there as well).
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_python_code

ship_python_code()

# --- fixed values -----------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title".split())
ENDS_PARAGRAPH = frozenset((
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul").split())
#: start tag -> (the open elements it ends, the elements beyond which it does not look)
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "table"])),
}
PARAGRAPH_SCOPE = frozenset("table td th caption button object".split())
MOST_DEPTH = 512
# ---------------------------------------------------------------------------------

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>""", re.S)
CLASS = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

TEXTS, PLACES = ("name", "tag", "cls"), ("open", "inner", "close", "end", "depth", "parent", "seq", "size")
INDEX_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in TEXTS] + [T.StructField(n, T.IntegerType()) for n in PLACES]))


def intervals(html: str) -> list[list]:
    """[name, start tag, classes, open, inner, close, end, depth, parent, seq, size] per
    element in page order; positions count characters, parent is an entry number or -1,
    seq the element's own one, and its descendants are the ``size`` entries after it."""
    found: list[list] = []
    stack: list[int] = []
    count: Counter[str] = Counter()  # open elements by name

    def shut(depth: int, close: int, end: int) -> None:
        """Close the open elements above ``depth``; the one there ends at ``end``."""
        for k in stack[depth:]:
            found[k][5] = found[k][6] = close
            found[k][10] = len(found) - 1 - k
            count[found[k][0]] -= 1
        found[stack[depth]][6] = end
        del stack[depth:]

    def nearest(names, beyond) -> int:
        for depth in range(len(stack) - 1 if any(count[n] > 0 for n in names) else -1, -1, -1):
            name = found[stack[depth]][0]
            if name in names:
                return depth
            if name in beyond:
                return -1
        return -1

    at = 0
    while (token := TOKEN.search(html, at)) is not None:
        at = token.end()
        if token[2] is None:
            continue
        name, start = token[2].lower(), token.start()
        if token[1]:
            if count[name] and (depth := nearest((name,), () if name == "table" else ("table",))) >= 0:
                shut(depth, start, at)
            continue
        if count["p"] and name in ENDS_PARAGRAPH and (depth := nearest(("p",), PARAGRAPH_SCOPE)) >= 0:
            shut(depth, start, start)
        if name in ENDS:
            while (depth := nearest(*ENDS[name])) >= 0:  # a cell, then its row, then its section
                shut(depth, start, start)
        given = CLASS.search(token[3]) if token[3] else None
        classes = f" {' '.join((given[1] or given[2] or given[3] or '').split())} " if given else ""
        entry = [name, token[0], classes, start, at, at, at, len(stack), stack[-1] if stack else -1, len(found), 0]
        found.append(entry)
        if name in VOID or token[3].endswith("/") and ":" in name:
            continue
        if name in RAW_TEXT:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            entry[5], entry[6] = (end.start(), end.end()) if end else (len(html), len(html))
            at = entry[6]
        elif len(stack) < MOST_DEPTH:
            stack.append(len(found) - 1)
            count[name] += 1
    if stack:
        shut(0, len(html), len(html))
    return found


# Stretches that leave the tree as one element of their kind does: elements of one name without attributes that hold
# text alone, one after another; tables without attributes that hold no table, text-only element or stray sign.
_PLAIN_TABLE = r"<table>(?:[^<]++|</?(?!(?:table|script|style|textarea|title)>)[a-z][a-z0-9]*+>)*+</table>"
RUN = re.compile(rf"(?:{_PLAIN_TABLE}[^<]*+)++|<(?!(?:table|script|style|textarea|title|{'|'.join(sorted(VOID))})>)([a-z][a-z0-9]*+)>[^<]*+</\1>(?:[^<]*+<\1>[^<]*+</\1>)*+")


def attributed_intervals(html: str) -> list[list]:
    """The entries of ``intervals`` for the elements whose start tag has attributes; parent and
    seq count these alone, and parent is the nearest of them. Without attributes an element is
    no item and no property, so it is only kept while it is open; a run of plain elements or
    plain tables is one step (below the greatest depth, where elements are no longer opened)."""
    found: list[list] = []
    stack: list[tuple] = []  # (name, entry or None, number of the nearest entry)
    count: Counter[str] = Counter()

    def shut(depth: int, close: int, end: int) -> None:
        for name, entry, _ in stack[depth:]:
            count[name] -= 1
            if entry is not None:
                entry[5] = entry[6] = close
                entry[10] = len(found) - 1 - entry[9]
        if stack[depth][1] is not None:
            stack[depth][1][6] = end
        del stack[depth:]

    def nearest(names, beyond) -> int:
        for depth in range(len(stack) - 1, -1, -1):
            name = stack[depth][0]
            if name in names:
                return depth
            if name in beyond:
                return -1
        return -1

    def starts(name: str, start: int) -> None:
        if count["p"] and name in ENDS_PARAGRAPH and (depth := nearest(("p",), PARAGRAPH_SCOPE)) >= 0:
            shut(depth, start, start)
        if name in ENDS:
            while any(count[n] for n in ENDS[name][0]) and (depth := nearest(*ENDS[name])) >= 0:
                shut(depth, start, start)

    at = 0
    while (token := TOKEN.search(html, at)) is not None:
        at, whole, end_tag, name, rest = token.end(), *token.group(0, 1, 2, 3)
        if name is None:
            continue
        start = token.start()
        if not end_tag and not rest and len(stack) < MOST_DEPTH and (run := RUN.match(html, start)):
            starts(run[1] or "table", start)
            # what a run closes is closed by its first element; it leaves nothing open
            at = run.end()
            continue
        name = name.lower()
        if end_tag:
            if count[name] and (depth := nearest((name,), () if name == "table" else ("table",))) >= 0:
                shut(depth, start, at)
            continue
        starts(name, start)
        above = stack[-1][2] if stack else -1
        entry = None
        if rest:
            given = CLASS.search(rest)
            classes = f" {' '.join((given[1] or given[2] or given[3] or '').split())} " if given else ""
            entry = [name, whole, classes, start, at, at, at, len(stack), above, len(found), 0]
            found.append(entry)
        if name in VOID or rest.endswith("/") and ":" in name:
            continue
        if name in RAW_TEXT:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            close, at = (end.start(), end.end()) if end else (len(html), len(html))
            if entry is not None:
                entry[5], entry[6] = close, at
        elif len(stack) < MOST_DEPTH:
            stack.append((name, entry, above if entry is None else entry[9]))
            count[name] += 1
    if stack:
        shut(0, len(html), len(html))
    return found


class _Elements:
    """Arrow columns of the elements of a batch of pages, appended page by page: the
    entries of one page at a time are Python objects, whatever the batch holds."""

    def __init__(self, texts, places):
        self.texts, self.places = texts, places
        self.offsets = array("i", [0])
        self.bytes = {n: bytearray() for n in texts}
        self.ends = {n: array("i", [0]) for n in texts}
        self.none = {n: array("b") for n in texts}
        self.numbers = {n: array("i") for n in places}
        self.size = 0

    def page(self, entries: list[list]) -> None:
        """Entries as ``texts`` then ``places``."""
        columns = list(zip(*entries)) or [()] * (len(self.texts) + len(self.places))
        for n, values in zip(self.texts, columns):
            held, ends = self.bytes[n], self.ends[n]
            for v in values:
                if v is not None:
                    held += v.encode()
                ends.append(len(held))
                self.none[n].append(v is None)
        for n, values in zip(self.places, columns[len(self.texts):]):
            self.numbers[n].extend(values)
        self.size += len(entries)
        self.offsets.append(self.size)

    def arrow(self) -> pa.Array:
        def strings(n):
            present = np.packbits(np.frombuffer(self.none[n], np.int8) == 0, bitorder="little") if self.size else np.zeros(0, np.uint8)
            return pa.Array.from_buffers(pa.string(), self.size, [pa.py_buffer(present), pa.py_buffer(self.ends[n]), pa.py_buffer(self.bytes[n])])
        fields = [pa.field(n, pa.string()) for n in self.texts] + [pa.field(n, pa.int32()) for n in self.places]
        columns = [strings(n) for n in self.texts] + [pa.Array.from_buffers(pa.int32(), self.size, [None, pa.py_buffer(self.numbers[n])]) for n in self.places]
        elements = pa.StructArray.from_arrays(columns, fields=fields)
        return pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(self.offsets), [None, pa.py_buffer(self.offsets)]), elements)


@F.arrow_udf(INDEX_TYPE)
def _index(html: pa.Array) -> pa.Array:
    out = _Elements(TEXTS, PLACES)
    for x in html:
        page = x.as_py()
        out.page(intervals(page) if page else [])
    return out.arrow()


TABLE_PARTS = frozenset("table thead tbody tr td th".split())
# As RUN, without table parts; and rows of cells without attributes that hold text alone, one after another.
OUTSIDE_RUN = re.compile(rf"<(?!(?:table|thead|tbody|tfoot|tr|td|th|script|style|textarea|title|{'|'.join(sorted(VOID))})>)([a-z][a-z0-9]*+)>[^<]*+</\1>(?:[^<]*+<\1>[^<]*+</\1>)*+")
ROW_RUN = re.compile(r"<tr>[^<]*+(?:(?:<td>[^<]*+</td>|<th>[^<]*+</th>)[^<]*+)*+</tr>(?:[^<]*+<tr>[^<]*+(?:(?:<td>[^<]*+</td>|<th>[^<]*+</th>)[^<]*+)*+</tr>)*+")
ROW_PART = re.compile(r"<(t[rdh])>([^<]*)")
ROW_END, CELL_END = "\u0001", "\u0002"
TABLE_TYPE = T.ArrayType(T.StructType([T.StructField("headers", T.StringType()), T.StructField("rows", T.StringType()),
                                       T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))]))


def table_parts(html: str) -> list[list]:
    """[name, content of a cell (else None), seq, size] per table element in page order;
    seq and size count table elements alone. The tree is that of ``intervals``; elements of other
    names are only kept while they are open, and a run of plain elements or of plain rows is one
    step (below the greatest depth, where elements are no longer opened)."""
    found: list[list] = []
    stack: list[tuple] = []  # (name, entry or None, where its content begins)
    count: Counter[str] = Counter()

    def shut(depth: int, close: int) -> None:
        for name, entry, inner in stack[depth:]:
            count[name] -= 1
            if entry is not None:
                entry[3] = len(found) - 1 - entry[2]
                if name in ("td", "th"):
                    entry[1] = html[inner:close]
        del stack[depth:]

    def nearest(names, beyond) -> int:
        for depth in range(len(stack) - 1, -1, -1):
            name = stack[depth][0]
            if name in names:
                return depth
            if name in beyond:
                return -1
        return -1

    def starts(name: str, start: int) -> None:
        if count["p"] and name in ENDS_PARAGRAPH and (depth := nearest(("p",), PARAGRAPH_SCOPE)) >= 0:
            shut(depth, start)
        if name in ENDS:
            while any(count[n] for n in ENDS[name][0]) and (depth := nearest(*ENDS[name])) >= 0:
                shut(depth, start)

    at = 0
    while (token := TOKEN.search(html, at)) is not None:
        at, end_tag, name, rest = token.end(), *token.group(1, 2, 3)
        if name is None:
            continue
        start = token.start()
        if not end_tag and not rest and len(stack) < MOST_DEPTH - 1:
            if (run := OUTSIDE_RUN.match(html, start)):
                starts(run[1], start)
                at = run.end()
                continue
            if name == "tr" and (run := ROW_RUN.match(html, start)):
                starts("tr", start)
                for part, text in ROW_PART.findall(html, start, run.end()):
                    if part == "tr":
                        row = ["tr", None, len(found), 0]
                        found.append(row)
                    else:
                        row[3] += 1
                        found.append([part, text, len(found), 0])
                at = run.end()
                continue
        name = name.lower()
        if end_tag:
            if count[name] and (depth := nearest((name,), () if name == "table" else ("table",))) >= 0:
                shut(depth, start)
            continue
        starts(name, start)
        entry = None
        if name in TABLE_PARTS:
            entry = [name, "" if name in ("td", "th") else None, len(found), 0]
            found.append(entry)
        if name in VOID or rest.endswith("/") and ":" in name:
            continue
        if name in RAW_TEXT:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif len(stack) < MOST_DEPTH:
            stack.append((name, entry, at))
            count[name] += 1
    if stack:
        shut(0, len(html))
    return found


def table_cells(parts: list[list]) -> list[list[list[str]]]:
    """[headers, row, row, ...] per table with rows, of the contents of the cells: headers from the
    first thead, rows from the first tbody or the table."""
    out = []
    for name, _, seq, size in parts:
        if name != "table":
            continue
        inside = parts[seq + 1:seq + 1 + size]
        scope = next((x for x in inside if x[0] == "tbody"), None)
        below = inside if scope is None else parts[scope[2] + 1:scope[2] + 1 + scope[3]]
        rows = [[x[1] for x in parts[k + 1:k + 1 + n] if x[1] is not None] for kind, _, k, n in below if kind == "tr"]
        rows = [row for row in rows if row]
        if rows:
            head = next((x for x in inside if x[0] == "thead"), None)
            out.append([[x[1] for x in parts[head[2] + 1:head[2] + 1 + head[3]] if x[0] == "th"] if head else [], *rows])
    return out


@F.arrow_udf(TABLE_TYPE)
def _table_index(html: pa.Array) -> pa.Array:
    out = []
    for x in html:
        page = x.as_py()
        tables = table_cells(table_parts(page)) if page and "<table" in page.lower() else []
        # a page that holds the signs between cells, or can decode to them, gives its cells one by one
        if tables and (ROW_END in page or CELL_END in page or "&#" in page):
            out.append([{"cells": table} for table in tables])
        else:
            out.append([{"headers": CELL_END.join(head) if head else None, "rows": ROW_END.join([CELL_END.join(row) for row in rows])} for head, *rows in tables])
    return pa.array(out, INDEX_OF_TABLES)


INDEX_OF_TABLES = pa.list_(pa.struct([("headers", pa.string()), ("rows", pa.string()), ("cells", pa.list_(pa.list_(pa.string())))]))


def table_index(html: Column) -> Column:
    """The tables with rows of a page in page order, with the contents of their cells: ``headers`` (null when there
    are none) parted by ``CELL_END``, ``rows`` parted by ``ROW_END`` and ``CELL_END``; or, where a page holds these
    signs, ``cells``, the headers and the rows. A null page has none."""
    return _table_index(html)


def element_index(html: Column) -> Column:
    """The elements of a page in page order; a null page has none. Use it as a column of
    its own (``withColumn``), then read fields from it."""
    return _index(html)


# ---------------------------------------------------------------- reading the index

def inner_html(html: Column, e: Column) -> Column:
    """Content of element ``e`` up to its own end tag."""
    return F.substring(html, e["inner"] + 1, e["close"] - e["inner"])


def descendants(index: Column, e: Column) -> Column:
    """The elements inside ``e``, a slice of the index."""
    return F.slice(index, e["seq"] + 2, e["size"])


def within(e: Column, outer: Column) -> Column:
    """Is ``e`` a descendant of ``outer``?"""
    return (e["open"] >= outer["inner"]) & (e["end"] <= outer["close"])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


FOLD_BLOCK = 64


def fold(values: Column, start: Column, step, emit, emitted: str) -> Column:
    """The non-null ``emit(state, value)`` of every value, an array of type ``emitted``, where
    the state is ``start`` and then ``step(state, value)``. ``start`` has to be small: Spark
    copies what a fold holds at every step, so what was emitted is held for one block of
    values at a time, and joined once per block."""
    none = F.array().cast(f"array<{emitted}>")

    def one(acc, value):
        said = F.array_compact(F.array(emit(acc["state"], value).cast(emitted)))
        return F.struct(step(acc["state"], value).alias("state"), F.concat(acc["out"], said).alias("out"))

    def block(vs):
        def run(acc, k):
            done = F.aggregate(F.slice(vs, k * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return let(done, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], x["out"]).alias("out")))

        blocks = F.when(F.size(vs) > 0, F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / FOLD_BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(blocks, F.struct(start.alias("state"), none.alias("out")), run)["out"]

    return let(values, block)


def first(elements: Column, outer: Column | None = None) -> Column:
    """The first of the elements (inside ``outer``), null when there is none."""
    return F.try_element_at(elements if outer is None else F.filter(elements, lambda e: within(e, outer)), F.lit(1))


def _test(e: Column, test: str) -> Column:
    """One condition of a rule: ``token`` or ``a|b`` (class), ``#id``, ``[attr]``,
    ``[attr=v]``, ``[attr*=v]``, ``[attr^=v]`` (values as written, entities not decoded);
    ``!`` before it negates."""
    if test.startswith("!"):
        return ~_test(e, test[1:])
    if test.startswith("#"):
        test = f"[id={test[1:]}]"
    if test.startswith("["):
        name, how, want = re.fullmatch(r"\[([A-Za-z-]+)(?:([*^]?=)(.*))?\]", test).groups()
        if how is None:
            return e["tag"].rlike(rf"(?i)\s{name}(?:\s*=|[\s>/])")
        want = re.escape(want)
        before = {"=": ("", "", ""), "^=": ("", "", ""), "*=": ('[^"]*', "[^']*", "[^\\s\"'>]*")}[how]
        after = {"=": ('"', "'", r"(?=[\s>/])"), "^=": ("", "", ""), "*=": ("", "", "")}[how]
        value = "|".join(q + x + want + y for q, x, y in zip(('"', "'", ""), before, after))
        return e["tag"].rlike(rf"(?i)\s{name}\s*=\s*(?:{value})")
    tokens = test.split("|")
    return e["cls"].contains(f" {test} ") if len(tokens) == 1 else e["cls"].rlike(" (?:" + "|".join(map(re.escape, tokens)) + ") ")


def matches(e: Column, rule: tuple) -> Column:
    """Does ``e`` match ``(name or None, *tests)``?"""
    name, tests = rule[0], [_test(e, test) for test in rule[1:]]
    return reduce(and_, ([e["name"] == name] if name else []) + tests)


def select(index: Column, chain: list) -> Column:
    """Elements that match the last rule of ``chain`` below elements that match the rules
    before it, in page order; ``">"`` between two rules asks for a direct child."""
    rule, rest = chain[-1], chain[:-1]
    own = F.filter(index, lambda e: matches(e, rule))
    if not rest:
        return own
    child = rest[-1] == ">"
    above = select(index, rest[:-1] if child else rest)
    # the outer elements are found once, the lambda compares intervals only
    return let(above, lambda outer: F.filter(own, lambda e: F.exists(outer, lambda a: within(e, a) & (a["depth"] == e["depth"] - 1) if child else within(e, a))))
