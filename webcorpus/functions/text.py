"""Text cleaning and HTML-to-text helpers (SCL5, SCL6, SCL13, EXT1, EXT17).

Every function maps ``Column -> Column`` with native Spark expressions only, so each
runs inside whole-stage code generation and Catalyst can prune what is not selected.

Regex dialect: the patterns are written so that Java (Spark) and RE2 (the DuckDB
oracle) read them the same way: no look-around, no back-references, and explicit
Unicode classes instead of ``\\w`` / ``\\s`` (both are ASCII-only there but Unicode in
the original Python service).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import CELL_END, ROW_END, let

# --- fixed values -----------------------------------------------------------------
# Whitespace as Python's Unicode ``\s`` sees it (str.isspace()).
WS_CLASS = (r"\t\n\x0B\f\r \x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_RUN = "[" + WS_CLASS + "]+"
# The same runs for Java: a text of ASCII alone needs ten signs, other texts pass over printable ASCII first.
# (Java tells signs that are listed one by one apart several times as fast as ranges.)
WS_RUN_ASCII = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F ]+"
WS_RUN_JAVA = "(?![!-~])" + WS_RUN
# Characters kept by clean_text: word characters, space and . , ! ? ; : ( ) - ' " @
NOT_KEPT = r"""[^\p{L}\p{N}_ .,!?;:()'"@-]"""
# The others in a text of ASCII alone.
DROPPED_ASCII = [chr(k) for k in range(128) if not (chr(k).isalnum() or chr(k) in "_ .,!?;:()'\"@-")]

# Tags dropped with their whole content before any extraction, plus comments.
BOILERPLATE_TAGS = ("script", "style", "noscript", "iframe", "nav", "footer", "header")
COMMENT = r"<!--.*?-->"
# Any start, end or declaration tag (a '<' not followed by a letter is text).
ANY_TAG = r"<[/!?]?[A-Za-z][^>]*>"
# The same in fragments that are read together: no tag reaches across the signs between them.
TAG_WITHIN = ANY_TAG.replace("[^>]*", f"[^>{ROW_END}{CELL_END}]*+")

# Entities decoded after tags are removed. Named entities outside this table are
# dropped (they decode to symbols that clean_text would delete anyway).
ENTITIES = (
    ("&nbsp;", " "),
    ("&#160;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#34;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
)
OTHER_ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
AMP_SENTINEL = "\uE000"
NUMERIC_ENTITY = r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
REPLACEMENT_CHAR = "\uFFFD"  # for code points that are not characters
# ---------------------------------------------------------------------------------


def _boilerplate_pattern(tags=BOILERPLATE_TAGS) -> str:
    parts = [COMMENT] + [rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in tags]
    return "(?is)" + "|".join(parts)


BOILERPLATE = _boilerplate_pattern()


def _one_start(pattern: str) -> str:
    """A ``(?is)`` alternation whose branches all begin with ``<``, with that sign in front: it matches the
    same and fails at once at every other character."""
    return "(?is)<(?:" + re.sub(r"(^|\|)<", r"\1", pattern.removeprefix("(?is)")) + ")"


COMMENTS_ONLY = "(?s)" + COMMENT


def clean_text(col: Column) -> Column:
    """SCL5: collapse whitespace runs to one space, delete characters outside word
    characters and ``.,!?;:()-'"@``, then trim. Order as in the original: ``a & b``
    becomes ``a  b`` (two spaces). Null gives ``""``."""
    return F.coalesce(F.trim(let(col, lambda t: _kept(t))), F.lit(""))


def _kept(t: Column, besides: str = "") -> Column:
    """``t`` with its whitespace collapsed and only the kept characters and those in ``besides``."""
    # most texts of ASCII hold no other whitespace than blanks
    blanks = F.when(t.rlike(WS_RUN_ASCII.replace(" ]+", "]")), F.regexp_replace(t, WS_RUN_ASCII, " ")) \
        .when(t.contains("  "), F.regexp_replace(t, "  +", " ")).otherwise(t)
    dropped = "[" + "".join(rf"\x{ord(c):02X}" for c in DROPPED_ASCII if c not in besides) + "]+"
    return F.when(F.octet_length(t) == F.length(t), F.regexp_replace(blanks, dropped, "")) \
        .otherwise(F.regexp_replace(F.regexp_replace(t, WS_RUN_JAVA, " "), NOT_KEPT.replace("[^", "[^" + besides), ""))


def truncate_text(col: Column, max_length: int = 500) -> Column:
    """SCL6: cut to ``max_length`` characters and append ``...`` when longer."""
    return F.when(F.length(col) <= max_length, col).otherwise(
        F.concat(F.substring(col, 1, max_length), F.lit("...")))


def code_point_char(code: Column) -> Column:
    """The character of a Unicode code point (U+FFFD when it is not a character)."""
    valid = (code >= 1) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(REPLACEMENT_CHAR))


# Zero-width split points around every numeric entity (Java look-around; the text is
# read once, so the expression stays cheap inside higher-order functions too).
NUMERIC_ENTITY_BOUNDS = r"(?=&#[0-9xX])|(?<=;)"
NUMERIC_ENTITY_WHOLE = r"^&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});$"


def decode_numeric_entities(col: Column) -> Column:
    """``&#233;`` / ``&#xE9;`` -> the character: the text is split before every ``&#``
    and after every ``;`` (cheap one-character tests), and pieces that are exactly a
    numeric entity are replaced by their characters."""
    def one(p):
        t = F.regexp_extract(p, NUMERIC_ENTITY_WHOLE, 1)
        code = F.when(F.lower(t).startswith("x"), F.conv(F.substring(t, 2, 8), 16, 10)).otherwise(t).cast("long")
        # a decoded "&" is parked on the sentinel, so it cannot start a second entity
        char = F.when(code == 38, F.lit(AMP_SENTINEL)).otherwise(code_point_char(code))
        return F.when(t != "", char).otherwise(p)
    return F.array_join(F.transform(F.split(col, NUMERIC_ENTITY_BOUNDS, -1), one), "")


def _decode_all(col: Column) -> Column:
    out = F.replace(col, F.lit("&amp;"), F.lit(AMP_SENTINEL))
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    out = let(out, lambda t: F.when(t.contains("&#"), decode_numeric_entities(t)).otherwise(t))
    out = F.regexp_replace(out, OTHER_ENTITY, "")
    return F.replace(out, F.lit(AMP_SENTINEL), F.lit("&"))


def decode_entities(col: Column) -> Column:
    """SCL13: decode the entity table above and every numeric entity; drop other named
    entities. ``&amp;`` is parked on a private-use sentinel first so ``&amp;lt;``
    decodes to the text ``&lt;`` exactly once, as a parser does. A text without ``&`` has no entity
    and is passed through (the sentinel alone is read back, as above)."""
    return let(col, lambda t: F.when(t.contains("&"), _decode_all(t)).otherwise(F.replace(t, F.lit(AMP_SENTINEL), F.lit("&"))))


def strip_boilerplate(html: Column, tags=BOILERPLATE_TAGS) -> Column:
    """EXT1: remove comments and the subtrees of script, style, noscript, iframe, nav,
    footer and header (non-greedy, first close tag ends the block)."""
    pattern = BOILERPLATE if tuple(tags) == BOILERPLATE_TAGS else _boilerplate_pattern(tags)
    return F.regexp_replace(html, _one_start(pattern), "")


def strip_comments(html: Column) -> Column:
    """Remove comments only (the ``include_boilerplate`` mode)."""
    return F.regexp_replace(html, COMMENTS_ONLY, "")


def inner_text(fragment: Column) -> Column:
    """Text of an HTML fragment with pieces joined by nothing (``get_text()``),
    entities decoded, then cleaned."""
    return clean_text(decode_entities(F.regexp_replace(fragment, ANY_TAG, "")))


def clean_texts(fragments: Column, clean=lambda t: clean_text(decode_entities(t)), tags: str | None = None) -> Column:
    """Entities decoded and cleaned, for every fragment. They are cleaned together, with a sign between
    them; where a fragment holds that sign, or decodes to it, each goes through ``clean`` alone."""
    def cleaned(fs):
        joined = F.array_join(fs, CELL_END, "")
        kept = let(decode_entities(F.regexp_replace(joined, tags, "") if tags else joined), lambda t: _kept(t, CELL_END))
        texts = let(F.split(kept, CELL_END, -1), lambda ts: F.when(F.size(ts) == F.size(fs), F.transform(ts, lambda t: F.trim(t)))
                    .otherwise(F.transform(fs, clean)))
        return F.when(F.size(fs) > 0, texts).when(fs.isNotNull(), F.array().cast("array<string>"))

    return let(fragments, cleaned)


def inner_texts(fragments: Column) -> Column:
    """``inner_text`` of every fragment."""
    return clean_texts(fragments, inner_text, TAG_WITHIN.replace(ROW_END, ""))


def inner_cells(rows: Column) -> Column:
    """``inner_text`` of the cells of a text that parts rows by ``ROW_END`` and cells by ``CELL_END``
    and holds or decodes to these signs nowhere else."""
    kept = let(decode_entities(F.regexp_replace(rows, TAG_WITHIN, "")), lambda t: _kept(t, ROW_END + CELL_END))
    return F.transform(F.split(kept, ROW_END, -1), lambda row: F.transform(F.split(row, CELL_END, -1), lambda t: F.trim(t)))


def spaced_text(fragment: Column) -> Column:
    """EXT17 text: pieces joined by one space (``get_text(' ', strip=True)``), cleaned.
    The doctype is not text."""
    return clean_text(decode_entities(F.regexp_replace(fragment, ANY_TAG, " ")))
