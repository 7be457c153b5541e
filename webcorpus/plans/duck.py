"""SQL fragments in DuckDB's dialect for the oracle queries.

The oracle re-states each operator in plain SQL over the given tables. These helpers
only render the same fixed patterns (from ``webcorpus.functions``) into DuckDB
syntax: ``regexp_replace(..., 'g')``, ``list_transform``/``list_filter`` lambdas,
``chr(1)`` markers. They are test code, not part of the Spark path.
"""

from __future__ import annotations

from ..functions import page as P
from ..functions import text as T
from ..functions import urls as U


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pattern: str, repl: str = "''") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {repl}, 'g')"


def clean(expr: str) -> str:
    return f"coalesce(trim({rr(rr(expr, T.WS_RUN, q(' ')), T.NOT_KEPT)}), '')"


def decode_numeric(x: str) -> str:
    pat = q(T.NUMERIC_ENTITY)
    code = "CASE WHEN lower(t) LIKE 'x%' THEN ('0x' || substr(t, 2))::BIGINT ELSE t::BIGINT END"
    char = (f"CASE WHEN ({code}) = 38 THEN chr(57344) "
            f"WHEN ({code}) BETWEEN 1 AND 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343 "
            f"THEN chr(({code})::INTEGER) ELSE chr(65533) END")
    pieces = f"string_split_regex({x}, {pat})"
    joined = (f"{pieces}[1] || array_to_string(list_transform(regexp_extract_all({x}, {pat}, 1), "
              f"lambda t, i: {char} || coalesce({pieces}[i + 1], '')), '')")
    return f"CASE WHEN contains({x}, '&#') THEN {joined} ELSE {x} END"


def decode(expr: str) -> str:
    out = f"replace({expr}, '&amp;', chr(57344))"
    for ent, ch in T.ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    out = decode_numeric(out)
    out = rr(out, T.OTHER_ENTITY)
    return f"replace({out}, chr(57344), '&')"


def inner_text(expr: str) -> str:
    return clean(decode(rr(expr, T.ANY_TAG)))


def spaced_text(expr: str) -> str:
    return clean(decode(rr(expr, T.ANY_TAG, "' '")))


def raw_text(expr: str) -> str:
    return decode(rr(expr, T.ANY_TAG))


def body(expr: str = "html", include_boilerplate: bool = False) -> str:
    return rr(expr, T.COMMENTS_ONLY if include_boilerplate else T.BOILERPLATE)


def has_tag(b: str, tag: str) -> str:
    return f"regexp_matches({b}, {q(f'(?i)<{tag}' + chr(92) + 'b')})"


def element_inner(b: str, tag: str) -> str:
    pat = rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|$)"
    return f"regexp_extract({b}, {q(pat)}, 1)"


def all_inner(b: str, tag: str) -> str:
    pat = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    return f"regexp_extract_all({b}, {q(pat)}, 1)"


def title(b: str) -> str:
    return (f"CASE WHEN {has_tag(b, 'title')} THEN {inner_text(element_inner(b, 'title'))} "
            f"WHEN {has_tag(b, 'h1')} THEN {inner_text(element_inner(b, 'h1'))} ELSE '' END")


def heading_texts(b: str, level: int) -> str:
    return (f"list_filter(list_transform({all_inner(b, f'h{level}')}, lambda x: {inner_text('x')}), "
            f"lambda t: t <> '')")


def paragraph_texts(b: str, min_length: int = P.MIN_PARAGRAPH_LENGTH) -> str:
    marked = rr(rr(b, P.P_START, "chr(1)"), P.P_END, "chr(2)")
    segs = f"regexp_extract_all({marked}, {q(P.SEGMENT)}, 1)"
    return (f"list_filter(list_transform({segs}, lambda s: {inner_text('s')}), "
            f"lambda t: length(t) >= {min_length})")


def main_content(b: str) -> str:
    parts = [f"WHEN {has_tag(b, t)} THEN {inner_text(nested_inner(b, P.NESTED.format(t)))}" for t in ("main", "article")]
    words = [w for i, w in enumerate(P.CONTENT_CLASS_WORDS) if not any(o in w for o in P.CONTENT_CLASS_WORDS[:i])]
    for word in words:
        start = rf"(?is)<([A-Za-z][A-Za-z0-9]*)\b[^>]*\bclass\s*=\s*[\"']?[^\"'>]*{word}[^>]*>"
        parts.append(f"WHEN regexp_matches({b}, {q(start)}) THEN {inner_text(nested_inner(b, start))}")
    parts.append(f"WHEN {has_tag(b, 'body')} THEN {inner_text(element_inner(b, 'body'))}")
    return "CASE " + " ".join(parts) + f" ELSE {inner_text(b)} END"


def nested_inner(b: str, start: str) -> str:
    """DuckDB form of functions.page.nested_inner (split at same-name close tags, fold
    the depth)."""
    name = f"regexp_extract({b}, {q(start)}, 1)"
    rest = f"regexp_extract({b}, {q(start + '(.*)$')}, 2)"
    pieces = f"string_split_regex({rest}, '(?i)</' || {name} || {q(r'\s*>')})"
    opens = f"'(?i)<' || {name} || {q(chr(92) + 'b')}"
    marked = f"list_transform({pieces}, lambda p, i: {{'p': p, 'last': i = len({pieces})}})"
    init = "{'depth': 1, 'done': false, 'out': ''}"
    d = f"(acc.depth + (len(string_split_regex(x.p, {opens})) - 1) - 1)"  # + opens in the piece, - its close
    step = (f"lambda acc, x: CASE WHEN acc.done THEN acc ELSE {{'depth': {d}, 'done': {d} <= 0, "
            f"'out': acc.out || x.p || CASE WHEN NOT x.last AND {d} > 0 THEN '</' || {name} || '>' ELSE '' END}} END")
    return f"list_reduce({marked}, {step}, {init}).out"


def attr(tag: str, name: str) -> str:
    """Attribute value of one start tag, NULL when absent (bare attributes aside)."""
    pat = P.ATTR_VALUE.replace("{name}", name)
    val = " || ".join(f"regexp_extract({tag}, {q(pat)}, {g})" for g in (1, 2, 3))
    return f"CASE WHEN regexp_matches({tag}, {q(pat)}) THEN {decode(val)} END"


def language(b: str) -> str:
    html_tag = f"regexp_extract({b}, {q(P.HTML_TAG)}, 1)"
    lang = attr(html_tag, "lang")
    meta_tag = f"regexp_extract({b}, {q(P.META_LANG_TAG)}, 1)"
    meta_lang = f"coalesce({attr(meta_tag, 'content')}, {q(P.DEFAULT_LANGUAGE)})"
    return (f"CASE WHEN coalesce({lang}, '') <> '' THEN {lang} "
            f"WHEN {meta_tag} <> '' THEN {meta_lang} ELSE {q(P.DEFAULT_LANGUAGE)} END")


def host(url: str) -> str:
    netloc = f"regexp_extract({url}, {q(U.URL_PARTS)}, 3)"
    return f"lower({rr(rr(netloc, r'^.*@'), r':[0-9]*$')})"


def registrable_domain(url: str) -> str:
    h = host(url)
    labels = f"string_split({h}, '.')"
    n = f"len({labels})"
    sfx = "[" + ", ".join(q(s) for s in U.PUBLIC_SUFFIXES) + "]"

    def last(k):
        return f"array_to_string({labels}[-{k}:], '.')"

    return (f"CASE WHEN {h} = '' THEN '.' "
            f"WHEN {n} >= 3 AND list_contains({sfx}, {last(2)}) THEN {last(3)} "
            f"WHEN {n} = 2 AND list_contains({sfx}, {last(2)}) THEN '.' || {last(2)} "
            f"WHEN {n} >= 2 AND list_contains({sfx}, {last(1)}) THEN {last(2)} "
            f"WHEN {n} = 1 AND list_contains({sfx}, {last(1)}) THEN '.' || {last(1)} "
            f"ELSE {labels}[-1] || '.' END")
