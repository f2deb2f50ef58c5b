"""The text rules as DuckDB SQL, for the checks of their queries."""

from __future__ import annotations

from kinsift.functions import text


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that folding turns into one other, their images, and ligatures."""
    one, image, more = [], [], []
    for code in [*range(0x80, 0x300), *range(0x370, 0x3400), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        got = text.fold_text(chr(code))
        if got == chr(code):
            continue
        if len(got) == 1 and got not in "'":
            one.append(chr(code))
            image.append(got)
        elif 0xFB00 <= code <= 0xFB06:
            more.append((chr(code), got))
    return "".join(one), "".join(image), more


def quoted(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def mapped(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_ONE, _IMAGE, _MORE = _folds()
_KEPT = r"0-9a-z\x{900}-\x{DFF}\x{4E00}-\x{9FFF}"
_NOT_EMPTY = "lambda x: x <> ''"


def fold(c: str) -> str:
    out = f"lower({c})"
    for old, new in _MORE:
        out = f"replace({out}, '{old}', '{new}')"
    return f"regexp_replace(translate({out}, '{_ONE}', '{_IMAGE}'), '[\\x{{300}}-\\x{{36F}}]', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, ' +'), {_NOT_EMPTY})"


def name_tokens(c: str) -> str:
    """Tokens of a folded name in column ``c``."""
    out = f"replace({c}, '&', ' and ')"
    for end in (".com", ".net", ".org"):
        out = f"replace({out}, '{end}', ' ')"
    return words(f"regexp_replace({out}, '[^{_KEPT}]+', ' ', 'g')")


def split_legal(source: str, tokens: str) -> str:
    """CTE body: columns of ``source`` with lists core and legal of its list ``tokens``."""
    law = quoted(text.LEGAL)
    return f"""SELECT * EXCLUDE (c, l), CASE WHEN len(c) > 0 THEN c ELSE l END AS core, CASE WHEN len(c) > 0 THEN l ELSE []::VARCHAR[] END AS legal FROM (
      SELECT *, list_filter(t, lambda w: NOT list_contains({law}, w)) AS c, list_filter(t, lambda w: list_contains({law}, w)) AS l FROM (
        SELECT * EXCLUDE ({tokens}), list_transform({tokens}, lambda w: coalesce({mapped(text.LEGAL_CANON)}[w], w)) AS t FROM {source}))"""


def norm_addr(c: str) -> str:
    """Tokens of a folded address in column ``c``."""
    out = f"replace(replace({c}, '<null>', ' '), '&', ' ')"
    for state in text.JOINED_STATES:
        out = f"replace({out}, '{state}', '{state.replace(' ', '')}')"
    toks = words(f"regexp_replace({out}, '[^{_KEPT}/\\-]+', ' ', 'g')")
    parts = f"list_filter(string_split_regex(t, '[-/]'), {_NOT_EMPTY})"
    whole = f"array_to_string(list_transform({parts}, lambda p: ltrim(p, '0')), '')"
    numbers = f"""list_concat(list_transform({parts}, lambda p: coalesce(nullif(ltrim(p, '0'), ''), '0')),
        CASE WHEN len({parts}) > 1 AND {whole} <> '' THEN [{whole}] ELSE []::VARCHAR[] END)"""
    named = f"""list_filter(list_transform(list_transform(list_filter({parts}, lambda p: regexp_full_match(p, '[\\x00-\\x7f]*')),
        lambda p: coalesce({mapped(text.STATES)}[p], p)), lambda p: coalesce({mapped(text.ABBR)}[p], p)), lambda p: NOT list_contains({quoted(text.ADDR_DROP)}, p))"""
    return f"flatten(list_transform({toks}, lambda t: CASE WHEN regexp_matches(t, '\\p{{Nd}}') THEN {numbers} ELSE {named} END))"


def index_tokens(core: str, addr: str) -> str:
    """Distinct namespaced tokens of the lists ``core`` and ``addr``."""
    first = lambda k: f"array_to_string({core}[1:{k}], '')"
    long = f"list_filter({core}, lambda w: length(w) >= 5 AND regexp_full_match(w, '[\\x00-\\x7f]*'))"
    # the first occurrence of each address token of two characters, in order
    seen = f"list_filter({addr}, lambda w, i: length(w) >= 2 AND list_position({addr}, w) = i)"
    ends = f"CASE WHEN len({seen}) <= 12 THEN {seen} ELSE list_concat(({seen})[1:6], ({seen})[-6:]) END"
    return f"""list_distinct(list_concat(
      list_transform({core}, lambda w: 'n:' || w), list_transform(list_filter({core}, lambda w: length(w) >= 6), lambda w: 'np:' || substring(w, 1, 5)),
      flatten(list_transform({long}, lambda w: list_transform(range(1, length(w) - 2), lambda k: 'g:' || substring(w, k, 4)))),
      CASE WHEN len({core}) > 0 THEN ['ne:' || array_to_string({core}, ''), 'nc:' || {first(2)}] ELSE []::VARCHAR[] END,
      CASE WHEN len({core}) = 1 OR len({core}) > 2 THEN ['nc3:' || {first(3)}] ELSE []::VARCHAR[] END,
      list_transform({addr}, lambda w: 'a:' || w),
      list_transform(list_filter({addr}, lambda w: length(w) >= 6 AND NOT regexp_full_match(w, '\\p{{Nd}}+')), lambda w: 'ap:' || substring(w, 1, 5)),
      list_transform(list_filter(list_transform(range(1, len({addr})), lambda i: [{addr}[i], {addr}[i + 1]]), lambda p: regexp_matches(p[1], '^\\p{{Nd}}') OR regexp_matches(p[2], '^\\p{{Nd}}')),
        lambda p: 'ab:' || p[1] || '_' || p[2]),
      flatten(list_transform((list_filter({core}, lambda w: length(w) >= 3))[1:4], lambda n: list_transform({ends}, lambda a: 'nx:' || n || '|' || a)))))"""


def fixed_numbers(c: str, glued: bool) -> str:
    months = quoted(text.MONTHS)
    tail = "(bis|ter|quater|[a-z])?" if glued else "(bis|ter|quater)?"
    near = lambda at: f"coalesce(list_contains({months}, {c}[{at}]), false)"
    return f"""list_transform(list_filter({c}, lambda x, i: NOT (regexp_full_match(x, '[0-9]{{1,2}}(er)?') AND {near('i + 1')})
        AND NOT (regexp_full_match(x, '1[5-9][0-9]{{2}}|20[0-9]{{2}}') AND {near('i - 1')}) AND regexp_full_match(x, '[0-9]{{1,9}}{tail}')),
      lambda x: CAST(regexp_extract(x, '^[0-9]+') AS BIGINT))"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


def crc32(c: str) -> str:
    """CRC-32 of an ASCII text, byte by byte."""
    table = "[" + ", ".join(f"{x}::BIGINT" for x in _crc_table()) + "]"
    data = f"list_transform(range(1, length({c}) + 1), lambda k: ascii(substring({c}, k, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda h, b: xor(h >> 8, {table}[(xor(h, b) & 255) + 1])), 4294967295::BIGINT)"
