"""String measures shared by the matching operators; plain Python on short strings."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_DOUBLED = re.compile(r"(.)\1+")
# Spellings that sound alike, applied in this order.
SOUNDS = (
    ("ph", "f"), ("th", "t"), ("sh", "s"), ("kh", "k"), ("gh", "g"), ("bh", "b"), ("dh", "d"), ("ck", "k"),
    ("ee", "i"), ("oo", "o"), ("c", "k"), ("q", "k"), ("w", "v"), ("y", "i"),
)


@lru_cache(maxsize=200_000)
def plain(text: str) -> str:
    """Lower case without accents; other scripts keep their letters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss"))
    out = "".join(c for c in text if not "̀" <= c <= "ͯ")
    return unicodedata.normalize("NFC", out)


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """One spelling for words that sound alike."""
    for a, b in SOUNDS:
        if a in word:
            word = word.replace(a, b)
    return _DOUBLED.sub(r"\1", word)


def within(a: str, b: str, limit: int) -> int:
    """Edit distance with adjacent swaps (optimal string alignment), or
    ``limit + 1`` as soon as it must exceed ``limit``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return min(limit + 1, len(a) + len(b))
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return min(row[-1], limit + 1)


def inside(part: str, whole: str) -> int:
    """Fewest edits that turn ``part`` into some substring of ``whole``, by the
    bit-parallel method of Myers."""
    m = len(part)
    if not m or part in whole:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(part):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in whole:
        eq = where.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        right = (down | ~(d0 | up)) & full
        left = d0 & up
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1) & full
        left = (left << 1) & full
        up = (left | ~(d0 | right)) & full
        down = d0 & right
        if score < best:
            best = score
    return best


def allowed(length: int) -> int:
    """Edits that a word of this length may carry and still be the same."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 14 else 3
