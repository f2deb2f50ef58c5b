"""One consistent form for text that looks the same.

A character is unstable if compatibility normalization would change it, if it
can compose with what stands before it, or if it cannot be seen. Quick-check
properties find the unstable characters; a segment is a run of them with the
character before it as boundary context. Only segments are normalized; the
results are spliced into the unchanged text. Words that mix scripts are then
brought into the script they are written in.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

# Letters of other scripts that look like a Latin letter.
LATIN_TWINS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "η": "n", "ω": "w", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "յ": "j", "ա": "w",
    "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲭ": "X", "Ⲧ": "T", "Ⲙ": "M", "Ⲕ": "K",
    "Ⲏ": "H", "Ⲃ": "B", "Ⲓ": "I", "Ⲛ": "N",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K",
    "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W",
    "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
#: Scripts whose letters pass for Latin ones.
TWIN_SCRIPTS = {"cyrillic", "greek", "armenian", "coptic", "cherokee", "lisu"}
# Latin letters that look like another Latin letter.
LATIN_VARIANTS = {"ɑ": "a", "ɡ": "g"}
# Invisible characters outside the format category.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏⁥⠀ㅤﾠ"
# Format characters that are visible signs.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࣢"
# Compatibility forms that do not look like what they stand for.
OTHER_LOOK = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")

_JOINERS = "‌‍"
_DIGIT_TWINS = {"o": "0", "O": "0", "l": "1", "I": "1"}
_DIGIT_RUN = re.compile(r"(?<=[0-9])[oOlI](?=[0-9])")


def _unseen(ch: str) -> bool:
    if ch in INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0000 <= ord(ch) <= 0xE0FFF:
        return True
    kind = unicodedata.category(ch)
    return (kind == "Cf" and ch not in VISIBLE_FORMAT) or (kind == "Cc" and ch not in "\t\n\r")


def _unstable(ch: str) -> bool:
    if ch < "\x7f":
        return _unseen(ch)
    if _unseen(ch) or unicodedata.combining(ch):
        return True
    if not unicodedata.is_normalized("NFC", ch):
        return True
    return not unicodedata.is_normalized("NFKC", ch) and not unicodedata.decomposition(ch).startswith(OTHER_LOOK)


def _ranges(test, stop: int) -> str:
    out, start = [], None
    for cp in range(stop + 1):
        hit = cp < stop and not 0xD800 <= cp < 0xE000 and test(chr(cp))
        if hit and start is None:
            start = cp
        elif not hit and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def _segments() -> re.Pattern:
    """Runs of unstable characters with the character before them, built from
    the Unicode tables of the running Python."""
    kinds = _ranges(_unstable, 0x20000) + "\\U0002f800-\\U0002fa1f\\U000e0000-\\U000e0fff"
    # Hangul vowels and finals compose with the syllable before them
    return re.compile(f"[^{kinds}]?[{kinds}ᅡ-ᅵᆨ-ᇂ]+", re.S)


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    if ch < "ɐ" or "Ḁ" <= ch <= "ỿ" or ch in LATIN_VARIANTS:
        return "latin"
    if "Ѐ" <= ch <= "ԯ":
        return "cyrillic"
    if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿":
        return "greek"
    if "Ա" <= ch <= "և":
        return "armenian"
    if "Ⲁ" <= ch <= "⳿":
        return "coptic"
    if "Ꭰ" <= ch <= "ᏽ" or "ꭰ" <= ch <= "ꮿ":
        return "cherokee"
    if "ꓐ" <= ch <= "꓿":
        return "lisu"
    return "other"


def _joins(text: str, at: int) -> bool:
    """Whether the joiner at ``at`` belongs to the spelling of its script: after
    a virama, or a non-joiner between letters of a cursive script."""
    before = text[at - 1] if at else ""
    after = text[at + 1] if at + 1 < len(text) else ""
    if before and unicodedata.combining(before) == 9:
        return True
    if text[at] == "‌":
        return "؀" <= before <= "ࣿ" and "؀" <= after <= "ࣿ"
    # emoji sequences
    return before > "←" and after > "←" and unicodedata.category(after) == "So"


def _mend(m: re.Match) -> str:
    text, segment, at = m.string, m.group(), m.start()
    kept = "".join(
        ch
        for k, ch in enumerate(segment)
        if not _unseen(ch)
        or (ch in _JOINERS and _joins(text, at + k))
        or (ch == "️" and at + k and unicodedata.category(text[at + k - 1]) == "So")
    )
    kept = unicodedata.normalize("NFC", kept)
    return unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) if _unstable(c) else c for c in kept))


def _words(text: str) -> str:
    words = re.split(r"(\s+)", text)
    scripts = [{_script(c) for c in w if c.isalpha()} for w in words]
    own: set[str] = set()  # scripts that the text has words of
    for w, s in zip(words, scripts):
        for script in s - {"latin"}:
            if any(_script(c) == script and c not in LATIN_TWINS for c in w if c.isalpha()):
                own.add(script)
    latin = any("latin" in s for s in scripts)
    for i, (w, s) in enumerate(zip(words, scripts)):
        foreign = s & TWIN_SCRIPTS
        if foreign and "latin" in s:
            strange = [c for c in w if c.isalpha() and _script(c) in foreign]
            if all(c in LATIN_TWINS for c in strange):
                words[i] = "".join(LATIN_TWINS.get(c, c) for c in w)
            elif len(foreign) == 1:  # a word of that script with Latin letters in it
                back = {v: k for k, v in LATIN_TWINS.items() if _script(k) in foreign}
                ours = [c for c in w if c.isalpha() and _script(c) == "latin"]
                if len(ours) < len(strange) and all(c in back for c in ours):
                    words[i] = "".join(back.get(c, c) for c in w)
        elif foreign and latin and not (foreign & own) and all(c in LATIN_TWINS for c in w if c.isalpha()):
            words[i] = "".join(LATIN_TWINS.get(c, c) for c in w)
        if "latin" in scripts[i] and any(v in words[i] for v in LATIN_VARIANTS):
            words[i] = "".join(LATIN_VARIANTS.get(c, c) for c in words[i])
    return "".join(words)


def unify(text: str | None) -> str | None:
    """The consistent form of ``text``; sound text comes back unchanged."""
    if text is None:
        return None
    if not text.isascii():
        text = _segments().sub(_mend, text)
        if not text.isascii():
            text = _words(text)
    elif not text.isprintable():
        text = _segments().sub(_mend, text)
    return _DIGIT_RUN.sub(lambda m: _DIGIT_TWINS[m.group()], text)


#: Rows whose text can hold something to mend; all others stay in the JVM.
SUSPECT = r"[^\x09\x0A\x0D\x20-\x7E]|[0-9][oOlI][0-9]"


def _unify_udf(columns: list[str]):
    kind = StructType([StructField(c, StringType()) for c in columns] + [StructField("changed", BooleanType())])

    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.DataFrame:
        out, changed = {}, None
        for name, values in zip(columns, cols):
            mended = [unify(x) for x in values]
            diff = pd.Series([a != b for a, b in zip(values, mended)])
            out[name], changed = mended, diff if changed is None else changed | diff
        return pd.DataFrame(out | {"changed": changed})

    return run


def unified(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` in their consistent form, and ``is_changed``.

    NULL stays NULL, an empty text empty; an existing column ``is_changed`` is
    replaced, all others are kept. Rows of plain ASCII never reach Python.
    """
    df = df.drop("is_changed", "__u")
    suspect = F.lit(False)
    for c in columns:
        suspect = suspect | F.coalesce(F.col(c).rlike(SUSPECT), F.lit(False))
    plain = df.where(~suspect).withColumn("is_changed", F.lit(False))
    mended = df.where(suspect).withColumn("__u", _unify_udf(columns)(*columns))
    mended = mended.select(
        *[F.col(f"__u.{c}").alias(c) if c in columns else F.col(c) for c in df.columns],
        F.col("__u.changed").alias("is_changed"),
    )
    return plain.unionByName(mended)


def affected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the rows of ``df`` that :func:`unified` changes, in consistent form."""
    return unified(df, columns).where("is_changed").drop("is_changed")
