"""Garbled text from a wrong character encoding: find it and restore it.

Near-twins teach the transformations. Two passages are near-twins if they agree
once their non-ASCII characters are stripped. Aligning the stripped characters
of both, one clean character with what stands in its place, shows which bytes
were read in which charset: every pair of charsets under which all aligned
characters come out gets a vote. The learned transformations are then applied
to all other words: a word that is the image of a more frequent word, or that
reads back into sound UTF-8, is garbled. Character references and percent
escapes are resolved first, so markup of sound characters is no case and markup
of garbled ones is.

Three tables are built from all texts, each pre-aggregated in its map task:
words in their context, passages of mostly foreign letters, and words alone.
Nothing but the vote table, bounded by the number of charset pairs, and a Bloom
filter of bounded size ever reaches the driver.
"""

from __future__ import annotations

import codecs
import encodings.aliases
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.arrow import batch_of
from kinsift.session import materialize

# The charsets that are met most, which go first where several explain a pair alike.
USUAL = (
    "utf-8", "cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "koi8-r", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15",
    "mac_roman", "cp437", "cp850",
)
READ_MULTI = ("cp932", "euc_jp", "gbk", "big5", "euc_kr", "utf-8", "ascii")


def _single_byte() -> list[str]:
    """Every charset Python has of one byte a character that agrees with ASCII, the usual ones first."""
    out = [c for c in USUAL if c != "utf-8"]
    known, plain = {codecs.lookup(c).name for c in (*out, *READ_MULTI)}, bytes(range(32, 127))
    for name in sorted(set(encodings.aliases.aliases.values())):
        try:
            upper = [bytes([b]).decode(name, "replace") for b in range(128, 256)]
            fits = plain.decode(name) == plain.decode("ascii") and all(len(c) == 1 for c in upper)
            # half the upper bytes are characters, and none of them begins a longer one
            if fits and sum(c != "\ufffd" for c in upper) > 60 and len((b"\xe0\xe1" * 8).decode(name, "replace")) == 16:
                if codecs.lookup(name).name not in known:
                    out.append(name)
        except (LookupError, UnicodeError):
            continue
    return out


SINGLE = _single_byte()

LOST = "�"
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_ASCII_RUN = re.compile(r"[0-9A-Za-z]+")
_SENTENCE = re.compile(r"(?<=[.!?;:।])[ \n]+|\n")
_MASK = str.maketrans("0123456789", "##########")
#: Letters that 7-bit text carries in shift sequences.
_SHIFT = re.compile(r"\+[A-Z][A-Za-z0-9/]+-?")
_ESCAPE = re.compile(r"&#?\w{2,8};|%[0-9A-Fa-f]{2}|\+[A-Z][A-Za-z0-9/]+")


def unescaped(word: str) -> str:
    """A word with its character references and percent escapes resolved."""
    if "&" in word and ";" in word:
        word = html.unescape(word)
    if "%" in word:
        try:
            word = unquote_to_bytes(word).decode("utf-8")
        except UnicodeDecodeError:
            pass
    return word.replace(" ", "\xa0")


def _telling(text: str) -> bool:
    """Whether a text holds anything but plain ASCII."""
    return not text.isascii() or _ESCAPE.search(text) is not None


@lru_cache(maxsize=None)
def _table(charset: str) -> str:
    """All 256 bytes of a charset as text; a byte without a character stays as
    the control character of its number, which is how lenient readers behave."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=None)
def _bytes_of(charset: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(charset))))}


def _read(data: bytes, charset: str) -> str:
    if charset in READ_MULTI:
        return data.decode(charset, "replace")
    table = _table(charset)
    return "".join([table[b] for b in data])


def _names() -> list[tuple]:
    out: list[tuple] = [("utf-7", "ascii", 1)]
    for w in ("utf-8", *SINGLE):
        for r in (*SINGLE, *READ_MULTI):
            if w != r:
                out.append((w, r, 1))
                if w == "utf-8" and r in SINGLE:
                    out.append((w, r, 2))
    return out


#: Transformations: (written in, read in, times), in a fixed order.
TRANSFORMS = _names()


def garble(text: str, transform: tuple) -> str | None:
    """``text`` as it comes out of a wrong reading; None if it has no such bytes."""
    written, read, times = transform
    try:
        for _ in range(times):
            text = _read(text.encode(written), read)
    except UnicodeEncodeError:
        return None
    return text


def ungarble(text: str, transform: tuple) -> str | None:
    """The inverse of :func:`garble` where it loses nothing, else None."""
    written, read, times = transform
    try:
        for _ in range(times):
            if read in READ_MULTI:
                data = text.encode(read)
            else:
                table = _bytes_of(read)
                data = bytes([table[c] for c in text])
            text = data.decode(written)
    except (KeyError, UnicodeError):
        return None
    return text


def _images(text: str, chosen: list[int]) -> dict[str, list[int]]:
    """What ``text`` becomes under the transformations; each also in lower case."""
    found: dict[str, list[int]] = {}
    for k in chosen:
        got = garble(text, TRANSFORMS[k])
        # what reads as sound UTF-8 was UTF-8
        if got is not None and got != text and (TRANSFORMS[k][1] != "utf-8" or LOST in got):
            found.setdefault(got, []).append(k)
            low = got.lower()
            if low != got and low != text:
                found.setdefault(low, []).append(k)
    return found


@lru_cache(maxsize=20_000)
def _char_images(char: str) -> list[tuple[str, frozenset[int]]]:
    """What a character may become, with the numbers of the transformations that make it so."""
    found: dict[str, set[int]] = {}
    for k, t in enumerate(TRANSFORMS):
        if t[0] == "utf-7" or t[1] in READ_MULTI:
            continue
        got = garble(char, t)
        if got is not None:
            found.setdefault(got, set()).add(k)
    return [(g, frozenset(ks)) for g, ks in found.items()]


_RUNS = re.compile(r"([^\x00-\x7f]+)")


def align(garbled: str, clean: str) -> frozenset[int]:
    """The transformations under which every non-ASCII character of ``clean``
    becomes what stands in its place in ``garbled``; the ASCII parts of both
    must agree."""
    left, right = _RUNS.split(garbled), _RUNS.split(clean)
    if len(left) != len(right) or left[::2] != right[::2]:
        return frozenset()
    agreed: frozenset[int] | None = None
    for g, c in zip(left[1::2], right[1::2]):
        at: dict[int, frozenset[int]] = {0: agreed} if agreed is not None else {0: frozenset(range(len(TRANSFORMS)))}
        for char in c:
            new: dict[int, set[int]] = {}
            images = _char_images(char)
            for pos, hows in at.items():
                for image, by in images:
                    if g.startswith(image, pos) and (both := hows & by):
                        new.setdefault(pos + len(image), set()).update(both)
            at = {p: frozenset(x) for p, x in new.items()}
            if not at:
                return frozenset()
        agreed = at.get(len(g), frozenset())
        if not agreed:
            return agreed
    return agreed or frozenset()


class _Reader:
    """Cuts texts into the units that twins are sought for."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, str]] = {}

    def word(self, w: str) -> tuple[str, str]:
        """(word without its digits, its ASCII letters alone)."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            plain = unescaped(w)
            shifts = _SHIFT.findall(plain)
            if shifts and plain.endswith(shifts[-1]) and not plain.endswith("-"):
                plain, shifts[-1] = plain + "-", shifts[-1] + "-"  # a blank ends a sequence too
            if shifts and plain.isascii():
                parts = [p.translate(_MASK) for p in _SHIFT.split(plain)]
                masked = "".join(x for pair in zip(parts, [*shifts, ""]) for x in pair)
                got = self.known[w] = (masked, "".join(parts).lower())
            else:
                masked = plain.translate(_MASK)
                got = self.known[w] = (masked, _FOREIGN.sub("", masked).lower())
        return got

    def units(self, text: str) -> Iterator[tuple[str, str, str]]:
        """(kind, key, variant): c a word in context, s a passage."""
        word = self.word
        for line in text.split("\n"):
            if not _telling(line):
                continue
            words = line.split(" ")
            last = len(words) - 1
            for i, w in enumerate(words):
                if not _telling(w):
                    continue
                masked, bare = word(w)
                if not _telling(masked):
                    continue
                before = word(words[i - 1])[1] if i else "^"
                after = word(words[i + 1])[1] if i < last else "$"
                yield "c", f"{before}\x1f{bare}\x1f{after}", masked
            if _ESCAPE.search(line):
                line = " ".join(unescaped(w) for w in words)
            for part in _SENTENCE.split(line):
                strange = len(part) - len(part.encode("ascii", "ignore"))
                if strange >= 6 and strange * 2 > len(part) - part.count(" "):
                    variant = _ASCII_RUN.sub("a", part)
                    yield "s", _FOREIGN.sub("¤", variant), variant


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, seen = _Reader(), Counter()

    def flush() -> pa.RecordBatch:
        keys = list(seen)
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            + [pa.array(list(seen.values()), pa.int64())],
            ["kind", "key", "variant", "n"],
        )
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and _telling(text):
                seen.update(reader.units(text))
        if len(seen) > 200_000:
            yield flush()
    if seen:
        yield flush()


VOTES = "kind string, key string, variant string, twin string, how array<bigint>"
IMAGES = "word string, clean string, n_clean bigint, how bigint"


#: Transformations whose reading spans characters, so that none can be aligned alone.
_SPANNING = [k for k, t in enumerate(TRANSFORMS) if t[0] == "utf-7" or t[1] in READ_MULTI]


def explained(garbled: str, clean: str, spanning: dict[str, list[int]], kind: str = "c") -> list[int]:
    """The transformations that make ``clean`` the other text, by alignment of
    their characters; in words ``clean`` may have lost its capitals."""
    hows = align(garbled, clean)
    low = clean.lower()
    if not hows and kind == "c" and low != clean and garbled == garbled.lower():
        hows = align(garbled, low)
    return sorted(hows) or spanning.get(garbled, [])


def _sure(k: int) -> bool:
    """Whether what a transformation makes shows by itself which side is the garbled one."""
    return TRANSFORMS[k][0] in ("utf-8", "utf-7") or TRANSFORMS[k][1] in READ_MULTI


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, variant, twin): those that a transformation explains,
    with the numbers of the transformations that do. Between charsets of one
    byte a character the variant must be ``rare`` beside its twin. Where the twin
    is the garbled one, which UTF-8 shows beyond doubt, the two change places."""
    cache: dict[str, dict[str, list[int]]] = {}

    def spanning(text: str) -> dict[str, list[int]]:
        got = cache.get(text)
        if got is None:
            if len(cache) > 2_000:
                cache.clear()
            got = cache[text] = _images(text, _SPANNING)
        return got

    for batch in batches:
        out = []
        for kind, key, variant, twin, rare in zip(*(c.to_pylist() for c in batch.columns)):
            hit = explained(variant, twin, spanning(twin), kind)
            if not rare:
                hit = [k for k in hit if _sure(k)]
            if hit:
                out.append((kind, key, variant, twin, hit))
            elif hit := [k for k in explained(twin, variant, {}, kind) if TRANSFORMS[k][0] == "utf-8"]:
                out.append((kind, key, twin, variant, hit))
        if out:
            yield batch_of(out, VOTES)


def _told(key) -> object:
    """Whether what surrounds a word is telling: two letters or digits at least."""
    return F.length(F.regexp_replace(key, "[^0-9a-z#]", "")) >= 2


def _leading(votes: dict[int, int]):
    """Of the transformations that explain a pair, the one with most votes; the
    table has at most one entry per transformation."""
    order = sorted(votes, key=lambda k: (-votes[k], k))
    if not order:
        return F.lit(-1).cast("bigint")
    rank = [len(order)] * len(TRANSFORMS)
    for i, k in enumerate(order):
        rank[k] = i
    place = F.expr(f"array({', '.join(map(str, rank))})")
    best = F.array_min(F.transform("how", lambda k: F.get(place, k.cast("int"))))
    return F.coalesce(F.get(F.expr(f"array({', '.join(f'{k}L' for k in order)})"), best), F.lit(-1).cast("bigint"))


def _distinct_chars(variant, twin):
    """Non-ASCII characters of the clean text that the garbled one lacks."""
    letters = lambda c: F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7f]", ""), ""))
    return F.array_except(letters(twin), letters(variant))


def learn(documents: DataFrame, min_votes: int = 2, min_chars: int = 2, ratio: int = 4) -> dict:
    """Learn transformations from near-twins.

    Returns ``units`` (all counted units), ``twins`` (units that are a garbled
    twin) and ``chosen`` (numbers of the learned transformations). A variant is
    aligned with the most frequent variant of its key, in both directions, so
    work is linear in the number of distinct variants, whatever the size of a
    key's group; variants of other words of the same key are reached by the
    learned transformations. A transformation counts if ``min_votes`` pairs
    speak for it before all others; one between charsets of one byte a
    character, where any two letters may trade places, must explain
    ``min_chars`` different characters as well, in twins that are ``ratio``
    times as frequent.
    """
    counted = documents.select("text").where(F.col("text").isNotNull()).mapInArrow(
        _count_units, "kind string, key string, variant string, n bigint"
    )
    units = materialize(counted.groupBy("kind", "key", "variant").agg(F.sum("n").alias("n")), "units")
    told = units.where((F.col("kind") == "s") | _told("key"))
    first = told.groupBy("kind", "key").agg(
        F.max(F.struct("n", "variant")).alias("top"), F.count(F.lit(1)).alias("width")
    ).where("width > 1").select("kind", "key", F.col("top.variant").alias("twin"), F.col("top.n").alias("n_twin"))
    pairs = told.join(first, ["kind", "key"]).where("variant != twin").select(
        "kind", "key", "variant", "twin", (F.col("n_twin") >= ratio * F.col("n")).alias("rare")
    )
    # a fixed number of parts: few bytes, but much work for each
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    voted = materialize(pairs.repartition(parts, F.xxhash64("twin", "key")).mapInArrow(_vote, VOTES), "votes")
    sound = voted.where(~F.col("variant").contains(LOST)).select("variant", "twin", "how").distinct()
    every = {r["k"]: r["count"] for r in sound.select(F.explode("how").alias("k")).groupBy("k").count().collect()}
    led = sound.select(_leading(every).alias("k"), F.explode_outer(_distinct_chars(F.col("variant"), F.col("twin"))).alias("c"), "variant", "twin")
    best = led.groupBy("k").agg(F.countDistinct("variant", "twin").alias("n"), F.countDistinct("c").alias("chars")).collect()
    chosen = sorted(r["k"] for r in best if r["k"] >= 0 and r["n"] >= min_votes and (_sure(r["k"]) or r["chars"] >= min_chars))
    allowed = F.array(*[F.lit(k).cast("bigint") for k in chosen or [-1]])
    sound_twin = F.udf(lambda variant, twin: (read_back(twin, chosen) or ("",))[0] != variant, "boolean")
    twins = voted.where(F.arrays_overlap("how", allowed)).where(sound_twin("variant", "twin")).withColumn(
        "how", F.array(_leading({k: every[k] for k in chosen}))
    )
    return {"units": units, "twins": twins, "chosen": chosen}


def _apply(chosen: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                back = read_back(word, chosen)
                for image, how in _images(word, chosen).items():
                    if back and back[0] == image:  # the word is the garbled one, however frequent
                        continue
                    if len(_FOREIGN.findall(image)) >= 2 or len(_ASCII_RUN.sub("", image)) <= len(image) - 2:
                        out.append((image, word, n, how[0]))
            if out:
                yield batch_of(out, IMAGES)

    return run


#: Charsets with symbols, no letters, where UTF-8 has continuation bytes; in others a short word of letters may be itself.
SYMBOLS = {"cp1252", "latin-1", "iso8859-15", "cp1254"}


def _plausible(text: str) -> bool:
    """Whether the letters of a word are of one script and none of them is rare in any spelling."""
    if not text.isprintable() or LOST in text or any("\u0180" <= c < "\u0250" and c not in "ȘșȚț" for c in text):
        return False
    scripts = {unicodedata.name(c, "?").split()[0] for c in text if c.isalpha() and c > "\xff"}
    return len(scripts | {"LATIN" for c in text if c.isalpha() and c <= "\xff"}) <= 1


def read_back(word: str, chosen: list[int]) -> tuple[str, int] | None:
    """(clean, transformation) of a word that one of ``chosen`` reads back into
    sound UTF-8, the shortest of them; None if there is none.

    Bytes above 127 are valid UTF-8 by chance only rarely, so a lossless round
    trip is evidence however rare the word is. Charsets of one byte a character
    take any bytes and prove nothing; words written in them need a twin.
    """
    foreign = _FOREIGN.findall(word)
    best = None
    for k in chosen:
        written, read, _ = TRANSFORMS[k]
        if written != "utf-8" or read in READ_MULTI:
            continue
        if read not in SYMBOLS and len(foreign) < 6 and all(c.isalpha() for c in foreign):
            continue
        got = ungarble(word, TRANSFORMS[k])
        if got is not None and got != word and _plausible(got) and (best is None or len(got) < len(best[0])):
            best = got, k
    return best


def _read_back(chosen: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                got = read_back(word, chosen)
                if got:
                    out.append((word, *got))
            if out:
                yield batch_of(out, "word string, clean string, how bigint")

    return run


def garbled_words(units: DataFrame, chosen: list[int]) -> DataFrame:
    """(word, clean, how): words that are the image of a more frequent word, or
    that a learned transformation reads back into sound text, whatever the counts."""
    lexicon = units.where("kind = 'c'").groupBy(F.col("variant").alias("word")).agg(F.sum("n").alias("n"))
    images = lexicon.where("n > 1").select("word", "n").mapInArrow(
        _apply(chosen), IMAGES
    )
    by_count = (
        images.join(lexicon, "word")
        .where("n_clean > n")
        .groupBy("word")
        .agg(F.max(F.struct("n_clean", "clean", "how")).alias("top"))
        .select("word", "top.clean", "top.how")
    )
    back = materialize(lexicon.select("word").mapInArrow(_read_back(chosen), "word string, clean string, how bigint"), "back")
    return back.union(by_count.join(back.select("word"), "word", "left_anti"))


def _slots(key: str, bits: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key)
    return h & (bits - 1), (h >> 32) & (bits - 1)


def _bloom(keys: DataFrame, most: int = 1 << 29) -> np.ndarray:
    """A filter over ``keys(key)``: 16 bits a key, 64 MB at most. A fuller one
    lets more through to the exact join, but loses nothing."""
    n = keys.count()
    bits = min(most, 1 << max(20, (16 * n).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for s in _slots(key, bits):
                    own[s >> 3] |= 1 << (s & 7)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for row in keys.coalesce(8).mapInArrow(part, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def _probe(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = _Reader(), {}

        def hit(key: str) -> bool:
            got = known.get(key)
            if got is None:
                if len(known) > 300_000:
                    known.clear()
                got = known[key] = all(bits[s >> 3] >> (s & 7) & 1 for s in _slots(key, 8 * len(bits)))
            return got

        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not _telling(text):
                    continue
                found = {"lost"} if LOST in text else set()
                for kind, key, variant in reader.units(text):
                    full = f"{kind}\x1f{key}\x1f{variant}"
                    if hit(full):
                        found.add(full)
                    if kind == "c" and hit(word := f"w\x1f{variant}"):
                        found.add(word)
                ids += [doc] * len(found)
                keys += found
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["doc_id", "key"])

    return run


def evidence(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, word, clean, how) for every garbled unit of every document.

    ``how`` is the number of a transformation, or -1 where characters were
    lost. NULL and empty texts have none; equal texts have equal evidence; an
    empty table gives an empty result; further columns are not read.
    """
    spark = documents.sparkSession
    got = learn(documents, **options)
    words = garbled_words(got["units"], got["chosen"]).select(
        F.concat(F.lit("w\x1f"), "word").alias("key"), "word", "clean", "how"
    )
    twins = got["twins"].select(
        F.concat_ws("\x1f", "kind", "key", "variant").alias("key"),
        F.col("variant").alias("word"),
        F.col("twin").alias("clean"),
        F.element_at("how", 1).alias("how"),
    )
    flagged = materialize(words.union(twins).dropDuplicates(["key"]), "garbled")
    bits = _bloom(flagged.select("key")).tobytes()
    hits = documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(
        _probe(bits), "doc_id bigint, key string"
    )
    hits = materialize(hits, "hits")
    lost = hits.where("key = 'lost'").select(
        "doc_id", F.lit(LOST).alias("word"), F.lit("").alias("clean"), F.lit(-1).cast("bigint").alias("how")
    )
    return hits.join(flagged.hint("merge"), "key").select("doc_id", "word", "clean", "how").union(lost)


def garbled_documents(documents: DataFrame, **options) -> DataFrame:
    """Ids of the documents whose text holds a garbled passage."""
    return evidence(documents, **options).select("doc_id").distinct()


def _mend_line(line: str, known: dict[str, tuple[str, int]], reader: _Reader) -> str:
    words, how, changed = line.split(" "), Counter(), False
    for i, w in enumerate(words):
        if not _telling(w):
            continue
        hit = known.get(reader.word(w)[0])
        if hit is None:
            continue
        clean, k = hit
        if k >= 0:
            how[k] += 1
        digits = re.findall("[0-9]", _SHIFT.sub("", w) if w.isascii() and _SHIFT.search(w) else unescaped(w))
        if clean and clean.count("#") == len(digits):
            digits = iter(digits)
            words[i] = "".join(next(digits) if c == "#" else c for c in clean)
            changed = True
    if not how:
        return " ".join(words) if changed else line
    # what no known word explains: the run of strange letters is read back
    order = [k for k, _ in how.most_common()]
    original = line.split(" ")
    for i, w in enumerate(words):
        if w.isascii() or w != original[i]:
            continue
        for k in order:
            parts = [
                p if p.isascii() else ungarble(p, TRANSFORMS[k]) for p in re.split(r"([^\x00-\x7f]+)", w)
            ]
            if all(p is not None and p.isprintable() for p in parts):
                words[i] = "".join(parts)
                break
    return " ".join(words)


def restore(text: str, words: list[str], cleans: list[str], hows: list[int]) -> str:
    """``text`` with its garbled words replaced, as far as they can be had."""
    known = {w: (c, k) for w, c, k in zip(words, cleans, hows) if w != LOST}
    reader = _Reader()
    return "\n".join(_mend_line(x, known, reader) if _telling(x) else x for x in text.split("\n"))


def restored_documents(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, restored, is_whole) of every document with a garbled passage;
    ``is_whole`` is false where characters were lost for good."""
    found = evidence(documents, **options)
    per_doc = found.groupBy("doc_id").agg(
        F.collect_list("word").alias("words"), F.collect_list("clean").alias("cleans"), F.collect_list("how").alias("hows")
    )

    @F.pandas_udf("string")
    def mend(text: pd.Series, words: pd.Series, cleans: pd.Series, hows: pd.Series) -> pd.Series:
        return pd.Series([restore(*x) for x in zip(text, words, cleans, hows)])

    return (
        documents.select("doc_id", "text")
        .join(per_doc, "doc_id")
        .select("doc_id", mend("text", "words", "cleans", "hows").alias("restored"))
        .withColumn("is_whole", ~F.col("restored").contains(LOST))
    )
