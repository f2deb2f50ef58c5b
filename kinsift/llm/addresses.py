"""Postal addresses that denote the same building.

Each address is expanded into its plausible normalised forms. Combinations of
their components (house number with street, with postcode, with town) are
hashed and exploded; addresses that share any hash are candidates. A candidate
stands unless house numbers, street, kind, direction, numbered cross or main,
town or postcode conflict, as far as both sides give them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.arrow import batch_of
from kinsift.llm.strings import allowed, inside, plain, sound
from kinsift.llm.unify_text import unify
from kinsift.session import bounded_broadcast, materialize

# Words of addresses and what they stand for.
KINDS = {
    "st": "st", "street": "st", "str": "st", "strasse": "st", "rd": "rd", "road": "rd", "ave": "ave", "av": "ave",
    "avenue": "ave", "aven": "ave", "avn": "ave", "blvd": "blvd", "boulevard": "blvd", "bd": "blvd", "bul": "blvd",
    "bulevard": "blvd", "ln": "ln", "lane": "ln", "dr": "dr", "drive": "dr", "nagar": "nagar", "ngr": "nagar",
    "col": "col", "colony": "col", "cly": "col", "marg": "marg", "mrg": "marg", "rue": "rue", "r": "rue",
    "ch": "ch", "chemin": "ch", "che": "ch", "pl": "pl", "place": "pl", "ul": "ul", "ulitsa": "ul", "ulica": "ul",
    "weg": "weg", "wg": "weg", "allee": "allee", "ct": "ct", "court": "ct", "sq": "sq", "square": "sq", "hwy": "hwy",
    "highway": "hwy", "pkwy": "pkwy", "parkway": "pkwy", "ter": "ter", "terrace": "ter", "platz": "platz",
}
KIND_SUFFIXES = {"strasse": "st", "straße": "st", "str": "st", "weg": "weg", "allee": "allee", "platz": "platz"}
DIRECTIONS = {
    "n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne",
    "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw",
}
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9,
    "tenth": 10,
}
NUMBERED = {"main": "m", "cross": "c", "cr": "c"}
UNITS = {"apt", "ste", "suite", "unit", "shop", "fl", "floor", "flat", "room"}
STREET_FIRST = {"ul", "ulitsa", "ulica", "bul", "bulevard", "str", "strasse", "weg", "wg", "allee"}
HOUSE_LETTERS = {"a", "b", "c", "d"}
HOUSE_SIGNS = {"no", "nr", "number"}
BUILDINGS = {"house", "complex", "tower", "plaza"}
NEARBY = {"opp", "opposite", "near", "behind"}
LANDMARKS = {
    "city": 2, "bus": 2, "post": 2, "market": 1, "temple": 1, "gare": 1, "bahnhof": 1, "station": 1, "school": 1,
    "hospital": 1, "bank": 1,
}
STATES = {
    "nj": "nj", "oh": "oh", "ohio": "oh", "ca": "ca", "california": "ca", "ga": "ga", "georgia": "ga", "tx": "tx",
    "texas": "tx", "or": "or", "oregon": "or", "me": "me", "maine": "me", "florida": "fl", "tn": "tn", "kl": "kl",
    "kerala": "kl", "gj": "gj", "gujarat": "gj", "ka": "ka", "karnataka": "ka", "wb": "wb", "occ": "occ",
    "occitanie": "occ", "nor": "nor", "normandie": "nor", "bre": "bre", "bretagne": "bre", "by": "by", "bayern": "by",
    "he": "he", "hessen": "he", "sn": "sn", "sachsen": "sn", "pd": "pd", "plovdiv": "pd", "vn": "vn", "varna": "vn",
    "ny": "ny", "wa": "wa", "il": "il", "pa": "pa", "mh": "mh", "dl": "dl", "up": "up", "ap": "ap",
}
STATE_PAIRS = {
    ("new", "jersey"): "nj", ("tamil", "nadu"): "tn", ("west", "bengal"): "wb", ("new", "york"): "ny",
    ("north", "carolina"): "nc", ("south", "carolina"): "sc", ("west", "virginia"): "wv", ("andhra", "pradesh"): "ap",
    ("uttar", "pradesh"): "up", ("madhya", "pradesh"): "mp",
}
DEBRIS = {"addr", "tel", "state", "zip", "country", "fax", "page", "menu"}
COUNTRIES = {"usa", "us", "india", "france", "deutschland", "germany", "bulgaria", "bharat"}

_HOUSE = re.compile(r"0*([0-9]{1,4})([a-z]?)$")
_NTH = re.compile(r"([0-9]{1,2})(st|nd|rd|th)$")


def parse(text: str | None, other: str | None = None) -> tuple | None:
    """Components of an address in one reading, or None if nothing is left of it.

    (house, direction, numbered cross or main, kind, postcode, postcode is cut,
    state, street, other segments). Units, floors, building names and landmarks
    are left out. Segments are joined tokens in their sound spelling. With
    ``other`` the house is a number that is not this one, which may then be the
    start of a postcode; None if there is no such number.
    """
    if not text:
        return None
    toks = plain(unify(text)).replace(",", " ").replace(".", " ").split()
    if not toks or toks == ["<null>"]:
        return None
    k = 0
    while k + 1 < len(toks):  # a house letter that stands alone
        if toks[k].isdigit() and len(toks[k]) <= 4 and toks[k + 1] in HOUSE_LETTERS:
            toks[k : k + 2] = [toks[k] + toks[k + 1]]
        k += 1
    n = len(toks)
    role: list[tuple[str, str] | None] = [None] * n
    i = 0
    while i < n:  # phrases
        w = toks[i]
        if w in NEARBY and i + 1 < n and toks[i + 1] in LANDMARKS:
            for k in range(i, min(n, i + 1 + LANDMARKS[toks[i + 1]])):
                role[k] = ("drop", "")
            i += 1 + LANDMARKS[toks[i + 1]]
            continue
        if i + 1 < n and (w, toks[i + 1]) in STATE_PAIRS:
            role[i] = role[i + 1] = ("state", STATE_PAIRS[w, toks[i + 1]])
            i += 2
            continue
        if w in BUILDINGS and i and role[i - 1] is None and not toks[i - 1][0].isdigit():
            role[i - 1] = role[i] = ("drop", "")
        i += 1
    for i, w in enumerate(toks):  # numbered crosses and mains
        if role[i] is None and w in NUMBERED and i and role[i - 1] is None:
            v = toks[i - 1]
            nth = ORDINALS.get(v) or (int(m[1]) if (m := _NTH.match(v)) else None)
            if nth:
                role[i - 1] = role[i] = ("nth", f"{NUMBERED[w]}{nth}")
    numbers = [i for i, w in enumerate(toks) if role[i] is None and w[0].isdigit()]
    for i, w in enumerate(toks):  # units
        if role[i] is not None or w not in UNITS:
            continue
        after = i + 1
        if w == "floor" and i and role[i - 1] is None and toks[i - 1].isdigit() and len(toks[i - 1]) <= 2:
            role[i - 1] = role[i] = ("drop", "")
            continue
        if after < n and toks[after] in HOUSE_SIGNS and w == "shop":
            after += 1
        if after < n and role[after] is None and toks[after].isdigit() and len(toks[after]) <= 3:
            rest = [k for k in numbers if k != after and role[k] is None and _HOUSE.match(toks[k])]
            if w == "fl" and (after == n - 1 or not rest) and i > 1:
                role[i] = ("state", "fl")  # Florida and the start of a postcode
                if rest:
                    role[after] = ("zip", toks[after])
                continue
            for k in range(i, after + 1):
                role[k] = ("drop", "")
        elif w == "fl":
            role[i] = ("state", "fl")
        else:
            role[i] = ("drop", "")
    for i, w in enumerate(toks):
        if role[i] is None and w in STATES:
            role[i] = ("state", STATES[w])
    post, cut, house = "", False, ""
    for i, w in enumerate(toks):
        if role[i] is None and w.isdigit() and len(w) >= 5:
            role[i], post = ("zip", w), post or w
    signed = [i for i, w in enumerate(toks) if role[i] is None and i and toks[i - 1] in HOUSE_SIGNS and _HOUSE.match(w)]
    plainly = [i for i, w in enumerate(toks) if role[i] is None and _HOUSE.match(w)]
    if other is not None:
        signed = []
    if len(plainly) > 1 and not post and other is None:  # the start of a postcode behind its state
        for k in sorted(plainly, key=lambda k: (k < n - 1, not (k and role[k - 1] and role[k - 1][0] == "state"))):
            by_state = any(0 <= x < n and role[x] and role[x][0] == "state" for x in (k - 1, k + 1))
            if by_state and k and toks[k].isdigit() and k not in signed:
                role[k], post, cut = ("zip", toks[k]), toks[k], True
                plainly.remove(k)
                break
    if len(plainly) > 1 and not post and not signed and plainly[0] == 0 and other is None:
        # where the house number follows the street, a number in front is the start of a postcode
        behind = any(w in STREET_FIRST or (len(w) > 6 and w.endswith(tuple(KIND_SUFFIXES))) for w in toks)
        k = 0 if behind or plainly[1] == 1 else plainly[-1]
        if len(toks[k]) in (2, 3) and toks[k].isdigit():
            role[k], post, cut = ("zip", toks[k]), toks[k], True
            plainly.remove(k)
    houses = signed or plainly
    if other is not None:  # a number at the end is a house only where houses follow their street
        behind = any(w in STREET_FIRST or (len(w) > 6 and w.endswith(tuple(KIND_SUFFIXES))) for w in toks)
        houses = [k for k in plainly if "".join(_HOUSE.match(toks[k]).groups()) != other and (k < n - 1 or behind)]
    if other is not None and not houses:
        return None
    if houses:
        k = houses[0]
        m = _HOUSE.match(toks[k])
        house = m[1] + m[2]
        role[k] = ("house", house)
        for x in plainly:
            start = x == n - 1 or (other is not None and toks[x].isdigit() and len(toks[x]) in (2, 3))
            if x != k and role[x] is None and not post and start:
                role[x], post, cut = ("zip", toks[x]), toks[x], True
            elif x != k and role[x] is None:
                role[x] = ("drop", "")
    if not post:
        for i, r in enumerate(role):
            if r and r[0] == "zip":
                post, cut = r[1], True
    way = nth = kind = state = ""
    segments: list[list[str]] = [[]]
    first_after = None
    for i, w in enumerate(toks):
        r = role[i]
        if r is None and w in HOUSE_SIGNS:
            r = ("drop", "")
        if r is None and w in DIRECTIONS and not way:
            r, way = ("way", w), DIRECTIONS[w]
        if r is None and w in KINDS and not (w == "st" and i + 1 < n and kind):
            r, kind = ("kind", w), kind or KINDS[w]
        if r is None and w in STATES:
            r = ("state", STATES[w])
        if r is None:
            for suffix, k in KIND_SUFFIXES.items():
                if w.endswith(suffix) and len(w) > len(suffix) + 1 and not kind:
                    kind, w = k, w[: -len(suffix)]
                    segments[-1].append(w)
                    if first_after is None and house:
                        first_after = len(segments) - 1
                    segments.append([])
                    r = ("done", "")
                    break
        if r is None:
            if w in ORDINALS or _NTH.match(w):
                continue
            segments[-1].append(w)
            continue
        if r[0] == "nth" and not nth:
            nth = r[1]
        if r[0] == "state" and not state:
            state = r[1]
        if r[0] != "done" and segments[-1]:
            segments.append([])
    joined = [sound("".join(s)) for s in segments if s]
    if not joined and not house:
        return None
    return (house, way, nth, kind, post, cut, state, tuple(joined))


def readings(text: str | None) -> list[tuple]:
    """All plausible forms of an address, the likeliest first.

    A text with several numbers, none of them marked as the house, is read with
    each of two as the house, where a house may stand, and the other as the
    start of a postcode or of no account; ``fl`` beside a short number is read as Florida and as a floor.
    """
    first = parse(text)
    if first is None:
        return []
    out = [first]
    if not HOUSE_SIGNS & set(plain(text).replace(".", " ").replace(",", " ").split()):
        turned = parse(text, first[0]) if first[0] else None
        if turned and turned[7]:
            out.append(turned)
    out += [(*x[:4], "", False, "", x[7]) for x in out if x[5] and x[6] == "fl"]
    return list(dict.fromkeys(out))


def from_tokens(words: list[str] | None, numbers: list[str] | None) -> str | None:
    """An address text from token lists: debris and country words go, numbers
    are put where their words are."""
    words = [plain(unify(w)) for w in (words if words is not None else []) if w]
    numbers = [plain(unify(x)) for x in (numbers if numbers is not None else []) if x]
    kept = []
    for i, w in enumerate(words):
        hall = w == "city" and i + 1 < len(words) and words[i + 1] == "hall"
        if (w in DEBRIS or w in COUNTRIES or w == "city") and not hall:
            continue
        kept.append(w)
    if not kept and not numbers:
        return None
    nths = [x for x in numbers if _NTH.match(x)]
    posts = [x for x in numbers if x.isdigit() and len(x) >= 5]
    small = [x for x in numbers if x not in nths and x not in posts]
    out: list[str] = []
    unit = next((i for i, w in enumerate(kept) if w in UNITS and w != "fl"), None)
    if unit is None:
        unit = next((i for i, w in enumerate(kept) if w == "fl"), None) if len(small) > 1 else None
    lead: list[str] = []
    if unit is not None and len(small) > 1:
        early = unit == 0 or kept[unit - 1] in HOUSE_SIGNS
        lead = ["unit", small.pop(0) if early else small.pop(1)]
        kept = [w for i, w in enumerate(kept) if i != unit]
    for i, w in enumerate(kept):
        if w in HOUSE_SIGNS:
            continue
        if w in NUMBERED and nths and (not out or out[-1] not in ORDINALS):
            out.append(nths.pop(0))
        out.append(w)
    return " ".join([*lead, *small[:1], *out, *small[1:], *posts]) or None


def _segment_fits(part: str, whole: str, more: int) -> bool:
    limit = allowed(len(part)) + (10 <= len(part) < 14)
    return inside(part, whole) <= limit + more * (limit > 1)


def same_building(a: tuple, b: tuple) -> bool:
    """Whether two parsed addresses agree in all that both give."""
    if not a[0] or a[0] != b[0]:
        return False
    for x, y in ((a[1], b[1]), (a[2], b[2]), (a[3], b[3]), (a[6], b[6])):
        if x and y and x != y:
            return False
    if a[4] and b[4]:
        if a[5] or b[5]:
            k = min(len(a[4]), len(b[4]))
            if a[4][:k] != b[4][:k]:
                return False
        elif a[4] != b[4]:
            return False
    if not a[7] or not b[7]:
        return False
    wa, wb = "".join(a[7]), "".join(b[7])
    wa2, wb2 = "".join(reversed(a[7])), "".join(reversed(b[7]))
    # house and whole postcode agree: the names may differ by more slips
    more = 2 if a[4] and b[4] and not a[5] and not b[5] else 0
    left_a = [s for s in a[7] if not (_segment_fits(s, wb, more) or _segment_fits(s, wb2, more))]
    left_b = [s for s in b[7] if not (_segment_fits(s, wa, more) or _segment_fits(s, wa2, more))]
    if left_a and left_b:
        return False
    return len(left_a) < len(a[7]) or len(left_b) < len(b[7])


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


PARSED = (
    "entity_id string, atok string, reading int, form bigint, house string, way string, nth string, kind string, post string, "
    "cut boolean, state string, segs array<string>"
)


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for entity, atok, words, numbers in zip(*(c.to_pylist() for c in batch.columns)):
            for k, got in enumerate(readings(atok) or readings(from_tokens(words, numbers))):
                if got[0] and got[7]:
                    out.append((entity, atok, k, _hash(repr(got)), *got[:7], list(got[7])))
        if out:
            yield batch_of(out, PARSED)


def parsed_addresses(records: DataFrame, record_tokens: DataFrame) -> DataFrame:
    """One row per record, address text and plausible reading, with its components.

    The address of records counts; where it is missing (NULL, empty or a
    placeholder) the token lists stand in. Records without any, and addresses
    without house number or names, which denote no building, drop out.
    """
    missing = "atok is null or trim(atok) in ('', '<null>')"
    rows = records.select("entity_id", "atok").where("entity_id is not null").distinct()
    lists = (
        record_tokens.select("entity_id", "business_address_tokens", "business_address_numbers")
        .where("size(business_address_tokens) > 0 or size(business_address_numbers) > 0")
        .groupBy("entity_id")
        .agg(F.max(F.struct("business_address_tokens", "business_address_numbers")).alias("t"))
    )
    stand_in = (
        rows.where(missing)
        .join(lists, "entity_id")
        .select(
            "entity_id", F.lit(None).cast("string").alias("atok"),
            F.col("t.business_address_tokens").alias("words"), F.col("t.business_address_numbers").alias("numbers"),
        )
    )
    none = F.lit(None).cast("array<string>")
    given = rows.where(f"not ({missing})").select("entity_id", "atok", none.alias("words"), none.alias("numbers"))
    # a fixed number of parts: few bytes, but much work for each
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return given.union(stand_in).repartition(parts, F.xxhash64("entity_id", "atok")).mapInArrow(_parse_rows, PARSED)


def _keys(house: str, post: str, cut: bool, segs: list[str]) -> set[int]:
    """Hashes of component combinations of one address."""
    out = set()
    if post and not cut:
        out.add(_hash("p", house, post))
    for s in segs:
        out.add(_hash("s", house, s))
        if len(s) >= 5:
            out.update(_hash("s", house, s[:i] + s[i + 1 :]) for i in range(len(s)))
            out.add(_hash("b", house, s[:6]))
            out.add(_hash("e", house, s[-6:]))
    for i, a in enumerate(segs):
        for j, b in enumerate(segs):
            if i != j:
                out.add(_hash("c", house, a[:4], b[:3]))
                out.add(_hash("d", house, a[-4:], b[:3]))
    if post:
        out.update(_hash("z", house, post[:2], a[:3]) for a in segs)
    return out


def _traits(*parts: str) -> int:
    """15 bits of each part, 0 where it is not given: parts that differ here conflict."""
    out = 0
    for part in parts:
        out = out << 15 | (1 + xxhash.xxh64_intdigest(part) % 32767 if part else 0)
    return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, keys, traits = [], [], []
        for form, house, post, cut, segs, *told in zip(*(c.to_pylist() for c in batch.columns)):
            got = _keys(house, post, cut, segs)
            forms += [form] * len(got)
            traits += [_traits(*told)] * len(got)
            keys += got
        yield pa.RecordBatch.from_arrays(
            [pa.array(forms, pa.int64()), pa.array(keys, pa.int64()), pa.array(traits, pa.int64())], ["form", "key", "traits"]
        )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = [], []
        cols = [c.to_pylist() for c in batch.columns]
        for a, b, x, y in zip(*cols):
            px = (*[x[k] for k in ("house", "way", "nth", "kind", "post", "cut", "state")], tuple(x["segs"]))
            py = (*[y[k] for k in ("house", "way", "nth", "kind", "post", "cut", "state")], tuple(y["segs"]))
            if same_building(px, py):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


#: A key that more forms share is dealt into parts of about this size.
CROWD = 1000


def same_forms(parsed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different parsed forms that denote the same building.

    An address has a form for each of its readings, and every key of every form counts, however many share it: the forms of a
    crowded key are dealt into parts on one side of the join and copied to each
    part on the other. Pairs whose direction, cross or main, kind or state
    conflict go in the join.
    """
    parts = ["house", "way", "nth", "kind", "post", "cut", "state", "segs"]
    forms = materialize(parsed.select("form", *parts).dropDuplicates(["form"]), "forms")
    keyed = forms.select("form", "house", "post", "cut", "segs", "way", "nth", "kind", "state")
    keyed = materialize(keyed.mapInArrow(_expand, "form bigint, key bigint, traits bigint"), "keys")
    crowded = keyed.groupBy("key").count().where(F.col("count") > CROWD).select(
        "key", F.ceil(F.col("count") / CROWD).cast("int").alias("parts")
    )
    keyed = keyed.join(bounded_broadcast(materialize(crowded, "crowded"), 50_000), "key", "left")
    deal = F.coalesce("parts", F.lit(1))
    left = keyed.select(F.col("form").alias("a"), "key", F.col("traits").alias("ta"), F.pmod(F.xxhash64("form"), deal).cast("int").alias("part"))
    right = keyed.select(F.col("form").alias("b"), "key", F.col("traits").alias("tb"), F.explode(F.sequence(F.lit(0), deal - 1)).alias("part"))
    at = lambda c, k: F.shiftright(c, 15 * k).bitwiseAND(F.lit(32767))
    agree = F.lit(True)
    for k in range(4):
        x, y = at("ta", k), at("tb", k)
        agree = agree & ((x == 0) | (y == 0) | (x == y))
    pairs = left.join(right, ["key", "part"]).where(F.col("a") < F.col("b")).where(agree).select("a", "b").distinct()
    side = forms.select("form", F.struct(*parts).alias("x"))
    both = pairs.join(side.toDF("a", "xa"), "a").join(side.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    return both.mapInArrow(_judge, "a bigint, b bigint")


def linked_classes(records: DataFrame, record_tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members(c, entity_id), pairs(ca, cb)): a class is all records with one
    ``atok`` text, or one record without; pairs of classes at the same building
    stand for all pairs of their records."""
    parsed = materialize(parsed_addresses(records, record_tokens), "parsed")
    links = materialize(same_forms(parsed), "links")
    member = parsed.select(
        "form", "entity_id", "reading", F.coalesce(F.concat(F.lit("t:"), "atok"), F.concat(F.lit("e:"), "entity_id")).alias("c")
    )
    one = member.groupBy("form", "c").agg((F.min("reading") == 0).alias("likely"))
    # second readings of both sides prove nothing
    within = (
        one.select("form", F.col("c").alias("ca"), F.col("likely").alias("la"))
        .join(one.select("form", F.col("c").alias("cb"), F.col("likely").alias("lb")), "form")
        .where("ca < cb and (la or lb)")
        .select("ca", "cb")
    )
    across = (
        links.join(one.select(F.col("form").alias("a"), F.col("c").alias("ca"), F.col("likely").alias("la")), "a")
        .join(one.select(F.col("form").alias("b"), F.col("c").alias("cb"), F.col("likely").alias("lb")), "b")
        .where("ca != cb and (la or lb)")
        .select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
    )
    return member.select("c", "entity_id").distinct(), within.union(across).distinct()


def same_address_pairs(records: DataFrame, record_tokens: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b), a < b, of records at the same building.

    Pairs with equal ``atok`` are left out; a NULL ``atok`` equals nothing. An
    entity with several addresses pairs by any of them; repeated rows change
    nothing; empty tables give no pairs; further columns are not read.
    """
    of, classes = linked_classes(records, record_tokens)
    return (
        classes.join(of.toDF("ca", "x"), "ca")
        .join(of.toDF("cb", "y"), "cb")
        .where("x != y")
        .select(F.least("x", "y").alias("entity_id_a"), F.greatest("x", "y").alias("entity_id_b"))
        .distinct()
    )


def address_links(records: DataFrame, record_tokens: DataFrame) -> DataFrame:
    """(entity_id, class, n_links): one row per record and address text with the
    number of records of other texts at the same building; no pair of records
    is made. The class is a hash of the text; the rest as in
    :func:`same_address_pairs`."""
    of, classes = linked_classes(records, record_tokens)
    of = materialize(of, "members")
    size = of.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    ends = classes.select(F.col("ca").alias("c"), F.col("cb").alias("o")).union(classes.select(F.col("cb").alias("c"), F.col("ca").alias("o")))
    n = ends.join(size.withColumnRenamed("c", "o"), "o").groupBy("c").agg(F.sum("n").alias("n_links"))
    return of.join(n, "c", "left").select("entity_id", F.xxhash64("c").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
