"""Text rules of the pipeline as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Legal words and stop words of names, and their canonical form.
LEGAL = (
    "inc", "incorporated", "llc", "ltd", "limited", "pvt", "private", "corp", "corporation", "co", "company", "llp",
    "lp", "plc", "sarl", "sas", "sasu", "sa", "eurl", "sci", "gmbh", "pty", "the", "and", "of", "de", "la", "le", "les",
    "du", "des", "et", "en", "un", "public", "ltda", "opc", "pllc", "pc", "ag", "nv", "bv", "com", "net", "org", "www",
    "http", "https", "formerly", "dba", "fka", "smt", "shri", "sri", "m", "s",
)
LEGAL_CANON = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd", "private": "pvt"}
# French legal forms that are asked for apart.
FRENCH_LEGAL = ("snc", "cie", "ets", "ei")
FRENCH_CANON = {"etablissements": "ets", "etablissement": "ets"}
# Abbreviations of addresses: streets, parts of buildings, ordinals, French and Indian words.
ABBR = {
    "street": "st", "str": "st", "saint": "st", "road": "rd", "avenue": "ave", "av": "ave", "avenu": "ave",
    "boulevard": "blvd", "bd": "blvd", "boulevar": "blvd", "bld": "blvd", "drive": "dr", "lane": "ln", "court": "ct",
    "place": "pl", "square": "sq", "highway": "hwy", "parkway": "pkwy", "circle": "cir", "terrace": "ter",
    "trail": "trl", "way": "wy", "north": "n", "south": "s", "east": "e", "west": "w", "suite": "ste",
    "apartment": "apt", "floor": "fl", "building": "bldg", "cross": "cr", "first": "1", "second": "2", "third": "3",
    "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10", "1st": "1",
    "2nd": "2", "3rd": "3", "4th": "4", "5th": "5", "6th": "6", "7th": "7", "8th": "8", "9th": "9", "10th": "10",
    "r": "rue", "chemin": "ch", "che": "ch", "impasse": "imp", "allee": "all", "route": "rte", "passage": "pass",
    "quai": "qu", "cours": "crs", "faubourg": "fg", "fbg": "fg", "residence": "res", "zone": "z", "colony": "col",
    "cly": "col", "sector": "sec", "phase": "ph", "opposite": "opp", "number": "no", "num": "no",
}
# Words an address loses.
ADDR_DROP = (
    "no", "h", "hno", "door", "dno", "plot", "pmb", "null", "nr", "near", "opp", "behind", "flat", "house", "the", "and",
    "of", "de", "la", "le", "du", "des", "&",
)
# States and territories of the United States and of India, several words joined.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "newhampshire": "nh", "newjersey": "nj",
    "newmexico": "nm", "newyork": "ny", "northcarolina": "nc", "northdakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhodeisland": "ri", "southcarolina": "sc", "southdakota": "sd",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "westvirginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
IN_STATES = {
    "andhrapradesh": "ap", "arunachalpradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga",
    "gujarat": "gj", "haryana": "hr", "himachalpradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhyapradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl",
    "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamilnadu": "tn",
    "telangana": "tg", "tripura": "tr", "uttarpradesh": "up", "uttarakhand": "uk", "westbengal": "wb", "delhi": "dl",
    "jammuandkashmir": "jk", "jammukashmir": "jk", "chandigarh": "ch", "puducherry": "py", "ladakh": "la",
}
STATES = US_STATES | IN_STATES
# States of several words that are joined before they are looked up, in this order.
JOINED_STATES = (
    "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "rhode island",
    "south carolina", "south dakota", "west virginia", "andhra pradesh", "arunachal pradesh", "himachal pradesh",
    "madhya pradesh", "tamil nadu", "uttar pradesh", "west bengal", "jammu and kashmir",
)
# French months, folded.
MONTHS = (
    "janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre",
)

_ASCII = r"^[\x00-\x7f]*$"
_KEPT = r"0-9a-z\x{900}-\x{DFF}\x{4E00}-\x{9FFF}"


def fold_text(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not "̀" <= c <= "ͯ")


@F.pandas_udf(StringType())
def _fold_rest(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


def fold(c: Column) -> Column:
    """Lower case, compatibility decomposition, combining marks dropped. ASCII
    never leaves the JVM; the rest goes through Arrow."""
    plain = c.rlike(_ASCII)
    return F.coalesce(F.when(plain, F.lower(c)), _fold_rest(F.when(~plain, c)))


def squash(c: Column) -> Column:
    """Runs of anything but digits, Latin letters and Indic or Han letters become one blank."""
    return F.trim(F.regexp_replace(c, f"[^{_KEPT}]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), " +"), lambda w: w != "")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _mapped(arr: Column, table: dict[str, str]) -> Column:
    m = _map(table)
    return F.transform(arr, lambda w: F.coalesce(m[w], w))


def name_tokens(folded: Column) -> Column:
    """Tokens of a folded name, before legal words are told apart."""
    t = F.replace(folded, F.lit("&"), F.lit(" and "))
    for end in (".com", ".net", ".org"):
        t = F.replace(t, F.lit(end), F.lit(" "))
    return words(squash(t))


def split_legal(tokens: Column, french: bool = False) -> Column:
    """struct(core, legal): tokens without and with the legal words, canonical;
    a name of nothing else keeps them as its core and has no legal part."""
    toks = _mapped(tokens, LEGAL_CANON | FRENCH_CANON if french else LEGAL_CANON)
    law = F.array(*[F.lit(x) for x in (LEGAL + FRENCH_LEGAL if french else LEGAL)])
    core = F.filter(toks, lambda w: ~F.array_contains(law, w))
    rest = F.filter(toks, lambda w: F.array_contains(law, w))
    empty = F.array().cast("array<string>")
    return F.struct(
        F.when(F.size(core) > 0, core).otherwise(rest).alias("core"), F.when(F.size(core) > 0, rest).otherwise(empty).alias("legal")
    )


def norm_name(c: Column, french: bool = False) -> Column:
    """struct(core, legal) of a name as it is written."""
    return split_legal(name_tokens(fold(c)), french)


def norm_folded_addr(folded: Column) -> Column:
    """Tokens of a folded address: states joined and coded, abbreviations
    applied, filler and foreign-script words gone, order kept. A token with a
    digit is cut at - and /, its parts lose leading zeros, and what several
    parts make together follows them."""
    t = F.replace(F.replace(folded, F.lit("<null>"), F.lit(" ")), F.lit("&"), F.lit(" "))
    for state in JOINED_STATES:
        t = F.replace(t, F.lit(state), F.lit(state.replace(" ", "")))
    toks = words(F.regexp_replace(t, f"[^{_KEPT}/\\-]+", " "))
    states, short, drop = _map(STATES), _map(ABBR), F.array(*[F.lit(x) for x in ADDR_DROP])
    empty = F.array().cast("array<string>")

    def one(token: Column) -> Column:
        parts = F.filter(F.split(token, "[-/]"), lambda p: p != "")
        bare = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
        whole = F.array_join(bare, "")
        numbers = F.concat(
            F.transform(bare, lambda p: F.when(p == "", "0").otherwise(p)),
            F.when((F.size(parts) > 1) & (whole != ""), F.array(whole)).otherwise(empty),
        )
        named = F.transform(F.filter(parts, lambda p: p.rlike(_ASCII)), lambda p: F.coalesce(states[p], p))
        named = F.filter(F.transform(named, lambda p: F.coalesce(short[p], p)), lambda p: ~F.array_contains(drop, p))
        return F.when(token.rlike(r"\p{Nd}"), numbers).otherwise(named)

    return F.flatten(F.transform(toks, one))


def norm_addr(c: Column) -> Column:
    """Tokens of an address as it is written."""
    return norm_folded_addr(fold(c))


def index_tokens(core: Column, addr: Column) -> Column:
    """Namespaced tokens of a record: words, prefixes, 4-grams, joined words,
    address tokens, address bigrams with a number, and name-address composites."""
    empty = F.array().cast("array<string>")
    ascii_long = F.filter(core, lambda w: (F.length(w) >= 5) & w.rlike(_ASCII))
    grams = F.flatten(
        F.transform(ascii_long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 3), lambda k: F.concat(F.lit("g:"), F.substring(w, k, F.lit(4)))))
    )
    joined = F.array_join(core, "")
    two = F.array_join(F.slice(core, 1, 2), "")
    three = F.array_join(F.slice(core, 1, 3), "")
    name = F.concat(
        F.transform(core, lambda w: F.concat(F.lit("n:"), w)),
        F.transform(F.filter(core, lambda w: F.length(w) >= 6), lambda w: F.concat(F.lit("np:"), F.substring(w, 1, 5))),
        grams,
        F.when(F.size(core) > 0, F.array(F.concat(F.lit("ne:"), joined), F.concat(F.lit("nc:"), two))).otherwise(empty),
        F.when((F.size(core) == 1) | (F.size(core) > 2), F.array(F.concat(F.lit("nc3:"), three))).otherwise(empty),
    )
    digit = lambda w: w.rlike(r"^\p{Nd}")
    place = F.concat(
        F.transform(addr, lambda w: F.concat(F.lit("a:"), w)),
        F.transform(F.filter(addr, lambda w: (F.length(w) >= 6) & ~w.rlike(r"^\p{Nd}+$")), lambda w: F.concat(F.lit("ap:"), F.substring(w, 1, 5))),
    )
    less = F.greatest(F.size(addr) - 1, F.lit(0))
    pairs = F.transform(
        F.filter(
            F.arrays_zip(F.slice(addr, F.lit(1), less).alias("a"), F.slice(addr, F.lit(2), less).alias("b")),
            lambda p: digit(p["a"]) | digit(p["b"]),
        ),
        lambda p: F.concat(F.lit("ab:"), p["a"], F.lit("_"), p["b"]),
    )
    lead = F.slice(F.filter(core, lambda w: F.length(w) >= 3), 1, 4)
    long = F.array_distinct(F.filter(addr, lambda w: F.length(w) >= 2))
    ends = F.when(F.size(long) <= 12, long).otherwise(F.concat(F.slice(long, 1, 6), F.slice(long, -6, 6)))
    both = F.flatten(F.transform(lead, lambda n: F.transform(ends, lambda a: F.concat(F.lit("nx:"), n, F.lit("|"), a))))
    return F.array_distinct(F.concat(name, place, pairs, both))


def channel(token: Column) -> Column:
    """name, composite or address, by the token's namespace."""
    return (
        F.when(token.rlike("^(n|np|nc|nc3|g|ne):"), "name").when(token.startswith("nx:"), "composite").otherwise("address")
    )


def house_numbers(addr: Column) -> Column:
    """Numbers of at most nine digits, in order."""
    return F.transform(F.filter(addr, lambda w: w.rlike("^[0-9]{1,9}$")), lambda w: w.cast("bigint"))


def fixed_numbers(addr: Column, glued: bool = False) -> Column:
    """House numbers without the day before and the year behind a French month;
    bis, ter and quater, and with ``glued`` one letter, come off the digits."""
    months = F.array(*[F.lit(m) for m in MONTHS])
    month = lambda i: F.coalesce(F.array_contains(months, F.get(addr, i)), F.lit(False))
    dated = lambda w, i: (w.rlike("^[0-9]{1,2}(er)?$") & month(i + 1)) | (w.rlike("^(1[5-9][0-9]{2}|20[0-9]{2})$") & month(i - 1))
    tail = "(bis|ter|quater|[a-z])?" if glued else "(bis|ter|quater)?"
    kept = F.filter(addr, lambda w, i: ~dated(w, i) & w.rlike(f"^[0-9]{{1,9}}{tail}$"))
    return F.transform(kept, lambda w: F.regexp_extract(w, "^[0-9]+", 0).cast("bigint"))
