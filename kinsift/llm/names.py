"""Names of organisations and persons as different people type them.

Frequent words (first names, trades) are learned from the corpus and told apart
from the words that identify. The q-grams of the identifying part, padded with
its own beginning so that swapped parts keep theirs, are min-hashed and banded;
the number of bands follows from the collision curve. Candidates are verified
by Monge-Elkan similarity over tokens, and star clustering gathers variants
around the best-attested spelling.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.arrow import batch_of, small
from kinsift.llm.strings import allowed, inside, plain, sound, within
from kinsift.llm.unify_text import unify
from kinsift.session import bounded_broadcast, discard, materialize, reclaim

# Short forms of first names.
NICKNAMES = {
    "mitko": "dimitar", "mike": "michael", "hannes": "johannes", "fritz": "friedrich", "sue": "susan",
    "fanfan": "francois", "joe": "joseph", "dede": "andre", "tony": "anthony", "will": "william", "bill": "william",
    "venkat": "venkatesh", "venky": "venkatesh", "tom": "thomas", "tommy": "thomas", "dick": "richard",
    "rick": "richard", "liz": "elizabeth", "beth": "elizabeth", "kathy": "katherine", "kate": "katherine",
    "jimmy": "james", "jim": "james", "lena": "helene", "maggie": "margaret", "peggy": "margaret", "kris": "krishnan",
    "kittu": "krishnan", "eddie": "edward", "ted": "edward", "laxmi": "lakshmi", "lachu": "lakshmi",
    "bobby": "robert", "bob": "robert", "rob": "robert",
}
FIRST_NAMES = set(NICKNAMES.values())
# Short forms of trades that no rule gives.
TRADE_SHORT = {
    "hdwe": "hardware", "mgmt": "management", "intl": "international", "mfg": "manufacturing", "engg": "engineering",
    "tpt": "transport", "svcs": "services", "agcs": "agencies", "roofg": "roofing", "plmbg": "plumbing",
    "ents": "enterprises", "labs": "laboratories", "logs": "logistics", "cof": "coffee", "cff": "coffee",
    "exp": "exports", "off": "office", "glry": "gallery", "rest": "restaurant",
}
# Trades known before any counting.
TRADES = (
    "dental", "office", "international", "construction", "roofing", "management", "coffee", "bakery", "enterprises",
    "jewellers", "furniture", "agencies", "printers", "transport", "hardware", "restaurant", "laboratories",
    "stationers", "pharmacy", "technologies", "gallery", "manufacturing", "distributors", "fitness", "electrical",
    "logistics", "plumbing", "engineering", "textiles", "automotive", "associates", "traders", "motors", "services",
    "exports",
)
# Legal forms and their long or spaced spellings.
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp",
    "co": "co", "company": "co", "llc": "llc", "llp": "llp", "pvt": "pvt", "private": "pvt", "opc": "opc", "p": "pvt",
    "the": "", "sa": "sa", "ste": "sa", "sas": "sas", "sasu": "sas", "sarl": "sarl", "eurl": "eurl", "ug": "ug",
    "haftungsbeschrankt": "", "gmbh": "gmbh", "ges": "gmbh", "mbh": "", "ag": "ag", "ood": "ood", "eood": "eood",
}
LINKS = {"and", "&", "und", "et", "i", "y"}

_VOWELS = re.compile("[aeiou]")
_DOUBLED = re.compile(r"(.)\1+")


def _bones(word: str) -> str:
    return _DOUBLED.sub(r"\1", word[:1] + _VOWELS.sub("", word[1:]))


class Lexicon:
    """Frequent words of names and what each of them stands for."""

    def __init__(self, counts: list[tuple[str, int, int]]) -> None:
        """``counts``: (word, occurrences, occurrences in front)."""
        self.base: dict[str, tuple[str, str]] = {n: ("first", n) for n in FIRST_NAMES}
        self.base |= {t: ("trade", t) for t in TRADES}
        self.size = 0
        self.trades: list[str] = list(TRADES)
        for word, n, front in sorted(counts, key=lambda x: (-x[1], x[0])):
            if len(word) < 3 or word in LEGAL or word in LINKS or word in self.base or word in NICKNAMES:
                continue
            known = self.match(word)
            if known:
                self.base[word] = known
            elif front * 2 > n:
                self.base[word] = ("first", word)
            else:
                self.base[word] = ("trade", word)
                self.trades.append(word)
        ends = dict(self.base)
        for t in self.trades:
            for w in (t + "s", _bones(t)):
                if len(w) >= 4:
                    ends.setdefault(w, ("trade", t))
        #: what may be glued to another word, the longest first
        self.glued = sorted(((w, *ends[w]) for w in ends if len(w) >= 4), key=lambda x: (-len(x[0]), x[0]))
        self.memo: dict[str, tuple[str, str] | None] = {}

    def match(self, word: str) -> tuple[str, str] | None:
        """(kind, stands for) of a word, or None."""
        got = self.base.get(word)
        if got:
            return got
        if word in NICKNAMES:
            return ("first", NICKNAMES[word])
        if word in TRADE_SHORT:
            return ("trade", TRADE_SHORT[word])
        if len(word) < 4:
            return None
        bones = _bones(word) if not _VOWELS.search(word[1:]) else None
        for name, flat in self.near_trades(word[0]):
            if word == name + "s" or name == word + "s" or (len(name) > len(word) and name.startswith(word)):
                return ("trade", name)
            if bones and (bones == flat or (bones[-1:] == "s" and bones[:-1] == flat)):
                return ("trade", name)
        if len(word) < 5:
            return None
        best, best_at, heard = None, 9, sound(word)
        for kind, name, said in self.near_names(word[0]):
            if abs(len(heard) - len(said)) <= 2:
                limit = 1 if len(name) < 8 else 2
                at = within(heard, said, limit)
                if at <= limit and at < best_at:
                    best, best_at = (kind, name), at
        return best

    def near_trades(self, letter: str) -> list[tuple[str, str]]:
        """Trades that start with a letter, with their consonants."""
        if len(self.trades) != self.size:
            self.size, self.by_start, self.by_near = len(self.trades), {}, {}
        got = self.by_start.get(letter)
        if got is None:
            got = self.by_start[letter] = [(t, _bones(t)) for t in self.trades if t[0] == letter]
        return got

    def near_names(self, letter: str) -> list[tuple[str, str, str]]:
        """All words that have a letter among their first two, with their sound."""
        got = self.by_near.get(letter)
        if got is None:
            every = [("trade", t) for t in self.trades] + [("first", f) for f in sorted(FIRST_NAMES)]
            got = self.by_near[letter] = [(k, w, sound(w)) for k, w in every if letter in w[:2]]
        return got

    def __call__(self, word: str) -> tuple[str, str] | None:
        if word not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = self.match(word)
        return self.memo[word]


def learn_lexicon(records: DataFrame, share: float = 0.001, least: int = 40) -> list[tuple[str, int, int]]:
    """Words that stand in ``share`` of all names and in ``least`` more, which is
    more than one organisation has, with the number of times they stand in
    front. At most ``tokens per name / share`` words can qualify, so what
    reaches the driver is bounded whatever the size of the table."""
    names = records.where("core is not null").select("entity_id", "core").distinct()
    total = names.count()
    words = names.mapInArrow(_words, "word string, n bigint, front bigint")
    rows = (
        words.groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("front").alias("front"))
        .where(F.col("n") >= least + math.ceil(share * total))
        .collect()
    )
    return [(r["word"], r["n"], r["front"]) for r in rows]


def tokens_of(core: str) -> list[str]:
    return [w for w in plain(unify(core)).replace(".", " ").replace(",", " ").split() if w not in LINKS]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    n, front = Counter(), Counter()
    for batch in batches:
        for core in batch.column("core").to_pylist():
            toks = tokens_of(core)
            n.update(set(toks))
            front.update(toks[:1] if len(toks) > 1 else [])
    keys = list(n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([front[k] for k in keys], pa.int64())],
        ["word", "n", "front"],
    )


def legal_form(text: str | None) -> str:
    """One spelling of a legal form; empty if there is none."""
    if not text:
        return ""
    toks = plain(text).split()
    if toks == ["<null>"]:
        return ""
    if len(toks) > 2 and all(len(t) == 1 for t in toks):
        toks = ["".join(toks)]
    return " ".join(sorted({LEGAL.get(t, t) for t in toks} - {""}))


def parse_name(core: str, legal: str | None, known: Lexicon) -> tuple[str, str, tuple[str, ...], str]:
    """(first name, trade, identifying tokens, legal form) of a name."""
    toks = tokens_of(core)
    form = legal_form(legal)
    tail: list[str] = []
    while len(toks) > 1 and toks[-1] in LEGAL and (len(toks) > 2 or toks[-1] not in ("p", "the")):
        tail.insert(0, toks.pop())
    while len(toks) > 2 and toks[0] in LEGAL and toks[0] != "p":
        tail.append(toks.pop(0))
    k = len(toks)
    while k > 2 and len(toks[k - 1]) == 1:
        k -= 1
    if len(toks) - k >= 3:
        tail = ["".join(toks[k:])]
        toks = toks[:k]
    if not form and tail:
        form = legal_form(" ".join(tail))
    first = trade = ""
    rest: list[str] = []
    hits = [known(w) if len(w) > 1 else None for w in toks]
    # a word that is known as it stands goes before one that is only near
    sure = {h[0] for w, h in zip(toks, hits) if h and (w in known.base or w in NICKNAMES or w in TRADE_SHORT)}
    for i, (w, hit) in enumerate(zip(toks, hits)):
        if hit and hit[0] in sure and not (w in known.base or w in NICKNAMES or w in TRADE_SHORT):
            hit = None
        if hit and hit[0] == "first" and not first:
            first = hit[1]
            continue
        if hit and hit[0] == "trade" and not trade:
            trade = hit[1]
            continue
        if len(w) == 1 and i == 0 and len(toks) > 2 and w.isalpha():
            first = first or w
            continue
        rest.append(w)
    # words run together: a frequent word at either end of a token comes off
    if not trade or not first:
        for i, w in enumerate(rest):
            for common, kind, name in known.glued:
                if len(w) < len(common) + 3 or (trade if kind == "trade" else first):
                    continue
                if w.endswith(common) and kind == "trade" and (len(common) >= 5 or not _VOWELS.search(common[1:])):
                    trade, w = name, w[: -len(common)]
                elif w.startswith(common) and (kind == "first" or len(common) >= 5):
                    w = w[len(common) :]
                    first, trade = (name, trade) if kind == "first" else (first, name)
                rest[i] = w
    if not rest:
        rest = [w for w in toks]
    heard = tuple(sound(w.replace("and", "", 1)) if len(w) > 14 and "and" in w else sound(w) for w in rest)
    return first, trade, heard, form


def _slips(token: str, whole: str, turned: str) -> int:
    """Edits of a token against the other side; what is cut off behind its
    fourth letter counts as one."""
    slips = min(inside(token, whole), inside(token, turned))
    if slips > 1 and len(token) >= 6 and slips <= len(token) - 4 and (token[:4] in whole or token[:4] in turned):
        return 1
    return slips


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Mean over the tokens of one side of their best likeness in the other, the
    lower of both directions; 0 if a token of either side has no counterpart.
    Tokens are sought in the joined other side, so split words do no harm. A
    token may carry two slips, or three where all others are all but sound."""
    low = 1.0
    for x, y in ((a, b), (b, a)):
        whole, turned = "".join(y), "".join(reversed(y))
        total, score = 0, 0.0
        for t in x:
            size = len(t)
            n = _slips(t, whole, turned)
            if n > (allowed(size) if size < 6 else 2 if size < 7 else 3) or (size < 4 and len(x) == 1):
                return 0.0
            total += n
            if total > 4:
                return 0.0
            score += 1 - n / size
        low = min(low, score / max(1, len(x)))
    return low


def _strange(text: str, other: str) -> int:
    """Letters of a text that the other lacks; each of them costs an edit."""
    have = set(other)
    return len([c for c in text if c not in have])


def first_names_agree(a: str, b: str) -> bool:
    return a == b or (len(a) == 1 and b.startswith(a)) or (len(b) == 1 and a.startswith(b) and bool(b))


def same_name(a: tuple, b: tuple) -> float:
    """Likeness of two parsed names; 0 if they name different organisations."""
    if a[1] and b[1] and a[1] != b[1]:
        return 0.0
    if not first_names_agree(a[0], b[0]) or bool(a[0]) != bool(b[0]):
        return 0.0
    joined_a, joined_b = "".join(a[2]), "".join(b[2])
    if abs(len(joined_a) - len(joined_b)) > 5:
        return 0.0
    strange = max(_strange(joined_a, joined_b), _strange(joined_b, joined_a))
    # more than four slips, unless a token is cut off
    if strange > 4:
        either = ((a[2], f"{joined_b} {''.join(reversed(b[2]))}"), (b[2], f"{joined_a} {''.join(reversed(a[2]))}"))
        if not any(len(t) >= 6 and t[:4] in o for x, o in either for t in x):
            return 0.0
    got = monge_elkan(a[2], b[2])
    if not got:  # short pieces: the joined names as a whole
        size = max(len(joined_a), len(joined_b))
        most = 3 if size >= 12 else 2 if size >= 8 else 0
        slips = within(joined_a, joined_b, most) if strange <= most else most + 1
        got = 1 - slips / size if slips <= most else 0.0
    return got if got >= 0.7 else 0.0


def bands_for(likeness: float, recall: float, rows: int) -> int:
    """Bands needed so that a pair of this Jaccard likeness collides in at least
    one of them with probability ``recall``: 1 - (1 - s^r)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - likeness**rows))


#: Bands of names that share first name and trade, and of names without trade.
#: Sized for a six-letter name with one changed letter, 3 of 9 padded trigrams.
SAME_TRADE = (2, bands_for(1 / 3, 0.95, 2))
NO_TRADE = (3, bands_for(1 / 3, 0.95, 3))


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def grams(rest: tuple[str, ...] | list[str], q: int = 3) -> set[str]:
    text = "".join(rest)
    text += text[: q - 1]
    return {text[i : i + q] for i in range(len(text) - q + 1)} or {text}


def _bander(rows: int, bands: int, first: int = 0, count: int | None = None, seed: int = 7):
    """Arrow function (node, rest, tag) -> (node, key): one key for each of the
    ``count`` bands from ``first`` on, all if not given. Only names of one tag share keys."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 1 << 62, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
    last = bands if count is None else min(bands, first + count)
    mul, add, width = mul[first * rows : last * rows], add[first * rows : last * rows], last - first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        index = np.arange(first, last, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in small(batches, 500):
            ids, sizes = [], []
            for rest in batch.column(1).to_pylist():
                own = grams(rest)
                for g in own:
                    if g not in memo:
                        memo[g] = xxhash.xxh64_intdigest(g)
                    ids.append(memo[g])
                sizes.append(len(own))
            if not sizes:
                continue
            h = np.array(ids, np.uint64)[:, None] * mul[None, :] + add[None, :]
            low = np.minimum.reduceat(h ^ (h >> np.uint64(29)), np.cumsum(sizes) - sizes, axis=0).reshape(-1, width, rows)
            key = index[None, :] ^ batch.column(2).to_numpy().view(np.uint64)[:, None]
            for r in range(rows):
                key = (key ^ low[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(31)
            nodes = np.repeat(batch.column(0).to_numpy(), width)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(key.ravel().view(np.int64))], ["node", "key"])

    return run


PARSED = "entity_id string, core string, node bigint, first string, trade string, rest array<string>, form string"
EDGES = "a bigint, b bigint, sim double"


def _parser(counts: list[tuple[str, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(counts)
        for batch in batches:
            out = []
            for entity, core, legal in zip(*(c.to_pylist() for c in batch.columns)):
                first, trade, rest, form = parse_name(core, legal, known)
                rest = rest or (core,)
                # a name without trade is told apart by its legal form as well
                node = _hash(first, trade, " ".join(rest), "" if trade else form)
                out.append((entity, core, node, first, trade, list(rest), form))
            if out:
                yield batch_of(out, PARSED)

    return run


def parsed_names(records: DataFrame) -> DataFrame:
    """One row per record and name, with its parsed parts; names that are NULL,
    empty or a placeholder drop out."""
    counts = learn_lexicon(records)
    rows = records.select("entity_id", "core", "legal").where(
        "entity_id is not null and trim(core) not in ('', '<null>')"
    ).distinct()
    return rows.mapInArrow(_parser(counts), PARSED)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b, fa, fb, ta, tb, ra, rb in zip(*(c.to_pylist() for c in batch.columns)):
            got = same_name((fa, ta, tuple(ra.split(" "))), (fb, tb, tuple(rb.split(" "))))
            if got > 0:
                out.append((a, b, got))
        if out:
            yield batch_of(out, EDGES)


KEYS = "node bigint, key bigint"
#: Names, and keys or pairs, that are worked on at a time: what bounds the disk.
SLICE_NODES, SLICE_ROWS = 50_000, 4_000_000


def _meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes that share a key; map tasks drop
    the repetitions they see before they write."""
    met = left.toDF("a", "key").join(right.toDF("b", "key"), "key").where("a < b" if left is right else "a != b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges among the pairs; what :func:`same_name` asks first is asked in the JVM."""
    agree = "fa = fb or (length(fa) = 1 and startswith(fb, fa)) or (length(fb) = 1 and startswith(fa, fb))"
    side = lambda x: nodes.select(
        F.col("node").alias(x), F.col("first").alias(f"f{x}"), F.col("trade").alias(f"t{x}"), F.array_join("rest", " ").alias(f"r{x}"),
        F.length(F.array_join("rest", "")).alias(f"l{x}"),
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("abs(la - lb) <= 5").where(agree)
    return both.select("a", "b", "fa", "fb", "ta", "tb", "ra", "rb").mapInArrow(_verify, EDGES)


def name_edges(nodes: DataFrame, slice_nodes: int = SLICE_NODES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Verified edges (a, b, sim), a < b, between parsed names.

    Names with a trade meet in bands that also hash trade and first name, so
    short bands with high recall stay selective. Names without one are few;
    they are looked up among all names in longer bands.

    Names of one trade and first letter are one slice, whole, and slices are
    paired and verified one after the other; the longer bands come some at a
    time. So keys and pairs of a part of the table only are on disk at once.
    """
    spark = nodes.sparkSession
    lead = F.expr("substring(first, 1, 1)")
    done = []

    def keys(df: DataFrame, *bander) -> DataFrame:
        return df.select("node", "rest", "tag").mapInArrow(_bander(*bander), KEYS)

    whole = nodes.where("trade != ''").withColumn("tag", F.xxhash64("trade", lead))
    slices = max(1, math.ceil(whole.count() / slice_nodes))
    for k in range(slices):
        part = whole.where(F.pmod("tag", F.lit(slices)) == k)
        alike = materialize(keys(part, *SAME_TRADE), "bands")
        done.append(materialize(_verified(_meetings(alike, alike), part), "edges"))
        discard(alike)
        reclaim(spark)

    every = nodes.withColumn("tag", F.xxhash64(lead))
    bare = every.where("trade = ''")
    n, few = nodes.count(), bare.count()
    if few:
        rows, bands = NO_TRADE
        at_once = max(1, min(bands, slice_rows // max(1, n)))
        met = []
        for first in range(0, bands, at_once):
            shape = (rows, bands, first, at_once)
            sought = bounded_broadcast(keys(bare, *shape), 300_000, few * at_once)
            met.append(materialize(_meetings(keys(every, *shape), sought), "met"))
            reclaim(spark)
        pairs = materialize(reduce(DataFrame.union, met).distinct(), "pairs") if len(met) > 1 else met[0]
        if len(met) > 1:
            discard(*met)
        slices = max(1, math.ceil(pairs.count() / slice_rows))
        for k in range(slices):
            done.append(materialize(_verified(pairs.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == k), nodes), "edges"))
            reclaim(spark)
        discard(pairs)
    return reduce(DataFrame.union, done)


def star_clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, center): every node with the centre of its star.

    Nodes are ranked by having a trade, then by records, degree and id. A node
    that outranks all its neighbours is a centre; any other joins the best of
    the centres next to it, one of its own legal form first. A node next to no
    centre asks again among the nodes that are still free, round after round;
    each round settles at least the highest free node of every component.
    """
    ends = edges.select("a", "b", "sim").union(edges.select("b", "a", "sim")).toDF("node", "other", "sim")
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    rank = nodes.join(degree, "node", "left").select(
        "node",
        "form",
        F.struct(
            (F.col("trade") != "").alias("whole"), "weight", F.coalesce("degree", F.lit(0)).alias("degree"), "node"
        ).alias("rank"),
    )
    rank = materialize(rank, "ranks")
    ends = materialize(
        ends.join(rank.select(F.col("node").alias("other"), F.col("rank").alias("r2"), F.col("form").alias("f2")), "other")
        .join(rank, "node")
        .select("node", "other", "sim", "rank", "r2", ((F.col("form") == F.col("f2")) & (F.col("form") != "")).alias("same")),
        "ends",
    )
    free, done = ends, rank.join(ends.select("node").distinct(), "node", "left_anti").select(
        "node", F.col("node").alias("center")
    )
    done = materialize(done, "stars")
    for _ in range(rounds):
        if free.isEmpty():
            break
        top = free.groupBy("node").agg(F.max("r2").alias("best"), F.max("rank").alias("rank"))
        center = materialize(top.where("rank > best").select("node"), "centers")
        satellite = (
            free.join(center.select(F.col("node").alias("other")), "other")
            .groupBy("node")
            .agg(F.max(F.struct("same", "r2")).alias("c"))
            .select("node", F.col("c.r2.node").alias("center"))
        )
        settled = materialize(center.select("node", F.col("node").alias("center")).union(satellite), "settled")
        done = done.union(settled)
        gone = settled.select("node")
        free = materialize(
            free.join(gone, "node", "left_anti").join(gone.select(F.col("node").alias("other")), "other", "left_anti")
            .select("node", "other", "sim", "rank", "r2", "same"),
            "free",
        )
        # nodes whose neighbours have all gone are centres of their own
        lone = materialize(
            ends.select("node").distinct().join(done.select("node"), "node", "left_anti")
            .join(free.select("node").distinct(), "node", "left_anti"),
            "lone",
        )
        done = done.union(lone.select("node", F.col("node").alias("center")))
    else:
        if not free.isEmpty():
            raise RuntimeError(f"star clusters are not settled after {rounds} rounds")
    return done


def named_clusters(records: DataFrame) -> DataFrame:
    """(entity_id, core, cluster) for every record with a name."""
    parsed = materialize(parsed_names(records), "names")
    nodes = materialize(
        parsed.groupBy("node").agg(
            F.first("first").alias("first"), F.first("trade").alias("trade"), F.first("rest").alias("rest"),
            F.max("form").alias("form"), F.countDistinct("entity_id").alias("weight"),
        ),
        "nodes",
    )
    edges = name_edges(nodes)
    stars = star_clusters(nodes, edges)
    return parsed.join(stars, "node").select("entity_id", "core", F.col("center").alias("cluster"))


def name_pairs(records: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b), a < b, of records that name the same
    organisation and whose ``core`` differs as stored.

    Records with the same core are one class; classes of a cluster are paired
    and then opened. NULL, empty and placeholder names are in no pair; repeated
    rows change nothing; an empty table gives no pairs; further columns are not
    read.
    """
    clusters = materialize(named_clusters(records).distinct(), "clusters")
    one = clusters.select("cluster", "core").distinct()
    pairs = (
        one.select("cluster", F.col("core").alias("ca"))
        .join(one.select("cluster", F.col("core").alias("cb")), "cluster")
        .where("ca < cb")
    )
    return (
        pairs.join(clusters.select("cluster", F.col("core").alias("ca"), F.col("entity_id").alias("x")), ["cluster", "ca"])
        .join(clusters.select("cluster", F.col("core").alias("cb"), F.col("entity_id").alias("y")), ["cluster", "cb"])
        .where("x != y")
        .select(F.least("x", "y").alias("entity_id_a"), F.greatest("x", "y").alias("entity_id_b"))
        .distinct()
    )


def name_links(records: DataFrame) -> DataFrame:
    """(entity_id, core, cluster, n_links): one row per record and name with the
    organisation it names and the number of records that name it otherwise; no
    pair of records is made. Missing names are absent, as in :func:`name_pairs`."""
    clusters = materialize(named_clusters(records).distinct(), "clusters")
    whole = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    alike = clusters.groupBy("cluster", "core").agg(F.count(F.lit(1)).alias("k"))
    return clusters.join(whole, "cluster").join(alike, ["cluster", "core"]).select(
        "entity_id", "core", "cluster", (F.col("n") - F.col("k")).alias("n_links")
    )
