"""Per-key results when a handful of keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Blanks around a token: everything of the Unicode property White_Space.
BLANKS = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def stripped(col):
    """``col`` without surrounding blanks of any kind."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def distinct_per_key(df: DataFrame, keys: list[str], item: str, out: str = "n_items") -> DataFrame:
    """Number of distinct ``item`` values per ``keys``, free of key skew.

    Both steps are algebraic aggregates. The first removes repeated
    (keys, item) rows in each map task before its shuffle, which is keyed by the
    item too, so rows of a hot key spread over all partitions. The second adds up
    one partial count per map task and key; a key however hot sends no more
    rows than there are tasks. NULL keys form a group, NULL items count for
    nothing; a key with none but NULL items gets 0; an empty input gives an
    empty result; other columns of ``df`` are not read.
    """
    return (
        df.select(*keys, item)
        .groupBy(*keys, item)
        .agg(F.lit(1).alias("__one"))
        .groupBy(*keys)
        .agg(F.count(F.col(item)).alias(out))
    )


def candidates_per_token(postings: DataFrame) -> DataFrame:
    """Distinct candidates per source and token (trimmed, lower case, at least
    two characters; NULL tokens, candidates and sources drop out)."""
    token = F.lower(stripped("token"))
    rows = (
        postings.select("candidate_source", token.alias("token"), "candidate_entity_id")
        .where(F.length("token") >= 2)
        .where(F.col("candidate_entity_id").isNotNull() & F.col("candidate_source").isNotNull())
    )
    return distinct_per_key(rows, ["candidate_source", "token"], "candidate_entity_id", "n_candidates")


def heavy_tokens(postings: DataFrame, share: float = 0.015) -> DataFrame:
    """Tokens that hold at least ``share`` of the distinct (candidate, token)
    pairs of their source. The totals are one row per source, built from the
    per-token counts, so their broadcast is bounded by the number of sources."""
    per_token = candidates_per_token(postings)
    total = per_token.groupBy("candidate_source").agg(F.sum("n_candidates").alias("__total"))
    return (
        per_token.join(total, "candidate_source")
        .where(F.col("n_candidates") >= F.lit(share) * F.col("__total"))
        .select("candidate_source", "token")
    )
