"""Score overrides by branch words, the threshold matrix of an audit, and rank probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinsift.operators.context import group_stats, ranked
from kinsift.operators.decide import f05


def branch_rules(pairs: DataFrame, vocabulary: list[str], owner: str) -> DataFrame:
    """Rejects (p = 0) and accepts (p = 1) pairs by branch words and numbers.

    Expects arrays ``a`` and ``b`` (names), ``aa`` and ``ab`` (address tokens),
    the number relation ``rel`` and the number key ``bkey``. A pair is a branch
    alternative if its added words meet the vocabulary and the numbers differ.
    Rejected: branch alternatives, and pairs with differing numbers whose
    non-empty key an alternative of the same owner has. Accepted, unless
    rejected: equal joined names, equal numbers, and 0.7 of B's address shared.
    """
    words = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    alt = F.arrays_overlap(F.array_except("b", "a"), words) & (F.col("rel") >= 2)
    out = pairs.withColumn("__alt", F.coalesce(alt, F.lit(False)))
    out = group_stats(out.withColumn("__key", F.coalesce("bkey", F.lit(""))), [owner, "__key"], __some=F.max("__alt"))
    near = F.col("__some") & (F.col("__key") != "")
    out = out.withColumn("r1", F.col("__alt") | ((F.col("rel") >= 2) & near)).drop("__some", "__key")
    same = (F.array_join("a", "") == F.array_join("b", "")) & (F.array_join("a", "") != "")
    shared = F.size(F.array_intersect("aa", "ab")) / F.greatest(F.size(F.array_distinct("ab")), F.lit(1))
    out = out.withColumn("r2", ~F.col("r1") & same & (F.col("rel") == 1) & (shared >= 0.7))
    return out.withColumn("p", F.when(F.col("r1"), 0.0).when(F.col("r2"), 1.0).otherwise(F.col("p"))).drop("__alt")


def threshold_matrix(pairs: DataFrame, owner: str, cuts: list[float]) -> DataFrame:
    """F0.5 per owner and threshold with a label of four states: 1 true, 0
    false, ? left out, NULL (outside the audited rows) false if predicted."""
    label = F.col("label")
    counts = label.isNull() | (label != "?")
    one = (F.coalesce(label, F.lit("0")) == "1").cast("int")
    sums = [F.sum(one).alias("n_true")]
    for i, c in enumerate(cuts):
        hit = counts & (F.col("p") >= c)
        sums += [F.sum(F.when(hit, one).otherwise(0)).alias(f"tp{i}"), F.sum(hit.cast("int")).alias(f"np{i}")]
    wide = pairs.groupBy(owner).agg(*sums)
    parts = [F.struct(F.lit(c).alias("th"), f05(F.col(f"tp{i}"), F.col(f"np{i}"), F.col("n_true")).alias("f05")) for i, c in enumerate(cuts)]
    return wide.select(owner, F.explode(F.array(*parts)).alias("x")).select(owner, "x.*")


def rank_of_true(pairs: DataFrame, group: list[str], scores: list[str], y: str = "y") -> DataFrame:
    """Rank of every true pair in each channel: one more than the number of
    higher scores in its group."""
    out = pairs
    for s in scores:
        out = ranked(out, group, s, f"rank_{s}", source=pairs)
    return out.where(F.col(y) == 1)


def segment_cut(p: str, segment: Column, cut: float, strict: float) -> Column:
    """A stricter threshold inside a segment."""
    return F.col(p) >= F.when(segment, strict).otherwise(cut)


def blank_partition(pairs: DataFrame, column: str, value: str) -> DataFrame:
    """Diagnostic: no match for one partition."""
    return pairs.where(F.col(column) != value)
