"""Features of a candidate among the other candidates of its entity.

One entity may own a third of all candidates, so nothing here sorts a group in
one task: maxima, counts, anchors and seconds are aggregates with map-side
combining that are joined back, and ranks come from counts of distinct scores
in ranges of the score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def group_stats(pairs: DataFrame, group: list[str], source: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """``pairs`` with aggregates of their group next to every row. The joined
    side has one row per group; adaptive execution splits a hot group's rows.
    ``source`` holds the same rows, where ``pairs`` has been joined already: so
    plans grow by a branch for each call and not by doubling."""
    per = (pairs if source is None else source).groupBy(*group).agg(*[a.alias(n) for n, a in aggregates.items()])
    return pairs.join(per, group)


def range_of(score: str) -> Column:
    """A whole number that never falls as the score rises; scores of a few per cent difference share one."""
    x = F.col(score).cast("double")
    return F.when(x >= 0, F.floor(F.log1p(x * 1000) * 16)).otherwise(-F.ceil(F.log1p(-x * 1000) * 16) - 1)


def ranked(pairs: DataFrame, group: list[str], score: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Rank of a score in its group, the highest first; ties share the lowest rank.

    A rank is one more than the number of higher scores: those of higher ranges,
    of which a group has some hundreds at most, and the higher ones of its own."""
    tied = (pairs if source is None else source).groupBy(*group, score).agg(F.count(F.lit(1)).alias("__n")).withColumn("__range", range_of(score))
    ahead = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = tied.groupBy(*group, "__range").agg(F.sum("__n").alias("__n")).withColumn(
        "__before", ahead(Window.partitionBy(*group).orderBy(F.col("__range").desc()))
    )
    within = ahead(Window.partitionBy(*group, "__range").orderBy(F.col(score).desc()))
    place = tied.withColumn("__within", within).join(ranges.drop("__n"), [*group, "__range"]).select(
        *group, score, (F.col("__before") + F.col("__within") + 1).cast("int").alias(out)
    )
    return pairs.join(place, [*group, score])


def group_context(pairs: DataFrame, group: list[str], columns: list[str], size: str = "n_cand") -> DataFrame:
    """Maximum, gap to it and rank (ties share the lowest) of each column, and
    the group's size."""
    out = group_stats(pairs, group, **{size: F.count(F.lit(1))}, **{f"{c}_mx": F.max(c) for c in columns})
    for c in columns:
        out = ranked(out.withColumn(f"{c}_gap", F.col(f"{c}_mx") - F.col(c)), group, c, f"{c}_rk", source=pairs)
    return out


def _best(score: str, tie: list[str], columns: list[str] = ()) -> Column:
    """The row of the highest score, the lowest ``tie`` first; further columns come along."""
    return F.min(F.struct((-F.col(score)).alias("s"), *tie, *[F.col(c).alias(f"v_{c}") for c in columns]))


def top_two(pairs: DataFrame, owner: str, p: str, tie: list[str]) -> DataFrame:
    """top, second (0 if none) and is_top of a score per owner."""
    out = group_stats(pairs, [owner], __b=_best(p, tie)).withColumn("top", -F.col("__b.s"))
    same = reduce(lambda a, b: a & b, [F.col(t) == F.col(f"__b.{t}") for t in tie], F.col(p) == F.col("top"))
    out = out.withColumn("is_top", same).drop("__b")
    return group_stats(out, [owner], second=F.coalesce(F.max(F.when(~F.col("is_top"), F.col(p))), F.lit(0.0)))


def combined(pairs: DataFrame, group: list[str], comb: Column, tie: list[str]) -> DataFrame:
    """Combined score with its gap, rank and the group's second best (0 if none)."""
    if len(group) != 1:
        raise ValueError("combined works on groups of one column")
    base = pairs.withColumn("comb", comb)
    out = top_two(base, group[0], "comb", tie).withColumn("comb_gap", F.col("top") - F.col("comb"))
    return ranked(out.withColumnRenamed("second", "comb_2nd").drop("top", "is_top"), group, "comb", "comb_rk", source=base)


def siblings(pairs: DataFrame, owner: str, key: str, tag: str, prefix: str = "", source: DataFrame | None = None) -> DataFrame:
    """Size, maximum and mean of ``comb`` over the owner's candidates with the
    same non-empty key; zeros where the key is empty."""
    names = {f"sib_{tag}_n": F.count(F.lit(1)).cast("double"), f"sib_{tag}_{prefix}mx": F.max("comb"), f"sib_{tag}_{prefix}mean": F.avg("comb")}
    keyed = lambda df: df.withColumn("__key", F.coalesce(F.col(key), F.lit("")))
    out = group_stats(keyed(pairs), [owner, "__key"], source=keyed(pairs if source is None else source), **names)
    for name in names:
        out = out.withColumn(name, F.when(F.col("__key") == "", F.lit(0.0)).otherwise(F.col(name)))
    return out.drop("__key")


def anchor(pairs: DataFrame, group: list[str], score: str, tie: list[str], columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """The group's best row next to every row of the group: ``an_<column>``."""
    out = group_stats(pairs, group, source=source, __b=_best(score, tie, columns))
    return out.select(*pairs.columns, *[F.col(f"__b.v_{c}").alias(f"an_{c}") for c in columns])


def joined_whole(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that must neither lose nor double a row of ``left`` and find
    every key: the check runs with the join, in the task that meets the fault."""
    marked = right.withColumn("__found", F.lit(True))
    twice = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__times"))
    out = left.join(marked, keys, "left").join(twice, keys, "left")
    fault = F.when(F.col("__found").isNull(), F.raise_error(F.lit("a row has no partner in the joined table")))
    fault = fault.when(F.col("__times") > 1, F.raise_error(F.lit("a row has several partners in the joined table")))
    return out.where(F.coalesce(fault.cast("boolean"), F.lit(True))).drop("__found", "__times")
