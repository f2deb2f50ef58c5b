"""From scores to matches, and how good they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinsift.operators.context import group_stats, range_of
from kinsift.session import materialize


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one entity; 1 if nothing is true and nothing predicted."""
    return (
        F.when((n_pred == 0) & (n_true == 0), 1.0)
        .when((n_pred == 0) | (n_true == 0), 0.0)
        .otherwise(1.25 * tp / (0.25 * n_true + n_pred))
    )


def score_selection(pairs: DataFrame, selected: Column, meta: DataFrame, owner: str) -> DataFrame:
    """tp, n_pred and f05 for every entity of ``meta(owner, n_true)``, also
    those without a candidate."""
    on = selected.cast("int")
    per = pairs.groupBy(owner).agg(F.sum(on * F.col("y")).alias("tp"), F.sum(on).alias("n_pred"))
    got = meta.join(per, owner, "left").fillna(0, ["tp", "n_pred"])
    return got.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def threshold_sweep(pairs: DataFrame, meta: DataFrame, owner: str, p: str, cuts: list[float], by: list[str] | None = None) -> DataFrame:
    """Mean F0.5 for every threshold, over all entities of ``meta``.

    A pair counts for all thresholds up to its score, so one pass over the pairs
    sums a fixed number of columns; no row is multiplied by thresholds."""
    sums = [x for i, c in enumerate(cuts) for x in (
        F.sum(F.when(F.col(p) >= c, F.col("y")).otherwise(0)).alias(f"tp{i}"),
        F.sum((F.col(p) >= c).cast("int")).alias(f"np{i}"))]
    got = meta.join(pairs.groupBy(owner).agg(*sums), owner, "left").fillna(0)
    means = [F.avg(f05(F.col(f"tp{i}"), F.col(f"np{i}"), F.col("n_true"))).alias(f"m{i}") for i in range(len(cuts))]
    wide = got.groupBy(*(by or [])).agg(*means)
    return wide.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(c).alias("th"), F.col(f"m{i}").alias("mean_f05")) for i, c in enumerate(cuts)])).alias("x")).select(*(by or []), "x.*")


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold with the highest mean; the lower one on a tie."""
    return sweep.groupBy(*(by or [])).agg(F.max(F.struct("mean_f05", (-F.col("th")).alias("neg"))).alias("b")).select(
        *(by or []), (-F.col("b.neg")).alias("th"), F.col("b.mean_f05").alias("mean_f05")
    )


def recall_bound_cut(pairs: DataFrame, p: str, cuts: list[float], least: float) -> DataFrame:
    """(th, kept) of the largest threshold that keeps the share ``least`` of the true pairs."""
    row = pairs.agg(F.sum("y").alias("n"), *[F.sum(F.when(F.col(p) >= c, F.col("y")).otherwise(0)).alias(f"k{i}") for i, c in enumerate(cuts)])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("th"), (F.col(f"k{i}") / F.col("n")).alias("kept")) for i, c in enumerate(cuts)])).alias("x")).select("x.*")
    return long.where(F.col("kept") >= least).orderBy(F.col("th").desc()).limit(1)


def keep_some(pairs: DataFrame, owner: str, p: str, tie: list[str], tau: float, min_keep: int = 2) -> DataFrame:
    """The pairs with p >= tau, and the owner's best ``min_keep`` below it. The
    rank filter reaches the group-limit operator, before and after the shuffle."""
    w = Window.partitionBy(owner).orderBy(F.col(p).desc(), *tie)
    best = pairs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= min_keep).drop("__n")
    return pairs.where(F.col(p) >= tau).unionByName(best.where(~F.coalesce(F.col(p) >= tau, F.lit(False))))


def expected_f05(pairs: DataFrame, owner: str, p: str, tie: list[str], miss_prior: float = 0.0, min_p: float = 0.0) -> DataFrame:
    """Adds ``selected``: the smallest prefix by score that maximises expected
    F0.5, none if the chance that nothing is true is at least as good.

    Running sums are those of the higher score ranges, of which an owner has
    some hundreds at most, and of the rows before in the own range."""
    out = pairs.withColumn("__range", range_of(p))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    down = before(Window.partitionBy(owner).orderBy(F.col("__range").desc()))
    ranges = out.groupBy(owner, "__range").agg(F.sum(p).alias("__s"), F.count(F.lit(1)).alias("__k")).select(
        owner, "__range", F.coalesce(F.sum("__s").over(down), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__k").over(down), F.lit(0)).alias("__m0")
    )
    order = Window.partitionBy(owner, "__range").orderBy(F.col(p).desc(), *tie)
    out = out.withColumn("__m", F.row_number().over(order)).withColumn("__cs", F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(ranges, [owner, "__range"]).withColumn("__m", F.col("__m") + F.col("__m0")).withColumn("__cs", F.col("__cs") + F.col("__s0"))
    out = materialize(out, "prefix")
    out = group_stats(out, [owner], __et=F.sum(p), __pe=F.exp(F.sum(F.log(1 - F.least(F.col(p), F.lit(1 - 1e-9))))))
    out = out.withColumn("__ef", 1.25 * F.col("__cs") / (0.25 * (F.col("__et") + miss_prior) + F.col("__m")))
    out = group_stats(out, [owner], __best=F.max("__ef"))
    out = group_stats(out, [owner], __bm=F.min(F.when(F.col("__ef") >= F.col("__best") - 1e-12, F.col("__m"))))
    out = out.withColumn("selected", (F.col("__m") <= F.col("__bm")) & (F.col("__pe") < F.col("__best")) & (F.col(p) >= min_p))
    return out.select(*pairs.columns, "selected")


def margin_rule(pairs: DataFrame, owner: str, p: str, cut: float, share: float) -> DataFrame:
    """The pairs with p >= cut and p >= share of the owner's best."""
    return group_stats(pairs, [owner], __top=F.max(p)).where((F.col(p) >= cut) & (F.col(p) >= share * F.col("__top"))).drop("__top")


def relative_cut_and_rescue(pairs: DataFrame, owner: str, p: str, cut: float, margin: float, low: float, rescue: float) -> DataFrame:
    """Drops what lies more than ``margin`` below the best; an owner left without
    a match gets its best back if that is at least ``low`` and leads by ``rescue``.
    Expects top, second and is_top."""
    out = pairs.withColumn("sel0", (F.col(p) >= cut) & (F.col("top") - F.col(p) <= margin))
    out = group_stats(out, [owner], __some=F.max("sel0"))
    back = ~F.col("__some") & F.col("is_top") & (F.col(p) >= low) & (F.col("top") - F.col("second") >= rescue)
    return out.withColumn("selected", F.col("sel0") | back).drop("sel0", "__some")


def one_owner(pairs: DataFrame, record: list[str], p: str, owner: str) -> DataFrame:
    """Each record stays with the owner that scores it highest."""
    w = Window.partitionBy(*record).orderBy(F.col(p).desc(), owner)
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def match_lists(owners: DataFrame, pairs: DataFrame, owner: str, p: str, rec: str, name: str) -> DataFrame:
    """One row per owner with its records joined by commas, best first; empty if none."""
    lists = pairs.groupBy(owner).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(p)).alias("k"), F.col(rec).alias("id")))), lambda x: x["id"]), ",").alias(name)
    )
    return owners.join(lists, owner, "left").select(owner, F.coalesce(name, F.lit("")).alias(name))
