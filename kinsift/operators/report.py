"""Diagnostics: cross tables, loss shares, reweighting, miss attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts per row and column value; zeros for absent ones. ``values`` are
    given, so no extra pass looks for them."""
    return df.groupBy(row).agg(*[F.sum((F.coalesce(F.col(col), F.lit("")) == v).cast("int")).alias(v) for v in values])


def loss_share(df: DataFrame, kind: str, loss: str) -> DataFrame:
    """Count, mean loss and share of all loss per kind."""
    g = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("mean_loss"), F.sum(loss).alias("s"))
    return g.crossJoin(F.broadcast(df.agg(F.sum(loss).alias("t")))).select(kind, "n", "mean_loss", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(0.0).alias("share"))


def frequency_weights(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Weight per key value that turns our frequencies into theirs; 0 where
    they have none."""
    def freq(df, name):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))).select(key, (F.col("c") / F.col("t")).alias(name))

    return freq(ours, "fv").join(freq(theirs, "ft"), key, "left").select(key, F.coalesce(F.col("ft") / F.col("fv"), F.lit(0.0)).alias("w"))


def effective_size(w: str) -> Column:
    return F.pow(F.sum(w), 2) / F.sum(F.col(w) * F.col(w))


def quartiles(df: DataFrame, by: str, col: str) -> DataFrame:
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(by).agg(q.alias("q")).select(by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def miss_stage(truth: DataFrame, blocked: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Where each true pair was lost: never blocked, dropped by the filter, or kept."""
    b, k = blocked.select(*keys).distinct().withColumn("b", F.lit(1)), kept.select(*keys).distinct().withColumn("k", F.lit(1))
    return truth.join(b, keys, "left").join(k, keys, "left").select(
        *keys, F.when(F.col("b").isNull(), "never blocked").when(F.col("k").isNull(), "dropped by filter").otherwise("kept").alias("stage")
    )


def bridge(ours: DataFrame, other: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """Weighted mean of two scores where the other model scored the pair too, else ours."""
    o = other.select(*keys, F.col("p").alias("__po"))
    return ours.join(o, keys, "left").withColumn("p", F.when(F.col("__po").isNotNull(), weight * F.col("__po") + (1 - weight) * F.col("p")).otherwise(F.col("p"))).drop("__po")


def by_partition(seen: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` for seen partitions, of ``b`` for the others."""
    return a.join(seen, key, "left_semi").unionByName(b.join(seen, key, "left_anti"))


def audit_score(pairs: DataFrame, labels: DataFrame, keys: list[str], owner: str, cut: float) -> DataFrame:
    """Precision parts of audited owners: label ? is left out, a predicted pair
    without label is wrong. Columns owner, tp, fp, n_true."""
    audited = labels.select(owner).distinct()
    got = pairs.where(F.col("p") >= cut).join(audited, owner, "left_semi").join(labels.select(*keys, "label"), keys, "left")
    per = got.where("label is null or label != '?'").groupBy(owner).agg(
        F.sum(F.coalesce((F.col("label") == "1").cast("int"), F.lit(0))).alias("tp"),
        F.sum(F.when(F.col("label") == "1", 0).otherwise(1)).alias("fp"),
    )
    true = labels.groupBy(owner).agg(F.sum((F.col("label") == "1").cast("int")).alias("n_true"))
    return true.join(per, owner, "left").fillna(0, ["tp", "fp"])


def share_windowed(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(by)))
