"""Token blocking under a budget, union of blocks, and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: (most records per token, most joined rows), strict to permissive.
TIERS = [(50, 2_000_000), (200, 20_000_000), (1000, 200_000_000), (5000, 2_000_000_000)]


def list_tokens(df: DataFrame, ident: list[str], column: str) -> DataFrame:
    """Distinct (ident..., token) of a list column: trimmed, lower case, two
    characters at least; NULL lists and elements drop out."""
    t = F.lower(F.trim(F.col("token")))
    return df.select(*ident, F.explode(column).alias("token")).where(F.length(F.trim("token")) >= 2).select(*ident, t.alias("token")).distinct()


def join_size(df1: DataFrame, df2: DataFrame, tiers: list[tuple[int, int]] = TIERS) -> DataFrame:
    """(max_df, rows): joined rows if only tokens below each cap are used; all
    tiers come from one pass over the joined frequencies."""
    both = df1.withColumnRenamed("df", "d1").join(df2.withColumnRenamed("df", "d2"), "token")
    low = F.greatest("d1", "d2")
    wide = both.agg(*[F.coalesce(F.sum(F.when(low <= c, F.col("d1") * F.col("d2"))), F.lit(0)).alias(f"t{c}") for c, _ in tiers])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("max_df"), F.col(f"t{c}").alias("rows")) for c, _ in tiers])).alias("x")).select("x.*")


def pick_tier(sizes: DataFrame, budget: int, tiers: list[tuple[int, int]] = TIERS) -> int | None:
    """The most permissive cap whose rows fit its own limit and the budget."""
    limit = dict(tiers)
    fits = [r["max_df"] for r in sizes.collect() if r["rows"] <= min(limit[r["max_df"]], budget)]
    return max(fits) if fits else None


def shared_token_block(s1: DataFrame, target: DataFrame, max_df: int) -> DataFrame:
    """Distinct pairs that share a token which at most ``max_df`` records of
    either side have."""
    rare = lambda t: t.groupBy("token").count().where(F.col("count") <= max_df).select("token")
    return (
        s1.join(rare(s1), "token").join(target.join(rare(target), "token"), "token")
        .select("source1_entity_id", "candidate_entity_id").distinct()
    )


def union_blocks(blocks: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per pair with the rules that found it, in name order."""
    out = None
    for rule, df in blocks:
        one = df.select("source1_entity_id", "candidate_entity_id").where("source1_entity_id is not null and candidate_entity_id is not null").withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    source = F.when(F.col("candidate_entity_id").like("S2-%"), "S2").when(F.col("candidate_entity_id").like("S3-%"), "S3")
    return (
        out.groupBy("source1_entity_id", "candidate_entity_id")
        .agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
        .withColumn("candidate_source", source)
    )


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(n_true, n_found, recall) over distinct pairs."""
    keys = ["source1_entity_id", "matched_entity_id"]
    hit = truth.join(found.select(F.col("source1_entity_id"), F.col("candidate_entity_id").alias("matched_entity_id")).distinct(), keys, "left_semi")
    return truth.agg(F.count(F.lit(1)).alias("n_true")).crossJoin(hit.agg(F.count(F.lit(1)).alias("n_found"))).withColumn(
        "recall", F.when(F.col("n_true") > 0, F.col("n_found") / F.col("n_true")).otherwise(0.0)
    )


def against_target(got: DataFrame, target: float) -> DataFrame:
    """A recall row with its target and whether it is met."""
    return got.withColumn("target", F.lit(float(target))).withColumn("target_met", (F.col("recall") >= target).cast("int"))


def require_target(got: DataFrame, target: float) -> float:
    """The recall, or an error that ends the run if it misses the target."""
    value = got.first()["recall"]
    if value < target:
        raise ValueError(f"recall {value:.4f} is below the target {target}")
    return value


def missed(truth: DataFrame, found: DataFrame) -> DataFrame:
    keys = ["source1_entity_id", "matched_entity_id"]
    return truth.join(found.select(F.col("source1_entity_id"), F.col("candidate_entity_id").alias("matched_entity_id")), keys, "left_anti")
