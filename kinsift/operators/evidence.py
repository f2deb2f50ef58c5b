"""Word, number, cluster and n-gram evidence for pairs; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinsift.operators.context import group_stats


def word_stats(pairs: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """(kind, word, n, pos): words only one side has, and how often such a pair is true."""
    ex = pairs.select(F.lit("ex").alias("kind"), F.explode(F.array_except(b, a)).alias("word"), y)
    ms = pairs.select(F.lit("ms").alias("kind"), F.explode(F.array_except(a, b)).alias("word"), y)
    return ex.union(ms).groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))


def shrunk_rate(n: Column, pos: Column, base: Column, prior: float = 20.0) -> Column:
    return (pos + prior * base) / (n + prior)


def branch_words(pairs: DataFrame, a: str, b: str, y: str, least: int = 100, rate: float = 0.01) -> DataFrame:
    """Words that, added alone, almost never belong to a true pair."""
    extra = F.array_except(b, a)
    return (
        pairs.where((F.size(extra) == 1) & (F.size(F.array_except(a, b)) == 0))
        .select(extra[0].alias("word"), y)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
        .where((F.col("n") >= least) & (F.col("rate") <= rate))
    )


def dice_partners(pairs: DataFrame, a: str, b: str, support: int = 3, confidence: float = 0.5) -> DataFrame:
    """For every word of ``b`` the word of ``a`` of highest Dice score, where it
    is seen ``support`` times and in the share ``confidence`` of its pairs."""
    left = pairs.select(F.explode(F.array_distinct(b)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("occ"))
    right = pairs.select(F.explode(F.array_distinct(a)).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("lf"))
    both = (
        pairs.select(F.explode(F.array_distinct(b)).alias("t"), F.array_distinct(a).alias("ls"))
        .select("t", F.explode("ls").alias("l")).groupBy("t", "l").agg(F.count(F.lit(1)).alias("c"))
    )
    scored = both.join(left, "t").join(right, "l").withColumn("dice", F.round(2 * F.col("c") / (F.col("occ") + F.col("lf")), 9))
    w = Window.partitionBy("t").orderBy(F.col("dice").desc(), "l")
    return (
        scored.withColumn("n", F.row_number().over(w))
        .where((F.col("n") == 1) & (F.col("c") >= support) & (F.col("c") / F.col("occ") >= confidence)).drop("n")
    )


def set_features(a: Column, b: Column, p: str = "") -> dict[str, Column]:
    """Overlap features of two token arrays."""
    inter, na, nb = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    one = F.lit(1)
    return {
        f"{p}b_in_a": inter / F.greatest(nb, one), f"{p}a_in_b": inter / F.greatest(na, one),
        f"{p}jac": inter / F.greatest(na + nb - inter, one), f"{p}b_minus_a": nb - inter, f"{p}a_minus_b": na - inter,
        f"{p}lta": F.size(a), f"{p}ltb": F.size(b),
        f"{p}b_sub_a": ((nb > 0) & (inter == nb)).cast("int"), f"{p}a_sub_b": ((na > 0) & (inter == na)).cast("int"),
        f"{p}first_eq": F.coalesce((F.slice(a, 1, 1) == F.slice(b, 1, 1)).cast("int"), F.lit(0)),
        f"{p}last_eq": F.coalesce((F.when(F.size(a) > 0, F.slice(a, -1, 1)).otherwise(a) == F.when(F.size(b) > 0, F.slice(b, -1, 1)).otherwise(b)).cast("int"), F.lit(0)),
    }


def grams(text: Column, n: int, pad: bool = False) -> Column:
    """Distinct character n-grams; a shorter text is its own gram, an empty one has none."""
    t = F.concat(F.lit(" "), text, F.lit(" ")) if pad else text
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(F.length(t) < n, F.array(t))
        .otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda k: F.substring(t, k, F.lit(n)))))
    )


def gram_similarity(a: Column, b: Column) -> dict[str, Column]:
    """Jaccard, cosine and the share of the first set that the second has."""
    return gram_shares(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def gram_shares(inter: Column, na: Column, nb: Column) -> dict[str, Column]:
    """The same from the sizes of the intersection and of both sets."""
    empty = (na == 0) | (nb == 0)
    safe = lambda x: F.when(empty, 0.0).otherwise(x)
    return {
        "jac": safe(inter / F.greatest(na + nb - inter, F.lit(1))), "cos": safe(inter / F.sqrt(F.greatest(na * nb, F.lit(1)))),
        "in_a": safe(inter / F.greatest(na, F.lit(1))),
    }


def number_relation(a: Column, b: Column) -> tuple[Column, Column]:
    """(relation, distance) of two number arrays: 0 none on a side, 1 shared,
    2 one digit apart, 3 one begins or ends the other, 4 different; the distance
    is ln(1 + least difference), 0 if shared, -1 if a side has none."""
    pair = lambda test: F.exists(a, lambda x: F.exists(b, lambda z: test(x, z)))
    s = lambda x: x.cast("string")
    near = pair(lambda x, z: F.levenshtein(s(x), s(z)) <= 1)
    part = pair(lambda x, z: s(x).startswith(s(z)) | s(z).startswith(s(x)) | s(x).endswith(s(z)) | s(z).endswith(s(x)))
    none = (F.size(a) == 0) | (F.size(b) == 0)
    rel = F.when(none, 0).when(F.arrays_overlap(a, b), 1).when(near, 2).when(part, 3).otherwise(4)
    gap = F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda z: F.abs(x - z)))))
    return rel, F.when(none, -1.0).when(F.arrays_overlap(a, b), 0.0).otherwise(F.log1p(gap))


def cluster_features(pairs: DataFrame, owner: str, key: str, rel: str, values: dict[str, str]) -> DataFrame:
    """Evidence of the owner's candidates that share a house-number key.

    ``values`` maps an output to ``min`` or ``max`` of a column ``<agg> <col>``;
    a row without key keeps its own value."""
    has = F.col("__key") != ""
    base = pairs.withColumn("__key", F.coalesce(F.col(key), F.lit("")))
    out = group_stats(base, [owner], s1_support=F.sum((F.col(rel) == 1).cast("int")), __keyed=F.sum((F.col("__key") != "").cast("int")))
    specs = {name: spec.split() for name, spec in values.items()}
    inner = {f"__{name}": (F.min if how == "min" else F.max)(col) for name, (how, col) in specs.items()}
    out = group_stats(out, [owner, "__key"], source=base, __size=F.count(F.lit(1)), **inner)
    out = out.withColumn("cl_size", F.when(has, F.col("__size")).otherwise(0))
    out = out.withColumn("cl_agree", F.when(has, (F.col(rel) == 1).cast("int")).otherwise(-1))
    for name, (_, col) in specs.items():
        out = out.withColumn(name, F.when(has, F.col(f"__{name}")).otherwise(F.col(col)))
    out = out.withColumn("cl_other_size", F.col("__keyed") - F.col("cl_size"))
    out = out.withColumn("cl_is_alt", ((F.col(rel) >= 2) & has & (F.col("s1_support") > 0)).cast("int"))
    return out.drop("__key", "__keyed", "__size", *inner)
