"""Synthetic duplicates: hashed draws, so every run gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Shares of none, one and two extra copies.
EXTRA = (0.45, 0.42, 0.13)


def uniform(ident: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the id and the salt alone."""
    return F.pmod(F.xxhash64(ident, F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0


def copies(ident: Column) -> Column:
    u = uniform(ident, "copies")
    return F.when(u < EXTRA[0], 0).when(u < EXTRA[0] + EXTRA[1], 1).otherwise(2)


def with_typo(df: DataFrame, text: str, ident: str, salt: str) -> DataFrame:
    """Swaps two neighbours or drops a letter inside the first word of five
    letters or more. Each step is a column of its own, so nothing is computed twice."""
    at, word = F.col("__at"), F.col("__word")
    df = df.withColumn("__word", F.regexp_extract(text, r"\b([A-Za-z]{5,})\b", 1))
    df = df.withColumn("__at", (F.floor(uniform(F.col(ident), salt + "at") * F.greatest(F.length(word) - 3, F.lit(1))) + 2).cast("int"))
    swapped = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.lit(1)), F.substring(word, at, F.lit(1)), F.substring(word, at + 2, F.length(word)))
    cut = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))
    df = df.withColumn("__new", F.when(uniform(F.col(ident), salt + "how") < 0.5, swapped).otherwise(cut))
    hit = (word != "") & (uniform(F.col(ident), salt) < 0.25)
    return df.withColumn(text, F.when(hit, F.replace(text, word, F.col("__new"))).otherwise(F.col(text))).drop("__word", "__at", "__new")


def with_name_variant(df: DataFrame, name: str, ident: str, vocabulary: list[str]) -> DataFrame:
    """Branch word (55 %, behind in 80 % of them), legal suffix (35 %), typo
    (25 %) and change of case."""
    i = F.col(ident)
    if vocabulary:
        words = F.array(*[F.lit(w) for w in vocabulary])
        pick = F.element_at(words, (F.floor(uniform(i, "word") * len(vocabulary)) + 1).cast("int"))
        placed = F.when(uniform(i, "side") < 0.8, F.concat_ws(" ", name, pick)).otherwise(F.concat_ws(" ", pick, name))
        df = df.withColumn(name, F.when(uniform(i, "branch") < 0.55, placed).otherwise(F.col(name)))
    df = df.withColumn(name, F.when(uniform(i, "legal") < 0.35, F.concat(name, F.lit(" ltd"))).otherwise(F.col(name)))
    df = with_typo(df, name, ident, "typo").withColumn("__u", uniform(i, "case"))
    return df.withColumn(name, F.when(F.col("__u") < 0.3, F.upper(name)).when(F.col("__u") < 0.6, F.initcap(name)).otherwise(F.col(name))).drop("__u")


def addr_variant(addr: Column, ident: Column) -> Column:
    """A sign or zeros in front of the first number, and change of case."""
    u = uniform(ident, "addr")
    out = F.when(u < 0.2, F.regexp_replace(addr, r"^([^0-9]*)([0-9])", "$1#$2")).when(u < 0.4, F.regexp_replace(addr, r"^([^0-9]*)([0-9])", "$100$2")).otherwise(addr)
    return F.when(uniform(ident, "addrcase") < 0.3, F.upper(out)).otherwise(out)


def duplicates(records: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Variants of the given records, each landing in source 2 or 3 under an id
    ``S<src>-A<hash>`` of its own."""
    many = records.withColumn("copy", F.explode(F.expr("sequence(1, 2)"))).where(F.col("copy") <= copies(F.col("entity_id")))
    many = many.withColumn("__id", F.concat_ws("#", "entity_id", F.col("copy").cast("string")))
    many = with_name_variant(many, "name", "__id", vocabulary)
    src = F.when(uniform(F.col("__id"), "src") < 0.5, 2).otherwise(3)
    return many.select(
        F.format_string("S%d-A%016x", src, F.xxhash64("__id")).alias("entity_id"), F.col("entity_id").alias("made_from"),
        "name", addr_variant(F.col("addr"), F.col("__id")).alias("addr"), "country",
    )


def near_siblings(pairs: DataFrame) -> DataFrame:
    """False pairs that look like siblings: numbers differ, the entity's own
    number is supported, names close, at most two extra words; once per record."""
    ok = "y = 0 and rel >= 2 and s1_support > 0 and (jw >= 0.85 or b_sub_a = 1 or a_sub_b = 1) and b_minus_a <= 2 and atsr >= 0.75"
    return pairs.where(ok).groupBy("src", "j").agg(F.min("i1").alias("i1"))
