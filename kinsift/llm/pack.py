"""Filling containers of fixed capacity with items of varying length.

Minimum bin slack: each container starts with the longest item left. A bitset
of reachable sums over the remaining lengths finds the fill closest to the
capacity, the counts of every length are backtracked from the steps of the
search, and the pattern is used as often as the counts allow.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinsift.session import small_rows


def _best_fill(room: int, lengths: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
    """(length, count) whose sum comes closest to ``room`` without passing it.

    Bit k of ``reach`` says that the sum k can be had. Counts are split into
    powers of two; ``steps`` keeps every state for the way back. The search
    ends as soon as the room can be filled exactly.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in lengths:
        if size > room or not left[size]:
            continue
        many = min(left[size], room // size)
        chunk = 1
        while many > 0:
            take = min(chunk, many)
            new = (reach | reach << (take * size)) & mask
            if new != reach:
                steps.append((reach, size, take))
                reach = new
            many -= take
            chunk *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, size, take in reversed(steps):
        if not before >> at & 1:
            at -= take * size
            used[size] = used.get(size, 0) + take
    return sorted(used.items(), reverse=True)


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item positions; no item may exceed the capacity."""
    where: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: -i):
        where.setdefault(sizes[i], []).append(i)
    left = {s: len(v) for s, v in where.items()}
    lengths = sorted(left, reverse=True)
    out: list[list[int]] = []
    for size in lengths:
        while left[size]:
            left[size] -= 1
            rest = _best_fill(capacity - size, lengths, left)
            left[size] += 1
            pattern: dict[int, int] = {size: 1}
            for s, n in rest:
                pattern[s] = pattern.get(s, 0) + n
            for _ in range(min(left[s] // n for s, n in pattern.items())):
                out.append([where[s].pop() for s, n in pattern.items() for _ in range(n)])
                for s, n in pattern.items():
                    left[s] -= n
    return out


def packed(sizes: DataFrame, bins: DataFrame, items_per_shard: int = 4000) -> DataFrame:
    """(bin_name, container, doc_id, first_token, n_tokens): a packing of all
    texts for every capacity.

    ``sizes(doc_id, n_tokens)`` are the texts, ``bins(bin_name,
    capacity_tokens)`` a small table. Only a text longer than the capacity is
    divided: into full containers and a rest, which is an item like any other.
    Items are dealt by hash into shards of about ``items_per_shard``; shards are
    packed apart, so work is linear, no task holds more than a shard, and at
    most one container a shard stays poorly filled.

    Texts without tokens need no container and are absent, as are bins whose
    capacity is NULL or below one; empty tables give an empty result; repeated
    rows are items of their own.
    """
    spark, schema = sizes.sparkSession, "bin_name string, capacity_tokens int"
    bins = bins.where("capacity_tokens >= 1").select("bin_name", F.col("capacity_tokens").cast("int").alias("capacity_tokens"))
    bins = spark.createDataFrame([tuple(r) for r in small_rows(bins, 1000, "bins")], schema)
    shards = max(1, -(-sizes.count() // items_per_shard))
    pieces = (
        sizes.where("n_tokens > 0")
        .select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row"))
        .crossJoin(F.broadcast(bins))
        .withColumn("first_token", F.explode(F.expr("sequence(0L, n_tokens - 1, bigint(capacity_tokens))")))
        .withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("first_token"), F.col("capacity_tokens").cast("bigint")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "first_token"), F.lit(shards)))
        .drop("row")
    )

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        name, shard, capacity = key
        pdf = pdf.sort_values(["doc_id", "first_token"], kind="stable").reset_index(drop=True)
        at = [""] * len(pdf)
        for k, items in enumerate(pack([int(x) for x in pdf["n_tokens"]], int(capacity))):
            for i in items:
                at[i] = f"{name}-{shard}-{k}"
        return pdf.assign(container=at, bin_name=name)[["bin_name", "container", "doc_id", "first_token", "n_tokens"]]

    return pieces.groupBy("bin_name", "shard", "capacity_tokens").applyInPandas(
        run, "bin_name string, container string, doc_id bigint, first_token bigint, n_tokens bigint"
    )


def fill_report(packing: DataFrame, bins: DataFrame) -> DataFrame:
    """Containers, tokens and the share of used space by bin."""
    return (
        packing.groupBy("bin_name")
        .agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
        .join(bins, "bin_name")
        .select("bin_name", "containers", "tokens",
                (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
    )
