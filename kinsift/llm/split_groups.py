"""Splits that keep related records together.

Groups are the connected components of records that share a linked record. The
assignment starts from hashed components and improves it by swap search:
components move between splits, or trade places, under simulated annealing
that lowers the deviation of sizes and labels from the targets. Searches run
in parallel, one per shard and seed, and the best state of each shard is kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinsift.llm.components import connected_components
from kinsift.session import materialize, small_rows


def normal_id(col: str):
    return F.upper(F.trim(F.col(col)))


def record_groups(positives: DataFrame, records: DataFrame) -> DataFrame:
    """(node, component) over S1 ids and the matched ids that tie them.

    Ids compare without surrounding blanks and in upper case. NULL, empty and
    placeholder ids, and any matched id that is no ``entity_id`` of records,
    tie nothing.
    """
    ties = positives.select(
        normal_id("source1_entity_id").alias("u"), normal_id("matched_entity_id").alias("v")
    ).where("u is not null and v is not null and u != '' and v != ''")
    known = records.select(normal_id("entity_id").alias("v")).distinct()
    # a matched id never is an S1 id; the prefix keeps the two kinds apart
    ties = ties.distinct().join(known, "v", "left_semi").select(
        F.concat(F.lit("a:"), "u").alias("u"), F.concat(F.lit("b:"), "v").alias("v")
    )
    found = connected_components(ties)
    return found.where("node like 'a:%'").select(
        F.expr("substring(node, 3)").alias("source1_entity_id"), "component"
    )


def assigned_groups(split_assign: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row of split_assign with its group; an id without ties is alone."""
    rows = split_assign.select(
        normal_id("source1_entity_id").alias("source1_entity_id"), F.lower(F.trim("split")).alias("split")
    ).where("source1_entity_id is not null and source1_entity_id != ''")
    return rows.join(groups, "source1_entity_id", "left").withColumn(
        "component", F.coalesce("component", F.concat(F.lit("a:"), "source1_entity_id"))
    )


def scattered_ids(split_assign: DataFrame, positives: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of split_assign whose group has more than one split there.

    All rows of an id count, a NULL split is none, and all listed ids of such a
    group are returned, those without a split too.
    """
    rows = assigned_groups(split_assign, record_groups(positives, records))
    bad = (
        rows.groupBy("component")
        .agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        .where("lo != hi")
        .select("component")
    )
    return rows.join(bad, "component", "left_semi").select("source1_entity_id").distinct()


def _anneal(sizes, labels, shares, goal_size, goal_label, start, seed, steps):
    """One annealing run over whole components; returns (cost, assignment)."""
    import math
    import random

    rng = random.Random(seed)
    k, n = len(shares), len(sizes)
    at = list(start)
    load = [0.0] * k
    lab = [[0.0] * len(goal_label[0]) for _ in range(k)]
    for i, s in enumerate(at):
        load[s] += sizes[i]
        for j, x in enumerate(labels[i]):
            lab[s][j] += x
    total = max(1.0, float(sum(sizes)))

    def part(s: int) -> float:
        c = abs(load[s] - goal_size[s])
        for j, x in enumerate(lab[s]):
            c += 0.2 * abs(x - goal_label[s][j])
        return c / total

    def shift(i: int, s: int, t: int) -> None:
        load[s] -= sizes[i]
        load[t] += sizes[i]
        for j, x in enumerate(labels[i]):
            lab[s][j] -= x
            lab[t][j] += x
        at[i] = t

    cost = sum(part(s) for s in range(k))
    best, kept, heat = cost, list(at), max(cost, 1e-9) / 4
    for step in range(steps):
        i = rng.randrange(n)
        s = at[i]
        if rng.random() < 0.5:
            t = rng.randrange(k)
            if t == s:
                continue
            before = part(s) + part(t)
            shift(i, s, t)
            delta = part(s) + part(t) - before
            undo = ((i, t, s),)
        else:
            j = rng.randrange(n)
            t = at[j]
            if t == s:
                continue
            before = part(s) + part(t)
            shift(i, s, t)
            shift(j, t, s)
            delta = part(s) + part(t) - before
            undo = ((j, s, t), (i, t, s))
        warm = heat * (1 - step / steps) + 1e-12
        if delta <= 0 or rng.random() < math.exp(-delta / warm):
            cost += delta
            if cost < best - 1e-12:
                best, kept = cost, list(at)
        else:
            for x in undo:
                shift(*x)
    return best, kept


def _search(names: list[str], shares: list[float], steps: int):
    """Pandas function of one shard and seed: one annealing run from the hashed
    start, with its cost on every row."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_right
        from hashlib import blake2b
        from itertools import accumulate

        shard, seed = key
        pdf = pdf.sort_values("component")
        sizes, labels = [float(x) for x in pdf["size"]], [list(x) for x in pdf["labels"]]
        whole, width, k = sum(sizes), len(labels[0]), len(names)
        every = [sum(x[j] for x in labels) for j in range(width)]
        edges = list(accumulate(shares))
        start = []
        for c in pdf["component"]:
            u = int.from_bytes(blake2b(c.encode(), digest_size=8).digest(), "big") / 2**64
            start.append(min(k - 1, bisect_right(edges, u * edges[-1])))
        cost, kept = _anneal(
            sizes, labels, shares, [g * whole for g in shares], [[g * x for x in every] for g in shares], start,
            int(1_000 * (shard + 2) + seed), steps * len(sizes),
        )
        return pd.DataFrame({"shard": shard, "seed": seed, "cost": cost, "component": pdf["component"], "split": [names[s] for s in kept]})

    return run


FOUND = "shard bigint, seed int, cost double, component string, split string"


def _best_runs(comp: DataFrame, names: list[str], shares: list[float], seeds: int, steps: int) -> DataFrame:
    """(component, split, size) of the run of lowest cost of every shard of
    ``comp(component, size, labels, shard)``; each shard and seed is a task's work of its own."""
    many = comp.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    runs = materialize(many.groupBy("shard", "seed").applyInPandas(_search(names, shares, steps), FOUND), "runs")
    best = runs.groupBy("shard").agg(F.min(F.struct("cost", "seed")).alias("b")).select("shard", "b.seed")
    return runs.join(best, ["shard", "seed"]).select("component", "split").join(comp.select("component", "size"), "component")


def assign_splits(
    members: DataFrame,
    targets: list[tuple[str, float]],
    *,
    shard_components: int = 4000,
    seeds: int = 4,
    steps_per_component: int = 40,
) -> DataFrame:
    """(member, component, split) that keeps every component whole.

    ``members(member, component, label)`` holds one row per record. Components
    above 1/400 of all records, of which at most 400 exist, go first, as a shard
    of their own; what they leave of each split's target is the target of the
    rest, which is cut by hash into shards of about ``shard_components``
    components. Each shard is searched from its hashed start with ``seeds``
    seeds, every shard and seed in a task of its own, and the best run counts,
    so work is linear and no task holds more than a shard. Shards aim at the
    same remaining proportions, which add up.

    NULL labels are a label of their own; an empty input gives an empty result;
    a repeated member counts once.
    """
    names = [n for n, _ in targets]
    total_share = sum(s for _, s in targets)
    shares = [s / total_share for _, s in targets]
    members = members.select("member", "component", F.coalesce("label", F.lit("")).alias("label")).dropDuplicates(
        ["member"]
    )
    members = materialize(members, "members")
    label_names = sorted(r[0] for r in small_rows(members.select("label").distinct(), 32, "distinct labels"))
    comp = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.array(*[F.sum((F.col("label") == x).cast("double")) for x in label_names] or [F.lit(0.0)]).alias("labels"),
    )
    comp = materialize(comp, "components")
    total, n_comp = comp.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    heavy_above = max(2, total // 400)
    n_shards = max(1, -(-n_comp // shard_components))
    heavy = comp.where(F.col("size") > heavy_above).withColumn("shard", F.lit(-1).cast("bigint"))
    heavy = materialize(_best_runs(heavy, names, shares, seeds, steps_per_component), "heavy")
    used = {r["split"]: float(r["n"]) for r in heavy.groupBy("split").agg(F.sum("size").alias("n")).collect()}  # one row per split
    rest = [max(0.0, g * total - used.get(n, 0.0)) for n, g in zip(names, shares)]
    rest = [r / sum(rest) for r in rest] if sum(rest) > 0 else shares
    light = comp.where(F.col("size") <= heavy_above).withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(n_shards)))
    chosen = _best_runs(light, names, rest, seeds, steps_per_component).union(heavy)
    return members.join(chosen.drop("size"), "component").select("member", "component", "split")


def balance(split_assignment: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, share, label_deviation): what an assignment reaches.
    ``labels(source1_entity_id, label)``; the deviation is the largest
    difference of a label's share in the split from its share in all."""
    rows = split_assignment.join(labels, "source1_entity_id").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    per = rows.groupBy("split").agg(F.sum("n").alias("n_split"))
    every = rows.groupBy("label").agg(F.sum("n").alias("n_label"))
    total = rows.agg(F.sum("n").alias("total"))
    off = rows.join(per, "split").join(every, "label").crossJoin(F.broadcast(total)).groupBy("split").agg(
        F.first("n_split").alias("n_split"), F.first("total").alias("total"),
        F.max(F.abs(F.col("n") / F.col("n_split") - F.col("n_label") / F.col("total"))).alias("label_deviation"),
    )
    return targets.select(F.col("split_name").alias("split"), F.col("share").alias("target_share")).join(off, "split", "left").select(
        "split", "target_share", F.coalesce(F.col("n_split") / F.col("total"), F.lit(0.0)).alias("share"),
        F.coalesce("label_deviation", F.lit(0.0)).alias("label_deviation"),
    )


def linked_members(split_assign: DataFrame, positives: DataFrame, records: DataFrame) -> DataFrame:
    """(member, component, label) for every S1 id of split_assign or positives;
    the label is the number of matches (0, 1, 2, 3+)."""
    groups = record_groups(positives, records)
    known = records.select(normal_id("entity_id").alias("m")).distinct()
    links = (
        positives.select(normal_id("source1_entity_id").alias("member"), normal_id("matched_entity_id").alias("m"))
        .where("member is not null and member != ''")
        .distinct()
    )
    matches = (
        links.join(known.withColumn("hit", F.lit(1)), "m", "left")
        .groupBy("member")
        .agg(F.sum("hit").alias("n"))
    )
    ids = (
        split_assign.select(normal_id("source1_entity_id").alias("member"))
        .where("member is not null and member != ''")
        .union(links.select("member"))
        .distinct()
    )
    return (
        ids.join(matches, "member", "left")
        .join(groups.withColumnRenamed("source1_entity_id", "member"), "member", "left")
        .select(
            "member",
            F.coalesce("component", F.concat(F.lit("a:"), "member")).alias("component"),
            F.least(F.coalesce("n", F.lit(0)), F.lit(3)).cast("string").alias("label"),
        )
    )


def grouped_splits(
    split_assign: DataFrame, positives: DataFrame, records: DataFrame, split_targets: DataFrame, **options
) -> DataFrame:
    """(source1_entity_id, component, split) for every S1 id of split_assign or
    positives; the label that is balanced is the number of matches."""
    members = linked_members(split_assign, positives, records)
    rows = small_rows(split_targets.select("split_name", "share").orderBy("split_name"), 1000, "split_targets")
    return assign_splits(members, [(r[0], float(r[1])) for r in rows], **options).withColumnRenamed("member", "source1_entity_id")
