"""Mixing sources to target weights.

Entropy balancing: among all rates that give every source its share of the
tokens, those nearest to one copy of each text are exponential in the text's
length, capped by the repeats allowed. The dual has one variable per source; a
Newton step needs two sums per source, taken over a histogram of lengths that
is itself a distributed aggregate. Rates are then rounded into copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from kinsift.session import materialize, small_rows


def balance(lengths: DataFrame, targets: dict[str, tuple[float, int]], total: float, rounds: int = 40) -> dict[str, float]:
    """The dual variable of every source.

    ``lengths(source, n_tokens, n)`` is the histogram, ``targets`` maps a source
    to its share and its most repeats. Each round is one aggregation with one
    row per source. The step is kept inside the interval that is known to hold
    the root, so capped and flat stretches do no harm. A source that cannot
    reach its share even when every text is repeated as often as allowed gets
    an infinite variable: all its texts at the cap.
    """
    base = {
        r["source"]: (r["tokens"], r["texts"])
        for r in lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("texts")).collect()
    }  # one row per source of the target table
    want = {s: share * total for s, (share, _) in targets.items() if s in base}
    dual: dict[str, float] = {}
    low, high = {}, {}
    for s, w in want.items():
        if w >= targets[s][1] * base[s][0]:
            dual[s] = math.inf
        elif w <= 0:
            dual[s] = -math.inf
        else:
            dual[s], low[s], high[s] = 0.0, -60.0, 60.0
    scale = {s: base[s][0] / base[s][1] for s in base}
    for _ in range(rounds):
        live = [s for s in low if high[s] - low[s] > 1e-9]
        if not live:
            break
        kind = "source string, lam double, cap double, scale double"
        state = lengths.sparkSession.createDataFrame([(s, dual[s], float(targets[s][1]), scale[s]) for s in live], kind)
        x = F.col("n_tokens") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        sums = (
            lengths.join(F.broadcast(state), "source")
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("n_tokens") * F.least(rate, F.col("cap"))).alias("got"),
                F.sum(F.when(rate < F.col("cap"), F.col("n") * F.col("n_tokens") * x * rate).otherwise(0.0)).alias("slope"),
            )
            .collect()
        )
        done = True
        for r in sums:
            s, gap = r["source"], r["got"] - want[r["source"]]
            if abs(gap) <= 1e-6 * want[s]:
                low[s] = high[s] = dual[s]
                continue
            done = False
            if gap > 0:
                high[s] = dual[s]
            else:
                low[s] = dual[s]
            step = dual[s] - gap / r["slope"] if r["slope"] > 0 else math.nan
            dual[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
        if done:
            break
    return dual


def mixed(sizes: DataFrame, mix_targets: DataFrame, total_tokens: float | None = None, bucket: int = 1000) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each text is used.

    ``sizes(doc_id, source, n_tokens)`` are all texts; ``mix_targets(source,
    target_share, max_repeats)`` is a small table. The mix aims at
    ``total_tokens``, by default as many tokens as the targeted sources hold. A
    source that cannot reach its share is used up to its cap; the others keep
    their targets. Rates are rounded by systematic sampling in buckets of about
    ``bucket`` texts dealt by hash, so the copies of a bucket miss its rates by
    less than one and no window holds a whole source.

    Texts without tokens, of a NULL source or of one without target are in no
    mix; texts with no copy are absent; repeated rows are texts of their own;
    empty tables give an empty result.
    """
    rows = small_rows(mix_targets.where("source is not null").select("source", "target_share", "max_repeats"), 10_000, "mix_targets")
    targets = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows}
    spark = sizes.sparkSession
    named = spark.createDataFrame([(s, float(m)) for s, (_, m) in targets.items()], "source string, cap double")
    texts = materialize(
        sizes.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(F.broadcast(named), "source"), "texts"
    )
    lengths = materialize(texts.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    facts = lengths.groupBy("source").agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).collect()
    if total_tokens is None:
        total_tokens = float(sum(r["tokens"] for r in facts))
    dual = balance(lengths, targets, total_tokens)
    state = spark.createDataFrame(
        [(r["source"], max(-1e9, min(1e9, dual[r["source"]])), r["tokens"] / r["texts"], max(1, -(-r["texts"] // bucket))) for r in facts],
        "source string, lam double, scale double, parts bigint",
    )
    rated = texts.join(F.broadcast(state), "source").withColumn(
        "rate", F.least(F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("scale"), F.lit(50.0))), F.col("cap"))
    )
    whole = F.floor("rate")
    rated = rated.withColumn("whole", whole).withColumn("part", F.col("rate") - whole)
    rated = rated.withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts")))
    order = Window.partitionBy("source", "bin").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(9)), "doc_id")
    running = F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, 0))
    start = F.pmod(F.xxhash64("source", "bin"), F.lit(1_000_003)) / 1_000_003
    extra = F.floor(running + start) - F.floor(running - F.col("part") + start)
    return (
        rated.withColumn("copies", F.least(F.col("whole") + extra, F.col("cap")).cast("int"))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )


def shares(mix: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, tokens, reached_share) for
    every target, with zeros for a source that contributes nothing."""
    per = mix.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")
    )
    got = mix_targets.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["texts", "tokens"])
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    return got.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "texts", "tokens",
        F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("reached_share"),
    )
