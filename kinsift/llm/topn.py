"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n_per_group(
    df: DataFrame,
    group: list[str],
    item: list[str],
    order: list[Column],
    n: int,
    rank_name: str = "rank",
) -> DataFrame:
    """The ``n`` first distinct items of every group.

    ``order`` must end in the item columns so that no two items tie. An item
    that occurs more than once counts once, with its first row in the order.

    Two row_number windows, each with a rank filter, so the optimiser puts a
    group limit before and after either shuffle. The first is keyed by group
    and item, hence a group holding any share of the rows spreads over all
    tasks; what reaches the second is cut to ``n`` rows per group and map task
    before it moves.

    NULL group keys form one group; an item column may be NULL; an empty input
    gives an empty result; further columns are carried along, except that
    ``rank_name`` and the two helper names are replaced.
    """
    once = Window.partitionBy(*group, *item).orderBy(*order)
    best = Window.partitionBy(*group).orderBy(*order)
    return (
        df.drop(rank_name, "__nth")
        .withColumn("__nth", F.row_number().over(once))
        .where(F.col("__nth") == 1)
        .drop("__nth")
        .withColumn(rank_name, F.row_number().over(best))
        .where(F.col(rank_name) <= n)
    )


def best_candidates(scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best candidate pairs of every ``i1``.

    Only rows with ``s_all`` above 0 count (not NULL, not NaN). Order: s_all,
    s_name, s_addr descending with NULL below every number, then src, j. A NaN
    in s_name or s_addr sorts above every number, as Spark orders NaN. Rows
    without i1, src or j are kept as items of their own like any other value.
    """
    sound = scores.select("i1", "src", "j", "s_all", "s_name", "s_addr").where(
        (F.col("s_all") > 0) & ~F.isnan("s_all")
    )
    order = [F.col(c).desc_nulls_last() for c in ("s_all", "s_name", "s_addr")] + [
        F.col("src").asc(),
        F.col("j").asc(),
    ]
    return top_n_per_group(sound, ["i1"], ["src", "j"], order, n)
