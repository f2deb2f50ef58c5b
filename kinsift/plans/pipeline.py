"""The linkage pipeline as one object of lazy stages.

Stages are written only where the work before them is worth keeping: after
retrieval, after the filter and after scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from kinsift.functions import text
from kinsift.operators import blocking, competition, context, decide
from kinsift.operators.model import PairModel
from kinsift.session import materialize, small_rows

FILTER_FEATURES = ["score", "shared", "n_cand", "score_gap", "score_rk", "comp_all_other", "comp_all_gap", "comp_all_rk", "comp_n_suitors"]


@dataclass
class LinkagePipeline:
    """records(entity_id, src, country, name) -> candidates -> scores -> matches.

    ``k`` candidates per entity and source; ``tau`` and ``min_keep`` of the filter;
    ``cut`` the decision threshold, ``unseen_cut`` that of countries without labels."""

    k: int = 12
    cap_frac: float = 0.003
    tau: float = 0.02
    min_keep: int = 2
    cut: float = 0.65
    unseen_cut: float = 0.9
    rounds: int = 10
    filter_model: PairModel | None = field(default=None, repr=False)
    seen: list[str] = field(default_factory=list)

    def candidates(self, records: DataFrame) -> DataFrame:
        tok = blocking.token_table(records.withColumn("core", text.norm_name(F.col("name"))["core"]), F.col("core"), "entity_id", "src", "country")
        pool = tok.where("src > 1")
        weights = blocking.token_weights(pool, pool.groupBy("country").agg(F.countDistinct("entity_id").alias("n")), ["country"], self.cap_frac)
        left = tok.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country", "token")
        right = pool.select(F.col("entity_id").alias("rec_id"), "src", "country", "token")
        scored = blocking.weighted_join(left, right, weights, ["country"], ["s1_id", "country", "src", "rec_id"])
        best = blocking.top_k(scored.withColumn("score", F.round("score", 6)), ["s1_id", "src"], "score", [F.col("rec_id")], self.k)
        full = competition.competition(best, ["src", "rec_id"], "s1_id", {"all": "score"})
        return materialize(context.group_context(full, ["s1_id"], ["score"]), "candidates")

    @staticmethod
    def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
        t = truth.select("s1_id", "rec_id").distinct().withColumn("y", F.lit(1))
        return candidates.join(t, ["s1_id", "rec_id"], "left").fillna(0, ["y"])

    def fit(self, candidates: DataFrame, truth: DataFrame) -> "LinkagePipeline":
        pairs = self.labelled(candidates, truth)
        self.filter_model = PairModel(FILTER_FEATURES, rounds=self.rounds).fit(pairs)
        self.seen = [r[0] for r in small_rows(pairs.where("y = 1").select("country").distinct(), 10_000, "countries with labels")]
        return self

    def score(self, candidates: DataFrame) -> DataFrame:
        scored = self.filter_model.score(candidates)
        return materialize(decide.keep_some(scored, "s1_id", "p", ["src", "rec_id"], self.tau, self.min_keep), "scored")

    def decide(self, scored: DataFrame, one_owner: bool = True) -> DataFrame:
        known: Column = F.col("country").isin(self.seen)
        out = scored.where(F.col("p") >= F.when(known, self.cut).otherwise(self.unseen_cut))
        return decide.one_owner(out, ["src", "rec_id"], "p", "s1_id") if one_owner else out

    def lists(self, records: DataFrame, matches: DataFrame) -> DataFrame:
        owners = records.where("src = 1").select(F.col("entity_id").alias("s1_id")).distinct()
        return decide.match_lists(owners, matches, "s1_id", "p", "rec_id", "matched_entity_ids")
