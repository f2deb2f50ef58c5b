"""Queries of metrics, decision rules and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.operators import context, decide, report, sample
from kinsift.plans import sqltext, views
from kinsift.plans.views import CAND_SQL, LAB_SQL, TRUTH_SQL
from kinsift.session import table

CUTS = [round(0.1 * k, 1) for k in range(1, 10)]
_TIE = ("src", "j")


def _tie():
    return [F.col(c) for c in _TIE]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return views.labelled(spark, d).select("i1", "src", "j", "source1_entity_id", "matched_entity_id", "s_all", "cs_name", F.round("cs_all", 3).alias("p"), "y")


def _with_meta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = _pairs(spark, d)
    return pairs, views.meta(pairs, views.truth(spark, d))


def truth_labels(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("i1", "src", "j", "y")


def macro_f05(spark: SparkSession, d: str) -> DataFrame:
    pairs, meta = _with_meta(spark, d)
    got = decide.score_selection(pairs, F.col("p") >= 0.5, meta, "i1")
    return got.select("i1", "n_true", "tp", "n_pred", F.round("f05", 6).alias("f05"))


def sweep(spark: SparkSession, d: str) -> DataFrame:
    pairs, meta = _with_meta(spark, d)
    return decide.threshold_sweep(pairs, meta, "i1", "p", CUTS).select("th", F.round("mean_f05", 6).alias("mean_f05"))


def best_cut(spark: SparkSession, d: str) -> DataFrame:
    return decide.best_threshold(sweep(spark, d))


def recall_cut(spark: SparkSession, d: str) -> DataFrame:
    return decide.recall_bound_cut(_pairs(spark, d), "p", CUTS, 0.05).select("th", F.round("kept", 6).alias("kept"))


def filter_keep(spark: SparkSession, d: str) -> DataFrame:
    return decide.keep_some(_pairs(spark, d), "i1", "p", list(_TIE), 0.5, 2).select("i1", "src", "j")


def expected(spark: SparkSession, d: str) -> DataFrame:
    return decide.expected_f05(_pairs(spark, d), "i1", "p", _tie()).where("selected").select("i1", "src", "j")


def margin(spark: SparkSession, d: str) -> DataFrame:
    return decide.margin_rule(_pairs(spark, d), "i1", "p", 0.3, 0.8).select("i1", "src", "j")


def rescue(spark: SparkSession, d: str) -> DataFrame:
    p = context.top_two(_pairs(spark, d), "i1", "p", list(_TIE))
    return decide.relative_cut_and_rescue(p, "i1", "p", 0.6, 0.1, 0.4, 0.2).where("selected").select("i1", "src", "j")


def cut_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where(F.col("p") >= F.when(F.col("src") == 2, 0.5).otherwise(0.6)).select("i1", "src", "j")


def one_owner(spark: SparkSession, d: str) -> DataFrame:
    return decide.one_owner(_pairs(spark, d).where("p >= 0.4"), ["src", "j"], "p", "i1").select("i1", "src", "j")


def unseen_cut(spark: SparkSession, d: str) -> DataFrame:
    """A stricter cut for entities whose country no label has."""
    ent = views.entities(spark, d).select(F.col("entity_id").alias("source1_entity_id"), "country")
    pairs = _pairs(spark, d).join(ent, "source1_entity_id")
    seen = pairs.where("y = 1").select("country").distinct().withColumn("seen", F.lit(True))
    got = pairs.join(seen, "country", "left")
    return got.where(F.col("p") >= F.when(F.col("seen"), 0.5).otherwise(0.8)).select("i1", "src", "j")


def match_lists(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "records", "entity_id", "src").where("src = 1").select(F.col("entity_id").alias("source1_entity_id")).distinct()
    best = _pairs(spark, d).where("p >= 0.5").groupBy("source1_entity_id", "matched_entity_id").agg(F.max("p").alias("p"))
    return decide.match_lists(owners, best, "source1_entity_id", "p", "matched_entity_id", "matched_entity_ids")


def crosstab(spark: SparkSession, d: str) -> DataFrame:
    c = views.candidates(spark, d).withColumn("band", F.when(F.col("cs_all") >= 0.5, "high").when(F.col("cs_all") >= 0.1, "mid").otherwise("low"))
    return report.crosstab(c, "src", "band", ["high", "mid", "low"])


def loss_share(spark: SparkSession, d: str) -> DataFrame:
    pairs, meta = _with_meta(spark, d)
    got = decide.score_selection(pairs, F.col("p") >= 0.5, meta, "i1").withColumn("loss", 1 - F.col("f05"))
    kind = F.when(F.col("n_true") == 0, "no match").when(F.col("n_pred") == 0, "empty").when(F.col("tp") == F.col("n_pred"), "clean").otherwise("mixed")
    return report.loss_share(got.withColumn("kind", kind), "kind", "loss").select("kind", "n", F.round("mean_loss", 6).alias("mean_loss"), F.round("share", 6).alias("share"))


def reweight(spark: SparkSession, d: str) -> DataFrame:
    ent = views.entities(spark, d)
    w = report.frequency_weights(ent.where("src = 1"), ent.where("src = 2"), "country")
    return w.select("country", F.round("w", 6).alias("w"))


def quartiles(spark: SparkSession, d: str) -> DataFrame:
    return report.quartiles(views.candidates(spark, d), "src", "s_all")


def miss_stage(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    keys = ["source1_entity_id", "matched_entity_id"]
    return report.miss_stage(views.truth(spark, d), p, p.where("p >= 0.5"), keys).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def blend(spark: SparkSession, d: str) -> DataFrame:
    ours = views.candidates(spark, d).select("i1", "src", "j", F.round("cs_name", 3).alias("p"))
    other = views.candidates(spark, d).where("s_addr > 0").select("i1", "src", "j", F.round("cs_addr", 3).alias("p"))
    return report.bridge(ours, other, ["i1", "src", "j"], 0.2).select("i1", "src", "j", F.round("p", 6).alias("p"))


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    c = views.candidates(spark, d)
    seen = c.groupBy("i1").count().where("count >= 5").select("i1")
    cols = ["i1", "src", "j", "p"]
    return report.by_partition(seen, c.withColumn("p", F.round("cs_all", 3)).select(*cols), c.withColumn("p", F.round("cs_name", 3)).select(*cols), "i1").select(*cols)


def mean_models(spark: SparkSession, d: str) -> DataFrame:
    return views.candidates(spark, d).select("i1", "src", "j", F.round((F.col("cs_name") + F.col("cs_addr") + F.col("cs_all")) / 3, 5).alias("p"))


def alt_profile(spark: SparkSession, d: str) -> DataFrame:
    """Strong candidates per entity beside its best one, clipped at 4."""
    c = context.top_two(views.candidates(spark, d), "i1", "cs_all", list(_TIE))
    return c.groupBy("i1").agg(F.least(F.sum(((F.col("cs_all") >= 0.3) & ~F.col("is_top")).cast("int")), F.lit(4)).alias("alts"))


def anchor_profile(spark: SparkSession, d: str) -> DataFrame:
    """Other strong candidates of the same source: the group's sum less the row's own."""
    c = views.candidates(spark, d).withColumn("strong", ((F.col("s_addr") > 0) & (F.col("cs_name") >= 0.3)).cast("int"))
    base = c
    c = context.group_stats(base, ["i1", "src"], same=F.sum("strong"))
    c = context.group_stats(c, ["i1"], source=base, every=F.sum("strong"))
    return c.select("i1", "src", "j", (F.col("same") - F.col("strong")).alias("anc_same"), (F.col("every") - F.col("same")).alias("anc_other"))


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "split_assign", "source1_entity_id")
    return listed.distinct().join(views.truth(spark, d).select("source1_entity_id").distinct(), "source1_entity_id", "left_anti")


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split_assign", "source1_entity_id").intersect(views.truth(spark, d).select("source1_entity_id"))


def validation_split(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "records", "entity_id", "src").where("src = 1").select("entity_id").distinct()
    return ids.where(sample.is_validation(F.col("entity_id")))


def strata(spark: SparkSession, d: str) -> DataFrame:
    c = views.candidates(spark, d).groupBy("i1").agg(F.max("cs_all").alias("m"))
    c = c.withColumn("stratum", F.when(F.col("m") >= 0.9, "sure").when(F.col("m") >= 0.4, "likely").otherwise("open"))
    return sample.stratified(c, "i1", "stratum", {"open": 15, "likely": 20, "sure": 10}, F.col("i1"))


def _sel(cond: str) -> str:
    return f"WITH {LAB_SQL}, pr AS (SELECT *, round(cs_all, 3) AS p FROM lab) SELECT i1, src, j FROM pr WHERE {cond}"


_PR = f"{LAB_SQL}, pr AS (SELECT *, round(cs_all, 3) AS p FROM lab)"
_F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN n_pred = 0 OR n_true = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END"
_SCORED = f"""{_PR}, sc AS (SELECT m.i1, m.n_true, CAST(coalesce(sum(CASE WHEN p >= 0.5 THEN y END), 0) AS BIGINT) AS tp,
    CAST(coalesce(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_pred FROM meta m LEFT JOIN pr USING (i1) GROUP BY m.i1, m.n_true),
  f AS (SELECT *, {_F05} AS f05 FROM sc)"""
_CUTS = ", ".join(f"({c})" for c in CUTS)
_SWEEP = f"""{_PR}, cuts(th) AS (VALUES {_CUTS}), g AS (SELECT m.i1, m.n_true, CAST(th AS DOUBLE) AS th,
    sum(CASE WHEN p >= th THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= th THEN 1 ELSE 0 END) AS n_pred
    FROM meta m CROSS JOIN cuts LEFT JOIN pr USING (i1) GROUP BY m.i1, m.n_true, th),
  sw AS (SELECT th, round(avg({_F05}), 6) AS mean_f05 FROM g GROUP BY th)"""

QUERIES = {
    "truth_labels": truth_labels, "macro_f05": macro_f05, "threshold_sweep": sweep, "best_threshold": best_cut,
    "recall_bound_cut": recall_cut, "filter_keep": filter_keep, "expected_f05": expected, "margin_rule": margin,
    "relative_cut_rescue": rescue, "cut_by_source": cut_by_source, "one_owner": one_owner, "unseen_cut": unseen_cut,
    "match_lists": match_lists, "crosstab": crosstab, "loss_share": loss_share, "reweight": reweight, "quartiles": quartiles,
    "miss_stage": miss_stage, "blend": blend, "hybrid": hybrid, "mean_models": mean_models, "alt_profile": alt_profile,
    "anchor_profile": anchor_profile, "set_difference": set_difference, "set_intersection": set_intersection,
    "validation_split": validation_split, "strata": strata,
}

ORACLE = {
    "truth_labels": f"WITH {LAB_SQL} SELECT i1, src, j, y FROM lab",
    "macro_f05": f"WITH {_SCORED} SELECT i1, n_true, tp, n_pred, round(f05, 6) AS f05 FROM f",
    "threshold_sweep": f"WITH {_SWEEP} SELECT th, mean_f05 FROM sw",
    "best_threshold": f"WITH {_SWEEP} SELECT th, mean_f05 FROM sw ORDER BY mean_f05 DESC, th LIMIT 1",
    "recall_bound_cut": f"""WITH {_PR}, cuts(th) AS (VALUES {_CUTS}), k AS (SELECT CAST(th AS DOUBLE) AS th,
        round(sum(CASE WHEN p >= th THEN y ELSE 0 END) / sum(y), 6) AS kept FROM pr CROSS JOIN cuts GROUP BY th)
      SELECT th, kept FROM k WHERE kept >= 0.05 ORDER BY th DESC LIMIT 1""",
    "filter_keep": f"""WITH {_PR} SELECT i1, src, j FROM (SELECT *, row_number() OVER (PARTITION BY i1 ORDER BY p DESC, src, j) AS n FROM pr)
      WHERE p >= 0.5 OR n <= 2""",
    "expected_f05": f"""WITH {_PR}, a AS (SELECT *, row_number() OVER w AS m, sum(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs,
          sum(p) OVER (PARTITION BY i1) AS et, exp(sum(ln(1 - least(p, 1 - 1e-9))) OVER (PARTITION BY i1)) AS pe
          FROM pr WINDOW w AS (PARTITION BY i1 ORDER BY p DESC, src, j)),
        b AS (SELECT *, 1.25 * cs / (0.25 * et + m) AS ef FROM a), c AS (SELECT *, max(ef) OVER (PARTITION BY i1) AS best FROM b),
        e AS (SELECT *, min(CASE WHEN ef >= best - 1e-12 THEN m END) OVER (PARTITION BY i1) AS bm FROM c)
      SELECT i1, src, j FROM e WHERE m <= bm AND pe < best AND p >= 0""",
    "margin_rule": f"WITH {_PR} SELECT i1, src, j FROM (SELECT *, max(p) OVER (PARTITION BY i1) AS t FROM pr) WHERE p >= 0.3 AND p >= 0.8 * t",
    "relative_cut_rescue": f"""WITH {_PR}, a AS (SELECT *, first_value(p) OVER w AS top, coalesce(nth_value(p, 2) OVER w, 0.0) AS second,
          row_number() OVER (PARTITION BY i1 ORDER BY p DESC, src, j) = 1 AS is_top FROM pr
          WINDOW w AS (PARTITION BY i1 ORDER BY p DESC, src, j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        b AS (SELECT *, p >= 0.6 AND top - p <= 0.1 AS s0 FROM a), c AS (SELECT *, bool_or(s0) OVER (PARTITION BY i1) AS any0 FROM b)
      SELECT i1, src, j FROM c WHERE s0 OR (NOT any0 AND is_top AND p >= 0.4 AND top - second >= 0.2)""",
    "cut_by_source": _sel("p >= CASE WHEN src = 2 THEN 0.5 ELSE 0.6 END"),
    "one_owner": f"WITH {_PR} SELECT i1, src, j FROM (SELECT *, row_number() OVER (PARTITION BY src, j ORDER BY p DESC, i1) AS n FROM pr WHERE p >= 0.4) WHERE n = 1",
    "unseen_cut": f"""WITH {_PR}, {views.ENT_SQL}, x AS (SELECT pr.*, ent.country FROM pr JOIN ent ON ent.entity_id = pr.source1_entity_id),
        seen AS (SELECT DISTINCT country FROM x WHERE y = 1)
      SELECT i1, src, j FROM x LEFT JOIN seen USING (country) WHERE p >= CASE WHEN seen.country IS NOT NULL THEN 0.5 ELSE 0.8 END""",
    "match_lists": f"""WITH {_PR}, b AS (SELECT source1_entity_id, matched_entity_id, max(p) AS p FROM pr WHERE p >= 0.5 GROUP BY ALL),
        l AS (SELECT source1_entity_id, string_agg(matched_entity_id, ',' ORDER BY p DESC, matched_entity_id) AS s FROM b GROUP BY 1)
      SELECT o.source1_entity_id, coalesce(l.s, '') AS matched_entity_ids FROM (SELECT DISTINCT entity_id AS source1_entity_id FROM records WHERE src = 1) o
      LEFT JOIN l USING (source1_entity_id)""",
    "crosstab": f"""WITH {CAND_SQL} SELECT src, sum(CASE WHEN cs_all >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS high,
        sum(CASE WHEN cs_all >= 0.1 AND cs_all < 0.5 THEN 1 ELSE 0 END)::BIGINT AS mid, sum(CASE WHEN cs_all < 0.1 THEN 1 ELSE 0 END)::BIGINT AS low FROM cand GROUP BY src""",
    "loss_share": f"""WITH {_SCORED}, k AS (SELECT CASE WHEN n_true = 0 THEN 'no match' WHEN n_pred = 0 THEN 'empty' WHEN tp = n_pred THEN 'clean' ELSE 'mixed' END AS kind,
        1 - f05 AS loss FROM f) SELECT kind, count(*) AS n, round(avg(loss), 6) AS mean_loss, round(sum(loss) / (SELECT sum(loss) FROM k), 6) AS share FROM k GROUP BY kind""",
    "reweight": f"""WITH {views.ENT_SQL}, a AS (SELECT country, count(*) / (SELECT count(*) FROM ent WHERE src = 1) AS fv FROM ent WHERE src = 1 GROUP BY country),
        b AS (SELECT country, count(*) / (SELECT count(*) FROM ent WHERE src = 2) AS ft FROM ent WHERE src = 2 GROUP BY country)
      SELECT country, round(coalesce(ft / fv, 0.0), 6) AS w FROM a LEFT JOIN b USING (country)""",
    "quartiles": f"WITH {CAND_SQL} SELECT src, quantile_cont(s_all, 0.25) AS q25, quantile_cont(s_all, 0.5) AS q50, quantile_cont(s_all, 0.75) AS q75 FROM cand GROUP BY src",
    "miss_stage": f"""WITH {_PR}, s AS (SELECT t.*, CASE WHEN (source1_entity_id, matched_entity_id) NOT IN (SELECT (source1_entity_id, matched_entity_id) FROM pr) THEN 'never blocked'
        WHEN (source1_entity_id, matched_entity_id) NOT IN (SELECT (source1_entity_id, matched_entity_id) FROM pr WHERE p >= 0.5) THEN 'dropped by filter' ELSE 'kept' END AS stage FROM truth t)
      SELECT stage, count(*) AS n FROM s GROUP BY stage""",
    "blend": f"""WITH {CAND_SQL} SELECT i1, src, j, round(CASE WHEN s_addr > 0 THEN 0.2 * round(cs_addr, 3) + 0.8 * round(cs_name, 3) ELSE round(cs_name, 3) END, 6) AS p FROM cand""",
    "hybrid": f"""WITH {CAND_SQL} SELECT i1, src, j, round(CASE WHEN count(*) OVER (PARTITION BY i1) >= 5 THEN cs_all ELSE cs_name END, 3) AS p FROM cand""",
    "mean_models": f"WITH {CAND_SQL} SELECT i1, src, j, round((cs_name + cs_addr + cs_all) / 3, 5) AS p FROM cand",
    "alt_profile": f"""WITH {CAND_SQL} SELECT i1, least(sum(CASE WHEN cs_all >= 0.3 AND n > 1 THEN 1 ELSE 0 END), 4)::BIGINT AS alts
      FROM (SELECT *, row_number() OVER (PARTITION BY i1 ORDER BY cs_all DESC, src, j) AS n FROM cand) GROUP BY i1""",
    "anchor_profile": f"""WITH {CAND_SQL}, a AS (SELECT *, CASE WHEN s_addr > 0 AND cs_name >= 0.3 THEN 1 ELSE 0 END AS st FROM cand)
      SELECT i1, src, j, (sum(st) OVER w - st)::BIGINT AS anc_same, (sum(st) OVER (PARTITION BY i1) - sum(st) OVER w)::BIGINT AS anc_other FROM a WINDOW w AS (PARTITION BY i1, src)""",
    "set_difference": f"WITH {TRUTH_SQL} SELECT source1_entity_id FROM split_assign EXCEPT SELECT source1_entity_id FROM truth",
    "set_intersection": f"WITH {TRUTH_SQL} SELECT source1_entity_id FROM split_assign INTERSECT SELECT source1_entity_id FROM truth",
    "validation_split": f"""SELECT entity_id FROM (SELECT DISTINCT entity_id, 'split' || entity_id AS t FROM records WHERE src = 1) WHERE {sqltext.crc32("t")} % 5 = 0""",
    "strata": f"""WITH {CAND_SQL}, m AS (SELECT i1, max(cs_all) AS m FROM cand GROUP BY i1),
        s AS (SELECT i1, CASE WHEN m >= 0.9 THEN 'sure' WHEN m >= 0.4 THEN 'likely' ELSE 'open' END AS stratum FROM m)
      SELECT i1, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY i1) AS n FROM s)
      WHERE n <= CASE stratum WHEN 'open' THEN 15 WHEN 'likely' THEN 20 ELSE 10 END""",
}
