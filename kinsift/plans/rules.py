"""Queries of the rules and probes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.functions import text
from kinsift.operators import evidence, rules
from kinsift.plans import decisions, features, views

WORDS = ["and", "office", "dental", "services"]


def branch_rules(spark: SparkSession, d: str) -> DataFrame:
    p = features._token_pairs(spark, d).withColumn("aa", text.words(F.col("aa"))).withColumn("ab", text.words(F.col("ab")))
    p = p.withColumn("na", text.house_numbers(F.col("aa"))).withColumn("nb", text.house_numbers(F.col("ab")))
    p = p.withColumn("rel", evidence.number_relation(F.col("na"), F.col("nb"))[0]).withColumn("p", F.round("cs_all", 3))
    p = p.withColumn("bkey", F.array_join(F.array_sort(F.array_distinct("nb")).cast("array<string>"), ","))
    return rules.branch_rules(p, WORDS, "i1").select("i1", "src", "j", F.round("p", 6).alias("p"))


def rank_of_true(spark: SparkSession, d: str) -> DataFrame:
    got = rules.rank_of_true(views.labelled(spark, d), ["i1", "src"], ["s_all", "s_name", "s_addr"])
    return got.select("i1", "src", "j", "rank_s_all", "rank_s_name", "rank_s_addr")


def threshold_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = decisions._pairs(spark, d).withColumn("label", F.when(F.col("s_all") < 2, None).when(F.col("j") % 7 == 0, "?").otherwise(F.col("y").cast("string")))
    got = rules.threshold_matrix(p, "i1", [0.3, 0.5, 0.7])
    return got.select("i1", "th", F.round("f05", 6).alias("f05"))


QUERIES = {"branch_rules": branch_rules, "rank_of_true": rank_of_true, "threshold_matrix": threshold_matrix}

_W = "['" + "', '".join(WORDS) + "']"
_F = decisions._F05
ORACLE = {
    "branch_rules": f"""WITH {features._PT}, w AS (SELECT *, list_filter(string_split_regex(aa, ' +'), lambda x: x <> '') AS wa, list_filter(string_split_regex(ab, ' +'), lambda x: x <> '') AS wb FROM pt),
        n AS (SELECT *, {features._NUM('aa')} AS na, {features._NUM('ab')} AS nb FROM w),
        m AS (SELECT *, flatten(list_transform(na, lambda p: list_transform(nb, lambda q: [CAST(p = q AS INTEGER)]))) AS m FROM n),
        r AS (SELECT *, CASE WHEN len(na) = 0 OR len(nb) = 0 THEN 0 WHEN list_max(list_transform(m, lambda t: t[1])) = 1 THEN 1 ELSE 2 END AS rel,
          array_to_string(list_sort(list_distinct(nb)), ',') AS bkey FROM m),
        s AS (SELECT *, rel = 2 AND len(list_intersect(list_filter(b, lambda x: NOT list_contains(a, x)), {_W})) > 0 AS alt FROM r),
        u AS (SELECT *, alt OR (rel = 2 AND bkey <> '' AND bool_or(alt) OVER (PARTITION BY i1, bkey)) AS r1 FROM s)
      SELECT i1, src, j, CASE WHEN r1 THEN 0.0 WHEN rel = 1 AND array_to_string(a, '') = array_to_string(b, '') AND array_to_string(a, '') <> ''
        AND len(list_intersect(list_distinct(wa), list_distinct(wb))) / greatest(len(list_distinct(wb)), 1) >= 0.7 THEN 1.0 ELSE round(cs_all, 3) END AS p FROM u""",
    "rank_of_true": f"""WITH {views.LAB_SQL} SELECT i1, src, j, rank_s_all, rank_s_name, rank_s_addr FROM (SELECT *,
        {', '.join(f'rank() OVER (PARTITION BY i1, src ORDER BY {s} DESC) AS rank_{s}' for s in ('s_all', 's_name', 's_addr'))} FROM lab) WHERE y = 1""",
    "threshold_matrix": f"""WITH {decisions._PR}, l AS (SELECT *, CASE WHEN s_all < 2 THEN NULL WHEN j % 7 = 0 THEN '?' ELSE y::VARCHAR END AS label FROM pr),
        g AS (SELECT i1, CAST(th AS DOUBLE) AS th, sum(CASE WHEN label = '1' THEN 1 ELSE 0 END) AS n_true,
          sum(CASE WHEN label = '1' AND p >= th THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN (label IS NULL OR label <> '?') AND p >= th THEN 1 ELSE 0 END) AS n_pred
          FROM l CROSS JOIN (VALUES (0.3), (0.5), (0.7)) c(th) GROUP BY i1, th)
      SELECT i1, th, round({_F}, 6) AS f05 FROM g""",
}
