"""Cleaned views of the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.session import table

SCORES = ("s_all", "s_name", "s_addr", "s_x", "cs_name", "cs_addr", "cs_all")

CAND_SQL = f"""cand AS (SELECT i1, CAST(src AS INTEGER) AS src, j,
    {', '.join(f'coalesce(CAST(max({c}) AS DOUBLE), 0.0) AS {c}' for c in SCORES)}
  FROM candidate_scores WHERE s_all IS NOT NULL AND NOT isnan(s_all) GROUP BY i1, CAST(src AS INTEGER), j)"""
ENT_SQL = """ent AS (SELECT entity_id, min(CAST(src AS INTEGER)) AS src, coalesce(min(lower(trim(country))), '') AS country,
    coalesce(min(nullif(name, '<null>')), '') AS name, coalesce(min(nullif(addr, '<null>')), '') AS addr,
    coalesce(min(nullif(core, '<null>')), '') AS core, coalesce(min(nullif(legal, '<null>')), '') AS legal,
    coalesce(min(nullif(atok, '<null>')), '') AS atok FROM records GROUP BY entity_id)"""
TRUTH_SQL = """truth AS (SELECT DISTINCT upper(trim(source1_entity_id)) AS source1_entity_id,
    upper(trim(matched_entity_id)) AS matched_entity_id FROM positives
  WHERE source1_entity_id IS NOT NULL AND upper(trim(matched_entity_id)) IN (SELECT upper(trim(entity_id)) FROM records))"""
LAB_SQL = f"""{CAND_SQL}, {TRUTH_SQL},
  s1 AS (SELECT DISTINCT row_no AS i1, entity_id AS source1_entity_id FROM records WHERE src = 1),
  rec AS (SELECT DISTINCT CAST(src AS INTEGER) AS src, row_no AS j, entity_id AS matched_entity_id FROM records WHERE src > 1),
  lab AS (SELECT c.*, s1.source1_entity_id, rec.matched_entity_id,
      CASE WHEN t.matched_entity_id IS NULL THEN 0 ELSE 1 END AS y
    FROM cand c JOIN s1 USING (i1) JOIN rec USING (src, j)
    LEFT JOIN truth t ON t.source1_entity_id = s1.source1_entity_id AND t.matched_entity_id = rec.matched_entity_id),
  meta AS (SELECT l.i1, count(DISTINCT t.matched_entity_id) AS n_true FROM (SELECT DISTINCT i1, source1_entity_id FROM lab) l
    LEFT JOIN truth t USING (source1_entity_id) GROUP BY l.i1)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair, sound scores only, NULL part scores as 0."""
    raw = table(spark, d, "candidate_scores", "i1", "src", "j", *SCORES).where("s_all is not null and not isnan(s_all)")
    return raw.groupBy("i1", F.col("src").cast("int").alias("src"), "j").agg(
        *[F.coalesce(F.max(c).cast("double"), F.lit(0.0)).alias(c) for c in SCORES]
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity, missing texts as ''."""
    sound = lambda c: F.coalesce(F.min(F.nullif(F.col(c), F.lit("<null>"))), F.lit("")).alias(c)
    return table(spark, d, "records").groupBy("entity_id").agg(
        F.min(F.col("src").cast("int")).alias("src"),
        F.coalesce(F.min(F.lower(F.trim("country"))), F.lit("")).alias("country"), sound("name"), sound("addr"), sound("core"), sound("legal"), sound("atok"),
    )


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labelled pairs whose matched id is known."""
    up = lambda c: F.upper(F.trim(F.col(c))).alias(c)
    known = table(spark, d, "records", "entity_id").select(F.upper(F.trim("entity_id")).alias("matched_entity_id")).distinct()
    return (
        table(spark, d, "positives").where("source1_entity_id is not null")
        .select(up("source1_entity_id"), up("matched_entity_id")).distinct().join(known, "matched_entity_id", "left_semi")
        .select("source1_entity_id", "matched_entity_id")
    )


def labelled(spark: SparkSession, d: str, scored: DataFrame | None = None) -> DataFrame:
    """Candidates with their ids and the label ``y``, one row per (i1, src, j):
    a record that is delivered again has its row number again. ``scored`` holds
    the candidates with further columns, where they are there already."""
    rec = table(spark, d, "records", "entity_id", "src", "row_no").distinct()
    s1 = rec.where("src = 1").select(F.col("row_no").alias("i1"), F.col("entity_id").alias("source1_entity_id"))
    other = rec.where("src > 1").select(F.col("src").cast("int").alias("src"), F.col("row_no").alias("j"), F.col("entity_id").alias("matched_entity_id"))
    return (
        (candidates(spark, d) if scored is None else scored).join(s1, "i1").join(other, ["src", "j"])
        .join(truth(spark, d).withColumn("__t", F.lit(1)), ["source1_entity_id", "matched_entity_id"], "left")
        .withColumn("y", F.coalesce("__t", F.lit(0))).drop("__t")
    )


def meta(pairs: DataFrame, true: DataFrame) -> DataFrame:
    """(i1, n_true) for every entity with a candidate."""
    n = true.groupBy("source1_entity_id").agg(F.countDistinct("matched_entity_id").alias("n_true"))
    return pairs.select("i1", "source1_entity_id").distinct().join(n, "source1_entity_id", "left").select("i1", F.coalesce("n_true", F.lit(0)).alias("n_true"))
