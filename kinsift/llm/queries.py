"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.llm import addresses, match, mix, mojibake, names, pack, split_groups, tokens, topn, unify_text
from kinsift.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best pairs of every i1."""
    return topn.best_candidates(table(spark, d, "candidate_scores"), 5).select(
        "i1", F.col("src").cast("int").alias("src"), "j"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids whose group is scattered over splits."""
    return split_groups.scattered_ids(
        table(spark, d, "split_assign"), table(spark, d, "positives"), table(spark, d, "records", "entity_id")
    )


def p4_assignment(spark: SparkSession, d: str) -> DataFrame:
    """A split for every S1 id, groups whole, sizes near split_targets."""
    return split_groups.grouped_splits(
        table(spark, d, "split_assign"),
        table(spark, d, "positives"),
        table(spark, d, "records", "entity_id"),
        table(spark, d, "split_targets"),
    ).select("source1_entity_id", "split")


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and labels of that assignment against the targets."""
    inputs = table(spark, d, "split_assign"), table(spark, d, "positives"), table(spark, d, "records", "entity_id")
    labels = split_groups.linked_members(*inputs).select(F.col("member").alias("source1_entity_id"), "label")
    return split_groups.balance(p4_assignment(spark, d), labels, table(spark, d, "split_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose core or atok holds look-alike or unseen characters."""
    rows = table(spark, d, "records", "entity_id", "core", "atok")
    return unify_text.affected(rows, ["core", "atok"]).select("entity_id").distinct()


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of core and atok of every affected record."""
    rows = table(spark, d, "records", "entity_id", "core", "atok")
    return unify_text.affected(rows, ["core", "atok"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose addresses denote the same building."""
    return addresses.same_address_pairs(table(spark, d, "records"), table(spark, d, "record_tokens"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its address class and the number of its links."""
    return addresses.address_links(table(spark, d, "records"), table(spark, d, "record_tokens"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its organisation and the number of its links."""
    return names.name_links(table(spark, d, "records", "entity_id", "core", "legal"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that name the same organisation in other words."""
    return names.name_pairs(table(spark, d, "records", "entity_id", "core", "legal"))


def _match_inputs(spark: SparkSession, d: str):
    return (
        table(spark, d, "records"),
        table(spark, d, "record_tokens"),
        table(spark, d, "positives"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the same organisation at the same place for unlabelled S1 ids."""
    return match.unlabelled_matches(*_match_inputs(spark, d)).select("source1_entity_id", "matched_entity_id").distinct()


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """All matched pairs with their confidence."""
    return match.matches(*_match_inputs(spark, d))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of all documents, written once."""
    return materialize(tokens.with_token_counts(table(spark, d, "documents", "doc_id", "source", "text")), "sizes")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text in containers of every capacity."""
    return pack.packed(_sizes(spark, d), table(spark, d, "pack_bins"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    return pack.fill_report(p8_packed(spark, d), table(spark, d, "pack_bins"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every text in the mix."""
    return mix.mixed(_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return mix.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage read in a wrong charset."""
    return mojibake.garbled_documents(table(spark, d, "documents", "doc_id", "text"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The restored text of those documents."""
    return mojibake.restored_documents(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_unified": p2_unified,
    "p4_found": p4_found,
    "p4_assignment": p4_assignment,
    "p4_balance": p4_balance,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p6_found": p6_found,
    "p6_links": p6_links,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

ORACLE = {
    "p1_found": """
        WITH sound AS (
          SELECT i1, CAST(src AS INTEGER) AS src, j, s_all, s_name, s_addr FROM candidate_scores
          WHERE s_all > 0 AND NOT isnan(s_all)
        ), once AS (
          SELECT *, row_number() OVER (PARTITION BY i1, src, j
            ORDER BY s_all DESC NULLS LAST, s_name DESC NULLS LAST, s_addr DESC NULLS LAST) AS nth FROM sound
        ), ranked AS (
          SELECT *, row_number() OVER (PARTITION BY i1
            ORDER BY s_all DESC NULLS LAST, s_name DESC NULLS LAST, s_addr DESC NULLS LAST, src, j) AS rn
          FROM once WHERE nth = 1
        )
        SELECT i1, src, j FROM ranked WHERE rn <= 5""",
    "p4_found": """
        WITH RECURSIVE known AS (SELECT DISTINCT upper(trim(entity_id)) AS m FROM records),
        ties AS (
          SELECT DISTINCT upper(trim(source1_entity_id)) AS s, upper(trim(matched_entity_id)) AS m FROM positives
          WHERE upper(trim(matched_entity_id)) IN (SELECT m FROM known) AND source1_entity_id IS NOT NULL
            AND trim(source1_entity_id) <> ''
        ), near AS (
          SELECT DISTINCT a.s AS s, b.s AS t FROM ties a JOIN ties b USING (m)
        ), reach AS (
          SELECT s, s AS t FROM (SELECT DISTINCT s FROM ties)
          UNION
          SELECT r.s, n.t FROM reach r JOIN near n ON r.t = n.s
        ), groups AS (SELECT s, min(t) AS g FROM reach GROUP BY s),
        listed AS (
          SELECT upper(trim(source1_entity_id)) AS s, lower(trim(split)) AS split FROM split_assign
          WHERE source1_entity_id IS NOT NULL AND trim(source1_entity_id) <> ''
        ), placed AS (
          SELECT l.s, l.split, coalesce(g.g, l.s) AS g FROM listed l LEFT JOIN groups g ON l.s = g.s
        ), bad AS (SELECT g FROM placed GROUP BY g HAVING count(DISTINCT split) > 1)
        SELECT DISTINCT s AS source1_entity_id FROM placed WHERE g IN (SELECT g FROM bad)""",
}
