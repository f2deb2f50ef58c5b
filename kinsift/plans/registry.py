"""Registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinsift.operators import skew
from kinsift.plans import decisions, features, pairs, retrieval, rules
from kinsift.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Tokens holding at least 1.5 % of their source's distinct pairs."""
    return skew.heavy_tokens(table(spark, d, "token_postings"))


def p3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates per source and token."""
    return skew.candidates_per_token(table(spark, d, "token_postings"))


_BLANK = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PAIRS = rf"""
    SELECT DISTINCT candidate_source, token, candidate_entity_id FROM (
      SELECT candidate_source, candidate_entity_id,
        lower(regexp_replace(token, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS token FROM token_postings)
    WHERE length(token) >= 2 AND candidate_entity_id IS NOT NULL AND candidate_source IS NOT NULL"""

QUERIES = {"p3_found": p3_found, "p3_token_counts": p3_token_counts} | retrieval.QUERIES | decisions.QUERIES | features.QUERIES | rules.QUERIES | pairs.QUERIES

ORACLE = {
    "p3_found": f"""
        WITH pairs AS ({_PAIRS}), per AS (
          SELECT candidate_source, token, count(*) AS n FROM pairs GROUP BY ALL)
        SELECT candidate_source, token FROM (
          SELECT *, sum(n) OVER (PARTITION BY candidate_source) AS total FROM per)
        WHERE n >= 0.015 * total""",
    "p3_token_counts": f"""
        SELECT candidate_source, token, count(*) AS n_candidates FROM ({_PAIRS}) GROUP BY ALL""",
} | retrieval.ORACLE | decisions.ORACLE | features.ORACLE | rules.ORACLE | pairs.ORACLE


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Capped IDF-weighted name blocking."""
    return retrieval.block_name(spark, d)
