"""Incremental matching: new records are blocked against a fixed pool.

The reference has no streams; this is the same token join, run by Structured
Streaming over arriving files. The pool side is static, so the join keeps no
state; late or repeated records are dropped within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.functions.text import norm_name
from kinsift.operators.blocking import token_table


def arriving(spark: SparkSession, path: str, schema, delay: str = "30 days") -> DataFrame:
    """Records from files as they come, once per id within the watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["entity_id"])


def stream_candidates(new: DataFrame, pool: DataFrame, weights: DataFrame) -> DataFrame:
    """(entity_id, candidate_id, token, w): shared weighted tokens of new records
    with the pool; sum them per pair in the sink's batch."""
    fresh = token_table(new.withColumn("toks", norm_name(F.col("name"))["core"]), F.col("toks"), "entity_id")
    known = token_table(pool.withColumn("toks", norm_name(F.col("name"))["core"]), F.col("toks"), "entity_id").withColumnRenamed("entity_id", "candidate_id")
    return fresh.join(weights, "token").join(known, "token").where("entity_id != candidate_id")
