"""Scans and sinks of the linkage pipeline."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

RAW_COLUMNS = ("entity_id", "business_name", "business_address", "country")


def _folder(spark: SparkSession, path: str):
    """(path, file system) as Hadoop sees them: local disks, HDFS and object stores alike."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def required_path(spark: SparkSession, path: str) -> str:
    """``path`` if it exists and holds something, else an error at once."""
    at, fs = _folder(spark, path)
    if not fs.exists(at) or fs.getContentSummary(at).getLength() == 0:
        raise FileNotFoundError(f"missing or empty input: {path}")
    return path


def read_tsv(spark: SparkSession, path: str, columns: Iterable[str] = RAW_COLUMNS) -> DataFrame:
    """All columns as text, quotes taken literally, missing values as ''."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", enforceSchema=True)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in schema.names])


def read_tagged(spark: SparkSession, inputs: list[tuple[str, str]], tag: str = "artifact") -> DataFrame | None:
    """Union of the readable Parquet inputs ``(path, label)``, each row tagged
    with its label. Inputs that cannot be read are left out; None if all are."""
    out = None
    for path, label in inputs:
        try:
            df = spark.read.parquet(path).withColumn(tag, F.lit(label))
        except Exception as why:  # unreadable optional input
            print(f"ignored {path}: {type(why).__name__}")
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_partition(spark: SparkSession, path: str, column: str, prefixes: list[str]) -> DataFrame:
    """Only the partitions whose value starts with one of ``prefixes``."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col(column).startswith(p)
    return spark.read.parquet(path).where(keep)


def first_column(df: DataFrame, options: Iterable[str], name: str) -> DataFrame:
    """``name`` from the first of ``options`` that exists, else NULL."""
    found = next((c for c in options if c in df.columns), None)
    return df.withColumn(name, F.col(found).cast("string") if found else F.lit(None).cast("string"))


def describe(df: DataFrame) -> DataFrame:
    """(column_name, column_type, nullable) of a frame, in order."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, nullable boolean")


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, version: str = "") -> DataFrame:
    """Write a stage once; if the marker of this ``version`` of its input is
    there, it is read instead."""
    spark = df.sparkSession
    mark, fs = _folder(spark, f"{path}/_DONE-{version or 'any'}")
    if not fs.exists(mark):
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        fs.create(mark, True).close()
    return spark.read.parquet(path)


def write_beside(original: DataFrame, added: DataFrame, path: str) -> DataFrame:
    """Original rows and synthetic ones in one new place; the input stays as it is."""
    out = original.unionByName(added.select(*original.columns))
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return original.sparkSession.read.parquet(path)


def write_hashed(df: DataFrame, path: str, key: list[str], buckets: int) -> None:
    """Hash-partitioned sink: one folder per bucket, equal keys together."""
    b = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    (df.withColumn("bucket", b).repartition(buckets, "bucket").write.mode("overwrite")
     .option("compression", "zstd").partitionBy("bucket").parquet(path))


def write_tsv(df: DataFrame, path: str, owners: DataFrame | None = None, key: str | None = None) -> None:
    """Result sink; refuses an empty result and, with ``owners``, one that has
    not exactly one row for each of them. The plan runs once: what was written
    is looked at, and taken away if it is refused."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("quote", "").option("emptyValue", "").csv(path, sep="\t", header=True)
    back = spark.read.csv(path, sep="\t", header=True, quote="")
    fault = "refusing to write an empty result" if back.isEmpty() else ""
    if not fault and owners is not None:
        n = owners.select(key).distinct().count()
        if back.count() != n or back.join(owners.select(key).distinct(), key, "left_semi").select(key).distinct().count() != n:
            fault = "the result has not one row for each owner"
    if fault:
        at, fs = _folder(spark, path)
        fs.delete(at, True)
        raise ValueError(fault)


def write_json(path: str, content: dict) -> None:
    with open(path + ".tmp", "w") as f:
        json.dump(content, f, indent=1, sort_keys=True)
    os.replace(path + ".tmp", path)


def log_stage(path: str, stage: str, **facts) -> None:
    """Append one line to the stage manifest."""
    with open(path, "a") as f:
        f.write(json.dumps({"stage": stage, "at": time.time(), **facts}) + "\n")
