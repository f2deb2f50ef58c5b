"""Session helpers: table access and fault-tolerant materialisation."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet``; with columns given only those are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset (tests, a laptop) a temporary
    folder is made once for the session and set as its checkpoint folder.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinsift-"))
        jdir = sc._jsc.sc().getCheckpointDir()
    return jdir.get()


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    Lineage ends at the files, so a lost executor costs no more than its own
    tasks. Columnar files are several times smaller than a serialized RDD
    checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinsift/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for frames that no one reads again."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:  # a union has several
            if "/kinsift/" in folder:
                folder = jvm.org.apache.hadoop.fs.Path(folder)
                folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_rows(df: DataFrame, most: int, what: str) -> list:
    """All rows of a table that must be small; an error beyond ``most``, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def bounded_broadcast(df: DataFrame, max_rows: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only if ``df`` is proven to have at most ``max_rows`` rows.

    The count stops after ``max_rows + 1`` rows. Beyond the bound the frame is
    returned unhinted and the planner shuffles.
    """
    from pyspark.sql import functions as F

    n = df.limit(max_rows + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= max_rows else df
