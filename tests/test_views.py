import random

from pyspark.sql import functions as F

from kinsift.functions import similarity
from kinsift.plans import views

D = "/root/testdata/sf0.001"


def test_labelled_has_one_row_per_pair(spark):
    got = views.labelled(spark, D)
    assert got.groupBy("i1", "src", "j").count().where("count > 1").count() == 0
    assert got.count() == views.candidates(spark, D).join(
        spark.read.parquet(f"{D}/records.parquet").where("src = 1").select(F.col("row_no").alias("i1")).distinct(), "i1", "left_semi"
    ).count()


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_similarity_on_any_script(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abé दुка") for _ in range(rnd.randrange(7)))
    rows = [(word(), word()) for _ in range(80)] + [("", ""), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("s", similarity.edit_similarity(F.col("a"), F.col("b")))
    for r in df.collect():
        n = max(len(r.a), len(r.b))
        assert abs(r.s - (1 - _edits(r.a, r.b) / n if n else 1)) < 1e-9
