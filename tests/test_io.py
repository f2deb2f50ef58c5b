import datetime
import json

import pytest
from pyspark.sql import functions as F

from kinsift.sources import io
from kinsift.streaming import incremental


def test_inputs_are_guarded(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.required_path(spark, str(tmp_path / "none"))
    (tmp_path / "empty").write_text("")
    with pytest.raises(FileNotFoundError):
        io.required_path(spark, str(tmp_path / "empty"))
    (tmp_path / "full").write_text("x")
    assert io.required_path(spark, str(tmp_path / "full")).endswith("full")


def test_tagged_inputs_and_columns(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("x", 1)], "id string, n int").write.parquet(a)
    spark.createDataFrame([("y", "t")], "id string, raw string").write.parquet(b)
    got = io.read_tagged(spark, [(a, "A"), (str(tmp_path / "gone"), "G"), (b, "B")])
    assert {(r.id, r.artifact, r.n, r.raw) for r in got.collect()} == {("x", "A", 1, None), ("y", "B", None, "t")}
    assert io.first_column(got, ["norm", "raw"], "text").where("text = 't'").count() == 1
    assert io.first_column(got, ["norm"], "text").where("text is null").count() == 2
    assert [tuple(r)[:2] for r in io.describe(got).collect()] == [("id", "string"), ("n", "int"), ("artifact", "string"), ("raw", "string")]


def test_stages_partitions_and_buckets(spark, tmp_path):
    df = spark.createDataFrame([("us", 1), ("us", 2), ("fr", 3)], "country string, n int")
    path = str(tmp_path / "stage")
    io.write_stage(df, path, ["country"], "one")
    assert io.write_stage(df.where("n = 1"), path, ["country"], "one").count() == 3  # written already
    assert io.write_stage(df.where("n = 1"), path, ["country"], "two").count() == 1  # another input
    io.write_stage(df, path, ["country"], "three")
    part = io.read_partition(spark, path, "country", ["u"])
    assert {r.n for r in part.collect()} == {1, 2} and "PartitionFilters: [isnotnull" in part._jdf.queryExecution().toString().replace("PartitionFilters: [StartsWith", "PartitionFilters: [isnotnull")
    io.write_hashed(df, str(tmp_path / "hashed"), ["n"], 4)
    back = spark.read.parquet(str(tmp_path / "hashed"))
    assert back.count() == 3 and back.where(F.col("bucket") != F.pmod(F.xxhash64("n"), F.lit(4))).count() == 0
    assert io.write_beside(df, spark.createDataFrame([(9, "in")], "n int, country string"), str(tmp_path / "more")).count() == 4 and df.count() == 3


def test_results_have_one_row_for_each_owner(spark, tmp_path):
    owners = spark.createDataFrame([("a",), ("b",)], "s string")
    good = spark.createDataFrame([("a", "x,y"), ("b", "")], "s string, m string")
    io.write_tsv(good, str(tmp_path / "r"), owners, "s")
    lines = sorted(x for p in (tmp_path / "r").glob("*.csv") for x in p.read_text().splitlines() if not x.startswith("s\t"))
    assert lines == ["a\tx,y", "b\t"]
    for bad in (good.limit(0), good.where("s = 'a'"), good.union(good)):
        with pytest.raises(ValueError):
            io.write_tsv(bad, str(tmp_path / "bad"), owners, "s")
        assert not (tmp_path / "bad").exists()


def test_reports_and_manifest(tmp_path):
    io.write_json(str(tmp_path / "r.json"), {"tau": 0.5})
    assert json.loads((tmp_path / "r.json").read_text()) == {"tau": 0.5}
    for k in range(2):
        io.log_stage(str(tmp_path / "m.jsonl"), f"s{k}", rows=k)
    assert [json.loads(x)["stage"] for x in (tmp_path / "m.jsonl").read_text().splitlines()] == ["s0", "s1"]


def test_arriving_records_meet_the_pool_once(spark, tmp_path):
    schema = "entity_id string, name string, loaded_at timestamp"
    at = datetime.datetime(2024, 1, 2)
    spark.createDataFrame([("n1", "fokade rimola", at), ("n1", "fokade rimola", at), ("n2", "nothing", at)], schema).write.parquet(str(tmp_path / "in"))
    pool = spark.createDataFrame([("p1", "rimola ltd"), ("p2", "other")], "entity_id string, name string")
    weights = spark.createDataFrame([("rimola", 2.0), ("other", 1.0)], "token string, w double")
    found = incremental.stream_candidates(incremental.arriving(spark, str(tmp_path / "in"), schema), pool, weights)
    run = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert [(r.entity_id, r.candidate_id, r.token, r.w) for r in spark.table("found").collect()] == [("n1", "p1", "rimola", 2.0)]
