import math
import random

from pyspark.sql import functions as F

from kinsift.operators import competition, context, decide


def test_metric_by_hand(spark):
    rows = [(2, 3, 2), (0, 0, 0), (0, 0, 2), (0, 2, 0), (2, 2, 2), (0, 2, 2)]
    df = spark.createDataFrame(rows, "tp int, n_pred int, n_true int")
    got = [round(r[0], 3) for r in df.select(decide.f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).collect()]
    assert got == [0.714, 1.0, 0.0, 0.0, 1.0, 0.0]


def test_expected_f05(spark):
    df = spark.createDataFrame([(1, 1, 0.99), (1, 2, 0.95), (1, 3, 0.05), (2, 4, 0.02), (2, 5, 0.01)], "i int, j int, p double")
    got = decide.expected_f05(df, "i", "p", ["j"]).where("selected").select("j").collect()
    assert sorted(r[0] for r in got) == [1, 2]


def test_filter_keeps_two(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.2), (1, 3, 0.1), (2, 4, 0.1), (2, 5, 0.05), (2, 6, 0.6)], "i int, j int, p double")
    assert sorted(r["j"] for r in decide.keep_some(df, "i", "p", ["j"], 0.5, 2).collect()) == [1, 2, 4, 6]


def test_competition_by_hand(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.2), (2, 4, 0.7), (3, 5, 0.4), (3, 6, 0.8)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    got = {r["o"]: (r["comp_all_other"], r["comp_all_rk"], r["comp_n_suitors"]) for r in competition.competition(df, ["k"], "o", {"all": "v"}).collect()}
    assert got == {1: (0.5, 1, 3), 2: (0.9, 2, 3), 3: (0.9, 3, 3), 4: (0.0, 1, 1), 5: (0.8, 2, 2), 6: (0.4, 1, 2)}


def test_lists_have_one_row_per_owner(spark):
    owners = spark.createDataFrame([(i,) for i in range(3)], "i int")
    pairs = spark.createDataFrame([(0, 0.7, "S3-2"), (0, 0.9, "S2-1"), (2, 0.5, "S2-9")], "i int, p double, rec string")
    got = {r["i"]: r["m"] for r in decide.match_lists(owners, pairs, "i", "p", "rec", "m").collect()}
    assert got == {0: "S2-1,S3-2", 1: "", 2: "S2-9"}


def test_top_two_single_row(spark):
    df = spark.createDataFrame([(1, 1, 0.4)], "i int, j int, p double")
    r = context.top_two(df, "i", "p", ["j"]).first()
    assert (r["top"], r["second"], r["is_top"]) == (0.4, 0.0, True)


def test_sweep_on_empty_pairs(spark):
    pairs = spark.createDataFrame([], "i int, p double, y int")
    meta = spark.createDataFrame([(1, 0), (2, 1)], "i int, n_true int")
    assert [r["mean_f05"] for r in decide.threshold_sweep(pairs, meta, "i", "p", [0.5]).collect()] == [0.5]


def test_ranks_and_context_against_windows(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), k, rnd.choice([0.0, 0.1, 0.5, 0.51, 0.512, 7.0, -2.0, rnd.random()])) for k in range(300)]
    df = spark.createDataFrame(rows, "i int, j int, v double")
    groups = {i: sorted((r for r in rows if r[0] == i), key=lambda r: (-r[2], r[1])) for i in (1, 2, 3)}
    for r in context.group_context(df, ["i"], ["v"]).collect():
        own = groups[r.i]
        assert (r.n_cand, r.v_mx, r.v_rk) == (len(own), own[0][2], 1 + sum(x[2] > r.v for x in own))
    for r in context.anchor(df, ["i"], "v", ["j"], ["j"]).collect():
        assert r.an_j == groups[r.i][0][1]
    for r in context.top_two(df, "i", "v", ["j"]).collect():
        assert (r.top, r.second, r.is_top) == (groups[r.i][0][2], groups[r.i][1][2], r.j == groups[r.i][0][1])
    positive = df.where("v >= 0 and v <= 1")
    prefix = {}
    for i in (1, 2, 3):
        p = [r[2] for r in groups[i] if 0 <= r[2] <= 1]
        ef = [1.25 * sum(p[: m + 1]) / (0.25 * sum(p) + m + 1) for m in range(len(p))]
        none = math.prod(1 - min(x, 1 - 1e-9) for x in p)
        prefix[i] = next(m for m, e in enumerate(ef) if e >= max(ef) - 1e-12) + 1 if none < max(ef) else 0
    got = decide.expected_f05(positive, "i", "v", ["j"]).where("selected").groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in got} == {i: n for i, n in prefix.items() if n}
