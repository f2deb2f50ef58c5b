import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinsift.operators import batches, pairs
from kinsift.plans import pairs as plan

DATA = "/root/testdata/sf0.001"
NAMES = ["rimola fokade", "fokade rimola ltd", "", "rf", "क्षेम rimola", "rimola", "rimolla fokad", "zotora bovoki motors", "rimola rimola x", "a", "kléa 𝔞b"]
ADDRESSES = ["12 fokade st oh", "", "fokade street 13 oh", "7 b rd", "12 12 st", "oh", "112 0012 fokade st", "1234567890 st", "१२ st"]


def _pairs(spark, n=150):
    rnd = random.Random(8)
    rows = [(k, rnd.choice([0, 0, 0, 1, 2, 5]), rnd.choice([2, 3]), k, rnd.choice(NAMES), rnd.choice(NAMES), rnd.choice(["", "inc", "inc ltd"]), rnd.choice(["", "ltd inc", "co"]),
             rnd.choice(ADDRESSES), rnd.choice(ADDRESSES), rnd.choice([0.0, 1.5, rnd.random() * 9]), rnd.choice([0.5, rnd.random()]), rnd.randrange(2)) for k in range(n)]
    schema = "__id bigint, i1 bigint, src int, j bigint, ca string, cb string, la string, lb string, aa string, ab string, s_all double, s_name double, y int"
    return spark.createDataFrame(rows, schema).withColumn("s_addr", F.col("s_all") - F.col("s_name"))


def _same(got, want, names):
    got, want = ({r["__id"]: r for r in df.select("__id", *names).collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for k, r in want.items():
        for c in names:
            assert abs(got[k][c] - float(r[c])) < 1e-9, (c, r, got[k])


@pytest.mark.parametrize("words, most, block", [(200_000, 1_000_000, 50_000), (1, 1_000_000, 20), (200_000, 40, 7)])
def test_batches_give_what_the_columns_give(spark, monkeypatch, words, most, block):
    """Whatever the bounds of a task: words by lookup or join, owners in one task, in blocks, or spread."""
    for name, bound in (("WORD_BOUND", words), ("OWNER_BOUND", most), ("BLOCK", block)):
        monkeypatch.setattr(batches, name, bound)
    base = _pairs(spark)
    stats, rate = plan._learned(base)
    alone = pairs.word_evidence(pairs.gram_features(pairs.pair_features(base)), ["__id"], stats, rate, 3)
    beside = pairs.derived(pairs.cluster_evidence(alone, "i1"), "i1", "src")
    wide = batches.similar(base, ["__id"], stats, rate, 3)
    assert wide.count() == base.count()
    _same(wide, beside, [*pairs.NAMES, *pairs.GRAMS, *pairs.WORDS, "n_rel", "n_dist"])
    found = batches.around(wide, "__id", "i1", "src", ["src", "j"])
    _same(found, beside, [*pairs.CLUSTER[2:], "nagree_ain8", *pairs.ANCHORS])
    _same(found, pairs.context_features(alone, "i1", ["src", "j"]), pairs.CONTEXT)


def test_no_pairs_have_no_features(spark):
    base = _pairs(spark).limit(0)
    wide = batches.similar(base, ["__id"], *plan._learned(base))
    assert wide.count() == 0 == batches.around(wide, "__id", "i1", "src", ["src", "j"]).count()


def test_whole_owners_meet(monkeypatch):
    monkeypatch.setattr(batches, "BLOCK", 5)
    keys = np.repeat(np.arange(9), [1, 2, 9, 1, 1, 1, 14, 3, 1])
    df = pd.DataFrame({"k": keys, "v": range(len(keys))})
    for step in (1, 2, 3, 7, 40):
        got = list(batches._whole_owners((df.iloc[s : s + step] for s in range(0, len(df), step)), "k"))
        assert pd.concat(got, ignore_index=True).equals(df)
        owners = [set(x["k"]) for x in got]
        assert sum(map(len, owners)) == 9 and all(len(x) >= 5 for x in got[:-1])


def test_slips_are_those_of_the_whole_rule():
    rnd = random.Random(3)
    some = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))) for _ in range(200)]
    for a in some:
        for b in ["", *some[:60], a[1:] + a[:1], a + "x", a[:-1]]:
            assert batches.is_slip(a, b) == pairs.is_typo_text(a, [b]), (a, b)


def test_ranks_of_ties_and_nan():
    got = batches._ranks(np.array([0, 0, 0, 0, 1]), np.array([0, 4]), np.array([1.0, 2.0, np.nan, 2.0, 0.0]))
    assert got.tolist() == [4, 2, 1, 2, 1]


def test_an_owners_candidates_meet_once(spark):
    """Not one shuffle of all pairs for every score that is ranked: there were 21 such shuffles."""
    steps = plan.pair_features(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Exchange hashpartitioning") <= 3


def test_the_matcher_works_in_slices_of_owners(spark, monkeypatch):
    """No step writes all pairs with all their features, and the features do not depend on the slices."""
    written, write = [], plan.materialize
    monkeypatch.setattr(plan, "materialize", lambda df, label: written.append(label) or write(df, label))
    fitted = {}
    monkeypatch.setattr(plan.model, "cross_fitted", lambda df, *_, **__: fitted.setdefault(len(fitted), df).withColumn("p", F.col("f_comb")))
    few = {tuple(r) for r in plan.matcher_scores(spark, DATA).collect()}
    monkeypatch.setattr(plan, "SLICE", 1000)
    many = {tuple(r) for r in plan.matcher_scores(spark, DATA).collect()}
    assert few == many and written.count("features") == 1 + min(plan.SLICES, len(few) // 1000 + 1) > 2
    assert fitted[0].exceptAll(fitted[1]).count() == 0 == fitted[1].exceptAll(fitted[0]).count()
