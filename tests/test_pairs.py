import math
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinsift.functions import similarity
from kinsift.operators import blocking, context, decide, pairs, recall, sample
from kinsift.plans import pairs as plan

DATA = "/root/testdata/sf0.001"

NAMES = ["rimola fokade", "fokade rimola ltd", "", "rf", "क्षेम rimola", "rimola", "zotora bovoki motors", "rimola rimola x"]
ADDRESSES = ["12 fokade st oh", "", "fokade street 12 oh", "7 b rd", "12 12 st", "oh"]


def _pairs(spark, n=40):
    rnd = random.Random(8)
    rows = [(rnd.randrange(4), rnd.choice([2, 3]), k, rnd.choice(NAMES), rnd.choice(NAMES), rnd.choice(["", "inc", "inc ltd"]), rnd.choice(["", "ltd inc", "co"]),
             rnd.choice(ADDRESSES), rnd.choice(ADDRESSES), round(rnd.random() * 9, 2), rnd.random(), rnd.randrange(2)) for k in range(n)]
    schema = "i1 bigint, src int, j bigint, ca string, cb string, la string, lb string, aa string, ab string, s_all double, s_name double, y int"
    return spark.createDataFrame(rows, schema).withColumn("s_addr", F.col("s_all") - F.col("s_name"))


def test_pair_features_against_sets(spark):
    for r in pairs.pair_features(_pairs(spark)).collect():
        ta, tb = r.ca.split(), r.cb.split()
        a, b, la, lb = set(ta), set(tb), set(r.la.split()), set(r.lb.split())
        ua, ub = set(r.aa.split()), set(r.ab.split())
        da, db = ({w for w in x if w[0].isdigit()} for x in (ua, ub))
        xa, xb = "".join(ta), "".join(tb)
        want = {
            "jac": len(a & b) / max(len(a | b), 1), "b_in_a": len(a & b) / max(len(b), 1), "a_minus_b": len(a - b), "lta": len(ta), "clen_d": len(xa) - len(xb),
            "acr_a": len(ta) >= 2 and xb == "".join(w[0] for w in ta), "acr_b": len(tb) >= 2 and xa == "".join(w[0] for w in tb),
            "legal_eq": bool(la) and la == lb, "b_nolegal": not lb, "legal_ov": bool(la & lb), "first_eq": ta[:1] == tb[:1], "last_eq": ta[-1:] == tb[-1:],
            "b_sub_a": bool(tb) and b <= a, "eq": r.ca == r.cb, "ceq": xa == xb, "b_noaddr": not ub, "a_ix": len(ua & ub), "a_ain": len(ua & ub) / max(len(ua), 1),
            "a_jac": len(ua & ub) / max(len(ua | ub), 1), "a_ixw": len((ua & ub) - da), "num_ix": len(da & db), "num_conf": bool(da and db and not da & db),
            "b_hasnum": bool(db), "num_hit": bool(da & db), "state_hit": bool(ub) and r.ab.split()[-1] in ua,
            "jw": similarity.jaro_winkler_text(r.ca, r.cb), "cpr": similarity.partial_text(xa, xb), "a_tsr": similarity.token_set_text(r.aa, r.ab) if ub else -1,
        }
        for name, value in want.items():
            assert abs(r[name] - float(value)) < 1e-9, (name, r)


def test_feature_lists_are_whole():
    assert len(pairs.NAMES) == 43 and len(pairs.BASE) == 109 == len(set(pairs.BASE))
    assert all(len(set(v)) == len(v) for v in pairs.VARIANTS.values())


def test_word_evidence_by_hand(spark):
    df = spark.createDataFrame([(1, "rimola fokade", "rimola fokadf group new"), (2, "a", "a"), (3, "rimola ltd", "")], "k int, ca string, cb string")
    stats = spark.createDataFrame([("ex", "group", 100, 2), ("ex", "new", 5, 5), ("ms", "ltd", 40, 30), ("ms", "rimola", 3, 0)], "kind string, word string, n bigint, pos bigint")
    base = spark.createDataFrame([(0.5,)], "base double")
    got = {r.k: r for r in pairs.word_evidence(df, ["k"], stats, base).collect()}
    rate = lambda n, p: (p + 10) / (n + 20)
    r = got[1]  # fokadf is a slip of fokade, new is unknown
    assert (round(r.w_ex_min, 9), r.w_ex_n, r.w_ex_unk, r.w_ex_typo, r.w_ms_n, r.w_ms_unk, r.w_ms_min) == (round(rate(100, 2), 9), 1, 1, 1, 0, 0, 1.0)
    assert tuple(got[2][c] for c in pairs.WORDS) == (1.0, 1.0, 0, 0, 0, 1.0, 0, 0)
    assert (round(got[3].w_ms_min, 9), got[3].w_ms_n, got[3].w_ms_unk) == (round(rate(40, 30), 9), 1, 1)


@pytest.mark.parametrize("a, b", [("abc", "abd"), ("abc", "ab"), ("abc", "xabc"), ("", "a"), ("ab", "ba"), ("abc", "abc"), ("abcd", "ab")])
def test_one_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert similarity.one_edit(a, b) == (row[-1] <= 1)


def test_partial_ratio_against_every_window():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(9))) for _ in range(2))
        x, y = (a, b) if len(a) <= len(b) else (b, a)
        want = (1.0 if not y else 0.0) if not x else max(similarity.ratio_text(x, y[max(0, i) : i + len(x)]) for i in range(1 - len(x), len(y)))
        assert abs(similarity.partial_text(a, b) - want) < 1e-12


def test_context_is_that_of_the_rows_given(spark):
    df = pairs.pair_features(_pairs(spark))
    for part in (df, df.where("s_all > 4")):
        rows = part.collect()
        for r in pairs.context_features(part, "i1", ["src", "j"]).collect():
            own = [x for x in rows if x.i1 == r.i1]
            top = max(x.s_all for x in own)
            comb = lambda x: round(x.jw + max(x.a_jac, 0) + x.s_all / (top + 1e-6), 9)  # noqa: B023, E731
            best = min(own, key=lambda x: (-comb(x), x.src, x.j))
            assert (r.n_cand, r.s_all_mx, r.jw_rk) == (len(own), top, 1 + sum(x.jw > r.jw for x in own))
            assert abs(r.comb - comb(r)) < 1e-9 and abs(r.comb_gap - comb(best) + comb(r)) < 1e-9 and abs(r.an_comb - comb(best)) < 1e-9
            name = [x for x in own if x.cb.replace(" ", "") == r.cb.replace(" ", "")]
            place = [x for x in own if x.ab == r.ab] if r.ab else []
            assert (r.sib_nm_n, r.sib_ad_n) == (len(name), len(place))
            widest = max(max(comb(x) for x in name), max((comb(x) for x in place), default=0.0))
            assert abs(r.cluster_gap - comb(best) + widest) < 1e-9
            assert r.an_jw == (1.0 if (r.src, r.j) == (best.src, best.j) else similarity.jaro_winkler_text(r.cb, best.cb))


def test_gram_sets_are_made_once(spark):
    got = pairs.gram_features(_pairs(spark))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 6
    cut = lambda t, n: {t[k : k + n] for k in range(max(len(t) - n, 0) + 1)} if t else set()
    for r in got.collect():
        x, z = (cut(t.replace(" ", ""), 4) for t in (r.ca, r.cb))
        assert abs(r.ng_n4j - (len(x & z) / len(x | z) if x and z else 0.0)) < 1e-9


def test_features_of_no_pairs(spark):
    empty = pairs.pair_features(_pairs(spark).limit(0))
    assert pairs.context_features(empty, "i1", ["src", "j"]).count() == 0


def test_lost_and_doubled_rows_raise(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    whole = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert context.joined_whole(left, whole, ["k"]).count() == 2
    for bad in (whole.where("k = 1"), whole.union(whole.where("k = 1"))):
        with pytest.raises(PySparkException):
            context.joined_whole(left, bad, ["k"]).collect()


def test_retrieval_against_sums(spark):
    rows = [("s1", 1, "name", "n:a"), ("s1", 1, "addr", "a:x"), ("s1", 1, "x", "nx:a|x"), ("s2", 1, "name", "n:b")]
    rows += [(f"p{k}", 2 + k % 2, "name", "n:a") for k in range(6)] + [("p0", 2, "addr", "a:x"), ("p0", 2, "x", "nx:a|x"), ("p1", 3, "addr", "a:y"), ("p2", 2, "name", "n:b")]
    tok = spark.createDataFrame(rows, "entity_id string, src int, kind string, token string").withColumn("country", F.lit("us"))
    pool = tok.where("src > 1")
    sizes = spark.createDataFrame([("us", k, 6) for k in blocking.PARTS], "country string, kind string, n bigint")
    w = blocking.token_weights(pool, sizes, ["country", "kind"])
    left = tok.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country", "kind", "token")
    right = pool.select(F.col("entity_id").alias("rec_id"), "src", "country", "kind", "token")
    got = {(r.s1_id, r.rec_id): r for r in blocking.retrieve(left, right, w, ["country"]).collect()}
    idf = lambda df: math.log(7 / (df + 1))
    r = got["s1", "p0"]
    assert (r.s_name, r.s_addr, r.s_x) == (round(idf(6), 6), round(idf(1), 6), round(idf(1), 6)) and r.r_t == 0 and r.r_e == 99
    assert got["s2", "p2"].r_n == 0 and ("s2", "p0") not in got and ("s1", "p2") not in got  # idf(6) is 0
    tight = blocking.token_weights(pool, sizes, ["country", "kind"], tighter=F.when(F.col("kind") == "x", 0).cast("bigint"))
    assert tight.where("kind = 'x'").count() == 0 and tight.where("kind = 'addr'").count() == 2


def test_halves_and_samples(spark):
    ids = spark.createDataFrame([(f"e{k}", "a" if k % 3 else "b") for k in range(600)], "i string, s string")
    for r in sample.half_splits(ids, "i", "s", 3).join(ids, "i").groupBy("seed", "s").agg(F.sum("half").alias("h"), F.count("*").alias("n")).collect():
        assert abs(2 * r.h - r.n) <= 1
    one, two = sample.fixed_size(ids, "i", 50, 1), sample.fixed_size(ids, "i", 50, 1)
    assert one.count() == 50 and one.exceptAll(two).count() == 0
    assert not sample.disjoint(one, two, "i") and sample.disjoint(one, ids.join(one, "i", "left_anti"), "i")
    kept = ids.where(sample.keep_entities(F.col("i"), 3)).count()
    assert 120 < kept < 240


def test_a_missed_target_ends_the_run(spark):
    truth = spark.createDataFrame([("a", "x"), ("b", "y")], "source1_entity_id string, matched_entity_id string")
    found = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "z")], "source1_entity_id string, candidate_entity_id string")
    got = recall.recall(truth, found)
    assert recall.require_target(got, 0.5) == 0.5 and recall.against_target(got, 0.92).first()["target_met"] == 0
    with pytest.raises(ValueError):
        recall.require_target(got, 0.92)


def _compared(monkeypatch, spark, name):
    """Rows of a query and the number of pairs whose texts it compares."""
    seen, measure = [], pairs.pair_features
    monkeypatch.setattr(pairs, "pair_features", lambda df: seen.append(df.count()) or measure(df))
    return plan.QUERIES[name](spark, DATA).collect(), sum(seen)


def test_texts_are_compared_for_what_a_filter_leaves(spark, monkeypatch):
    rows, compared = _compared(monkeypatch, spark, "context_after_filter")
    lab = plan._labelled(spark, DATA)
    kept = decide.keep_some(lab, "i1", "cs_all", ["src", "j"], 0.3, 2)
    assert {(r.i1, r.src, r.j) for r in rows} == {tuple(r) for r in kept.select("i1", "src", "j").collect()}
    assert compared == len(rows) < lab.count()
    whole = pairs.pair_features(plan._with_texts(spark, DATA, kept)).collect()
    for r in rows:
        assert r.n_cand == sum(x.i1 == r.i1 for x in whole) and r.jw_mx == round(max(x.jw for x in whole if x.i1 == r.i1), 6)


def test_texts_are_compared_where_numbers_let_a_pair_be_a_sibling(spark, monkeypatch):
    base = plan._base(spark, DATA)
    number = lambda t: [int(w) for w in t.split() if w.isascii() and w.isdigit() and len(w) <= 9]
    every = pairs.pair_features(base).collect()
    agrees = {r.i1 for r in every if set(number(r.aa)) & set(number(r.ab))}
    apart = [r for r in every if r.y == 0 and r.i1 in agrees and number(r.aa) and number(r.ab) and not set(number(r.aa)) & set(number(r.ab))]
    want: dict = {}
    for r in apart:
        if (r.jw >= 0.85 or r.b_sub_a or r.a_sub_b) and r.b_minus_a <= 2 and r.a_tsr >= 0.75:
            want[r.src, r.j] = min(want.get((r.src, r.j), r.i1), r.i1)
    rows, compared = _compared(monkeypatch, spark, "sibling_selection")
    assert {(r.src, r.j): r.i1 for r in rows} == want and 0 < compared <= len(apart) < len(every)


def test_wide_features_are_written_once(spark, monkeypatch):
    """What looks at an owner's other candidates works on few columns."""
    written, write = [], plan.materialize
    for module in (plan, pairs):
        monkeypatch.setattr(module, "materialize", lambda df, label: written.append((label, len(df.columns))) or write(df, label))
    got = plan.pair_features(spark, DATA)
    assert [label for label, n in written if n > 60] == ["similar"] and set(plan.EVERY) <= set(got.columns)
    base = plan._base(spark, DATA)
    keys = {tuple(r) for r in got.select(*plan.IDENT).collect()}
    assert got.count() == base.count() and keys == {tuple(r) for r in base.select(*plan.IDENT).collect()}
    want = {tuple(r[:3]): r[3:] for r in plan.name_statistics(spark, DATA).collect()}
    assert {tuple(r[:3]): r[3:] for r in got.select(*plan.IDENT, *pairs.STATISTICS).collect()} == want


def test_retrieval_shuffles_pairs_once(spark):
    """Sums and all seven ranks of an entity's pairs are made where one shuffle brings them."""
    rows = [(f"S1-{k}", k % 2, "name", f"n:{t}") for k in range(6) for t in range(k, k + 4)]
    left = spark.createDataFrame(rows, "s1_id string, country int, kind string, token string")
    right = left.select(F.regexp_replace("s1_id", "S1", "S2").alias("rec_id"), F.lit(2).alias("src"), "country", "kind", "token")
    w = right.groupBy("country", "kind", "token").agg((1 / F.count(F.lit(1))).alias("w"))
    got = blocking.retrieve(left, right, w, ["country"])
    steps = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(s1_id", steps)) == 1 and "Union" not in steps
    best = {r.s1_id: r.rec_id for r in got.where("r_t = 0").collect()}
    assert best == {f"S1-{k}": f"S2-{k}" for k in range(6)}
    assert {c: got.where(f"r_{c} < 99").count() for c in "axy"} == {"a": 0, "x": 0, "y": 0}
    assert got.where("r_e < 99 and r_n < 99 and r_c < 99").count() == got.count() == 14
