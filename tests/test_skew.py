from collections import defaultdict

import duckdb

from kinsift.operators import skew
from kinsift.plans import registry

ROWS = [("a", "S2", " The "), ("a", "S2", "the"), ("b", "S2", "THE"), ("b", "S2", None), ("b", "S2", "x"), (None, "S2", "the"),
        ("c", "S3", " the"), ("c", "S3", ""), ("d", None, "the")]


def test_counts_against_brute_force(spark):
    want = defaultdict(set)
    for c, s, t in ROWS:
        k = t.strip().lower() if t else ""
        if c and s and len(k) >= 2:
            want[s, k].add(c)
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "candidate_entity_id string, candidate_source string, token string, n_candidates int")
    got = {(r[0], r[1]): r[2] for r in skew.candidates_per_token(df).select("candidate_source", "token", "n_candidates").collect()}
    assert got == {k: len(v) for k, v in want.items()}
    assert skew.heavy_tokens(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view token_postings as from '{d}/token_postings.parquet'")
    got = sorted(map(tuple, registry.p3_found(spark, d).select("candidate_source", "token").collect()))
    assert got == sorted(con.execute(f"select candidate_source, token from ({registry.ORACLE['p3_found']})").fetchall())
