import random
import time

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kinsift.functions import similarity, text
from kinsift.operators import evidence, sample
from kinsift.sources import io

WORD = st.text(alphabet="abcde", max_size=8)


@settings(max_examples=60, deadline=None)
@given(WORD, WORD)
def test_lcs_against_table(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    assert similarity.lcs(a, b) == row[-1][-1]


def _texts(n=1500):
    rnd = random.Random(12)
    words = ["rimola", "rimolo", "ltd", "a", "12", "क्षेम", "fokade", "b b", "rimola rimola", "\U0001f600x"]
    text = lambda: rnd.choice([" ".join(rnd.choice(words) for _ in range(rnd.randrange(5))), "".join(rnd.choice("abc ") for _ in range(rnd.randrange(12)))])
    many = "".join(chr(0x4E00 + k) for k in range(300))
    rows = [(text(), text()) for _ in range(n)] + [("a" * 300 + "bc" * 20, "b" * 70 + "ac" * 110), (many, many[::-1]), ("", ""), ("", "a"), ("a", "")]
    return [list(x) for x in zip(*rows)]


def test_measures_of_many_pairs_equal_those_of_one():
    a, b = _texts()
    for many, one in ((similarity.lcs_many, similarity.lcs), (similarity.ratio_many, similarity.ratio_text), (similarity.token_sort_many, similarity.token_sort_text),
                      (similarity.token_set_many, similarity.token_set_text), (similarity.partial_many, similarity.partial_text), (similarity.jaro_winkler_many, similarity.jaro_winkler_text)):
        assert many(a, b).tolist() == [one(x, y) for x, y in zip(a, b)], one
        assert len(many([], [])) == 0


def test_measures_of_many_pairs_take_a_fraction_of_the_time():
    rnd = random.Random(3)
    a, b = (["".join(rnd.choice("abcdefghij ") for _ in range(28)) for _ in range(8000)] for _ in range(2))
    for many, one in ((similarity.ratio_many, similarity.ratio_text), (similarity.partial_many, similarity.partial_text), (similarity.jaro_winkler_many, similarity.jaro_winkler_text)):
        t = time.thread_time()
        many(a, b)
        took = time.thread_time() - t
        t = time.thread_time()
        for x, y in zip(a[:800], b[:800]):
            one(x, y)
        assert took < 0.7 * 10 * (time.thread_time() - t), one


def test_nulls_have_no_similarity(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "a"), ("a", None), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(similarity.indel_ratio("a", "b")).collect()] == [1.0, None, None, 1.0]


def test_jaro_winkler_against_duckdb():
    con = duckdb.connect()
    for a, b in [("abcdef", "abxxxx"), ("martha", "marhta"), ("dixon", "dicksonx"), ("a", "b"), ("same", "same"), ("", "x")]:
        assert abs(similarity.jaro_winkler_text(a, b) - con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9


def test_name_and_address_rules(spark):
    df = spark.createDataFrame([("Café & Co", "No 007 New Jersey Street, <null>"), ("Ltd", ""), (None, None)], "n string, a string")
    got = df.select(text.norm_name(F.col("n"))["core"], text.norm_name(F.col("n"))["legal"], text.norm_addr(F.col("a"))).collect()
    assert list(map(list, got[0])) == [["cafe"], ["and", "co"], ["7", "nj", "st"]]
    assert got[1][0] == ["ltd"] and got[2][0] is None or got[2][0] == []


@pytest.mark.parametrize("name, core, legal", [
    ("Étoile & Fils S.A.", "etoile fils a", "and s"), ("www.Rimola.com", "rimola", "www"), ("The Company", "the co", ""), ("ＦＡＢ Incorporated", "fab", "inc"),
    ("ﬁne 日本 Ltd", "fine 日本", "ltd"), ("", "", ""), (None, "", ""), ("!!", "", ""),
])
def test_names_of_any_kind(spark, name, core, legal):
    df = spark.createDataFrame([(name,)], "n string")
    r = df.select(text.norm_name(F.col("n")).alias("x")).select("x.*").first()
    assert (" ".join(r.core), " ".join(r.legal)) == (core, legal)


def test_french_forms_only_if_asked(spark):
    df = spark.createDataFrame([("Etablissements Rimo SNC",)], "n string")
    assert df.select(text.norm_name(F.col("n"))["legal"]).first()[0] == []
    assert df.select(text.norm_name(F.col("n"), True)["legal"]).first()[0] == ["ets", "snc"]


@pytest.mark.parametrize("addr, tokens", [
    ("Door No 1-0/13/09, First Cross, West Bengal", "1 0 13 9 1139 1 cr wb"), ("North Carolina Street-Road 007", "nc st rd 7"), ("000", "0"), ("0-0", "0 0"),
    ("12 Allée du 8 mai 1945", "12 all 8 mai 1945"), ("रोड 5 near the Flat", "5"), ("<NULL>", ""), (None, ""), ("a-b/c", "a b c"),
])
def test_addresses_of_any_kind(spark, addr, tokens):
    df = spark.createDataFrame([(addr,)], "a string")
    assert " ".join(df.select(text.norm_addr(F.col("a"))).first()[0]) == tokens


def test_index_tokens_by_hand(spark):
    df = spark.createDataFrame([(["rimola", "ab"], ["12", "st", "st"]), ([], []), (["solo"], [])], "c array<string>, a array<string>")
    got = [sorted(r[0]) for r in df.select(text.index_tokens(F.col("c"), F.col("a"))).collect()]
    assert got[0] == sorted(["n:rimola", "n:ab", "np:rimol", "g:rimo", "g:imol", "g:mola", "ne:rimolaab", "nc:rimolaab", "a:12", "a:st", "ab:12_st", "nx:rimola|12", "nx:rimola|st"])
    assert got[1] == [] and got[2] == sorted(["n:solo", "ne:solo", "nc:solo", "nc3:solo"])


def test_fixed_numbers(spark):
    df = spark.createDataFrame([(["8", "mai", "1945", "7bis", "8a", "75008", "mars"],)], "a array<string>")
    r = df.select(text.house_numbers(F.col("a")), text.fixed_numbers(F.col("a")), text.fixed_numbers(F.col("a"), True)).first()
    assert [list(x) for x in r] == [[8, 1945, 75008], [7, 75008], [7, 8, 75008]]


def test_number_relation(spark):
    rows = [([], [1]), ([5], [5]), ([12], [13]), ([12], [1299]), ([1], [77])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    rel, _ = evidence.number_relation(F.col("a"), F.col("b"))
    assert [r[0] for r in df.select(rel).collect()] == [0, 1, 2, 3, 4]


def test_split_share_and_stability(spark):
    ids = spark.range(20000).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("i"))
    n = ids.where(sample.is_validation(F.col("i"))).count()
    assert 3700 < n < 4300 and n == ids.where(sample.is_validation(F.col("i"))).count()


def test_tsv_round_trip(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "quoted" name\t\tUS\n')
    r = io.read_tsv(spark, str(p)).first()
    assert tuple(r) == ("S1-1", 'A "quoted" name', "", "US")
    assert io.read_tagged(spark, [(str(tmp_path / "none"), "x")]) is None
