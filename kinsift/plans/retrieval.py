"""Queries of scanning, retrieval, competition and context, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.functions import text
from kinsift.operators import blocking, competition, context
from kinsift.plans import views
from kinsift.plans.views import CAND_SQL, ENT_SQL
from kinsift.plans import sqltext
from kinsift.session import discard, materialize, table


def scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate_scores", "i1", "j", "src", "cs_all").where(F.col("cs_all") > 0.5).select(
        "i1", "j", F.col("src").cast("int").alias("src"), F.round(F.col("cs_all").cast("double"), 3).alias("cs_all"))


def _name_tokens(spark: SparkSession, d: str) -> DataFrame:
    ent = views.entities(spark, d).where("core != ''")
    return blocking.token_table(ent, text.words(F.col("core")), "entity_id", "src", "country").where(F.length("token") >= 2)


def _weights(tok: DataFrame, keys: list[str]) -> DataFrame:
    pool = tok.where("src > 1")
    sizes = pool.groupBy(*keys).agg(F.countDistinct("entity_id").alias("n"))
    return blocking.token_weights(pool, sizes, keys)


def token_df(spark: SparkSession, d: str) -> DataFrame:
    return blocking.document_frequency(_name_tokens(spark, d).where("src > 1"), ["country"])


def token_idf(spark: SparkSession, d: str) -> DataFrame:
    return _weights(_name_tokens(spark, d), ["country"]).select("country", "token", F.round("w", 6).alias("w"))


def self_weights(spark: SparkSession, d: str) -> DataFrame:
    tok = _name_tokens(spark, d)
    return blocking.self_weight(tok, _weights(tok, ["country"]), ["country"], ["entity_id"]).select("entity_id", F.round("self_w", 6).alias("self_w"))


def block_name(spark: SparkSession, d: str) -> DataFrame:
    """The best twelve records of either source by shared weighted name tokens."""
    tok = _name_tokens(spark, d)
    w = _weights(tok, ["country"])
    s1 = tok.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country", "token")
    rec = tok.where("src > 1").select(F.col("entity_id").alias("rec_id"), "src", "country", "token")
    scored = blocking.weighted_join(s1, rec, w, ["country"], ["s1_id", "src", "rec_id"])
    scored = scored.select("s1_id", "src", "rec_id", F.round("score", 6).alias("score"))
    return blocking.top_k(scored, ["s1_id", "src"], "score", [F.col("rec_id")], 12, rank="rank")


_TOK_SQL = f"""{ENT_SQL}, tok AS (SELECT DISTINCT entity_id, src, country, token FROM (
    SELECT entity_id, src, country, unnest(string_split_regex(core, ' +')) AS token FROM ent WHERE core <> '') WHERE length(token) >= 2),
  n AS (SELECT country, count(DISTINCT entity_id) AS n FROM tok WHERE src > 1 GROUP BY country),
  df AS (SELECT country, token, count(*) AS df FROM tok WHERE src > 1 GROUP BY country, token),
  w AS (SELECT country, token, ln((n + 1) / (df + 1)) AS w FROM df JOIN n USING (country) WHERE df <= greatest(30, floor(n * 0.003)))"""


def channels(spark: SparkSession, d: str) -> DataFrame:
    """Union of five channels with the rank in each."""
    c = views.candidates(spark, d)
    norm = F.round(F.col("s_name") / F.sqrt(F.col("s_all") + 1), 6)
    return blocking.channel_ranks(
        c, {"t": (F.col("s_all"), 15), "n": (F.col("s_name"), 12), "a": (F.col("s_addr"), 12), "x": (F.col("s_x"), 10), "c": (norm, 6)}, ["i1", "src"], ["j"])


def _typed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, src, country, kind, token): distinct index tokens of every record."""
    from kinsift.plans.features import _normalised

    e = _normalised(spark, d).select("entity_id", "src", "country", F.explode(text.index_tokens(F.col("core"), F.col("addr"))).alias("token"))
    kind = text.channel(F.col("token"))
    return e.withColumn("kind", F.when(kind == "composite", "x").when(kind == "address", "addr").otherwise("name"))


def retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all seven channels, from the tokens themselves; composite keys of more than 200 records are left out."""
    tok = materialize(_typed_tokens(spark, d), "tokens")
    pool = tok.where("src > 1")
    sizes = pool.groupBy("country").agg(F.countDistinct("entity_id").alias("n"))
    sizes = sizes.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in blocking.PARTS], "kind string")))
    w = blocking.token_weights(pool, sizes, ["country", "kind"], tighter=F.when(F.col("kind") == "x", 200).cast("bigint"))
    left = tok.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country", "kind", "token")
    right = pool.select(F.col("entity_id").alias("rec_id"), "src", "country", "kind", "token")
    got = blocking.retrieve(left, right, w, ["country"])
    discard(tok)
    return got


def topk_ties(spark: SparkSession, d: str) -> DataFrame:
    return blocking.top_k(views.candidates(spark, d).where("s_addr > 0"), ["i1", "src"], "s_addr", [F.col("j")], 5, ties=True).select("i1", "src", "j", "s_addr", "r")


def compete(spark: SparkSession, d: str) -> DataFrame:
    got = competition.competition(views.candidates(spark, d), ["src", "j"], "i1", {"all": "s_all", "name": "s_name", "addr": "s_addr"})
    return got.select("i1", "src", "j", "comp_n_suitors", *[f"comp_{c}_{k}" for c in ("all", "name", "addr") for k in ("other", "gap", "rk")])


def pair_context(spark: SparkSession, d: str) -> DataFrame:
    c = materialize(views.candidates(spark, d).select("i1", "src", "j", "s_all", "cs_name", "cs_addr"), "candidates")
    c = materialize(context.group_context(c, ["i1"], ["s_all", "cs_name"]), "context")
    comb = F.round(F.col("cs_name") + F.col("cs_addr") + F.col("s_all") / (F.col("s_all_mx") + 1e-6), 6)
    c = context.combined(c, ["i1"], comb, ["src", "j"])
    return c.select("i1", "src", "j", "n_cand", "s_all_mx", "s_all_gap", "s_all_rk", "cs_name_rk", F.round("comb", 6).alias("comb"),
                    F.round("comb_gap", 6).alias("comb_gap"), "comb_rk", F.round("comb_2nd", 6).alias("comb_2nd"))


def sibling_context(spark: SparkSession, d: str) -> DataFrame:
    """Agreement among an entity's candidates that have the same address score."""
    c = views.candidates(spark, d).withColumn("comb", F.col("s_all")).withColumn("key", F.when(F.col("s_addr") > 0, F.col("s_addr").cast("decimal(10,3)").cast("string")).otherwise(""))
    c = context.siblings(c, "i1", "key", "ad")
    return c.select("i1", "src", "j", "sib_ad_n", "sib_ad_mx", F.round("sib_ad_mean", 6).alias("sib_ad_mean"))


def anchor_context(spark: SparkSession, d: str) -> DataFrame:
    c = context.anchor(views.candidates(spark, d), ["i1"], "s_all", ["src", "j"], ["src", "j", "cs_name"])
    return c.select("i1", "src", "j", "an_src", "an_j", (F.col("cs_name") == F.col("an_cs_name")).cast("int").alias("an_eq"))


def top_second(spark: SparkSession, d: str) -> DataFrame:
    c = context.top_two(views.candidates(spark, d), "i1", "cs_all", ["src", "j"])
    return c.select("i1", "src", "j", F.round("top", 6).alias("top"), F.round("second", 6).alias("second"), F.col("is_top").cast("int").alias("is_top"))


def _ranked(col: str, ch: str, k: int) -> str:
    return f"""SELECT i1, src, j, '{ch}' AS ch, r FROM (SELECT *, row_number() OVER (PARTITION BY i1, src ORDER BY {col} DESC, j) - 1 AS r
        FROM cand WHERE {col} > 0) WHERE r < {k}"""


QUERIES = {
    "scan_pruned": scan_pruned, "token_df": token_df, "token_idf": token_idf, "self_weights": self_weights,
    "block_name": block_name, "retrieval": retrieval, "channel_ranks": channels, "topk_ties": topk_ties, "competition": compete,
    "pair_context": pair_context, "sibling_context": sibling_context, "anchor_context": anchor_context, "top_second": top_second,
}

_CHANNELS = {"t": ("s_all", 15), "n": ("s_name", 12), "a": ("s_addr", 12), "x": ("s_x", 10), "c": ("c", 6), "y": ("y", 6), "e": ("e", 5)}


def _retrieval_sql() -> str:
    sums = lambda p: ", ".join(f"sum(CASE WHEN kind = '{k}' THEN w ELSE 0.0 END) AS {p}_{k}" for k in ("name", "addr", "x"))
    ranks = " UNION ALL ".join(f"""SELECT s1_id, src, rec_id, '{c}' AS ch, r FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY {col} DESC, rec_id) - 1 AS r
      FROM sc WHERE {col} > 0) WHERE r < {k}""" for c, (col, k) in _CHANNELS.items())
    return f"""WITH {ENT_SQL}, folded AS (SELECT *, {sqltext.fold('name')} AS fn, {sqltext.fold('addr')} AS fa FROM ent),
      nt AS (SELECT entity_id, src, country, {sqltext.name_tokens('fn')} AS nt, {sqltext.norm_addr('fa')} AS addr FROM folded), norm AS ({sqltext.split_legal('nt', 'nt')}),
      tok AS (SELECT entity_id, src, country, token, CASE WHEN starts_with(token, 'nx:') THEN 'x' WHEN regexp_matches(token, '^(n|np|nc|nc3|g|ne):') THEN 'name' ELSE 'addr' END AS kind
        FROM (SELECT entity_id, src, country, unnest({sqltext.index_tokens('core', 'addr')}) AS token FROM norm)),
      n AS (SELECT country, count(DISTINCT entity_id) AS n FROM tok WHERE src > 1 GROUP BY country),
      df AS (SELECT country, kind, token, count(*) AS df FROM tok WHERE src > 1 GROUP BY ALL),
      w AS (SELECT country, kind, token, ln((n + 1) / (df + 1)) AS w FROM df JOIN n USING (country) WHERE df <= greatest(30, floor(n * 0.003)) AND (kind <> 'x' OR df <= 200)),
      p AS (SELECT a.entity_id AS s1_id, b.src, b.entity_id AS rec_id, {sums('s')} FROM tok a JOIN w USING (country, kind, token) JOIN tok b USING (country, kind, token)
        WHERE a.src = 1 AND b.src > 1 GROUP BY ALL),
      own AS (SELECT entity_id, {sums('o')} FROM tok JOIN w USING (country, kind, token) GROUP BY entity_id),
      sc AS (SELECT s1_id, p.src, rec_id, round(s_name + s_addr, 6) AS s_all, round(s_name, 6) AS s_name, round(s_addr, 6) AS s_addr, round(s_x, 6) AS s_x,
        round(s_name / sqrt(a.o_name * b.o_name + 1e-6), 6) AS cs_name, round(s_addr / sqrt(a.o_addr * b.o_addr + 1e-6), 6) AS cs_addr,
        round((s_name + s_addr) / sqrt((a.o_name + a.o_addr) * (b.o_name + b.o_addr) + 1e-6), 6) AS cs_all,
        round(s_name / sqrt(b.o_name + 1), 6) AS c, round(s_x / sqrt(b.o_x + 1), 6) AS y, CASE WHEN b.o_addr = 0 THEN round(s_name, 6) ELSE 0.0 END AS e
        FROM p JOIN own a ON a.entity_id = s1_id JOIN own b ON b.entity_id = rec_id),
      u AS ({ranks}), f AS (SELECT s1_id, src, rec_id, {', '.join(f"coalesce(min(CASE WHEN ch = '{c}' THEN r END), 99) AS r_{c}" for c in _CHANNELS)} FROM u GROUP BY s1_id, src, rec_id)
    SELECT f.*, s_all, s_name, s_addr, s_x, cs_name, cs_addr, cs_all FROM f JOIN sc USING (s1_id, src, rec_id)"""


_COMP = ", ".join(
    f"""coalesce(CASE WHEN rn_{c} = 1 THEN lead({v}) OVER w_{c} ELSE first_value({v}) OVER w_{c} END, 0.0) AS comp_{c}_other,
    {v} - coalesce(CASE WHEN rn_{c} = 1 THEN lead({v}) OVER w_{c} ELSE first_value({v}) OVER w_{c} END, 0.0) AS comp_{c}_gap, rn_{c} AS comp_{c}_rk"""
    for c, v in (("all", "s_all"), ("name", "s_name"), ("addr", "s_addr"))
)
ORACLE = {
    "scan_pruned": "SELECT i1, j, CAST(src AS INTEGER) AS src, round(CAST(cs_all AS DOUBLE), 3) AS cs_all FROM candidate_scores WHERE cs_all > 0.5",
    "token_df": f"WITH {_TOK_SQL} SELECT country, token, df FROM df",
    "token_idf": f"WITH {_TOK_SQL} SELECT country, token, round(w, 6) AS w FROM w",
    "self_weights": f"WITH {_TOK_SQL} SELECT entity_id, round(sum(w), 6) AS self_w FROM tok JOIN w USING (country, token) GROUP BY entity_id",
    "block_name": f"""WITH {_TOK_SQL}, p AS (
        SELECT a.entity_id AS s1_id, b.src, b.entity_id AS rec_id, round(sum(w), 6) AS score
        FROM tok a JOIN w USING (country, token) JOIN tok b USING (country, token) WHERE a.src = 1 AND b.src > 1 GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY score DESC, rec_id) - 1 AS rank FROM p) WHERE rank < 12""",
    "retrieval": _retrieval_sql(),
    "channel_ranks": f"""WITH {CAND_SQL}, u AS ({_ranked('s_all', 't', 15)} UNION ALL {_ranked('s_name', 'n', 12)} UNION ALL {_ranked('s_addr', 'a', 12)}
        UNION ALL {_ranked('s_x', 'x', 10)} UNION ALL {_ranked('round(s_name / sqrt(s_all + 1), 6)', 'c', 6)})
      SELECT i1, src, j, {', '.join(f"coalesce(min(CASE WHEN ch = '{c}' THEN r END), 99) AS r_{c}" for c in 'tnaxc')} FROM u GROUP BY i1, src, j""",
    "topk_ties": f"""WITH {CAND_SQL} SELECT i1, src, j, s_addr, r FROM (SELECT *, rank() OVER (PARTITION BY i1, src ORDER BY s_addr DESC) AS place,
        row_number() OVER (PARTITION BY i1, src ORDER BY s_addr DESC, j) - 1 AS r FROM cand WHERE s_addr > 0) WHERE place <= 5 AND r < 15""",
    "competition": f"""WITH {CAND_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY src, j) AS comp_n_suitors,
        {', '.join(f'row_number() OVER (PARTITION BY src, j ORDER BY {v} DESC, i1) AS rn_{c}' for c, v in (('all', 's_all'), ('name', 's_name'), ('addr', 's_addr')))} FROM cand)
      SELECT i1, src, j, comp_n_suitors, {_COMP} FROM n WINDOW
        {', '.join(f'w_{c} AS (PARTITION BY src, j ORDER BY {v} DESC, i1)' for c, v in (('all', 's_all'), ('name', 's_name'), ('addr', 's_addr')))}""",
    "pair_context": f"""WITH {CAND_SQL}, a AS (SELECT *, count(*) OVER (PARTITION BY i1) AS n_cand, max(s_all) OVER (PARTITION BY i1) AS s_all_mx,
          rank() OVER (PARTITION BY i1 ORDER BY s_all DESC) AS s_all_rk, rank() OVER (PARTITION BY i1 ORDER BY cs_name DESC) AS cs_name_rk FROM cand),
        b AS (SELECT *, round(cs_name + cs_addr + s_all / (s_all_mx + 1e-6), 6) AS comb FROM a)
      SELECT i1, src, j, n_cand, s_all_mx, s_all_mx - s_all AS s_all_gap, s_all_rk, cs_name_rk, round(comb, 6) AS comb,
        round(max(comb) OVER (PARTITION BY i1) - comb, 6) AS comb_gap, rank() OVER (PARTITION BY i1 ORDER BY comb DESC) AS comb_rk,
        round(coalesce(nth_value(comb, 2) OVER (PARTITION BY i1 ORDER BY comb DESC, src, j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0), 6) AS comb_2nd FROM b""",
    "sibling_context": f"""WITH {CAND_SQL} SELECT i1, src, j, CASE WHEN s_addr > 0 THEN CAST(count(*) OVER w AS DOUBLE) ELSE 0.0 END AS sib_ad_n,
        CASE WHEN s_addr > 0 THEN max(s_all) OVER w ELSE 0.0 END AS sib_ad_mx, round(CASE WHEN s_addr > 0 THEN avg(s_all) OVER w ELSE 0.0 END, 6) AS sib_ad_mean
      FROM cand WINDOW w AS (PARTITION BY i1, s_addr)""",
    "anchor_context": f"""WITH {CAND_SQL}, a AS (SELECT *, first_value(src) OVER w AS an_src, first_value(j) OVER w AS an_j, first_value(cs_name) OVER w AS an_cs
        FROM cand WINDOW w AS (PARTITION BY i1 ORDER BY s_all DESC, src, j)) SELECT i1, src, j, an_src, an_j, CAST(cs_name = an_cs AS INTEGER) AS an_eq FROM a""",
    "top_second": f"""WITH {CAND_SQL} SELECT i1, src, j, round(first_value(cs_all) OVER w, 6) AS top, round(coalesce(nth_value(cs_all, 2) OVER w, 0.0), 6) AS second,
        CAST(row_number() OVER (PARTITION BY i1 ORDER BY cs_all DESC, src, j) = 1 AS INTEGER) AS is_top
      FROM cand WINDOW w AS (PARTITION BY i1 ORDER BY cs_all DESC, src, j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
}
