"""Queries of text rules, pair features, learned word evidence, token blocking
and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.functions import similarity, text
from kinsift.operators import augment, evidence, model, recall, sample
from kinsift.plans import sqltext, views
from kinsift.plans.views import ENT_SQL, LAB_SQL, TRUTH_SQL
from kinsift.session import small_rows, table


def fold_names(spark: SparkSession, d: str) -> DataFrame:
    return views.entities(spark, d).select("entity_id", text.fold(F.col("name")).alias("folded"))


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, src, country, core, legal, addr): every entity with the token
    lists that the rules make of its name and address; folding runs once."""
    e = views.entities(spark, d).withColumn("fn", text.fold(F.col("name"))).withColumn("fa", text.fold(F.col("addr")))
    e = e.withColumn("n", text.split_legal(text.name_tokens(F.col("fn"))))
    return e.select("entity_id", "src", "country", "n.core", "n.legal", text.norm_folded_addr(F.col("fa")).alias("addr"))


def norm_names(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d).select("entity_id", F.array_join("core", " ").alias("core"), F.array_join("legal", " ").alias("legal"))


def norm_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d).select("entity_id", F.array_join("addr", " ").alias("addr"))


def index_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every index token of every record with its channel."""
    e = _normalised(spark, d).select("entity_id", F.explode(text.index_tokens(F.col("core"), F.col("addr"))).alias("token"))
    return e.select("entity_id", text.channel(F.col("token")).alias("channel"), "token")


def house_numbers(spark: SparkSession, d: str) -> DataFrame:
    a = text.words(F.col("atok"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return views.entities(spark, d).select(
        "entity_id", joined(text.house_numbers(a)).alias("numbers"), joined(text.fixed_numbers(a)).alias("dated"),
        joined(text.fixed_numbers(a, True)).alias("fixed"))


def _native_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens in other scripts of matched names, and all tokens of their S1 names."""
    e = _normalised(spark, d).select("entity_id", F.concat("core", "legal").alias("tokens"))
    pairs = views.truth(spark, d).join(e.toDF("source1_entity_id", "a"), "source1_entity_id").join(e.toDF("matched_entity_id", "b"), "matched_entity_id")
    pairs = pairs.withColumn("b", F.filter("b", lambda w: ~w.rlike(r"^[\x00-\x7f]*$")))
    return pairs.where(F.size("b") > 0)


def native_words(spark: SparkSession, d: str) -> DataFrame:
    """What each word in another script is written as in Latin letters."""
    return evidence.dice_partners(_native_pairs(spark, d), "a", "b", 2, 0.5).select("t", "l", "c", "occ", "lf")


def native_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with their words of other scripts replaced by what was learned."""
    learned = native_words(spark, d).select("t", "l")
    e = _normalised(spark, d).select("entity_id", F.posexplode("core").alias("at", "t"))
    got = e.join(learned, "t", "left").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("l", "t").alias("w")))).alias("x"))
    return got.select("entity_id", F.array_join("x.w", " ").alias("core"))


def _pair_texts(spark: SparkSession, d: str) -> DataFrame:
    """All labelled candidates with both sides' texts."""
    ent = views.entities(spark, d)
    pairs = views.labelled(spark, d).select("i1", "src", "j", "source1_entity_id", "matched_entity_id", "cs_all", "y")
    a = ent.select(F.col("entity_id").alias("source1_entity_id"), F.col("core").alias("ca"), F.col("atok").alias("aa"))
    b = ent.select(F.col("entity_id").alias("matched_entity_id"), F.col("core").alias("cb"), F.col("atok").alias("ab"))
    return pairs.join(a, "source1_entity_id").join(b, "matched_entity_id")


def _token_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pair_texts(spark, d).withColumn("a", text.words(F.col("ca"))).withColumn("b", text.words(F.col("cb")))


def set_features(spark: SparkSession, d: str) -> DataFrame:
    feats = evidence.set_features(F.col("a"), F.col("b"))
    return _token_pairs(spark, d).select("i1", "src", "j", *[F.round(c, 6).alias(n) if n in ("b_in_a", "a_in_b", "jac") else c.alias(n) for n, c in feats.items()])


def string_features(spark: SparkSession, d: str) -> DataFrame:
    """Jaro-Winkler and edit similarity of core names, spaced and joined."""
    p = _pair_texts(spark, d).withColumn("xa", F.replace("ca", F.lit(" "), F.lit(""))).withColumn("xb", F.replace("cb", F.lit(" "), F.lit("")))
    same = lambda a, b: (F.col(a) == F.col(b)).cast("int")
    return p.select("i1", "src", "j", F.round(similarity.jaro_winkler("ca", "cb"), 6).alias("jw"), F.round(similarity.edit_similarity(F.col("ca"), F.col("cb")), 6).alias("lev"),
                    F.round(similarity.jaro_winkler("xa", "xb"), 6).alias("cjw"), F.round(similarity.edit_similarity(F.col("xa"), F.col("xb")), 6).alias("clev"),
                    same("ca", "cb").alias("eq"), same("xa", "xb").alias("ceq"))


def ratio_features(spark: SparkSession, d: str) -> DataFrame:
    """The LCS ratio family on names and addresses, -1 without a B address."""
    p = _pair_texts(spark, d)
    ad = lambda f: F.when(F.col("ab") == "", -1.0).otherwise(f("aa", "ab"))
    return p.select("i1", "src", "j", similarity.token_set_ratio("ca", "cb").alias("tsr"), similarity.token_sort_ratio("ca", "cb").alias("tsort"),
                    similarity.partial_ratio("ca", "cb").alias("pr"), ad(similarity.token_set_ratio).alias("a_tsr"), ad(similarity.token_sort_ratio).alias("a_tsort"))


def number_features(spark: SparkSession, d: str) -> DataFrame:
    p = _pair_texts(spark, d).withColumn("na", text.house_numbers(text.words(F.col("aa")))).withColumn("nb", text.house_numbers(text.words(F.col("ab"))))
    rel, dist = evidence.number_relation(F.col("na"), F.col("nb"))
    return p.select("i1", "src", "j", rel.alias("rel"), F.round(dist, 6).alias("dist"))


def cluster_features(spark: SparkSession, d: str) -> DataFrame:
    p = _pair_texts(spark, d).withColumn("na", text.house_numbers(text.words(F.col("aa")))).withColumn("nb", text.house_numbers(text.words(F.col("ab"))))
    rel, _ = evidence.number_relation(F.col("na"), F.col("nb"))
    p = p.withColumn("rel", rel).withColumn("bkey", F.array_join(F.array_sort(F.array_distinct("nb")).cast("array<string>"), ","))
    p = p.withColumn("ex", F.size(F.array_except(text.words(F.col("cb")), text.words(F.col("ca")))))
    p = evidence.cluster_features(p, "i1", "bkey", "rel", {"cl_ex_n": "max ex"})
    return p.select("i1", "src", "j", "cl_size", "cl_agree", "s1_support", "cl_ex_n", "cl_other_size", "cl_is_alt")


def word_stats(spark: SparkSession, d: str) -> DataFrame:
    return evidence.word_stats(_token_pairs(spark, d), "a", "b", "y")


def word_rates(spark: SparkSession, d: str) -> DataFrame:
    p = _token_pairs(spark, d)
    base = p.agg(F.avg("y").alias("base"))
    return evidence.word_stats(p, "a", "b", "y").crossJoin(F.broadcast(base)).select("kind", "word", F.round(evidence.shrunk_rate(F.col("n"), F.col("pos"), F.col("base")), 6).alias("rate"))


def branch_words(spark: SparkSession, d: str) -> DataFrame:
    return evidence.branch_words(_token_pairs(spark, d), "a", "b", "y", 2, 0.5).select("word", "n", F.round("rate", 6).alias("rate"))


def dice_partners(spark: SparkSession, d: str) -> DataFrame:
    p = _token_pairs(spark, d).where("y = 1")
    return evidence.dice_partners(p, "a", "b").select("t", "l", "c", "occ", "lf")


def name_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each joined name occurs in source 1 and in the others."""
    e = views.entities(spark, d).where("core != ''").withColumn("compact", F.replace("core", F.lit(" "), F.lit("")))
    one = e.where("src = 1").groupBy("compact").agg(F.count(F.lit(1)).alias("n1"))
    rest = e.where("src > 1").groupBy("compact").agg(F.count(F.lit(1)).alias("n2"))
    return e.select("entity_id", "compact").join(one, "compact", "left").join(rest, "compact", "left").select("entity_id", F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"))


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "record_tokens", "entity_id", "business_name_tokens")
    s1 = recall.list_tokens(t.where("entity_id like 'S1-%'").withColumnRenamed("entity_id", "source1_entity_id"), ["source1_entity_id"], "business_name_tokens")
    other = recall.list_tokens(t.where("entity_id not like 'S1-%'").withColumnRenamed("entity_id", "candidate_entity_id"), ["candidate_entity_id"], "business_name_tokens")
    return s1, other


def join_sizes(spark: SparkSession, d: str) -> DataFrame:
    s1, other = _lists(spark, d)
    f = lambda t: t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return recall.join_size(f(s1), f(other))


#: Most joined rows that shared-token blocking may make.
BUDGET = 20_000_000


def token_block(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share a token, under the most permissive tier that fits the budget."""
    tier = recall.pick_tier(join_sizes(spark, d), BUDGET)
    if tier is None:
        raise ValueError("no tier of shared tokens fits the budget")
    return recall.shared_token_block(*_lists(spark, d), tier)


def block_recall(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall(views.truth(spark, d), token_block(spark, d)).select("n_true", "n_found", F.round("recall", 6).alias("recall"))


def block_union(spark: SparkSession, d: str) -> DataFrame:
    scored = views.labelled(spark, d).where("cs_all >= 0.3").select("source1_entity_id", F.col("matched_entity_id").alias("candidate_entity_id"))
    return recall.union_blocks([("tokens", token_block(spark, d)), ("scores", scored)])


def missed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Missed true pairs with the texts of both sides."""
    e = views.entities(spark, d).select("entity_id", "name")
    got = recall.missed(views.truth(spark, d), token_block(spark, d))
    return got.join(e.toDF("source1_entity_id", "s1_name"), "source1_entity_id", "left").join(e.toDF("matched_entity_id", "rec_name"), "matched_entity_id", "left")


def synthetic(spark: SparkSession, d: str) -> DataFrame:
    e = views.entities(spark, d).where("src = 1").select("entity_id", "name", F.col("atok").alias("addr"), "country")
    learned = evidence.branch_words(_token_pairs(spark, d), "a", "b", "y", 2, 0.5).select("word").orderBy("word")
    return augment.duplicates(e, [r["word"] for r in small_rows(learned, 10_000, "branch words")])


def half_splits(spark: SparkSession, d: str) -> DataFrame:
    """200 halvings of source 1 within countries."""
    e = views.entities(spark, d).where("src = 1")
    return sample.half_splits(e, "entity_id", "country", 200)


def dropped_entities(spark: SparkSession, d: str) -> DataFrame:
    return sample.drop_entities(views.entities(spark, d).where("src = 1"), "entity_id", 0.2, 3).select("entity_id")


FEATURES = ["s_all", "s_name", "s_addr", "cs_name", "cs_addr", "cs_all"]


def filter_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a cross-fitted candidate filter for every labelled candidate."""
    pairs = views.labelled(spark, d).select("i1", "src", "j", *FEATURES, "y")
    return model.cross_fitted(pairs, "i1", FEATURES, rounds=5).select("i1", "src", "j", F.round("p", 6).alias("p"))


QUERIES = {
    "fold_names": fold_names, "native_words": native_words, "native_names": native_names, "norm_names": norm_names, "norm_addresses": norm_addresses, "index_tokens": index_tokens,
    "house_numbers": house_numbers, "set_features": set_features, "string_features": string_features,
    "ratio_features": ratio_features, "number_features": number_features,
    "cluster_features": cluster_features, "word_stats": word_stats, "word_rates": word_rates, "branch_words": branch_words,
    "dice_partners": dice_partners, "name_counts": name_counts, "join_sizes": join_sizes, "token_block": token_block,
    "block_recall": block_recall, "block_union": block_union, "missed_pairs": missed_pairs, "synthetic": synthetic,
    "half_splits": half_splits, "dropped_entities": dropped_entities, "filter_scores": filter_scores,
}

_WORDS = "list_filter(string_split_regex({}, ' +'), lambda x: x <> '')"
_NORM = f"""{ENT_SQL}, folded AS (SELECT *, {sqltext.fold('name')} AS fn, {sqltext.fold('addr')} AS fa FROM ent),
  tok AS (SELECT entity_id, src, country, {sqltext.name_tokens('fn')} AS nt, {sqltext.norm_addr('fa')} AS addr FROM folded), norm AS ({sqltext.split_legal('tok', 'nt')})"""
_NATIVE = f"""{_NORM}, {TRUTH_SQL}, q AS (SELECT list_distinct(list_concat(x.core, x.legal)) AS a,
    list_distinct(list_filter(list_concat(z.core, z.legal), lambda w: NOT regexp_full_match(w, '[\\x00-\\x7f]*'))) AS b
    FROM truth t JOIN norm x ON x.entity_id = t.source1_entity_id JOIN norm z ON z.entity_id = t.matched_entity_id), p AS (SELECT * FROM q WHERE len(b) > 0),
  o AS (SELECT t, count(*) AS occ FROM (SELECT unnest(b) AS t FROM p) GROUP BY t), f AS (SELECT l, count(*) AS lf FROM (SELECT unnest(a) AS l FROM p) GROUP BY l),
  c AS (SELECT t, l, count(*) AS c FROM (SELECT t, unnest(a) AS l FROM (SELECT a, unnest(b) AS t FROM p)) GROUP BY t, l),
  s AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(2 * c / (occ + lf), 9) DESC, l) AS n FROM c JOIN o USING (t) JOIN f USING (l)),
  learned AS (SELECT t, l, c, occ, lf FROM s WHERE n = 1 AND c >= 2 AND c / occ >= 0.5)"""
_PT = f"""{LAB_SQL}, {ENT_SQL}, pt AS (SELECT l.i1, l.src, l.j, l.y, l.cs_all, a.core AS ca, b.core AS cb, a.atok AS aa, b.atok AS ab,
    {_WORDS.format('a.core')} AS a, {_WORDS.format('b.core')} AS b FROM lab l JOIN ent a ON a.entity_id = l.source1_entity_id
    JOIN ent b ON b.entity_id = l.matched_entity_id)"""
_INTER = "len(list_intersect(list_distinct(a), list_distinct(b)))"
_NA, _NB = "len(list_distinct(a))", "len(list_distinct(b))"
_NUM = lambda c: f"list_transform(list_filter(string_split_regex({c}, ' +'), lambda x: regexp_full_match(x, '[0-9]{{1,9}}')), lambda x: CAST(x AS BIGINT))"
_LT = """lt AS (SELECT DISTINCT entity_id, lower(trim(token, ' ')) AS token FROM (SELECT entity_id, unnest(business_name_tokens) AS token FROM record_tokens)
    WHERE length(trim(token, ' ')) >= 2), s1 AS (SELECT entity_id AS source1_entity_id, token FROM lt WHERE entity_id LIKE 'S1-%'),
  ot AS (SELECT entity_id AS candidate_entity_id, token FROM lt WHERE entity_id NOT LIKE 'S1-%'),
  d1 AS (SELECT token, count(*) AS d1 FROM s1 GROUP BY token), d2 AS (SELECT token, count(*) AS d2 FROM ot GROUP BY token),
  size AS (SELECT c, most, coalesce(sum(d1 * d2) FILTER (WHERE greatest(d1, d2) <= c), 0) AS n FROM d1 JOIN d2 USING (token),
    (VALUES (50, 2000000), (200, 20000000), (1000, 200000000), (5000, 2000000000)) v(c, most) GROUP BY c, most),
  tier AS (SELECT max(c) AS t FROM size WHERE n <= least(most, 20000000)),
  blk AS (SELECT DISTINCT source1_entity_id, candidate_entity_id FROM s1 JOIN ot USING (token) JOIN d1 USING (token) JOIN d2 USING (token), tier WHERE d1 <= t AND d2 <= t)"""
_WS = """ws AS (SELECT 'ex' AS kind, unnest(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS word, y FROM pt
  UNION ALL SELECT 'ms', unnest(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), y FROM pt)"""

ORACLE = {
    "fold_names": f"WITH {ENT_SQL} SELECT entity_id, {sqltext.fold('name')} AS folded FROM ent",
    "norm_names": f"WITH {_NORM} SELECT entity_id, array_to_string(core, ' ') AS core, array_to_string(legal, ' ') AS legal FROM norm",
    "norm_addresses": f"WITH {_NORM} SELECT entity_id, array_to_string(addr, ' ') AS addr FROM norm",
    "index_tokens": f"""WITH {_NORM}, x AS (SELECT entity_id, unnest({sqltext.index_tokens('core', 'addr')}) AS token FROM norm)
      SELECT entity_id, CASE WHEN regexp_matches(token, '^(n|np|nc|nc3|g|ne):') THEN 'name' WHEN starts_with(token, 'nx:') THEN 'composite' ELSE 'address' END AS channel, token FROM x""",
    "house_numbers": f"""WITH {ENT_SQL}, w AS (SELECT entity_id, atok, {_WORDS.format('atok')} AS w FROM ent)
      SELECT entity_id, array_to_string({_NUM('atok')}, ',') AS numbers, array_to_string({sqltext.fixed_numbers('w', False)}, ',') AS dated,
        array_to_string({sqltext.fixed_numbers('w', True)}, ',') AS fixed FROM w""",
    "native_words": f"WITH {_NATIVE} SELECT t, l, c, occ, lf FROM learned",
    "native_names": f"""WITH {_NATIVE}, x AS (SELECT entity_id, generate_subscripts(core, 1) AS k, unnest(core) AS t FROM norm)
      SELECT entity_id, string_agg(coalesce(l, t), ' ' ORDER BY k) AS core FROM x LEFT JOIN learned USING (t) GROUP BY entity_id""",
    "set_features": f"""WITH {_PT} SELECT i1, src, j, round({_INTER} / greatest({_NB}, 1), 6) AS b_in_a, round({_INTER} / greatest({_NA}, 1), 6) AS a_in_b,
        round({_INTER} / greatest({_NA} + {_NB} - {_INTER}, 1), 6) AS jac, {_NB} - {_INTER} AS b_minus_a, {_NA} - {_INTER} AS a_minus_b, len(a) AS lta, len(b) AS ltb,
        CAST({_NB} > 0 AND {_INTER} = {_NB} AS INTEGER) AS b_sub_a, CAST({_NA} > 0 AND {_INTER} = {_NA} AS INTEGER) AS a_sub_b,
        CAST(a[1:1] = b[1:1] AS INTEGER) AS first_eq, CAST(a[-1:] = b[-1:] AS INTEGER) AS last_eq FROM pt""",
    "number_features": f"""WITH {_PT}, n AS (SELECT i1, src, j, {_NUM('aa')} AS x, {_NUM('ab')} AS z FROM pt),
        e AS (SELECT i1, src, j, list_transform(x, lambda p: list_transform(z, lambda q: [CAST(p = q AS BIGINT), CAST(levenshtein(p::VARCHAR, q::VARCHAR) <= 1 AS BIGINT),
          CAST(starts_with(p::VARCHAR, q::VARCHAR) OR starts_with(q::VARCHAR, p::VARCHAR) OR ends_with(p::VARCHAR, q::VARCHAR) OR ends_with(q::VARCHAR, p::VARCHAR) AS BIGINT), abs(p - q)])) AS m, len(x) AS lx, len(z) AS lz FROM n),
        f AS (SELECT i1, src, j, lx, lz, flatten(m) AS m FROM e),
        r AS (SELECT i1, src, j, CASE WHEN lx = 0 OR lz = 0 THEN 0 WHEN list_max(list_transform(m, lambda t: t[1])) = 1 THEN 1 WHEN list_max(list_transform(m, lambda t: t[2])) = 1 THEN 2
          WHEN list_max(list_transform(m, lambda t: t[3])) = 1 THEN 3 ELSE 4 END AS rel, list_min(list_transform(m, lambda t: t[4])) AS g FROM f)
      SELECT i1, src, j, rel, CASE WHEN rel = 0 THEN -1.0 WHEN rel = 1 THEN 0.0 ELSE round(ln(1 + g), 6) END AS dist FROM r""",
    "cluster_features": f"""WITH {_PT}, n AS (SELECT i1, src, j, {_NUM('aa')} AS x, {_NUM('ab')} AS z, len(list_filter(list_distinct(b), lambda w: NOT list_contains(a, w))) AS ex FROM pt),
        m AS (SELECT *, flatten(list_transform(x, lambda p: list_transform(z, lambda q: [CAST(p = q AS BIGINT), CAST(levenshtein(p::VARCHAR, q::VARCHAR) <= 1 AS BIGINT),
          CAST(starts_with(p::VARCHAR, q::VARCHAR) OR starts_with(q::VARCHAR, p::VARCHAR) OR ends_with(p::VARCHAR, q::VARCHAR) OR ends_with(q::VARCHAR, p::VARCHAR) AS BIGINT)]))) AS m FROM n),
        r AS (SELECT i1, src, j, ex, array_to_string(list_sort(list_distinct(z)), ',') AS k, CASE WHEN len(x) = 0 OR len(z) = 0 THEN 0 WHEN list_max(list_transform(m, lambda t: t[1])) = 1 THEN 1
          WHEN list_max(list_transform(m, lambda t: t[2])) = 1 THEN 2 WHEN list_max(list_transform(m, lambda t: t[3])) = 1 THEN 3 ELSE 4 END AS rel FROM m),
        g AS (SELECT *, count(*) OVER c AS n, max(ex) OVER c AS mx, sum(CASE WHEN rel = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY i1) AS s1, sum(CASE WHEN k <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY i1) AS keyed
          FROM r WINDOW c AS (PARTITION BY i1, k))
      SELECT i1, src, j, CASE WHEN k <> '' THEN n ELSE 0 END AS cl_size, CASE WHEN k <> '' THEN CAST(rel = 1 AS INTEGER) ELSE -1 END AS cl_agree, s1::BIGINT AS s1_support,
        CASE WHEN k <> '' THEN mx ELSE ex END AS cl_ex_n, (keyed - CASE WHEN k <> '' THEN n ELSE 0 END)::BIGINT AS cl_other_size, CAST(rel >= 2 AND k <> '' AND s1 > 0 AS INTEGER) AS cl_is_alt FROM g""",
    "half_splits": f"""WITH {ENT_SQL}, h AS (SELECT seed, entity_id, country, {sqltext.crc32("t")} AS h FROM (SELECT *, entity_id || '|' || seed AS t FROM ent, range(200) r(seed) WHERE src = 1))
      SELECT CAST(seed AS INTEGER) AS seed, entity_id, CAST(row_number() OVER (PARTITION BY seed, country ORDER BY h, entity_id) % 2 AS INTEGER) AS half FROM h""",
    "dropped_entities": f"""WITH {ENT_SQL} SELECT entity_id FROM (SELECT entity_id, entity_id || '|3' AS t FROM ent WHERE src = 1) WHERE {sqltext.crc32("t")} % 1000000 >= 200000""",
    "word_stats": f"WITH {_PT}, {_WS} SELECT kind, word, count(*) AS n, sum(y)::BIGINT AS pos FROM ws GROUP BY kind, word",
    "word_rates": f"WITH {_PT}, {_WS} SELECT kind, word, round((sum(y) + 20.0 * (SELECT avg(y) FROM pt)) / (count(*) + 20.0), 6) AS rate FROM ws GROUP BY kind, word",
    "branch_words": f"""WITH {_PT}, e AS (SELECT list_filter(list_distinct(b), lambda x: NOT list_contains(a, x)) AS ex, list_filter(a, lambda x: NOT list_contains(b, x)) AS ms, y FROM pt)
      SELECT ex[1] AS word, count(*) AS n, round(avg(y), 6) AS rate FROM e WHERE len(ex) = 1 AND len(ms) = 0 GROUP BY 1 HAVING count(*) >= 2 AND avg(y) <= 0.5""",
    "dice_partners": f"""WITH {_PT}, q AS (SELECT list_distinct(a) AS a, list_distinct(b) AS b FROM pt WHERE y = 1), o AS (SELECT t, count(*) AS occ FROM (SELECT unnest(b) AS t FROM q) GROUP BY t),
        f AS (SELECT l, count(*) AS lf FROM (SELECT unnest(a) AS l FROM q) GROUP BY l), c AS (SELECT t, l, count(*) AS c FROM (SELECT t, unnest(a) AS l FROM (SELECT a, unnest(b) AS t FROM q)) GROUP BY t, l),
        s AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY round(2 * c / (occ + lf), 9) DESC, l) AS n FROM c JOIN o USING (t) JOIN f USING (l))
      SELECT t, l, c, occ, lf FROM s WHERE n = 1 AND c >= 3 AND c / occ >= 0.5""",
    "name_counts": f"""WITH {ENT_SQL}, e AS (SELECT *, replace(core, ' ', '') AS k FROM ent WHERE core <> '')
      SELECT entity_id, (SELECT count(*) FROM e x WHERE x.k = e.k AND x.src = 1) AS n1, (SELECT count(*) FROM e x WHERE x.k = e.k AND x.src > 1) AS n2 FROM e""",
    "join_sizes": f"WITH {_LT} SELECT CAST(c AS INTEGER) AS max_df, coalesce(sum(d1 * d2) FILTER (WHERE greatest(d1, d2) <= c), 0)::BIGINT AS rows FROM d1 JOIN d2 USING (token), (VALUES (50), (200), (1000), (5000)) v(c) GROUP BY c",
    "token_block": f"WITH {_LT} SELECT source1_entity_id, candidate_entity_id FROM blk",
    "block_recall": f"""WITH {_LT}, {TRUTH_SQL}, h AS (SELECT t.* FROM truth t SEMI JOIN blk b ON b.source1_entity_id = t.source1_entity_id AND b.candidate_entity_id = t.matched_entity_id)
      SELECT (SELECT count(*) FROM truth) AS n_true, (SELECT count(*) FROM h) AS n_found, round((SELECT count(*) FROM h) / (SELECT count(*) FROM truth), 6) AS recall""",
    "block_union": f"""WITH {LAB_SQL.replace('s1 AS', 's1r AS').replace('JOIN s1 USING', 'JOIN s1r USING').replace('s1.source1', 's1r.source1')}, {_LT}, u AS (SELECT source1_entity_id, candidate_entity_id, 'tokens' AS rule FROM blk
        UNION ALL SELECT source1_entity_id, matched_entity_id, 'scores' FROM lab WHERE cs_all >= 0.3)
      SELECT source1_entity_id, candidate_entity_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules,
        CASE WHEN candidate_entity_id LIKE 'S2-%' THEN 'S2' WHEN candidate_entity_id LIKE 'S3-%' THEN 'S3' END AS candidate_source FROM u GROUP BY 1, 2""",
    "missed_pairs": f"""WITH {_LT}, {TRUTH_SQL}, {ENT_SQL} SELECT t.source1_entity_id, t.matched_entity_id, a.name AS s1_name, b.name AS rec_name FROM truth t
      ANTI JOIN blk k ON k.source1_entity_id = t.source1_entity_id AND k.candidate_entity_id = t.matched_entity_id
      LEFT JOIN ent a ON a.entity_id = t.source1_entity_id LEFT JOIN ent b ON b.entity_id = t.matched_entity_id""",
}
