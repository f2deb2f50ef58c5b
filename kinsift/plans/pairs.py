"""Queries of the matcher's features, its fit and its diagnostics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsift.functions import text
from kinsift.operators import augment, batches, blocking, competition, context, decide, evidence, model, pairs, recall, report, rules, sample
from kinsift.plans import sqltext, views
from kinsift.plans.decisions import _F05
from kinsift.plans.views import CAND_SQL, ENT_SQL, LAB_SQL
from kinsift.session import discard, materialize, reclaim, table

IDENT = ["i1", "src", "j"]
TIE = ["src", "j"]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return views.labelled(spark, d).select(*IDENT, "source1_entity_id", "matched_entity_id", *views.SCORES, "y")


def _with_texts(spark: SparkSession, d: str, lab: DataFrame) -> DataFrame:
    """Labelled candidates with the normalised strings of both sides."""
    e = views.entities(spark, d)
    side = lambda key, x: e.select(F.col("entity_id").alias(key), F.col("core").alias(f"c{x}"), F.col("legal").alias(f"l{x}"), F.col("atok").alias(f"a{x}"))
    return lab.join(side("source1_entity_id", "a"), "source1_entity_id").join(side("matched_entity_id", "b"), "matched_entity_id")


def _base(spark: SparkSession, d: str) -> DataFrame:
    """All labelled candidates with the normalised strings of both sides."""
    return _with_texts(spark, d, _labelled(spark, d))


def _words(df: DataFrame) -> DataFrame:
    for c in ("ca", "cb", "la", "lb", "aa", "ab"):
        df = df.withColumn(c, text.words(F.col(c)))
    return df


def _rounded(cols: dict) -> list:
    return [F.round(c.cast("double"), 6).alias(n) for n, c in cols.items()]


def legal_features(spark: SparkSession, d: str) -> DataFrame:
    """Acronyms and legal words."""
    p = _words(_base(spark, d))
    return p.select(*IDENT, *_rounded(pairs.legal_features(F.col("ca"), F.col("cb"), F.col("la"), F.col("lb"))))


def address_features(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of address tokens, words and numbers."""
    p = _words(_base(spark, d))
    return p.select(*IDENT, *_rounded(pairs.address_features(F.col("aa"), F.col("ab"))))


def gram_features(spark: SparkSession, d: str) -> DataFrame:
    """Character 3- and 4-grams of names, padded 3-grams of addresses."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pairs.gram_features(_base(spark, d).repartition(parts, F.xxhash64(*IDENT))).select(*IDENT, *[F.round(c, 6).alias(c) for c in pairs.GRAMS])


def name_statistics(spark: SparkSession, d: str) -> DataFrame:
    """How often the names of both sides and their tokens occur."""
    got = pairs.name_statistics(_base(spark, d), views.entities(spark, d).select("src", "core"))
    return got.select(*IDENT, *[F.round(c, 6).alias(c) for c in pairs.STATISTICS])


def _learned(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = base.withColumn("a", text.words(F.col("ca"))).withColumn("b", text.words(F.col("cb")))
    return evidence.word_stats(split, "a", "b", "y"), base.agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("base"))


def word_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the words only one side has."""
    base = _base(spark, d)
    return pairs.word_evidence(base, IDENT, *_learned(base)).select(*IDENT, *[F.round(c, 6).alias(c) for c in pairs.WORDS])


def _ranks(c: DataFrame) -> DataFrame:
    found = blocking.channel_ranks(c, {"t": (F.col("s_all"), 15), "n": (F.col("s_name"), 12), "a": (F.col("s_addr"), 12)}, ["i1", "src"], ["j"])
    return c.join(found, IDENT, "left").fillna(99, ["r_t", "r_n", "r_a"])


def _with_competition(c: DataFrame) -> DataFrame:
    return competition.competition(c, ["src", "j"], "i1", {"all": "s_all", "name": "s_name", "addr": "s_addr"})


def _texts_and_statistics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts and name statistics of every entity as the left and as the right side of a pair."""
    e = materialize(views.entities(spark, d).select("entity_id", "src", "core", "legal", "atok"), "entities")
    side = lambda key, x: e.select(F.col("entity_id").alias(key), F.col("core").alias(f"c{x}"), F.col("legal").alias(f"l{x}"), F.col("atok").alias(f"a{x}"))
    a, b = side("source1_entity_id", "a"), side("matched_entity_id", "b")
    left, right = pairs.statistics_of(e.select("src", "core"), a.select("ca").distinct(), b.select("cb").distinct())
    return materialize(a.join(left, "ca"), "left"), materialize(b.join(right, "cb"), "right")


def _similar(spark: SparkSession, d: str) -> DataFrame:
    """All labelled candidates with whatever a pair tells by itself; competition
    counts all candidates, labelled or not.

    Name statistics belong to a record and come with its texts. All measures are
    made in one pass and written once."""
    found = materialize(views.candidates(spark, d), "candidates")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each
    a, b = _texts_and_statistics(spark, d)
    scored = _with_competition(_ranks(found))
    base = views.labelled(spark, d, scored).join(a, "source1_entity_id").join(b, "matched_entity_id")
    # numbered in a fixed order, so that the fit draws the same rows each time
    base = base.repartition(parts, F.xxhash64(*IDENT)).sortWithinPartitions(*IDENT).withColumn("__id", F.monotonically_increasing_id())
    base = materialize(base, "pairs")
    discard(a, b, found)
    reclaim(spark)
    wide = materialize(batches.similar(base, ["__id"], *_learned(base)), "similar")
    discard(base)
    reclaim(spark)
    return wide


def _features(wide: DataFrame) -> DataFrame:
    """Every feature of every variant for whole owners of :func:`_similar`: what the
    other candidates add comes from a second pass over few columns."""
    return wide.join(batches.around(wide, "__id", "i1", "src", TIE), "__id").drop("__id", "__house")


EVERY = tuple(dict.fromkeys(f for v in pairs.VARIANTS.values() for f in v))


def pair_features(spark: SparkSession, d: str) -> DataFrame:
    """The matcher's whole feature table."""
    return _features(_similar(spark, d)).select(*IDENT, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in EVERY if c not in IDENT], "y")


def context_after_filter(spark: SparkSession, d: str) -> DataFrame:
    """Context of the candidates that a filter leaves, computed anew. The filter
    asks for scores only, so texts are compared for what it leaves."""
    lab = materialize(_labelled(spark, d), "labelled")
    kept = _with_texts(spark, d, decide.keep_some(lab, "i1", "cs_all", TIE, 0.3, 2))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    similar = pairs.pair_features(kept.repartition(parts, F.xxhash64(*IDENT))).select(*IDENT, "cb", "ab", *pairs.RANKED)
    similar = materialize(similar, "similar")
    discard(lab)
    return pairs.context_features(similar, "i1", TIE).select(*IDENT, *[F.round(c, 6).alias(c) for c in pairs.CONTEXT])


def cheap_features(spark: SparkSession, d: str) -> DataFrame:
    """The candidate filter's features for all labelled candidates."""
    every = _with_competition(views.candidates(spark, d)).select(*IDENT, *pairs.COMPETITION)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pairs.cheap_features(_base(spark, d).join(every, IDENT).repartition(parts, F.xxhash64(*IDENT)), "i1").select(*IDENT, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in pairs.CHEAP])


#: Pairs for which the matcher takes a step of its own, and the most steps: each reads the table of pairs.
SLICE, SLICES = 50_000, 8


def matcher_scores(spark: SparkSession, d: str, rounds: int = 20) -> DataFrame:
    """Scores of a matcher on the whole feature list; no entity is scored by a model that saw it."""
    wide, made = _similar(spark, d), []
    slices = min(SLICES, wide.count() // SLICE + 1)
    for k in range(slices):  # so that no shuffle holds all pairs with all their features
        part = _features(wide.where(F.pmod(F.xxhash64("i1"), F.lit(slices)) == k))
        made.append(materialize(part.select(*IDENT, *[F.col(c).cast("double").alias(f"f_{c}") for c in EVERY], "y"), "features"))
        reclaim(spark)
    discard(wide)
    features = spark.read.schema(made[0].schema).parquet(*[name for df in made for name in df.inputFiles()])
    got = model.cross_fitted(features, "i1", [f"f_{c}" for c in EVERY], kind="matcher", rounds=rounds)
    return got.select(*IDENT, F.round("p", 6).alias("p"))


def sibling_selection(spark: SparkSession, d: str) -> DataFrame:
    """False pairs that look like siblings of a true one."""
    e = views.entities(spark, d).select("entity_id", text.house_numbers(text.words(F.col("atok"))).alias("n"))
    lab = _labelled(spark, d).drop(*views.SCORES)
    got = lab.join(e.toDF("source1_entity_id", "na"), "source1_entity_id").join(e.toDF("matched_entity_id", "nb"), "matched_entity_id")
    got = materialize(got.withColumn("rel", evidence.number_relation(F.col("na"), F.col("nb"))[0]).drop("na", "nb"), "relations")
    support = got.groupBy("i1").agg(F.sum((F.col("rel") == 1).cast("int")).alias("s1_support")).where("s1_support > 0")
    # texts are compared only where the numbers let a pair be a sibling
    open_ = _with_texts(spark, d, got.where("y = 0 and rel >= 2").join(support, "i1"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = pairs.pair_features(open_.repartition(parts, F.xxhash64(*IDENT))).withColumn("atsr", F.col("a_tsr"))
    return augment.near_siblings(p).select("src", "j", "i1")


def clear_cut(spark: SparkSession, d: str) -> DataFrame:
    """By country: pairs of one joined name, most of B's address in A and no
    conflict of numbers, and the share of true ones among them."""
    p = _words(_base(spark, d))
    place = pairs.address_features(F.col("aa"), F.col("ab"))
    clear = (F.array_join("ca", "") == F.array_join("cb", "")) & (place["a_bin"] >= 0.8) & (place["num_conf"] == 0)
    e = views.entities(spark, d).select(F.col("entity_id").alias("source1_entity_id"), "country")
    got = p.select("source1_entity_id", "y", clear.alias("clear")).join(e, "source1_entity_id").groupBy("country").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("clear").cast("int")).alias("n_clear"), F.avg(F.when(F.col("clear"), F.col("y"))).alias("rate")
    )
    return got.select("country", "n", "n_clear", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"))


def recall_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Blocking recall of every country and source."""
    e = views.entities(spark, d)
    true = views.truth(spark, d).join(e.select(F.col("entity_id").alias("source1_entity_id"), "country"), "source1_entity_id")
    true = true.join(e.select(F.col("entity_id").alias("matched_entity_id"), "src"), "matched_entity_id")
    found = views.labelled(spark, d).select("source1_entity_id", "matched_entity_id").distinct().withColumn("hit", F.lit(1))
    got = true.join(found, ["source1_entity_id", "matched_entity_id"], "left").groupBy("country", "src").agg(
        F.count(F.lit(1)).alias("n_true"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_found")
    )
    return got.select("country", "src", "n_true", "n_found", F.round(F.col("n_found") / F.col("n_true"), 6).alias("recall"))


def no_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Entities of source 1 without any candidate, and whether they have a true match."""
    s1 = views.entities(spark, d).where("src = 1").select(F.col("entity_id").alias("source1_entity_id"))
    none = s1.join(views.labelled(spark, d).select("source1_entity_id").distinct(), "source1_entity_id", "left_anti")
    true = views.truth(spark, d).select("source1_entity_id").distinct().withColumn("t", F.lit(1))
    return none.join(true, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("t", F.lit(0)).alias("has_match"))


FILTERS = [(0.0, 0), (0.1, 2), (0.3, 2), (0.3, 4)]


def oracle_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """What a perfect matcher reaches behind filters of several strictness:
    recall, mean F0.5 and candidates per entity."""
    lab = views.labelled(spark, d).select("i1", "src", "j", "source1_entity_id", F.round("cs_all", 3).alias("p"), "y")
    meta = views.meta(lab, views.truth(spark, d))
    out = None
    for tau, keep in FILTERS:
        kept = decide.keep_some(lab, "i1", "p", TIE, tau, keep) if keep else lab
        per = meta.join(kept.groupBy("i1").agg(F.sum("y").alias("tp"), F.count(F.lit(1)).alias("n_kept")), "i1", "left").fillna(0, ["tp", "n_kept"])
        one = per.agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.avg(decide.f05(F.col("tp"), F.col("tp"), F.col("n_true"))).alias("f05"), F.avg("n_kept").alias("c"))
        one = one.select(F.lit(tau).alias("tau"), F.lit(keep).alias("min_keep"), F.round(F.col("tp") / F.col("n_true"), 6).alias("recall"), F.round("f05", 6).alias("f05"), F.round("c", 6).alias("candidates"))
        out = one if out is None else out.unionByName(one)
    return out


def country_cuts(spark: SparkSession, d: str) -> DataFrame:
    """The best threshold of every country, chosen on its labelled entities."""
    e = views.entities(spark, d).select(F.col("entity_id").alias("source1_entity_id"), "country")
    lab = views.labelled(spark, d).withColumn("p", F.round("cs_all", 3))
    meta = views.meta(lab, views.truth(spark, d)).join(lab.select("i1", "source1_entity_id").distinct().join(e, "source1_entity_id").groupBy("i1").agg(F.min("country").alias("country")), "i1")
    sweep = decide.threshold_sweep(lab, meta, "i1", "p", [0.3, 0.5, 0.7], by=["country"]).withColumn("mean_f05", F.round("mean_f05", 6))
    return decide.best_threshold(sweep, ["country"])


def segment_cut(spark: SparkSession, d: str) -> DataFrame:
    """A stricter cut where B has no address and its joined name is shared in source 1."""
    p = pairs.name_statistics(_base(spark, d), views.entities(spark, d).select("src", "core")).withColumn("p", F.round("cs_all", 3))
    shared = (F.col("ab") == "") & (F.col("e_nm1_cnt") >= 2)
    return p.where(rules.segment_cut("p", shared, 0.4, 0.8)).select(*IDENT)


def blank_country(spark: SparkSession, d: str) -> DataFrame:
    """Matches above a cut without those of one country."""
    e = views.entities(spark, d).select(F.col("entity_id").alias("source1_entity_id"), "country")
    p = views.labelled(spark, d).withColumn("p", F.round("cs_all", 3)).where("p >= 0.4").join(e, "source1_entity_id")
    return rules.blank_partition(p, "country", "us").select(*IDENT)


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Score of audited entities: labels 1, 0 and ?; predicted pairs without a label are wrong."""
    lab = views.labelled(spark, d).withColumn("p", F.round("cs_all", 3))
    mark = F.when(F.col("j") % 7 == 0, "?").otherwise(F.col("y").cast("string"))
    labels = lab.where("s_all >= 2").select(*IDENT, mark.alias("label"))
    got = report.audit_score(lab.select(*IDENT, "p"), labels, IDENT, "i1", 0.3)
    return got.select("i1", "n_true", "tp", "fp")


def effective_sample(spark: SparkSession, d: str) -> DataFrame:
    """How many entities the reweighted ones of source 1 are worth."""
    e = views.entities(spark, d)
    w = report.frequency_weights(e.where("src = 1"), e.where("src = 2"), "country")
    return e.where("src = 1").join(w, "country").agg(F.count(F.lit(1)).alias("n"), F.round(report.effective_size("w"), 6).alias("n_eff"))


def lossless_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labelled pairs joined with the competition of all candidates; no row may be lost or doubled."""
    lab = views.labelled(spark, d).select(*IDENT, "y")
    extra = _with_competition(views.candidates(spark, d)).select(*IDENT, "comp_n_suitors")
    return context.joined_whole(lab, extra, IDENT)


def recall_target(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the stored candidates against the target of the blocking."""
    found = views.labelled(spark, d).select("source1_entity_id", F.col("matched_entity_id").alias("candidate_entity_id"))
    got = recall.against_target(recall.recall(views.truth(spark, d), found), 0.92)
    return got.select("n_true", "n_found", F.round("recall", 6).alias("recall"), "target", "target_met")


def dropout_competition(spark: SparkSession, d: str) -> DataFrame:
    """Competition among the entities that are left when a fifth of source 1 is dropped."""
    left = sample.drop_entities(views.entities(spark, d).where("src = 1"), "entity_id", 0.2, 3).select("entity_id")
    rows = table(spark, d, "records", "entity_id", "src", "row_no").where("src = 1").join(left, "entity_id", "left_semi")
    kept = views.candidates(spark, d).join(rows.select(F.col("row_no").alias("i1")).distinct(), "i1", "left_semi")
    got = competition.competition(kept, ["src", "j"], "i1", {"all": "s_all"})
    return got.select(*IDENT, "comp_n_suitors", "comp_all_other", "comp_all_rk")


QUERIES = {
    "recall_target": recall_target, "dropout_competition": dropout_competition,
    "legal_features": legal_features, "address_features": address_features, "gram_features": gram_features,
    "name_statistics": name_statistics, "word_evidence": word_evidence, "pair_features": pair_features,
    "context_after_filter": context_after_filter, "cheap_features": cheap_features, "matcher_scores": matcher_scores,
    "sibling_selection": sibling_selection, "clear_cut": clear_cut, "recall_by_source": recall_by_source,
    "no_candidates": no_candidates, "oracle_ceiling": oracle_ceiling, "country_cuts": country_cuts, "segment_cut": segment_cut,
    "blank_country": blank_country, "audit": audit, "effective_sample": effective_sample, "lossless_labels": lossless_labels,
}

_W = "list_filter(string_split_regex({}, ' +'), lambda x: x <> '')"
_PX = f"""{LAB_SQL}, {ENT_SQL}, px AS (SELECT l.*, a.core AS ca, b.core AS cb, a.atok AS aa, b.atok AS ab, {_W.format('a.core')} AS a, {_W.format('b.core')} AS b,
    list_distinct({_W.format('a.legal')}) AS la, list_distinct({_W.format('b.legal')}) AS lb, list_distinct({_W.format('a.atok')}) AS ua, list_distinct({_W.format('b.atok')}) AS ub,
    {_W.format('b.atok')} AS wb, a.country FROM lab l JOIN ent a ON a.entity_id = l.source1_entity_id JOIN ent b ON b.entity_id = l.matched_entity_id)"""
_INITIALS = lambda x: f"array_to_string(list_transform({x}, lambda w: substring(w, 1, 1)), '')"
_ADDR = f"""{_PX}, ix AS (SELECT *, list_intersect(ua, ub) AS ix, list_filter(ua, lambda w: regexp_matches(w, '^\\p{{Nd}}')) AS da, list_filter(ub, lambda w: regexp_matches(w, '^\\p{{Nd}}')) AS db FROM px),
  ad AS (SELECT *, len(list_intersect(da, db)) AS hit, len(ix) / greatest(len(ub), 1) AS a_bin FROM ix)"""
_G = lambda t, n: f"CASE WHEN length({t}) < {n} THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t}) - {n} + 2), lambda k: substring({t}, k, {n}))) END"
_GRAM = lambda t, n: f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE {_G(t, n)} END"


def _sim(a: str, b: str, how: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    by = {"j": f"(len({a}) + len({b}) - {inter})", "c": f"sqrt(len({a}) * len({b}))", "a": f"len({a})"}[how]
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE round({inter} / {by}, 6) END"


def _kept(tau: float, keep: int) -> str:
    return f"p >= {tau} OR n <= {keep}" if keep else "true"


ORACLE = {
    "recall_target": f"""WITH {LAB_SQL}, h AS (SELECT count(*) AS n FROM (SELECT DISTINCT t.* FROM truth t SEMI JOIN lab l ON l.source1_entity_id = t.source1_entity_id AND l.matched_entity_id = t.matched_entity_id))
      SELECT m AS n_true, n AS n_found, round(n / m, 6) AS recall, CAST(0.92 AS DOUBLE) AS target, CAST(n / m >= 0.92 AS INTEGER) AS target_met FROM h, (SELECT count(*) AS m FROM truth)""",
    "dropout_competition": f"""WITH {CAND_SQL}, {ENT_SQL}, e AS (SELECT entity_id FROM (SELECT entity_id, entity_id || '|3' AS t FROM ent WHERE src = 1) WHERE {sqltext.crc32('t')} % 1000000 >= 200000),
        k AS (SELECT * FROM cand WHERE i1 IN (SELECT row_no FROM records WHERE src = 1 AND entity_id IN (SELECT entity_id FROM e))),
        n AS (SELECT *, count(*) OVER (PARTITION BY src, j) AS comp_n_suitors, row_number() OVER w AS rn, lead(s_all) OVER w AS nxt, first_value(s_all) OVER w AS top FROM k WINDOW w AS (PARTITION BY src, j ORDER BY s_all DESC, i1))
      SELECT i1, src, j, comp_n_suitors, coalesce(CASE WHEN rn = 1 THEN nxt ELSE top END, 0.0) AS comp_all_other, rn AS comp_all_rk FROM n""",
    "legal_features": f"""WITH {_PX} SELECT i1, src, j, CAST(len(a) >= 2 AND {_INITIALS('a')} = array_to_string(b, '') AS DOUBLE) AS acr_a,
        CAST(len(b) >= 2 AND {_INITIALS('b')} = array_to_string(a, '') AS DOUBLE) AS acr_b, CAST(len(la) > 0 AND list_sort(la) = list_sort(lb) AS DOUBLE) AS legal_eq,
        CAST(len(lb) = 0 AS DOUBLE) AS b_nolegal, CAST(len(list_intersect(la, lb)) > 0 AS DOUBLE) AS legal_ov FROM px""",
    "address_features": f"""WITH {_ADDR} SELECT i1, src, j, CAST(len(ub) = 0 AS DOUBLE) AS b_noaddr, len(ua)::DOUBLE AS ata, len(ub)::DOUBLE AS atb, len(ix)::DOUBLE AS a_ix,
        round(a_bin, 6) AS a_bin, round(len(ix) / greatest(len(ua), 1), 6) AS a_ain, round(len(ix) / greatest(len(ua) + len(ub) - len(ix), 1), 6) AS a_jac, (len(ix) - hit)::DOUBLE AS a_ixw,
        hit::DOUBLE AS num_ix, CAST(len(da) > 0 AND len(db) > 0 AND hit = 0 AS DOUBLE) AS num_conf, CAST(len(db) > 0 AS DOUBLE) AS b_hasnum, CAST(hit > 0 AS DOUBLE) AS num_hit,
        CAST(coalesce(list_contains(ua, wb[-1]), false) AS DOUBLE) AS state_hit FROM ad""",
    "gram_features": f"""WITH {_PX}, c AS (SELECT *, replace(ca, ' ', '') AS x, replace(cb, ' ', '') AS z FROM px),
        g AS (SELECT *, {_GRAM('x', 3)} AS a3, {_GRAM('z', 3)} AS b3, {_GRAM('x', 4)} AS a4, {_GRAM('z', 4)} AS b4,
          CASE WHEN aa = '' THEN []::VARCHAR[] ELSE {_G("(' ' || aa || ' ')", 3)} END AS p3, CASE WHEN ab = '' THEN []::VARCHAR[] ELSE {_G("(' ' || ab || ' ')", 3)} END AS q3 FROM c)
      SELECT i1, src, j, {_sim('a3', 'b3', 'j')} AS ng_n3j, {_sim('a3', 'b3', 'c')} AS ng_n3c, {_sim('a3', 'b3', 'a')} AS ng_n3a, {_sim('a4', 'b4', 'j')} AS ng_n4j,
        CASE WHEN ab = '' THEN -1.0 ELSE {_sim('p3', 'q3', 'j')} END AS ng_a3j, CASE WHEN ab = '' THEN -1.0 ELSE {_sim('p3', 'q3', 'c')} END AS ng_a3c FROM g""",
    "name_statistics": f"""WITH {_PX}, nm AS (SELECT src, {_W.format('core')} AS t FROM ent), v AS (SELECT w, count(*) AS k FROM (SELECT unnest(t) AS w FROM nm WHERE src = 1) GROUP BY w),
        o AS (SELECT array_to_string(t, '') AS x, count(*) AS n FROM nm WHERE src = 1 GROUP BY 1), q AS (SELECT array_to_string(t, '') AS x, count(*) AS n FROM nm WHERE src > 1 GROUP BY 1),
        ta AS (SELECT c, min(ln(1 + coalesce(k, 0))) AS lo, avg(ln(1 + coalesce(k, 0))) AS av FROM (SELECT c, unnest({_W.format('c')}) AS w FROM (SELECT DISTINCT ca AS c FROM px)) LEFT JOIN v USING (w) GROUP BY c),
        tb AS (SELECT c, avg(CASE WHEN k IS NULL THEN 0 ELSE 1 END) AS kn, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS nu FROM (SELECT c, unnest({_W.format('c')}) AS w FROM (SELECT DISTINCT cb AS c FROM px)) LEFT JOIN v USING (w) GROUP BY c)
      SELECT i1, src, j, coalesce(o1.n, 0)::DOUBLE AS e_nm1_cnt, round(coalesce(ta.lo, 0.0), 6) AS e_tk1_min, round(coalesce(ta.av, 0.0), 6) AS e_tk1_mean, coalesce(q.n, 0)::DOUBLE AS e_nmB_cnt,
        coalesce(o2.n, 0)::DOUBLE AS e_nmB_s1, round(coalesce(tb.kn, 1.0), 6) AS e_known, coalesce(tb.nu, 0)::DOUBLE AS e_nunk,
        CAST(coalesce(tb.kn, 1.0) = 0 AND coalesce(tb.nu, 0) > 0 AS DOUBLE) AS e_allunk
      FROM px LEFT JOIN o o1 ON o1.x = array_to_string(a, '') LEFT JOIN q ON q.x = array_to_string(b, '') LEFT JOIN o o2 ON o2.x = array_to_string(b, '')
        LEFT JOIN ta ON ta.c = ca LEFT JOIN tb ON tb.c = cb""",
    "clear_cut": f"""WITH {_ADDR}, k AS (SELECT country, y, array_to_string(a, '') = array_to_string(b, '') AND a_bin >= 0.8 AND NOT (len(da) > 0 AND len(db) > 0 AND hit = 0) AS clear FROM ad)
      SELECT country, count(*) AS n, sum(CAST(clear AS INTEGER))::BIGINT AS n_clear, round(coalesce(avg(CASE WHEN clear THEN y END), 0.0), 6) AS rate FROM k GROUP BY country""",
    "recall_by_source": f"""WITH {LAB_SQL}, {ENT_SQL}, f AS (SELECT DISTINCT source1_entity_id, matched_entity_id, 1 AS hit FROM lab)
      SELECT a.country, b.src, count(*) AS n_true, sum(coalesce(hit, 0))::BIGINT AS n_found, round(sum(coalesce(hit, 0)) / count(*), 6) AS recall FROM truth t
      JOIN ent a ON a.entity_id = t.source1_entity_id JOIN ent b ON b.entity_id = t.matched_entity_id LEFT JOIN f USING (source1_entity_id, matched_entity_id) GROUP BY a.country, b.src""",
    "no_candidates": f"""WITH {LAB_SQL}, {ENT_SQL} SELECT entity_id AS source1_entity_id, CAST(entity_id IN (SELECT source1_entity_id FROM truth) AS INTEGER) AS has_match
      FROM ent WHERE src = 1 AND entity_id NOT IN (SELECT source1_entity_id FROM lab)""",
    "oracle_ceiling": f"""WITH {LAB_SQL}, r AS (SELECT i1, src, j, y, round(cs_all, 3) AS p, row_number() OVER (PARTITION BY i1 ORDER BY round(cs_all, 3) DESC, src, j) AS n FROM lab) """
    + " UNION ALL ".join(
        f"""SELECT CAST({tau} AS DOUBLE) AS tau, {keep} AS min_keep, round(sum(tp) / sum(n_true), 6) AS recall, round(avg(f), 6) AS f05, round(avg(nk), 6) AS candidates FROM (
        SELECT tp, n_true, nk, {_F05.replace('n_pred', 'tp')} AS f FROM (SELECT m.n_true, coalesce(sum(CASE WHEN {_kept(tau, keep)} THEN y END), 0) AS tp,
          count(CASE WHEN {_kept(tau, keep)} THEN p END) AS nk FROM meta m LEFT JOIN r USING (i1) GROUP BY m.i1, m.n_true))"""
        for tau, keep in FILTERS
    ),
    "country_cuts": f"""WITH {LAB_SQL}, {ENT_SQL}, o AS (SELECT i1, min(country) AS country FROM lab JOIN ent ON entity_id = source1_entity_id GROUP BY i1), pr AS (SELECT *, round(cs_all, 3) AS p FROM lab),
        g AS (SELECT o.country, m.i1, m.n_true, CAST(th AS DOUBLE) AS th, sum(CASE WHEN p >= th THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= th THEN 1 ELSE 0 END) AS n_pred
          FROM meta m JOIN o USING (i1) CROSS JOIN (VALUES (0.3), (0.5), (0.7)) c(th) LEFT JOIN pr USING (i1) GROUP BY o.country, m.i1, m.n_true, th),
        s AS (SELECT country, th, round(avg({_F05}), 6) AS mean_f05 FROM g GROUP BY country, th)
      SELECT country, th, mean_f05 FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY mean_f05 DESC, th) AS n FROM s) WHERE n = 1""",
    "segment_cut": f"""WITH {_PX}, o AS (SELECT array_to_string({_W.format('core')}, '') AS x, count(*) AS n FROM ent WHERE src = 1 GROUP BY 1)
      SELECT i1, src, j FROM px LEFT JOIN o ON o.x = array_to_string(a, '') WHERE round(cs_all, 3) >= CASE WHEN ab = '' AND coalesce(o.n, 0) >= 2 THEN 0.8 ELSE 0.4 END""",
    "blank_country": f"WITH {_PX} SELECT i1, src, j FROM px WHERE round(cs_all, 3) >= 0.4 AND country <> 'us'",
    "audit": f"""WITH {LAB_SQL}, l AS (SELECT i1, src, j, CASE WHEN j % 7 = 0 THEN '?' ELSE y::VARCHAR END AS label FROM lab WHERE s_all >= 2),
        t AS (SELECT i1, sum(CASE WHEN label = '1' THEN 1 ELSE 0 END)::BIGINT AS n_true FROM l GROUP BY i1),
        g AS (SELECT x.i1, sum(CASE WHEN label = '1' THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN label = '1' THEN 0 ELSE 1 END)::BIGINT AS fp FROM lab x LEFT JOIN l USING (i1, src, j)
          WHERE round(x.cs_all, 3) >= 0.3 AND x.i1 IN (SELECT i1 FROM l) AND (label IS NULL OR label <> '?') GROUP BY x.i1)
      SELECT t.i1, n_true, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM t LEFT JOIN g USING (i1)""",
    "effective_sample": f"""WITH {ENT_SQL}, a AS (SELECT country, count(*) AS c, count(*) / (SELECT count(*) FROM ent WHERE src = 1) AS fv FROM ent WHERE src = 1 GROUP BY country),
        b AS (SELECT country, count(*) / (SELECT count(*) FROM ent WHERE src = 2) AS ft FROM ent WHERE src = 2 GROUP BY country), w AS (SELECT c, coalesce(ft / fv, 0.0) AS w FROM a LEFT JOIN b USING (country))
      SELECT sum(c)::BIGINT AS n, round(sum(c * w) * sum(c * w) / sum(c * w * w), 6) AS n_eff FROM w""",
    "lossless_labels": f"""WITH {LAB_SQL} SELECT i1, src, j, y, n AS comp_n_suitors FROM lab JOIN (SELECT src, j, count(*) AS n FROM cand GROUP BY src, j) USING (src, j)""",
}
