from kinsift.plans.pipeline import LinkagePipeline


def test_pipeline_end_to_end(spark):
    names = ["fokade rimola", "gisote pahilo", "zotora bovoki", "lezabre tomohi", "kehoha zaklabra", "drasiba hiklejo"] * 4
    rows = []
    for k, n in enumerate(names):
        n = f"{n} {chr(97 + k % 26)}x{k}"
        rows += [(f"S1-{k}", 1, "us", n), (f"S2-{k}", 2, "us", n + " ltd"), (f"S3-{k}", 3, "fr" if k == 0 else "us", n)]
    rec = spark.createDataFrame(rows, "entity_id string, src int, country string, name string")
    truth = spark.createDataFrame([(f"S1-{k}", f"S{s}-{k}") for k in range(len(names)) for s in (2, 3)], "s1_id string, rec_id string")
    pipe = LinkagePipeline(rounds=3, cut=0.5)
    cand = pipe.candidates(rec)
    matches = pipe.fit(cand, truth).decide(pipe.score(cand))
    got = {tuple(r) for r in matches.select("s1_id", "rec_id").collect()}
    want = {(f"S1-{k}", f"S{s}-{k}") for k in range(len(names)) for s in (2, 3)} - {("S1-0", "S3-0")}
    assert len(got & want) >= 0.8 * len(want) and len(got - want) <= 2
    assert pipe.lists(rec, matches).count() == len(names)
