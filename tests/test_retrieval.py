import numpy as np
from pyspark.sql import functions as F

from chartloom.operators import answers, evaluation, planning, ranking, search


def close(a, b, eps=1e-6):
    return abs(a - b) < eps


def test_bm25(spark):
    texts = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green sky tree"), (4, "blue sea"), (5, "dog"), (6, None)][:5], "id long, text string")
    queries = spark.createDataFrame([(9, "red fox"), (10, "red fox"), (11, ""), (12, None)], "query_id long, text string")
    rows = search.bm25(texts, queries).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.rank) for r in rows] == [(9, 1, 1), (9, 2, 2), (10, 1, 1), (10, 2, 2)]
    assert close(rows[0].score, 1.694358) and close(rows[1].score, 0.350824)
    assert search.bm25(texts.limit(0), queries).count() == 0


def test_exact_counts_rare_needles(spark):
    texts = spark.createDataFrame([(i, "cough" if i < 90 else "ramipril losartan cough") for i in range(100)], "id long, text string")
    needles = spark.createDataFrame([(1, "ramipril"), (1, "losartan"), (1, "losartan"), (2, "cough"), (3, "none")], "query_id long, needle string")
    rows = search.exact(texts, needles, 5).collect()
    one = [r for r in rows if r.query_id == 1]
    assert [r.id for r in sorted(one, key=lambda r: r.rank)] == [90, 91, 92, 93, 94]
    assert close(one[0].score, 2 * (1 + 10**0.5) + 20) and {r.query_id for r in rows} == {1, 2}


def test_dense_as_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "id long, vector array<float>")
    rows = search.dense(df, df.where("id % 20 = 0"), 5, block=64).collect()
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    for q in range(0, 300, 20):
        assert [r.id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] == sorted(range(300), key=lambda i: (-s[q, i], i))[:5]


def test_late_interaction(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.6, 0.8]), (2, 3, [0.0, 1.0])], "id long, member long, vector array<double>")
    q = spark.createDataFrame([(7, 1, [1.0, 0.0]), (7, 2, [0.0, 1.0])], "id long, member long, vector array<double>")
    assert {(r.id, r.score) for r in search.late_interaction(df, q).collect()} == {(1, 1.8), (2, 1.0)}


def test_fusion(spark):
    hits = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id long, id string, rank int")
    weights = spark.createDataFrame([(1, "x", 0.35), (1, "y", 0.25)], "query_id long, channel string, weight double")
    rows = ranking.fuse({"x": hits("abc"), "y": hits("bd")}, weights).orderBy("rank").collect()
    assert [r.id for r in rows] == list("bacd")
    assert all(close(r.score, s, 1e-8) for r, s in zip(rows, (0.009743522, 0.005737705, 0.005555556, 0.004032258)))


def test_diversity_and_scaling(spark):
    rows = [(1, i, "e" if i < 8 else "f", i + 1) for i in range(9)]
    df = spark.createDataFrame(rows, "query_id long, id long, grp string, rank int")
    assert sorted(r.id for r in ranking.diversify(df).collect()) == [0, 1, 2, 3, 4, 5, 8]
    s = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (2, 2.0)], "query_id long, s double")
    got = sorted((r.query_id, r.m) for r in s.select("query_id", ranking.minmax(F.col("s")).alias("m")).collect())
    assert got == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.5), (2, 1.0)]


def test_top_k_is_a_prefix(spark):
    df = spark.createDataFrame([(q, i, float(i % 3)) for q in range(3) for i in range(20)], "query_id long, id long, score double")
    five = {(r.query_id, r.id, r.rank) for r in search.top(df, 5).collect()}
    assert five == {(r.query_id, r.id, r.rank) for r in search.top(df, 10).collect() if r.rank <= 5}


def test_planning(spark):
    names = spark.createDataFrame([("Ramipril",), (" ramipril",), (None,)], "name string")
    q = [(1, "why was ramipril started?"), (2, "Who electronically signed the note?"), (3, "table of values in June 2024"), (4, ""), (5, None)]
    got = {r.query_id: r for r in planning.plan(spark.createDataFrame(q, "query_id long, text string"), names).collect()}
    assert got[1].intent == "clinical_explanation" and got[1].sections == ["plan"] and got[1].needles == ["ramipril"]
    assert got[2].intent == "signature_lookup" and got[4].intent == "general" and got[4].needles == []
    assert got[5].intent == "general" and got[5].needles == [] and got[5].text == ""
    assert got[3].intent == "table_heavy" and close(got[3].w_structured, 0.304348) and close(got[3].w_lexical, 0.26087)
    assert close(got[1].w_lexical + got[1].w_dense + got[1].w_structured + got[1].w_visual, 1.0, 1e-5)


def test_planning_as_specified(spark):
    """Literal cases: intent, sections and entities of a query; nothing here is taken from the tables of rules."""
    names = spark.createDataFrame([("Jardiance",), ("insulin glargine",), ("Amlodipine",)], "name string")
    cases = [
        (1, "What is the patient's date of birth?", "metadata_exact", ["demographics"]),
        (2, "Which timeframe was given?", "general", ["follow_up"]),
        (3, "HbA1c when Jardiance 10 mg was started", "lab_value_linked_to_medication_change", ["plan", "laboratory_results"]),
        (4, "ICD codes I10 and E11.65 of the visit", "icd_code_lookup", ["assessment"]),
        (5, "Was blood pressure 140/90 at the office visit with Dr. Anna Berg, MD on May 3, 2024?", "general", ["vitals"]),
        (6, "allergies and family history of the mother", "multi_part_clinical", ["allergies", "medical_history", "family_history"]),
        (7, "reason for insulin  glargine", "clinical_explanation", []),
        (8, "secondary hypertension", "general", []),
    ]
    got = {r.query_id: r for r in planning.plan(spark.createDataFrame([c[:2] for c in cases], "query_id long, text string"), names).collect()}
    for i, text, intent, sections in cases:
        assert (got[i].intent, list(got[i].sections)) == (intent, sections), text
    assert list(got[3].medications) == ["jardiance"] and got[3].numbers == ["10 mg"] and got[3].labs == ["HbA1c", "LDL"][:1]
    assert {"empagliflozin", "jardiance", "sglt2 inhibitor"} <= set(got[3].expansions) and {"10 mg", "hba1c", "empagliflozin"} <= set(got[3].needles)
    assert got[4].codes == ["I10", "E11.65"] and {"i10", "e11.65", "assessment", "diagnoses"} <= set(got[4].needles)
    assert got[5].numbers == ["140/90"] and got[5].providers == ["Dr. Anna Berg, MD"] and got[5].encounter_types == ["office visit"] and got[5].dates == ["2024-05-03"]
    assert got[5].expansions == ["BP", "mmHg"] and got[5].expanded.endswith("BP mmHg 2024-05-03") and close(got[5].w_structured, 0.4 / 1.15)
    assert list(got[7].medications) == ["insulin glargine"]  # names are compared by words, whatever blanks stand between
    assert "renal artery stenosis" in got[8].expansions


def test_metadata_matches(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    date = ranking.date_match
    row = spark.range(1).select(
        date(a("2024-05-03"), a("2024-05-03")).alias("day"), date(a("2024-05"), a("2024-05-09")).alias("month"), date(a("2024-06"), a("2024-05-09")).alias("none"), date(a(), a()).alias("empty"),
        ranking.section_match(a("follow_up"), F.lit("follow up visit"), F.lit(None).cast("string"), F.lit("section")).alias("named"), ranking.section_match(a("vitals"), F.lit("x"), F.lit("vitals"), F.lit("atomic")).alias("typed"),
        ranking.section_match(a("plan", "vitals"), F.lit("x"), F.lit(None).cast("string"), F.lit("compound")).alias("synthesis"), ranking.section_match(a("plan"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("section")).alias("no"),
        ranking.structure_match(F.lit("any allergies?"), a(), F.lit("allergies"), F.lit(None)).alias("history"), ranking.structure_match(F.lit("dose taken"), a(), F.lit("current medications"), F.lit(None).cast("string")).alias("drug"),
    ).first()
    assert row.asDict() == {"day": 1.0, "month": 1.0, "none": 0.0, "empty": 0.0, "named": 1.0, "typed": 1.0, "synthesis": 0.9, "no": 0.0, "history": 1.0, "drug": 0.85}
    d = spark.createDataFrame([("p", "BP 140/90, ramipril 10 mg", "bp 140/90, ramipril 10 mg", ["140/90"], ["ramipril"], [], ["HbA1c"], [], [], ["vitals"], [])], "q string, text string, norm string, norm_numbers array<string>, aliases array<string>, providers array<string>, labs array<string>, encounter_types array<string>, query_codes array<string>, sections array<string>, codes array<string>")
    r = d.select(ranking.numeric_match(F.col("norm")).alias("n"), ranking.entity_match(F.lower("text"), F.col("codes"), F.lit(None).cast("string")).alias("e"), ranking.cooccurrence(F.lit("bp?"), F.lower("text"), F.col("norm"), F.col("codes")).alias("c")).first()
    assert (r.n, r.e, r.c) == (1.0, 1.0, 0.7)


def test_sparse_search_has_no_hot_term(spark):
    # One term in every item and every query, blocks smaller than the tables.
    rng = np.random.default_rng(3)
    items = [(f"i{i:03d}", [1, 100 + i % 7], [1.0, float(rng.integers(1, 5))]) for i in range(250)]
    asked = [(q, [1, 100 + q % 7], [0.5, 1.0]) for q in range(30)]
    a = spark.createDataFrame(items, "id string, terms array<bigint>, weights array<double>")
    b = spark.createDataFrame(asked + [(99, [777], [1.0]), (98, [], [])], "query_id long, terms array<bigint>, weights array<double>")
    got = search.sparse(a, b, 5, block=32, asked=8).collect()
    assert len(got) == 150
    for q, terms, weights in asked:
        want = sorted(((-sum(w * dict(zip(t, v)).get(x, 0.0) for x, w in zip(terms, weights)), i) for i, t, v in items))[:5]
        assert [(r.id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in want]


def test_needles_of_several_words(spark):
    texts = spark.createDataFrame([(1, "Renal artery stenosis seen."), (2, "artery renal stenosis"), (3, None)], "id long, text string")
    rows = search.exact(texts, spark.createDataFrame([(1, "renal artery"), (2, "stenosis"), (3, ""), (4, None)], "query_id long, needle string")).collect()
    assert {(r.query_id, r.id) for r in rows} == {(1, 1), (2, 1), (2, 2)}


def test_evidence_cascade(spark):
    cases = [
        ("Initiate Jardiance (empagliflozin) 10mg daily given HbA1c of 8.2%", "Initiate Jardiance (empagliflozin) 10mg daily given HbA1c of 8.2%", True),
        ("Allergies | Penicillin — Reaction: Hives — Severity: Moderate", "Penicillin — Reaction: Hives — Severity: Moderate", True),
        ("Patient takes metformin 500 mg with meals", "metformin 1000 mg with meals", False),  # an anchor is missing
        ("Blood pressure was 140/90 and weight 80 kg", "140/90; weight 80 kg", True),
        ("Blood pressure was 140/90", "140/90; weight 80 kg", False),  # every clause must match
        ("renal artery stenosis was suspected in this patient today", "today renal artery stenosis was suspected in this patient", True),  # by words
        ("Appendectomy in the year 2001", "Appendectomy in the year 2001, tonsillectomy in 1990 and a knee arthroscopy in the spring of 2011", False),  # anchors are missing
        ("gall bladder removed in spring", "Operations were: gall bladder removed in spring, with good recovery afterwards and no further complaints", True),  # held by the evidence
        ("weight loss noted", "", False), (None, "x y z", False), ("abc", None, False),
    ]
    df = spark.createDataFrame(cases, "text string, evidence string, want boolean")
    for r in evaluation.evidence_matches(df).collect():
        assert r.matches == r.want, (r.text, r.evidence)


def test_quality(spark):
    m = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 10)], "query_id long, first_rank int")
    r = evaluation.quality(m).first()
    assert r.hit_10 == 0.75 and close(r.mrr_10, (1 + 1 / 3 + 0.1) / 4) and close(r.ndcg_10, 0.447266) and r.missed == 1
    assert evaluation.quality(m.limit(0)).first().queries == 0
    v = spark.createDataFrame([([float(x) for x in range(18)],)], "v array<double>").select(evaluation.nearest_rank(F.col("v"), 0.95).alias("p")).first().p
    assert v == 17.0


def test_answers(spark):
    found = answers.evidence(spark.createDataFrame([(1, 1, "c1", "One  fact.\nMore."), (1, 2, "c2", "x" * 2000)], "query_id long, rank int, id string, text string"))
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r for r in answers.extractive(q, found).collect()}
    assert got[1].answer.startswith("[E1] One fact. More.\n[E2] xxx") and got[1].evidence == 2
    assert got[2].answer == "The evidence is insufficient."
    used, invalid = answers.citations(F.lit("x [E2] y [E10] z [E2]"), F.array(*map(F.lit, ("E1", "E2", "E3"))))
    assert spark.range(1).select(used.alias("u"), invalid.alias("i")).first() == (["E2", "E10"], ["E10"])
    r = spark.range(1).select(evaluation.token_overlap(F.lit("a b"), F.lit("B c")).alias("x"), evaluation.token_overlap(F.lit(""), F.lit("b")).alias("y")).first()
    assert (r.x, r.y) == (0.5, 0.0)


def test_prompts_and_bundles(spark):
    q = spark.createDataFrame([(1, "Why?"), (2, None), (3, "x")], "query_id long, text string")
    results = spark.createDataFrame([(1, 1, "c1", " One fact. "), (1, 2, "c2", "y" * 2000), (2, 1, "c3", "z")], "query_id long, rank int, id string, text string")
    found = answers.evidence(results)
    full = found.withColumn("page", F.lit(4)).withColumn("section", F.lit(None).cast("string")).withColumn("score", F.lit(0.5))
    got = {r.query_id: r for r in answers.prompts(q, full, top=1).collect()}
    assert got[1].prompt == "Question: Why?\n\nEvidence:\n[E1] chunk_id=c1 page=4 section=None score=0.5000\nOne fact.\n\nWrite the answer with [E#] citations. If evidence is insufficient, say so."
    assert got[2].prompt.startswith("Question: \n") and 3 not in got and got[1].prompt_tokens == len(got[1].prompt) // 4
    model = spark.createDataFrame([(1, "So it is [E1], not [E7]."), (2, "Yes [E1]."), (3, "No idea.")], "query_id long, answer string")
    bundle = {r.query_id: r for r in answers.bundles(q, found, model).collect()}
    assert bundle[1].invalid_citations == ["E7"] and not bundle[1].grounded and bundle[1].answer.endswith("[Validation] Dropped/unknown citations: E7")
    assert bundle[2].grounded and bundle[2].mode == "llm" and not bundle[3].grounded and bundle[3].evidence is None
    assert {r.query_id: r.grounded for r in answers.bundles(q, found).collect()} == {1: True, 2: True, 3: False}


def test_reports(spark):
    matches = spark.createDataFrame([(1, 2), (2, None)], "query_id long, first_rank int")
    results = spark.createDataFrame([(2, 1, "d", 7, 8), (2, 2, "d", 9, 9), (1, 1, "d", 1, 1), (1, 2, "e", 3, 5)], "query_id long, rank int, document_id string, page_start int, page_end int")
    rows = {r.query_id: (r.category, r.notes, r.hit) for r in evaluation.error_rows(matches, results).collect()}
    assert rows == {1: ("OK", "rank=2", 1), 2: ("RETRIEVAL_MISS", "top_pages=7,9", 0)}
    expected = spark.createDataFrame([(1, "e", 4), (2, "d", 6), (3, "d", None)], "query_id long, document_id string, page int")
    assert evaluation.page_hits(results, expected).first().asDict() == {"queries": 3, "page_hit": 0.333333, "page_precision": 0.033333}
    r = evaluation.latencies(spark.createDataFrame([(float(x),) for x in range(18)] + [(None,)], "seconds double")).first()
    assert (r.n, r.mean, r.p50, r.p95, r.max) == (18, 8.5, 9.0, 17.0, 17.0)


def test_page_spread(spark):
    pages = spark.createDataFrame([(1, "d", 1, 1.0), (1, "d", 2, 0.9)], "query_id long, document_id string, page_number int, score double")
    chunks = spark.createDataFrame([("a", "d", 1, 1, "section"), ("b", "d", 1, 2, "section"), ("v", "d", 1, 1, "page_visual"), ("k", "d", 1, 1, "encounter_key_facts")], "id string, document_id string, page_start int, page_end int, chunk_type string")
    got = {r.id: (r.score, r.rank) for r in ranking.page_spread(pages, chunks).collect()}
    assert got == {"v": (1.0, 1), "b": (0.9, 2), "a": (0.869565, 3)}


def test_late_interaction_without_coarse_cut(spark):
    rng = np.random.default_rng(5)
    rows = [(g, m, [float(x) for x in rng.normal(size=4)]) for g in range(40) for m in range(3)]
    df = spark.createDataFrame(rows, "id long, member long, vector array<double>")
    q = df.where("id < 2")
    exact = [(r.query_id, r.id) for r in search.late_interaction(df, q, 5).orderBy("query_id", "rank").collect()]
    by = {}
    for g, m, v in rows:
        by.setdefault(g, []).append(np.array(v))
    want = [(i, g) for i in range(2) for g in sorted(by, key=lambda g: (-round(sum(max(float(a @ b) for b in by[g]) for a in by[i]), 6), g))[:5]]
    assert exact == want
    # A group of many vectors comes in parts and scores the same.
    before, search._grouped.__defaults__ = search._grouped.__defaults__, (2, 256)
    try:
        assert [(r.query_id, r.id) for r in search.late_interaction(df, q, 5).orderBy("query_id", "rank").collect()] == want
    finally:
        search._grouped.__defaults__ = before
    assert search.late_interaction(df, q, 5, coarse=40).count() == 10 and search.late_interaction(df.limit(0), q).count() == 0


def test_partitioning_changes_nothing(spark):
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            texts = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} fox") for i in range(60)], "id long, text string").repartition(partitions)
            queries = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "query_id long, text string")
            got.append([tuple(r) for r in search.bm25(texts, queries, 5).orderBy("query_id", "rank").collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 10


def test_best_of_blocks_in_any_order():
    rng = np.random.default_rng(5)
    items = [(f"i{i:03d}", sorted(rng.choice(40, 6, replace=False).tolist()), rng.integers(1, 4, 6).astype(float)) for i in range(400)]
    asked = [(q, sorted(rng.choice(45, 4, replace=False).tolist()), rng.integers(1, 3, 4).astype(float)) for q in range(20)]
    flat = lambda rows: ([r[0] for r in rows], [len(r[1]) for r in rows], np.concatenate([r[1] for r in rows]).astype(np.int64), np.concatenate([r[2] for r in rows]))
    for order in (list(range(400)), rng.permutation(400).tolist()):
        best = search._Best(*flat(asked), np.ones(80), 7, 20.0)
        for at in range(0, 400, 50):
            best.add(*flat([items[i] for i in order[at : at + 50]]))
        got = best.rows()
        for q, terms, weights in asked:
            met = [[w * dict(zip(t, v))[x] for x, w in zip(terms, weights) if x in t] for _, t, v in items]
            want = sorted((-(sum(m) + 20.0 * (len(m) >= 2)), i) for (i, _, _), m in zip(items, met))[:7]
            assert list(zip(-got[got.g == q].score, got[got.g == q].id)) == want


def test_fusion_shuffles_hits_once_by_their_query(spark):
    hits = spark.createDataFrame([(q, f"i{i}", i + 1) for q in (1, 2) for i in range(3)], "query_id long, id string, rank int")
    weights = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.25), (2, "y", 1.0), (2, None, 1.0)], "query_id long, channel string, weight double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fused = ranking.fuse({"x": hits, "y": hits.where("rank < 3")}, weights)
        steps = fused._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in fused.collect())
    assert got == [(1, 1, "i0", round(0.75 / 61, 9)), (1, 2, "i1", round(0.75 / 62, 9)), (1, 3, "i2", round(0.5 / 63, 9)), (2, 1, "i0", round(1 / 61, 9)), (2, 2, "i1", round(1 / 62, 9))]
    assert steps.count("Exchange hashpartitioning") == 2  # hits and weights


def test_ranking_needs_no_texts_once_pairs_are_read(spark):
    plans = spark.createDataFrame([(1, "dose of ramipril", ["medications"], ["ramipril"], [], [], [], [], [], [])], "query_id long, text string, sections array<string>, aliases array<string>, providers array<string>, encounter_types array<string>, labs array<string>, codes array<string>, dates array<string>, numbers array<string>")
    kinds = "id string, grp string, section string, chunk_type string, table_type string, encounter_type string, text string, norm string, tokens array<string>, head string, dates array<string>, codes array<string>"
    items = spark.createDataFrame([(i, "g", "medications", "section", None, None, t, t, t.split(), t, [], []) for i, t in (("a", "dose of ramipril"), ("b", "dose"), ("c", "dose"), ("d", "cough"))], kinds)
    fused = spark.createDataFrame([(1, x, 1.0 - i / 10, i + 1) for i, x in enumerate("dcba")], "query_id long, id string, score double, rank int")
    features = ranking.pair_features(fused, items, plans)
    assert not {"text", "norm", "tokens", "low_text"} & set(features.columns)
    whole = sorted((r["rank"], r.id, r.score) for r in ranking.final_ranking(fused, items, plans).collect())
    assert whole == sorted((r["rank"], r.id, r.score) for r in ranking.final_ranking(fused, None, None, features=features).collect())
    assert [x[1] for x in whole] == ["a", "c", "d"]


def test_a_text_is_put_together_once_for_all_its_needles(spark, monkeypatch):
    seen, real = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: seen.append(df) or real(df))
    texts = spark.createDataFrame([(1, "renal artery stenosis, artery of the kidney"), (2, "artery renal 1.5"), (3, ""), (4, None)], "id long, text string")
    needles = spark.createDataFrame([(1, "renal artery"), (1, "artery"), (2, "artery stenosis of"), (2, "1.5"), (3, "!")], "query_id long, needle string")
    rows = sorted((r.query_id, r.id, r["rank"]) for r in search.exact(texts, needles).collect())
    assert rows == [(1, 1, 1), (1, 2, 2), (2, 2, 1)]
    steps = next(df for df in seen if df.columns == ["id", "needle"])._jdf.queryExecution().optimizedPlan().toString()
    # Below the rows of single words, that is, once per text.
    assert steps.index("array_join(") > steps.index("explode(array_distinct(")
