from pyspark.sql import functions as F

from chartloom.operators import facts, structure
from chartloom.operators.chunking import build_chunks, chunk_boxes, combined_history

FACTS = "key string, text string"


def found(spark, key, text):
    row = spark.createDataFrame([(key, text)], FACTS).select(facts.facts_of(F.col("key"), F.col("text")).alias("f")).first()
    return [(f.table_type, dict(f.columns), f.raw_text) for f in row.f]


def test_tables_unrolled_into_lines(spark):
    assert found(spark, "allergies", "Allergies\nSubstance\nReaction\nSeverity\nPenicillin\nHives\nModerate\n") == [
        ("allergies", {"substance": "Penicillin", "reaction": "Hives", "severity": "Moderate"}, "Penicillin — Reaction: Hives — Severity: Moderate")
    ]
    text = "Blood Type\nA+\nAllergies\nNuts\nRash\nunknown\nCurrent Medications\nMedication\nDose\nFrequency\nIndication\nRamipril\n5 mg\ndaily\npressure\nAspirin\n100 mg\nSocial History\nx"
    got = found(spark, "general", text)
    assert [g[0] for g in got] == ["demographics", "current_medications"] and got[1][2] == "Ramipril 5 mg, daily, Indication: pressure"
    text = "Medical & Surgical History\nCondition\nYear Diagnosed\nStatus\nHypertension\n2010\nactive\nGout\nlate\nactive\nProcedure\nYear\nNotes\nAppendectomy\n2001\nno trouble.\nstray\nArthroscopy\n2015\nleft knee\nFamily History\n- Father: gout \nMother: none"
    got = found(spark, "medical_history", text)
    assert [(g[0], g[2]) for g in got] == [
        ("medical_history", "Hypertension — Year Diagnosed 2010 — Status: active"),
        ("surgical_history", "Appendectomy (2001, no trouble)"), ("surgical_history", "Arthroscopy (2015, left knee)"),
        ("family_history", "Family History — Father: gout"), ("family_history", "Family History — Mother: none"),
    ]


def test_facts_of_sections(spark):
    got = found(spark, "assessment", "I10 — Hypertension\nE11.65 - Diabetes\nfine")
    assert [g[0] for g in got] == ["diagnoses", "diagnoses", "diagnoses_set"] and got[2][1] == {"codes": "I10;E11.65"}
    assert [g[2] for g in found(spark, "plan", "• rest\n- water\nHbA1c\n8.2%")] == ["HbA1c: 8.2%", "• rest", "• water"]
    assert [g[0] for g in found(spark, "plan", "Continue as before.")] == ["plan_block"]
    assert [g[2] for g in found(spark, "referrals", "Cardiology\nchest pain\nNeurology for headache")] == ["Cardiology — chest pain", "Cardiology — chest pain", "Neurology — for headache"]
    assert found(spark, "imaging_orders", "Chest X-ray (CXR)\nfor cough")[0][1] == {"study": "Chest X-ray (CXR)", "context": "for cough"}
    assert found(spark, "signature", "Electronically signed by: Dr. Ann Lee, MD Date: May 3, 2024")[0][1] == {"provider": "Dr. Ann Lee, MD", "date": "May 3, 2024"}
    assert found(spark, "vitals", "BP 140 / 90 mmHg, Weight: 180 lbs")[0][2] == "BP 140/90 mmHg; Weight 180 lbs"
    assert found(spark, "vitals", None) == [] and found(spark, None, "x") == [] and found(spark, "plan", "") == []


CHUNK = "chunk_id string, document_id string, encounter_id string, section string, page_start int, page_end int, chunk_type string, encounter_date string, provider string"
PAGE = "document_id string, page_number int, text string, clean_text string, width double, height double, loaded_at timestamp_ntz"
ENC = "document_id string, encounter_id string, encounter_number int, encounter_type string, encounter_date string, provider string, facility string, start_page int, end_page int, loaded_at timestamp_ntz"
BLOCK = "document_id string, page_number int, block_id string, text string, bbox array<double>, reading_order int"


def tables(spark):
    body = {1: "Assessment\nI10 — Hypertension\nE11.65 — Diabetes", 2: "Plan of care\n- rest at home\n- drink water", 3: "Nothing of note was said on this page, and it goes on for more than eighty characters.", 4: "short", 5: None}
    pages = spark.createDataFrame([("d", p, t, t, 600.0, 800.0, None) for p, t in body.items()], PAGE)
    chunks = spark.createDataFrame([("c1", "d", "E1", "Assessment", 1, 1, "section", None, None), ("c2", "d", "E1", " Plan of  care", 2, 2, "section", None, None), ("c3", "d", "E1", None, 5, 5, "section", None, None)], CHUNK)
    enc = spark.createDataFrame([("d", "E1", 1, "office visit", "2024-05-03", "Dr. A", "F", 1, 2, None)], ENC)
    return chunks, pages, enc


def test_chunk_build(spark):
    rows = build_chunks(*tables(spark)).orderBy("chunk_id").collect()
    kinds = [(r.chunk_type, r.table_type) for r in rows]
    assert kinds.count(("atomic", "diagnoses")) == 2 and ("atomic", "diagnoses_set") in kinds and kinds.count(("atomic", "plan_item")) == 2
    # The key facts begin like the compound, so of the two the first one stays.
    assert {r.chunk_type for r in rows} == {"atomic", "section", "compound", "page", "page_visual"}
    by = {r.chunk_id: r for r in rows}
    assert len(by) == len(rows)
    compound = next(r for r in rows if r.chunk_type == "compound")
    assert compound.raw_text.startswith("Encounter E1\n\nType: office visit\n\nDate: 2024-05-03\n\nProvider: Dr. A\n\n[Assessment]\n") and (compound.page_start, compound.page_end) == (1, 2)
    assert [r.page_start for r in rows if r.chunk_type == "page"] == [3]
    for r in rows:
        assert r.next_id is None or by[r.next_id].previous_id == r.chunk_id
        assert r.raw_text in r.retrieval_text
    assert sum(r.previous_id is None for r in rows) == 1
    chunks, pages, enc = tables(spark)
    assert build_chunks(chunks.limit(0), pages.limit(0), enc.limit(0)).count() == 0


def test_labelled_sections(spark):
    pages = spark.createDataFrame([
        ("d", 1, "x", "Name\nAllergies\nNuts", 1.0, 1.0, None), ("d", 2, "x", "Encounter #1 | ENC-1\nS — Subjective\ncough\nP — Plan\n- rest", 1.0, 1.0, None),
        ("d", 3, "x", "- water\n\nReferrals\nnone", 1.0, 1.0, None), ("d", 4, "x", None, 1.0, 1.0, None),
    ], PAGE)
    enc = spark.createDataFrame([("d", "E1", 1, "t", None, None, None, 2, 4, None)], ENC)
    got = sorted((r.encounter_id or "", r.section_no, r.section, r.start_page, r.end_page, r.text) for r in structure.labelled_sections(pages, enc).collect())
    assert got == [
        ("", 0, "general", 1, 1, "Name"), ("", 1, "allergies", 1, 1, "Allergies\nNuts"), ("E1", 1, "general", 2, 2, "Encounter #1 | ENC-1"), ("E1", 2, "subjective", 2, 2, "S — Subjective\ncough"),
        ("E1", 3, "plan", 2, 3, "P — Plan\n- rest\n\n- water"), ("E1", 4, "referrals", 3, 3, "Referrals\nnone"),
    ]


def test_combined_history(spark):
    rows = [("d", "c", i, "surgical_history", p, t) for i, (p, t) in enumerate([(1, "A (2001, x)"), (3, "B (2002, y)"), (9, "C (2003, z)")])] + [("e", "c", 0, "surgical_history", 1, "A")]
    got = combined_history(spark.createDataFrame(rows, "document_id string, chunk_id string, fact_no int, table_type string, page_start int, raw_text string")).collect()
    assert [(r.document_id, r.text, r.parts) for r in got] == [("d", "A (2001, x); B (2002, y)", 2)]


def test_boxes(spark):
    pages = tables(spark)[1]
    texts = spark.createDataFrame([("a", "d", 1, 2, "The whole line stands here\nand another line there"), ("b", "d", 1, 1, "none of this is found"), ("c", "d", 3, 3, "no blocks on this page"), ("n", "d", 1, 1, None)], "chunk_id string, document_id string, page_start int, page_end int, text string")
    blocks = spark.createDataFrame(
        [("d", 1, "x", "Before. the WHOLE line stands here. After", [1.0, 2.0, 3.0, 4.0], 2), ("d", 1, "y", "tiny", [5.0, 5.0, 6.0, 6.0], 1), ("d", 2, "z", "another line there", [7.04, 7.0, 8.0, 8.0], 1), ("d", 2, "q", "another line there", None, 2), ("d", 1, "w", None, [0.0, 0.0, 1.0, 1.0], 3)], BLOCK
    )
    got = {(r.chunk_id, r.box_no): (r.page_number, r.box) for r in chunk_boxes(texts, blocks, pages).collect()}
    assert got == {("a", 1): (1, "1.0,2.0,3.0,4.0"), ("a", 2): (2, "7.0,7.0,8.0,8.0"), ("b", 1): (1, "1.0,2.0,3.0,4.0"), ("b", 2): (1, "5.0,5.0,6.0,6.0"), ("c", 1): (3, "0.0,0.0,600.0,800.0")}
