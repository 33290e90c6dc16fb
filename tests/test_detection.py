import numpy as np
import pytest

from chartloom.operators import encounters, evaluation, search, vector_index

PAGE = "document_id string, page_number int, text string, clean_text string, loaded_at timestamp_ntz"


def make(spark, pages):
    return spark.createDataFrame([(d, p, t, t, None) for d, p, t in pages], PAGE)


def test_numbered_headers(spark):
    pages = make(spark, [
        ("a", 8, "Encounter #3 | ENC-464119 |\nAnnual Physical | February 20, 2024\nProvider: Dr. Aarav Ali, MD — Family Medicine\nMaple Creek Medical Center"),
        ("a", 11, "Encounter #4 | ENC-383740 |\nTelehealth Visit |\nFebruary 15, 2024"),
        ("a", 12, "Encounter #4 | ENC-383740 |\nTelehealth Visit | February 15, 2024"),
        ("b", 150, "Encounter #1 | ENC-1 |\nOffice Visit | July 23, 2029 00:00"),
        ("b", 151, None),
    ])
    got = {r.encounter_id: r for r in encounters.detected(pages).collect()}
    a = got["ENC-464119"]
    assert (a.encounter_type, a.encounter_date, a.start_page, a.end_page, a.encounter_number) == ("Annual Physical", "2024-02-20", 8, 11, 3)
    assert "Aarav Ali" in a.provider and a.facility == "Maple Creek Medical Center"
    assert (got["ENC-383740"].encounter_type, got["ENC-383740"].encounter_date, got["ENC-383740"].start_page) == ("Telehealth Visit", "2024-02-15", 11)
    assert (got["ENC-1"].encounter_type, got["ENC-1"].encounter_date, got["ENC-1"].end_page) == ("Office Visit", "2029-07-23", 151)


def test_an_id_that_comes_back_begins_anew(spark):
    pages = make(spark, [("a", p, f"Encounter #{n} | ENC-{n} |\nOffice Visit | May {p}, 2024") for p, n in ((1, 1), (2, 1), (3, 2), (4, 1))])
    got = sorted((r.start_page, r.end_page, r.encounter_id) for r in encounters.get_parser()(pages).collect())
    assert got == [(1, 3, "ENC-1"), (3, 4, "ENC-2"), (4, 4, "ENC-1")]


def test_visit_dates_and_fallback(spark):
    pages = make(spark, [
        ("c", 1, "Visit Date: March 3, 2027\nProvider: Alex Kim, MD\nPlan: labs."), ("c", 2, "more"), ("c", 3, "Visit Date: April 4, 2027"), ("d", 1, "Nothing dated here"), ("d", 2, None),
        ("e", 1, "Progress Note\nDOS: June 1, 2028\nJane Roe, MD"), ("f", 1, "Encounter ENC77 seen"), ("g", 2, "Telehealth on 2024-05-06"), ("h", 1, "Clinical Note by Ann Lee, NP"),
    ])
    rows = encounters.detected(pages).collect()
    got = {(r.document_id, r.encounter_id): (r.encounter_date, r.start_page, r.end_page, r.encounter_type) for r in rows}
    assert got == {
        ("c", "VISIT-2027-03-03"): ("2027-03-03", 1, 2, "Clinical Visit"), ("c", "VISIT-2027-04-04"): ("2027-04-04", 3, 3, "Clinical Visit"), ("d", "GEN-DOC"): (None, 1, 2, "Document"),
        ("e", "VISIT-2028-06-01"): ("2028-06-01", 1, 1, "Clinical Visit"), ("f", "ENC-77"): (None, 1, 1, "Clinical Visit"), ("g", "VISIT-2024-05-06"): ("2024-05-06", 2, 2, "Telehealth"), ("h", "GEN-P1"): (None, 1, 1, "Progress Note"),
    }
    assert {r.provider for r in rows} == {None, "Alex Kim, MD", "Jane Roe, MD", "Ann Lee, NP"} and {r.parser for r in rows} == {"generic"}
    assert encounters.detected(pages.limit(0)).count() == 0


def test_parsers_by_name():
    assert {"auto", "generic", "synthetic_soap"} <= set(encounters.PARSERS)
    assert encounters.get_parser(" Generic ") is encounters.plain and encounters.get_parser() is encounters.soap
    with pytest.raises(ValueError):
        encounters.get_parser("none")


def test_evidence(spark):
    rows = [
        (1, "Allergies | Penicillin — Reaction: Hives — Severity: Moderate", "Penicillin — Reaction: Hives — Severity: Moderate"),
        (2, "Take 10mg daily. Return in 2 weeks.", "take 10 mg daily; return in 2 weeks"),
        (3, "Take 10mg daily.", "take 10 mg daily; start insulin glargine"),
        (4, "rest at home and drink a lot of water tonight", "rest at home and drink a lot of water tonite"), (8, "abcdefghij klm", "abcdefghij kln"), (5, None, "x"), (6, "x", None), (7, "x", ""),
    ]
    df = spark.createDataFrame(rows, "i int, text string, evidence string")
    assert {r.i for r in evaluation.evidence_matches(df).collect() if r.matches} == {1, 2, 4}


def test_index_recall(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16))
    v = [middle[i % 20] + 0.4 * rng.normal(size=16) for i in range(1200)]
    v = [x / np.linalg.norm(x) for x in v]
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(5000, None)], "id long, vector array<double>")
    centres = vector_index.fit_centres(df)
    index = vector_index.assign(df, centres)
    assert index.count() == 1200
    queries = df.where("id % 20 = 0")
    near = {(r.query_id, r.id) for r in vector_index.search_cells(index, queries, centres).collect()}
    exact = {(r.query_id, r.id) for r in search.dense(df, queries, 10).collect()}
    assert len(near & exact) / len(exact) >= 0.9
