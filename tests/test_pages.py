from datetime import datetime

import pytest

from chartloom.operators import chunking, pages, structure
from chartloom.operators.order import ordinals, running_sum

PAGE = "document_id string, page_number int, height double, text string, clean_text string, loaded_at timestamp_ntz, line string"
ENC = "document_id string, encounter_id string, encounter_type string, encounter_date string, provider string, facility string, start_page int, end_page int, loaded_at timestamp_ntz"


@pytest.fixture(scope="module")
def chart(spark):
    rows = [("c", p, 800.0, f"Clinic sheet {p}\n\n\n\nBody {'abcdefgh'[p]} text\nPage {p} of 7", f"Vital Signs\nBody {p}", datetime(2024, 1, 1), "x") for p in range(1, 7)]
    rows += [("c", 1, 800.0, "Clinic sheet 1\nNewer body", "Assessment\nNewer", datetime(2024, 2, 1), "x"), ("c", 7, 800.0, None, None, None, "x"), (None, 1, 1.0, "x", "x", None, "x")]
    return spark.createDataFrame(rows, PAGE)


def test_latest_and_report(chart):
    assert {r.page_number: r.text for r in pages.latest_pages(chart).collect()}[1].endswith("Newer body")
    r = pages.validation_report(chart, 20).first()
    assert (r.page_count, r.unreadable_pages) == (7, [7]) and 7 in r.ocr_pages


def test_clean_pages(chart):
    got = {r.page_number: r.cleaned for r in pages.clean_pages(chart, 0.5).collect()}
    assert got[2] == "Body c text" and got[1] == "Newer body" and got[7] == ""
    assert pages.clean_pages(chart.limit(0)).count() == 0


def test_short_pages_count_twice(spark):
    df = spark.createDataFrame([("c", 1, 1.0, "one\ntwo", "", None, "")], PAGE)
    assert {(r.line, r.copies) for r in pages.repeated_edge_lines(df).collect()} == {("one", 2), ("two", 2)}


def test_block_kinds(spark, chart):
    blocks = spark.createDataFrame(
        [("c", 2, "a", "Clinic sheet 2\nmore", [0.0, 10.0, 1.0, 1.0], "x"), ("c", 2, "b", "page 2 of 7", None, "x"), ("c", 2, "d", "Body 2 text", [0.0, 1.0, 1.0, 1.0], "x"), ("c", 2, "e", None, None, None)],
        "document_id string, page_number int, block_id string, text string, bbox array<double>, line string",
    )
    assert {(r.block_id, r.kind) for r in pages.block_kinds(blocks, chart).collect()} == {("a", "header"), ("b", "footer")}


def test_sections_over_page_breaks(chart):
    got = {r.section_no: (r.section, r.start_page, r.end_page) for r in structure.sections(chart).collect()}
    assert got[1] == ("assessment", 1, 1) and got[2] == ("vitals", 2, 2) and len(got) == 6


def test_intervals_and_pages(spark, chart):
    rows = [("c", "E1", None, None, None, None, 1, 3, None), ("c", "E2", None, None, None, None, 3, 5, datetime(2024, 1, 1)), ("c", "E2", None, None, None, None, 4, 5, datetime(2024, 1, 2)), ("c", "E3", None, None, None, None, None, None, None), (None, "E4", None, None, None, None, 1, 2, None)]
    enc = spark.createDataFrame(rows, ENC)
    got = {r.encounter_id: (r.start_page, r.end_page) for r in structure.closed_intervals(enc, chart).collect()}
    assert got == {"E1": (1, 4), "E2": (4, 7)}
    tight = {r.encounter_id: r.end_page for r in structure.closed_intervals(enc, chart, overlap=False).collect()}
    assert tight == {"E1": 3, "E2": 7}
    of = {r.page_number: r.encounter_id for r in structure.encounter_of_page(chart, enc).collect()}
    assert of == {1: "E1", 2: "E1", 3: "E1", 4: "E2", 5: "E2", 6: None, 7: None}


def test_facts(spark):
    text = "HbA1c\t9.7\tg/L\timproved\n- see neurology (J30.2)\n* I10 and J30.2\nBlood pressure was 142/83 mmHg. Weight was 70.5 kg.\nElectronically signed by Ann\nDoe, MD."
    df = spark.createDataFrame([("c", 1, 1.0, text, text, None, "x"), ("c", 2, 1.0, None, None, None, "x")], PAGE)
    row = structure.table_rows(df).first()
    assert (row.analyte, row.value, row.unit, row.trend) == ("HbA1c", 9.7, "g/L", "improved")
    assert [r.item for r in structure.list_items(df).orderBy("line_no").collect()] == ["see neurology (J30.2)", "I10 and J30.2"]
    assert structure.code_sets(df).first().codes == ["I10", "J30.2"]
    v = structure.vitals(df).first()
    assert (v.pressure, v.weight_kg) == ("142/83", 70.5) and structure.signatures(df).first().signer == "Ann"


def test_ordinals_across_spans(spark):
    df = spark.createDataFrame([("g", i * 37 % 1000) for i in range(1000)] + [("h", 5), ("h", -300)], "g string, n int")
    got = ordinals(df, ["g"], ["n"]).collect()
    assert sorted((r.n, r.ordinal) for r in got if r.g == "g") == [(i, i + 1) for i in range(1000)]
    assert sorted((r.n, r.ordinal) for r in got if r.g == "h") == [(-300, 1), (5, 2)]
    total = running_sum(df.where("g = 'g'"), ["g"], ["n"], "n", "s").agg({"s": "max"}).first()[0]
    assert total == sum(range(1000))


def test_chunks(spark, chart):
    rows = [("c_SEC_1", "c", 1, 2, "Vital Signs", "E1", None, "section", None), ("c_SEC_2", "c", 3, 3, "Vital Signs", "E1", None, "section", None), ("c_AF_3", "c", 3, 3, None, "E1", None, "atomic_fact", None), ("x", None, 1, 1, None, None, None, "section", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_start int, page_end int, section string, encounter_id string, encounter_date string, chunk_type string, provider string")
    texts = chunking.section_texts(chunks, chart)
    assert {r.chunk_id: r.text for r in texts.collect()} == {"c_SEC_1": "Assessment\nNewer\nVital Signs\nBody 2", "c_SEC_2": "Vital Signs\nBody 3"}
    assert chunking.longest_sections(texts).first().chunk_id == "c_SEC_1"
    assert {(r.chunk_id, r.previous_id, r.next_id) for r in chunking.neighbours(chunks).collect()} == {("c_SEC_1", None, "c_SEC_2"), ("c_SEC_2", "c_SEC_1", "c_AF_3"), ("c_AF_3", "c_SEC_2", None)}
    assert {r.page_number for r in chunking.uncovered_pages(chunks, chart, 5).collect()} == {4, 5, 6}
    enc = spark.createDataFrame([("c", "E1", "Visit", "2024-03-05", "Dr. A", None, 1, 2, None)], ENC)
    facts = chunking.key_facts(texts, enc).first().text
    assert facts.startswith("Encounter E1\n\nType: Visit\n\nDate: 2024-03-05\n\nProvider: Dr. A\n\n[Vital Signs]\nAssessment\nNewer")
    heads = {r.chunk_id: r.header for r in chunking.headers(chunks, enc).collect()}
    assert heads["c_SEC_1"] == "Encounter: E1\nType: Visit\nDate: March 5, 2024\nProvider: Dr. A\nSection: Vital Signs\nPages: 1-2"
