import pytest
from pyspark.sql import functions as F

from chartloom.llm.scans import repaired_pages, scan_traces, skeleton

PAGE = "document_id string, page_number int, text string, clean_text string, loaded_at timestamp_ntz, kind string"
GOOD = "The patient reports a cough for the past months and the chart was reviewed by the nurse.\nBlood pressure was stable and the clinic will repeat the values together with sodium."
BAD = {
    101: "The patient reports a cough for the past rnonths and the chart was reviewed.",
    102: "Blood pressure was sta-\nble and the clinic will repeat the values together.",
    103: "The cbart was reviewed by the nurse.",
    104: "C L I N I C\n\nBlood pressure was stable.",
    105: "Blood pres sure was stable and the cli nic will repeat the values.",
    106: "Blood pressure was con¬\nstant and the clinic will repeat.",
    107: "» Blood pressure was stable.",
}
FINE = {
    201: "Pre- and post-test values, short-\nand long-term goals; code J30.2, lot 4969-103, 3:1 @ 5 mg.",
    202: "Blood pressure was stable - the clinic will repeat the values (5 mg/dL).",
    203: "",
    204: None,
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(f"c{i}", 1, GOOD, GOOD, None, "k") for i in range(1, 41)]
    rows += [("d", i, t, t, None, "k") for i, t in {**BAD, **FINE}.items()]
    rows += [("d", 101, BAD[101], BAD[101], None, "k"), (None, 1, "x", "x", None, None)]
    words = GOOD.replace("\n", " ").replace(".", "").split()
    for i in range(9):
        body = " ".join(words[i * 2 :: 3] + words[i::2]) + "."
        rows.append(("e", i, f"Copy of Some Clinic, sheet {i}\n{body}", (f"Copy of Some Clinic, sheet {i}\n" if i == 0 else "") + body, None, "k"))
    return spark.createDataFrame(rows, PAGE)


def test_pages_found(pages):
    got = {(r.document_id, r.page_number): r.kinds for r in scan_traces(pages).collect()}
    assert set(got) == {("d", i) for i in BAD} | {("e", 0)}
    assert got["e", 0] == ["running_line"] and got["d", 103] == ["misread"] and got["d", 102] == ["broken_word"]


def test_repair(pages):
    out = {(r.document_id, r.page_number): r.repaired for r in repaired_pages(pages).collect()}
    assert "past months" in out["d", 101] and "The chart was" in out["d", 103]
    assert out["d", 102] == "Blood pressure was stable and the clinic will repeat the values together."
    assert out["d", 104].split("\n\n")[0] == "CLINIC" and out["d", 107] == "Blood pressure was stable."
    assert out["d", 105] == "Blood pressure was stable and the clinic will repeat the values."
    assert "short- and long-term" in out["d", 201]
    assert "Copy of" not in out["e", 0] and out["c1", 1] == GOOD.replace("\n", " ")
    assert out["d", 204] is None


def test_lookalikes_share_a_skeleton(spark):
    pairs = [("clinic", "c1inic"), ("modern", "rnodcrn"), ("wound", "vvouncl"), ("continued", "continiied"), ("describe", "descnbe"), ("fill", "ﬁll"), ("offered", "oﬀered"), ("difficult", "diﬃcult")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(skeleton(F.col("a")) != skeleton(F.col("b"))).count() == 0


def test_line_ends_ligatures_and_capitals(spark):
    rows = [(f"c{i}", 1, GOOD, GOOD, None, "k") for i in range(1, 41)]
    bodies = ["Weight was stable.", "Denies fever.", "Gait was observed.", "Sleep is good.", "Lives alone.", "Sodium rose.", "Plan agreed."]
    for i, body in enumerate(bodies):
        text = f"Copy of Some Clinic, sheet {i}\r\n{body}\r\nDone on day {i}, see other notes {body}"
        rows.append(("w", i, text, text, None, "k"))
    rows += [("d", 1, "x", "He was oﬀered a diﬃcult ﬂoor plan and ﬁrst aﬄicted laﬆ.", None, "k"), ("d", 2, "x", "PAST RNONTHS AND THE CHART WAS REVIEWED.", None, "k")]
    pages = spark.createDataFrame(rows, PAGE)
    out = {(r.document_id, r.page_number): r.repaired for r in repaired_pages(pages).collect()}
    assert all("Copy of" not in out["w", i] and bodies[i] in out["w", i] for i in range(7))
    assert out["d", 1] == "He was offered a difficult floor plan and first afflicted last."
    assert out["d", 2].startswith("PAST MONTHS AND")
    found = {(r.document_id, r.page_number): r.kinds for r in scan_traces(pages).collect()}
    assert all(found["w", i] == ["running_line"] for i in range(7))


def test_context_chooses_among_the_forms_of_a_skeleton(spark):
    rows = [(f"a{i}", 1, "x", "Please add water slowly. Uric acid level rose. Patient mrn verified today. Dose of 5 mm noted.", None, "k") for i in range(60)]
    rows += [(f"b{i}", 1, "x", "Please add water slowly. Dose of 5 mm noted. Dose of 5 mm noted.", None, "k") for i in range(900)]
    rows += [("d", 1, "x", "Uric aeid level rose.", None, "k"), ("d", 2, "x", "Please aeid water slowly.", None, "k"), ("d", 3, "x", "Uric ac1d level rose.", None, "k"), ("d", 4, "x", "Patient mrn verified today.", None, "k")]
    out = {(r.document_id, r.page_number): r.repaired for r in repaired_pages(spark.createDataFrame(rows, PAGE)).collect()}
    assert [out["d", i] for i in range(1, 5)] == ["Uric acid level rose.", "Please add water slowly.", "Uric acid level rose.", "Patient mrn verified today."]
    assert "mrn" in out["a1", 1]


def test_headers_of_many_lines(spark):
    body = [f"Finding {chr(97 + i) * 5} noted for the {w} today" for i, w in enumerate("arm leg hip toe ear eye jaw rib lip chin".split())]
    head = ["Some Clinic of the North", "Department of Records", "Second Floor, East Wing", "Copies on request only", "Printed for internal use"]
    # Line six stands on every page too, but below a line of its own.
    rows = [("h", i, "x", "\n".join([*head, body[i], "Assessment and plan", body[9 - i], body[i] + " again", body[i] + " once more", body[9 - i] + " and again", body[i] + " at last"]), None, "k") for i in range(10)]
    rows = [(d, i, t, t, a, k) for d, i, _, t, a, k in rows]
    out = {r.page_number: r.repaired for r in repaired_pages(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(h not in out[i] for h in head for i in range(10)) and all("Assessment and plan" in out[i] for i in range(10))


def test_empty(pages):
    assert scan_traces(pages.limit(0)).count() == 0
    assert repaired_pages(pages.limit(0)).count() == 0
