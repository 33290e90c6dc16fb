import time

import pytest

from chartloom.llm.pii import KINDS, _replace, finder, lexicon_names, pages_with_items, spans

NAMES = (("Ilsa", "given"), ("Mark", "given"), ("Grant", "given"), ("Dorvark", "family"), ("Elstwold", "family"))
CASES = [
    ("Next of kin Ilsa Dorvark, tel (415) 555-0115.", "Next of kin [PERSON], tel [PHONE]."),
    ("Provider: Dr. Wenna van der Quorn-Zelk, MD — cardiology.", "Provider: Dr. [PERSON], MD — cardiology."),
    ("ACCOMPANIED BY ULRIKE FJARIN FOR\nTODAY'S VISIT.", "ACCOMPANIED BY [PERSON] FOR\nTODAY'S VISIT."),
    ("Emergency\ncontact: Yarran, Corvin. Done.", "Emergency\ncontact: [PERSON]. Done."),
    ("Case reviewed with H. van der Wexo, who agrees.", "Case reviewed with [PERSON], who agrees."),
    ("spoke with emrick o'talm regarding nausea", "spoke with [PERSON] regarding nausea"),
    ("Faith K. Zelk states that cough began.", "[PERSON] states that cough began."),
    ("Her daughter Mark helps; mark the scalp.", "Her daughter [PERSON] helps; mark the scalp."),
    ("mail <a.b+c@mail.orrin.test> or x_1 @ veldry.example, y[at]tide.example", "mail <[EMAIL]> or [EMAIL], [EMAIL]"),
    ("Left voicemail on 6025550187; call +44 1632 960 025; tel 01632 960 659 or 1-303-555-0133 ext. 42.", "Left voicemail on [PHONE]; call [PHONE]; tel [PHONE] or [PHONE]."),
    ("Verified member ID XKB-9016-7930, medical\nrecord no. 2582584, SSN 962-18-1950.", "Verified member ID [ID], medical\nrecord no. [ID], SSN [ID]."),
    ("Lives at Flat 7, 956 Mill Race Road, Quaymere ZQ10 6ZZ with two cats.", "Lives at [ADDRESS] with two cats."),
    ("Home address: PO Box 5257, Dunmarsh. Moved to Lindenweg 12, 00606 Lindental.", "Home address: [ADDRESS]. Moved to [ADDRESS]."),
    ("Case reviewed with A. Wexo, who agrees.", "Case reviewed with [PERSON], who agrees."),
    ("Write to o'brien@mail.example or 'ann.lee@mail.example' today.", "Write to [EMAIL] or '[EMAIL]' today."),
    ("Write to " + "very.long.local.part" * 5 + "@mail.example today.", "Write to [EMAIL] today."),
    ("Paid with 4111 1111 1111 1111 and 4012-8888-8888-1881; then 378282246310005.", "Paid with [ID] and [ID]; then [ID]."),
    ("Seen today: patient Ilsa Smith feels well.", "Seen today: patient [PERSON] feels well."),
    ("Hildegardemarialouise Annabellacharlotte Montgomery-Featherstonehaugh states that cough began.", "[PERSON] states that cough began."),
]
NONE = [
    "Workup excluded Crohn disease and Hodgkin lymphoma; Foley catheter, rose bengal, mark the scalp.",
    "Dispensed under NDC 99475-9358-41; model TX-4164-1056; lot 4969-103; ratio 3:1 @ 93 percent.",
    "Velport General Hospital, weight 102.0 kg, 135-145, 98-107; GRACE score 187; May repeat; Will return.",
    "The patient has no next of kin. Mother attended. The daughter agreed.",
    "Order 4111 1111 1111 1112 and product 4111-1111-1111-1113; patient Grant program.",
    "",
]


@pytest.mark.parametrize("text,want", CASES)
def test_items_become_placeholders(text, want):
    assert _replace(text, NAMES) == want


@pytest.mark.parametrize("text", NONE)
def test_no_items(text):
    assert spans(text, NAMES) == []


def test_long_text_without_items():
    assert spans("QPST" * 100_000 + " 1" * 50_000, NAMES) == []


def test_large_lexicon_costs_texts_nothing():
    names = tuple((f"Qux{i}", "family") for i in range(200_000))
    known = finder(names)
    began = time.time()
    for _ in range(200):
        spans("Qux77 states that the cough began two days ago.", known)
    assert time.time() - began < 1


def test_rows_of_pages_and_blocks(spark):
    pages = spark.createDataFrame([("c", 1, CASES[0][0], "x"), ("c", 1, CASES[0][0], "x"), ("c", 2, None, "x"), (None, 3, CASES[0][0], "x"), ("c", 4, "", "x")], "document_id string, page_number int, clean_text string, text string")
    blocks = spark.createDataFrame([("c", 2, CASES[8][0], "z"), ("c", 4, NONE[0], "z")], "document_id string, page_number int, text string, pii_kind string")
    lexicon = spark.createDataFrame([*NAMES, (None, "given"), ("Ilsa", "given")], "name string, name_kind string")
    assert lexicon_names(lexicon) == tuple(sorted(NAMES))
    got = {tuple(r) for r in pages_with_items(pages, blocks, lexicon).collect()}
    assert got == {("c", 1, "person_name"), ("c", 1, "phone"), ("c", 2, "email")}
    assert pages_with_items(pages.limit(0), blocks.limit(0), lexicon.limit(0)).count() == 0
    assert set(KINDS) >= {r[2] for r in got}
