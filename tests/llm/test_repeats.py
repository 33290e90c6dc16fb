import re

import pytest

from chartloom.llm.repeats import chunk_hashes, repeated_lines, repeated_spans, running_chunks, without_repeats

BLOCK = "document_id string, page_number int, block_id string, text string, block_type string, key string"
PAGE = "document_id string, page_number int, key string"


def chart(doc, n, body):
    pages = [(doc, p, "x") for p in range(1, n + 1)]
    blocks = []
    for p in range(1, n + 1):
        head = f"Chart copy of Some Clinic, sheet {p}"
        if p == 2:
            head = "Chart c0py of Some Clinjc, sheet 2"  # damaged
        if p == 3:
            head = "Chart copy of Some Clinic, sheet 3 | Not valid without the archive seal."  # run together
        blocks += [(doc, p, "a", head, "text", "k"), (doc, p, "b", body[p % len(body)] + f"\nNot valid without the archive seal.", None, "k")]
    return pages, blocks


BODY = ["Weight was stable over the last weeks.", "Denies cough and fever at this time.", "Referral to cardiology was placed.",
        "Sodium is repeated later on.", "Gait was observed in the hall.", "Sleep averages six hours a night.", "Lives with two cats near the river."]


@pytest.fixture(scope="module")
def tables(spark):
    pages, blocks = chart("c1", 7, BODY)
    pages += [("c1", 1, "x")]  # stored twice
    blocks += [("c1", None, "z", "Chart copy of Some Clinic, sheet 9", None, None), (None, 1, "z", "x", None, None), ("c1", 4, "n", None, None, None), ("c1", 4, "e", "", None, None)]
    small_pages, small_blocks = chart("c2", 3, BODY)
    return spark.createDataFrame(blocks + small_blocks + blocks[:1], BLOCK), spark.createDataFrame(pages + small_pages, PAGE)


def test_lines_found_and_no_others(tables):
    rows = {tuple(r) for r in repeated_lines(*tables).collect()}
    assert rows == {("c1", p, "a", 1) for p in range(1, 8)} | {("c1", p, "b", 2) for p in range(1, 8)}


def test_clean_blocks_keep_the_rest(tables):
    blocks, pages = tables
    out = {(r.document_id, r.page_number, r.block_id): r for r in without_repeats(blocks, pages).collect()}
    assert out["c1", 1, "b"].kept_text == BODY[1] and out["c1", 1, "a"].kept_text == "" and out["c1", 4, "n"].kept_text is None
    assert out["c2", 1, "a"].removed == 0 and out["c2", 1, "a"].kept_text.startswith("Chart copy")
    assert without_repeats(blocks, pages).count() == blocks.count()


def test_empty_tables(tables):
    blocks, pages = tables
    assert repeated_lines(blocks.limit(0), pages).count() == 0
    assert repeated_lines(blocks, pages.limit(0)).count() == 0


def test_chunks_depend_on_content_only(spark):
    long = "wehavealongkeyoflettersthatiscutwhereverthehashsays" * 3
    df = spark.createDataFrame([(0, long), (1, "zz" + long), (2, ""), (3, None), (4, "#")], "i int, key string")
    got = {r.i: r.h for r in df.select("i", chunk_hashes("key").alias("h")).collect()}
    assert got[2] == [] and got[3] == [] and len(got[4]) == 1
    assert len(set(got[0]) & set(got[1])) >= len(set(got[0])) - 2


def test_lines_of_every_other_page(spark):
    line = "Riverside Clinic, chart of the left page"
    pages = [("big", p, "x") for p in range(1, 301)]
    blocks = [("big", p, "a", line if p % 2 else "", "text", "k") for p in range(1, 301)]
    found = repeated_lines(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(pages, PAGE)).collect()
    assert {r.page_number for r in found} == set(range(1, 301, 2))


def test_equal_damaged_copies_count_for_the_intact_line(spark):
    whole, short = "Not valid without the archive seal.", "Not valid without the archive se"
    pages = [("c", p, "x") for p in range(1, 13)] + [("d", p, "x") for p in range(1, 13)]
    blocks = [("c", p, "a", short if p in (3, 8) else whole, "text", "k") for p in range(1, 13)]
    # Two forms that reach the four needed pages only together.
    blocks += [("d", p, "a", whole if p < 3 else short if p < 5 else "", "text", "k") for p in range(1, 13)]
    found = repeated_lines(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(pages, PAGE)).collect()
    assert {(r.document_id, r.page_number) for r in found} == {("c", p) for p in range(1, 13)} | {("d", p) for p in range(1, 5)}


def test_chunks_run_over_line_breaks(spark):
    long = "wehavealongkeyoflettersthatiscutwhereverthehashsays" * 2
    other = "ashortbeginningofthirtyletters"
    df = spark.createDataFrame([(0, [long]), (1, [long[:50], long[50:]]), (2, [other, long[:30], long[30:]]), (3, ["", "#"]), (4, []), (5, None)], "i int, keys array<string>")
    got = {r.i: r.c for r in df.select("i", running_chunks("keys").alias("c")).collect()}
    assert got[0][0] == list(dict.fromkeys(got[1][0] + got[1][1])) or set(got[0][0]) == set(got[1][0] + got[1][1])
    assert len(set(got[0][0]) & {h for line in got[2] for h in line}) >= len(set(got[0][0])) - 1
    assert got[3][0] == [] and len(got[3][1]) == 1 and got[4] == []


def test_text_repeated_without_line_breaks(spark):
    notice = "This copy was made by the records office and may not be shared without the written consent of the patient"
    pages = [("c", p, "x") for p in range(1, 13)]
    # Another sentence before and after it, and another line break in it, on each page.
    blocks = [("c", p, "a", f"{BODY[p % 7]} {notice[: 9 * p]}\n{notice[9 * p :]} {BODY[(p * 3 + 1) % 7]}", "text", "k") for p in range(1, 13)]
    blocks += [("c", 3, "n", None, None, None), ("c", 4, "e", "", None, None), (None, 4, "e", notice, None, None), blocks[0]]
    rows = repeated_spans(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(pages, PAGE)).collect()
    assert {(r.page_number, r.block_id) for r in rows} == {(p, "a") for p in range(1, 13)} and len(rows) == 12
    for r in rows:
        cut = blocks[r.page_number - 1][3][r.start : r.end].replace("\n", " ").replace("  ", " ")
        assert "records office and may not be shared without the written consent of the" in cut.replace("rec ords", "records") or len(cut) > 70
    assert repeated_spans(spark.createDataFrame([], BLOCK), spark.createDataFrame(pages, PAGE)).count() == 0


def test_long_lines_with_much_damage(spark):
    line = " ".join(f"clause{chr(97 + i % 26)} of the notice binds party{chr(97 + i // 26)}" for i in range(60))
    damaged = line
    for i in range(20):
        damaged = damaged.replace(f"clause{chr(97 + i)} of", f"clavse{chr(97 + i)} of", 1)
    pages = [("c", p, "x") for p in range(1, 10)]
    blocks = [("c", p, "a", damaged if p == 4 else line, "text", "k") for p in range(1, 10)]
    found = repeated_lines(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(pages, PAGE)).collect()
    assert {r.page_number for r in found} == set(range(1, 10))
