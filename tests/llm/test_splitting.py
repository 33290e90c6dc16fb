import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import splitting
from chartloom.llm.splitting import cut_points, split_sections

CHUNK = "chunk_id string, document_id string, page_start int, page_end int, section string, chunk_type string, page_number int"
PAGE = "document_id string, page_number int, clean_text string, loaded_at timestamp_ntz, section string"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n;é", max_size=900), st.integers(40, 120), st.integers(0, 9))
def test_cuts_cover_the_text_within_the_limit(text, limit, overlap):
    ends = cut_points(text, limit, overlap)
    assert ends == sorted(set(ends)) or ends == [0]
    assert ends[-1] == len(text)
    starts = [0] + [e - overlap for e in ends[:-1]]
    assert all(e - s <= limit for s, e in zip(starts, ends))


def test_cut_at_the_change_of_topic():
    a = "The heart rhythm and heart valves were checked by heart monitor. " * 6
    b = "Knee joint cartilage and knee ligament pain limit the knee motion. " * 6
    assert cut_points(a + b, 700, 50)[0] == len(a)


def test_depths_against_whole_vectors():
    rnd = random.Random(7)
    # More different words than fit a small table of ids.
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = " ".join(" ".join(rnd.choice(words[i * 40 : i * 40 + 60]) for _ in range(9)) + "." for i in range(60) for _ in range(3))
    at = splitting._boundaries(text)[0]
    parts = [Counter(splitting._WORD.findall(text[a:b])) for a, b in zip([0, *at], [*at, len(text)])]
    sims = []
    for i in range(1, len(parts)):
        left, right = sum(parts[max(0, i - splitting.SIDE) : i], Counter()), sum(parts[i : i + splitting.SIDE], Counter())
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        sims.append(sum(v * right[w] for w, v in left.items()) / norm if norm else 0.0)
    near = lambda i, d: max(sims[max(0, i - splitting.SIDE) : i + 1] if d < 0 else sims[i : i + splitting.SIDE + 1])
    want = [near(i, -1) + near(i, 1) - 2 * s for i, s in enumerate(sims)]
    assert splitting._depths(text, at) == pytest.approx(want)


@pytest.mark.parametrize("block", [splitting.BLOCK, 700])
def test_pieces_join_to_the_section(spark, monkeypatch, block):
    monkeypatch.setattr(splitting, "BLOCK", block)
    rnd = random.Random(4)
    texts = {p: " ".join(rnd.choice(["Cough", "fever.", "heart", "knee", "plan", "é"]) for _ in range(rnd.choice([5, 60, 150]))) for p in range(1, 30)}
    pages = [("d", p, t, None, "x") for p, t in texts.items()] + [("d", 3, texts[3], None, "x"), ("d", 5, None, None, "x"), ("d", 40, "", None, "x")]
    chunks = [("s1", "d", 1, 29, "Plan", "section", 0), ("s2", "d", 40, 41, None, "section", 0), ("s3", "d", 1, 1, None, "section", 0), ("f", "d", 1, 29, None, "atomic_fact", 0), ("s4", None, 1, 29, None, "section", 0), ("s5", "d", 9, 2, None, "section", 0)]
    rows = split_sections(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(pages, PAGE), 900, 60).orderBy("piece_no").collect()
    whole = "\n".join(texts[p] for p in sorted(texts))
    assert {r.chunk_id for r in rows} == {"s1"} and [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
    assert all(len(r.piece) <= 900 and r.piece == whole[r.piece_start : r.piece_start + len(r.piece)] for r in rows)
    assert rows[0].piece_start == 0 and rows[-1].piece_start + len(rows[-1].piece) == len(whole)
    for a, b in zip(rows, rows[1:]):
        assert a.piece_start + len(a.piece) - b.piece_start == 60
    assert rows[0].page_start == 1 and rows[-1].page_end == 29 and rows[0].section == "Plan"


def test_seams_of_blocks_lie_at_topic_boundaries(spark, monkeypatch):
    monkeypatch.setattr(splitting, "BLOCK", 3000)
    topics = ["The heart rhythm and heart valves were checked by heart monitor. ", "Knee joint cartilage and knee ligament pain limit the knee motion. ", "Skin lesion biopsy showed skin tissue without malignant skin cells. "]
    # Pages end inside topics, so page breaks are no boundaries of their own.
    whole = "".join(topics[i % 3] * 8 for i in range(30))
    pages = [("d", i + 1, whole[a : a + 500], None, "x") for i, a in enumerate(range(0, len(whole), 500))]
    chunks = [("s", "d", 1, len(pages), "Plan", "section", 0)]
    rows = split_sections(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(pages, PAGE), 700, 50).orderBy("piece_no").collect()
    text = "\n".join(p[2] for p in pages)
    plain = text.replace("\n", " ")
    ends = [r.piece_start + len(r.piece) for r in rows[:-1]]
    words = [(plain[: e].split()[-4:], plain[e:].split()[:4]) for e in ends]
    assert all(r.piece == text[r.piece_start : r.piece_start + len(r.piece)] and len(r.piece) <= 700 for r in rows)
    assert ends[-1] < len(text) and rows[0].piece_start == 0 and all(b.piece_start == e - 50 for b, e in zip(rows[1:], ends))
    assert sum(a[-1].endswith(".") for a, _ in words) >= 0.9 * len(words)


def test_empty(spark):
    chunks, pages = spark.createDataFrame([], CHUNK), spark.createDataFrame([], PAGE)
    assert split_sections(chunks, pages).count() == 0
