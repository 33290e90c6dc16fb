import os

import pytest

from chartloom.llm.bpe import PerfectHash, default_vocabulary, encoder
from chartloom.llm.encode import encode_corpus

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [
    "Weight was 109.0 kg, a change of 6.1 kg.\r\n\r\n  Tab\there's the patient's note...",
    "Größe  naïve übergewichtig — señor Íñaki   x",
    "漢字かな交じり文 и кириллица العربية 😀👩‍👩‍👧",
    "QPST" * 3000,
    "a" * 5000 + " " * 300 + "\n" * 50,
    "<|endoftext|> plain",
    "",
    None,
    " ",
]


def test_same_as_public_library(spark):
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(default_vocabulary()), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df.select("doc_id", "text")).collect()}
    for i, x in enumerate(TEXTS):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else []), x


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode_corpus(df).collect()) == [(0, 0), (1, 2), (1, 2)]
    assert encode_corpus(df.limit(0)).collect() == []


def test_hash_is_perfect_and_minimal():
    e = encoder(default_vocabulary())
    keys = list(e.ranks)
    assert e.hash.get(keys).tolist() == list(e.ranks.values())
    assert len(e.hash.slot_value) == len(keys) and (e.hash.slot_value >= 0).all()
    assert PerfectHash([b"x"], [7]).get([b"x", b"y"]).tolist() == [7, -1]
