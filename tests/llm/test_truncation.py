from chartloom.llm.truncation import truncated_texts, truncation_by_source

DOCS = "doc_id long, text string, source string, cut string"
FULL = "The patient reports a persistent cough. Denies fever at this time.\n- Ramipril 5 mg twice daily\n- Losartan 5 mg at bedtime\nReview is planned."


def rows():
    docs = [(i, FULL, "a", "x") for i in range(6)]
    docs += [
        (10, "The patient reports a persist", "a", "x"),  # inside a word
        (11, "The patient reports a persistent", "a", "x"),  # inside a sentence
        (12, "Denies fever at this ti [cut]", "b", "x"),
        (13, "Denies fever at thi…", None, "x"),
        (14, 'Patient states: "it comes and goes..."', "b", "x"),
        (15, "Review is planned.\n- Ramipril 5 mg twice daily", "b", "x"),  # ends in a whole list line
        (16, "Review is planned.\n- Ramipril 5 mg twi", "b", "x"),
        (17, None, "b", "x"), (18, "", "b", "x"), (19, "  \n", None, "x"),
        (20, "Review is planned.\nCodes: E11.9, I10", "b", "x"),
    ]
    docs += [(30 + i, f"Review is planned.\nElectronically filed, 0{i}:15", "b", "x") for i in range(4)]
    return docs + docs[6:7]


def test_cut_texts(spark):
    got = truncated_texts(spark.createDataFrame(rows(), DOCS)).collect()
    assert sorted(r.doc_id for r in got if r.cut) == [10, 10, 11, 12, 13, 16]
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[10].prefix_of == "persistent" and by[11].prefix_of is None and by[12].marked


def test_share_per_source(spark):
    got = {r.source: (r.texts, r.cut_texts) for r in truncation_by_source(spark.createDataFrame(rows(), DOCS)).collect()}
    assert got == {"a": (9, 3), "b": (11, 2), None: (2, 1)}


def test_empty(spark):
    assert truncated_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_answers_do_not_depend_on_corpus_size(spark):
    def corpus(times):
        docs = [(f"{t}-{i}", f"Visit {t} {i}. {FULL}", "a") for t in range(times) for i in range(40)]
        docs += [(f"{t}-cc{i}", f"Visit {t} {i}. Review is planned.\ncc: care team (by internal mail)", "a") for t in range(times) for i in range(3)]
        docs += [(f"{t}-in", f"Visit {t}. Review is planned.\ncc: care team (by internal mail)\nBring the list.", "a") for t in range(times)]
        docs += [(f"{t}-item", f"Visit {t}. Stop:\n- Ramipril 5 mg\n- Losartan 5 mg at bedtime\nReview is planned.", "a") for t in range(times)]
        # Cut in an item after a word that seldom ends one.
        docs += [(f"{t}-mg", f"Visit {t}. Review is planned.\n- Losartan 5 mg", "a") for t in range(times)]
        rows = truncated_texts(spark.createDataFrame(docs, "doc_id string, text string, source string")).where("cut").collect()
        return {r.doc_id for r in rows}

    for times in (1, 5):
        assert corpus(times) == {f"{t}-mg" for t in range(times)}


def test_every_cut_has_evidence(spark):
    got = {r.doc_id: r for r in truncated_texts(spark.createDataFrame(rows(), DOCS)).collect()}
    assert [list(got[i].evidence) for i in (10, 11, 12, 13, 15, 16)] == [["prefix"], ["phrase"], ["mark", "prefix"], ["mark", "prefix"], [], ["prefix"]]
    assert all(r.cut == bool(r.evidence) for r in got.values())
    # Nothing known about the last token and no mark: no case.
    assert not got[20].cut


def test_words_of_any_length(spark):
    long = "immuno" * 40
    docs = [(1, f"Stain with {long} today.", "a"), (2, f"Stain with {long[:200]}", "a"), (3, f"Stain with {long[:199]}x", "a")]
    got = {r.doc_id: r for r in truncated_texts(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got[2].prefix_of == long and list(got[2].evidence) == ["prefix"]
    assert not got[3].cut
