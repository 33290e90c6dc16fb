import math

import pytest

from chartloom.llm.mixing import dual_variables, mixture, mixture_shares

DOC = "doc_id long, text string, source string, copies int"
TARGET = "source string, target_share double, max_repeats int, tokens int"
LENGTHS = "source string, tokens int, n long, share double, cap double"


def given(lengths, cap, mean, dual):
    return sum(n * t * (cap if dual is None else min(cap, math.exp(min(700, dual * t / mean)))) for t, n in lengths)


@pytest.mark.parametrize("total", [None, 2_000])
def test_newton_meets_the_shares_by_tilting_documents(spark, total):
    sources = {"few": ([(2, 30), (40, 5)], 0.2, 4.0), "many": ([(1, 500), (10, 100), (400, 9)], 0.5, 1.0), "mid": ([(7, 70), (900, 1)], 0.3, 3.0)}
    rows = [(s, t, n, share, cap) for s, (ls, share, cap) in sources.items() for t, n in ls]
    got = {r.source: r for r in dual_variables(spark.createDataFrame(rows, LENGTHS), total).collect()}
    whole = total or min(cap * sum(t * n for t, n in ls) / share for ls, share, cap in sources.values())
    for s, (ls, share, cap) in sources.items():
        r, tokens = got[s], sum(t * n for t, n in ls)
        assert math.isclose(r.mean, tokens / sum(n for _, n in ls))
        want = min(share * whole, cap * tokens)
        assert math.isclose(r.goal, want) and math.isclose(given(ls, cap, r.mean, r.dual), want, rel_tol=1e-6)
        if r.dual is not None:
            # One constant rate would miss the optimum: the documents of a source differ by their length.
            assert abs(r.dual - math.log(want / tokens)) > 1e-3
    assert (got["few"].dual is None) == (total is None)  # the scarcest source is used to its cap


def test_mix(spark):
    words = "one two three four five six seven eight".split()
    docs = [(i, " ".join(words[: 1 + i % 8]), "big", 9) for i in range(4000)] + [(5000 + i, "one two three", "small", 9) for i in range(100)]
    docs += [(9000, None, "big", 1), (9001, "", "small", 1), (9002, "x", None, 1), (9003, "x", "other", 1), (5000, "one two three", "small", 9)]
    targets = spark.createDataFrame([("big", 0.7, 1, 0), ("small", 0.2, 3, 0), ("none", 0.1, 2, 0)], TARGET)
    df = spark.createDataFrame(docs, DOC)
    rows = {r.source: r for r in mixture_shares(df, targets).collect()}
    assert abs(rows["big"].actual_share - 0.7 / 0.9) < 0.01 and abs(rows["small"].actual_share - 0.2 / 0.9) < 0.01
    assert rows["none"].actual_share == 0 and rows["none"].docs == 0 and set(rows) == {"big", "small", "none"}
    copies = mixture(df, targets).collect()
    assert all(0 <= r.copies <= (1 if r.source == "big" else 3) for r in copies) and len(copies) == 4000 + 100 + 3
    assert {r.copies for r in copies if r.doc_id in (9000, 9001)} == {0}


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOC), spark.createDataFrame([("a", 1.0, 2, 0)], TARGET)
    assert [r.actual_share for r in mixture_shares(docs, targets).collect()] == [0.0]
    assert mixture(docs, targets.limit(0)).count() == 0
