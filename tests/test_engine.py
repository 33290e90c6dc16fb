import json
import os
import shutil

import pytest

from chartloom.engine import Engine
from chartloom.operators import evaluation, index, jobs, ranking
from chartloom.plans import retrieval
from chartloom.sources import files
from chartloom.streaming import jobs as streams

DATA = "/root/testdata/sf0.001"
EVENT = "job_id string, document_id string, status string, attempts int, updated_at double, created_at double"
EVENTS = [
    ("a", "d", "queued", 0, 1.0, 1.0), ("a", "d", "running", 1, 2.0, 1.0), ("a", "d", "succeeded", 1, 3.0, 1.0), ("a", "d", "running", 1, 2.0, 1.0),
    ("b", "d", "queued", 0, 2.0, 2.0), ("b", "d", "dead", 3, 9.0, 2.0), (None, "d", "queued", 0, 1.0, 1.0), ("c", None, None, None, None, None),
]


def test_jobs(spark):
    df = spark.createDataFrame(EVENTS, EVENT)
    assert {r.job_id: r.status for r in jobs.latest_jobs(df).collect()} == {"a": "succeeded", "b": "dead", "c": None}
    assert {r.job_id: r.history for r in jobs.job_histories(df).collect()} == {"a": "queued>running>succeeded", "b": "queued>dead", "c": "?"}
    assert {r.status: r.jobs for r in jobs.state_counts(df).collect()} == {"succeeded": 1, "dead": 1, None: 1}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, EVENT)
    for i, part in enumerate(df.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.latest_jobs_stream(streams.job_events(spark, str(tmp_path / "in"), df.schema, 1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest_jobs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("latest_jobs").collect()} == {tuple(r) for r in jobs.latest_jobs(df).collect()}


def test_update_stream_is_read_back(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, EVENT)
    for i in range(2):
        df.where("job_id <> 'a' or status <> 'succeeded'" if i == 0 else "job_id = 'a'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.latest_jobs_stream(streams.job_events(spark, str(tmp_path / "in"), df.schema, 1))
        streams.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "update").awaitTermination(120)
    assert {r.job_id: r.status for r in streams.read_versions(spark, str(tmp_path / "out")).collect()} == {"a": "succeeded", "b": "dead", "c": None}


def test_windowed_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"j{i}", "d", "queued", 0, 3600.0 * i, 0.0) for i in range(60)], EVENT)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    counts = streams.windowed_counts(streams.job_events(spark, str(tmp_path / "in"), df.schema))
    streams.run_once(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert rows and all(r.events == 1 for r in rows)


def test_sources(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes("eins\fzwei".encode())
    (tmp_path / "f" / "b.txt").write_bytes(b"\xff\xfe")
    found = files.files(spark, str(tmp_path / "f"), "*.txt")
    assert {len(r.sha256) for r in found.collect()} == {64}
    pages = {(os.path.basename(r.path), r.page_number): r.text for r in files.extract(found, files.plain_text_pages).collect()}
    assert pages == {("a.txt", 1): "eins", ("a.txt", 2): "zwei", ("b.txt", 0): None}
    df = spark.createDataFrame([("d", 1, 1.0, 1.0, "t", None, 1, None)], files.PAGE)
    files.write_json_lines(df, str(tmp_path / "pages"))
    assert files.read_json_lines(spark, str(tmp_path / "pages"), files.PAGE).collect() == df.collect()
    (tmp_path / "gold.json").write_text(json.dumps([{"query_id": "Q1", "query": "why?"}]))
    assert files.read_gold(spark, str(tmp_path / "gold.json")).first().query_id == "Q1"
    postings = spark.createDataFrame([("icd", "I10", 1), ("drug", "x", 2)], "kind string, value string, doc_id long")
    files.write_postings(postings, str(tmp_path / "p"))
    assert [r.value for r in files.read_postings(spark, str(tmp_path / "p"), "icd").collect()] == ["I10"]
    files.write_report(postings, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    assert files.read_settings(str(tmp_path / "none.json")) == {}
    (tmp_path / "enc.json").write_text(json.dumps([{"encounter_id": "E1", "start_page": 2}]))
    assert [(r.encounter_id, r.start_page, r.provider) for r in files.read_records(spark, str(tmp_path / "enc.json"), files.ENCOUNTER).collect()] == [("E1", 2, None)]
    assert files.read_records(spark, str(tmp_path / "none.json"), files.ENCOUNTER).count() == 0
    (tmp_path / "lex.json").write_text(json.dumps({"aliases": {"Jardiance": ["empagliflozin"], "x": None}}))
    assert [tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "lex.json")).collect()] == [("Jardiance", "empagliflozin")]
    for record in (files.BOX, files.BLOCK, files.REPORT, files.ENCOUNTER, files.SECTION, files.CHUNK, files.RESULT):
        assert spark.createDataFrame([], record).columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_stored_index(spark, tmp_path):
    built = index.stored(spark, DATA)
    assert index.stored(spark, DATA) is built
    index.save(built, str(tmp_path / "index"))
    again = index.load(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "why was losartan started?")], "query_id long, text string")
    first, second = ([tuple(r) for r in Engine(spark, DATA, i).retrieve(queries).orderBy("rank").collect()] for i in (built, again))
    assert first == second and first
    # A cleaned folder is noticed.
    shutil.rmtree(os.path.dirname(built.terms.inputFiles()[0].removeprefix("file://")))
    assert index.stored(spark, DATA) is not built


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_engine(spark):
    engine = Engine(spark, DATA)
    queries = spark.createDataFrame([(1, "why was losartan started?"), (2, "vital signs and weight"), (3, "zzz"), (4, None)], "query_id long, text string")
    found = engine.retrieve(queries).collect()
    assert {r.query_id for r in found} >= {1, 2} and all(1 <= r.rank <= 10 for r in found)
    answered = {r.query_id: r for r in engine.answer(queries).collect()}
    assert set(answered) == {1, 2, 3, 4} and answered[1].invalid == [] and answered[1].used[0] == "E1"
    assert answered[3].answer == "The evidence is insufficient."
    gold = spark.createDataFrame([(1, found[0].id)], "query_id long, id string")
    assert engine.evaluate(queries, gold).first().queries == 4
    assert engine.status().count() >= 1 and engine.readability().count() >= 1


def test_a_channel_builds_only_the_tables_it_reads(spark):
    engine = Engine(spark, DATA, index.build(spark, DATA))
    plans = engine.plan(spark.createDataFrame([(1, "why was metformin started"), (2, "why was metformin started")], "query_id long, text string"))
    rows = engine.hits("structured", plans).collect()
    assert len(engine.index.built()) == 2 and sorted((r.id, r.rank) for r in rows if r.query_id == 1) == sorted((r.id, r.rank) for r in rows if r.query_id == 2) != []


def test_configurations_share_the_texts_they_read(spark):
    run = retrieval.Inputs(spark, DATA)
    configs = list(dict.fromkeys(c for c, _ in retrieval.CONFIGS.values()))
    apart = [sorted(map(tuple, run.results(c).collect())) for c in configs[1:3]]
    run.prepare(*configs)
    assert run._features.count() == run._features.select("query_id", "id").distinct().count() > 0
    assert apart == [sorted(map(tuple, run.results(c).collect())) for c in configs[1:3]]


@pytest.mark.parametrize("name", ["h02_prompts", "i11_page_hits", "h04_answers", "i13_quality"])
def test_equal_texts_are_ranked_once(spark, monkeypatch, name):
    run, seen, features = retrieval.Inputs(spark, DATA), [], ranking.pair_features
    asked = [(1, "why was metformin started", "d", 1), (2, "vital signs and weight", "d", 1), (3, "why was metformin started", "d", 2), (4, "", "d", None)]
    run.queries = spark.createDataFrame(asked, "query_id long, text string, document_id string, page int")
    monkeypatch.setattr(retrieval, "Inputs", lambda *_: run)
    monkeypatch.setattr(ranking, "pair_features", lambda pairs, *rest: seen.append(pairs.select("query_id").distinct().count()) or features(pairs, *rest))
    rows = getattr(retrieval, name)(spark, DATA).collect()
    assert seen == [2]
    if name[0] == "i":
        assert [r.queries for r in rows] == [4]
        return
    digest = {r.query_id: r.digest for r in rows}
    assert len(rows) == len(digest) == (4 if name == "h04_answers" else 3) and digest[1] == digest[3] != digest[2]
    results = {i: sorted((r["rank"], r.id) for r in run.results().collect() if r.query_id == i) for i in (1, 2, 3)}
    assert results[1] == results[3] != results[2] and results == {
        i: sorted((r["rank"], r.id) for r in ranking.final_ranking(run.fused(), run.items, run.plans).collect() if r.query_id == i) for i in (1, 2, 3)
    }


def test_quality_ranks_only_texts_with_a_gold_candidate(spark, monkeypatch):
    run, planned, features = retrieval.Inputs(spark, DATA), [], ranking.pair_features
    text = "why was metformin started"
    run.queries = spark.createDataFrame([(1, text, "d", 1)], "query_id long, text string, document_id string, page int")
    third = run.results().where("rank = 3").join(run.items.select("id", "document_id", "page_start"), "id").first()
    other = retrieval.Inputs(spark, DATA)
    asked = [(1, text, third.document_id, third.page_start), (2, "vital signs and weight", "d", 1), (3, text, "d", 2), (4, "", "d", None)]
    other.queries = spark.createDataFrame(asked, "query_id long, text string, document_id string, page int")
    expected = evaluation.quality(evaluation.first_match(other.results(), other.gold(), other.queries)).first()
    assert expected.queries == 4 and expected.missed == 3 and expected.hit_3 == 0.25
    monkeypatch.setattr(retrieval, "Inputs", lambda *_: other)
    monkeypatch.setattr(ranking, "pair_features", lambda pairs, items, plans, *rest: planned.append([r.text for r in plans.collect()]) or features(pairs, items, plans, *rest))
    assert retrieval.i13_quality(spark, DATA).first() == expected and planned == [[text]]
