import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptwell.operators import retrieval, sessions
from scriptwell.schemas import COLLECTION

NOW = dt.datetime(2024, 1, 2)


def doc(i, vector, ts=NOW, document=None, **metadata):
    return (str(i), document or f"d{i}", {k: str(v) for k, v in metadata.items()}, vector, ts)


def collection(spark, rows, parts=3):
    return spark.createDataFrame(rows, COLLECTION).repartition(parts)


def now():
    return F.lit(NOW)


def ids(df):
    return [r.id for r in df.orderBy("question_id", "rank").collect()]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    questions = {f"q{i}": v.tolist() for i, v in enumerate(rng.normal(size=(5, 8)))}
    docs = collection(spark, [doc(i, v.tolist()) for i, v in enumerate(vectors)], 7)
    got = {}
    for r in retrieval.search(docs, questions, 6).collect():
        got.setdefault(r.question_id, []).append((r.rank, r.id, r.similarity))
    for name, q in questions.items():
        v = vectors.astype(np.float64)
        s = v @ np.array(q) / np.linalg.norm(v, axis=1) / np.linalg.norm(q)
        best = sorted(range(len(s)), key=lambda i: (-round(s[i], 9), str(i)))[:6]
        assert [(i, d) for i, d, _ in sorted(got[name])] == [
            (n, str(i)) for n, i in enumerate(best, start=1)]
        assert [x for _, _, x in sorted(got[name])] == pytest.approx(
            [round(s[i], 4) for i in best], abs=1e-4)


def test_copies_are_ordered_by_id_and_never_pile_up(spark):
    docs = collection(spark, [doc(i, [1.0, 0.0]) for i in range(300)] + [doc("z", [0.0, 1.0])], 5)
    assert ids(retrieval.search(docs, {"q": [2.0, 0.0]}, 3)) == ["0", "1", "10"]


def test_identical_orthogonal_zero_and_bad_vectors(spark):
    docs = collection(spark, [
        doc("same", [1.0, 1.0]), doc("right", [1.0, -1.0]), doc("zero", [0.0, 0.0]),
        doc("short", [1.0]), doc("none", None), doc("hole", [1.0, None])])
    rows = {r.id: r.similarity for r in retrieval.search(docs, {"q": [3.0, 3.0]}, 9).collect()}
    assert rows == {"same": 1.0, "right": 0.0, "zero": 0.0}


def test_where_and_threshold(spark):
    docs = collection(spark, [doc(1, [1.0, 0.0], kind="a"), doc(2, [0.9, 0.1], kind="b"),
                              doc(3, [0.2, 1.0], kind="a")])
    q = {"q": [1.0, 0.0]}
    assert ids(retrieval.search(docs, q, 5, {"kind": "a"})) == ["1", "3"]
    assert ids(retrieval.search(docs, q, 5, {"kind": "a", "x": "1"})) == []
    assert ids(retrieval.retrieve_knowledge(docs, q)) == ["1", "2"]


def test_more_questions_than_one_pass(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUESTIONS_PER_PASS", 2)
    docs = collection(spark, [doc(1, [1.0, 0.0]), doc(2, [0.0, 1.0])])
    questions = {f"q{i}": [1.0, float(i)] for i in range(5)}
    assert retrieval.search(docs, questions, 1).count() == 5


def test_upsert_last_write_wins(spark):
    old = collection(spark, [doc(1, [1.0], document="old"), doc(2, [1.0])])
    new = collection(spark, [doc(1, [2.0], NOW + dt.timedelta(1), "new"), doc(3, [1.0])])
    rows = {r.id: r.document for r in retrieval.upsert(old, new).collect()}
    assert rows == {"1": "new", "2": "d2", "3": "d3"}
    assert retrieval.count(old).first()[0] == 2
    late = collection(spark, [doc(2, [3.0], NOW - dt.timedelta(1), "late"),
                              doc(2, [3.0], NOW - dt.timedelta(2), "later")])
    rows = {r.id: r.document for r in retrieval.upsert(old, late).collect()}
    assert rows == {"1": "old", "2": "late"}


def test_reset(spark, folder):
    collection(spark, [doc(1, [1.0])]).write.parquet(f"{folder}/c")
    retrieval.reset_collection(spark, f"{folder}/c")
    assert spark.read.parquet(f"{folder}/c").count() == 0


def test_cache_threshold_and_age(spark):
    def entry(i, vector, age):
        return doc(i, vector, NOW - dt.timedelta(seconds=age), sql=f"S{i}", summary="s",
                   row_count=3)
    near, far = [0.93, float(np.sqrt(1 - 0.93**2))], [0.92, float(np.sqrt(1 - 0.92**2))]
    ask = {"q": [1.0, 0.0]}
    look = lambda *e: [r.generated_sql for r in retrieval.cache_lookup(
        collection(spark, list(e)), ask, now()).collect()]
    assert look(entry(1, near, 900)) == ["S1"]
    assert look(entry(1, far, 10)) == []
    assert look(entry(1, near, 901)) == []
    # The best hit decides even though an older second one would still do.
    assert look(entry(1, [1.0, 0.0], 901), entry(2, near, 10)) == []


def test_cache_write_and_evict(spark, folder):
    asked = spark.createDataFrame([("q?", [1.0, 0.0], "SELECT 1", "one", 1)],
                                  "q string, e array<float>, s string, t string, n long")
    entry = retrieval.cache_entry(asked, "q", "e", "s", "t", "n", now())
    again = retrieval.cache_entry(asked, "q", "e", "s", "t", "n", now())
    assert entry.first().id == again.first().id and entry.first().id.startswith("cache_")
    assert retrieval.history_entry(asked, "q", "e", "s", "n", now()).first().metadata == {
        "question": "q?", "sql": "SELECT 1", "row_count": "1"}
    old = entry.withColumn("ts", F.lit(NOW - dt.timedelta(seconds=901)).cast("timestamp_ntz"))
    both = entry.unionByName(old)
    assert retrieval.evict_expired_entries(both, now(), f"{folder}/kept") == 1
    assert spark.read.parquet(f"{folder}/kept").count() == 1


def test_bundle(spark):
    know = collection(spark, [doc(1, [1.0, 0.0]), doc(2, [0.9, 0.1])])
    schemas = collection(spark, [doc(3, [1.0, 0.1], table="T")])
    past = collection(spark, [doc(4, [0.0, 1.0], question="old?", sql="S")])
    rows = {r.question_id: r for r in retrieval.context_bundle(
        {"a": [1.0, 0.0], "b": [0.0, 1.0]}, know, schemas, past).collect()}
    assert rows["a"].domain_knowledge == ["d1", "d2"]
    assert rows["a"].relevant_tables[0].table == "T" and rows["a"].query_examples == 0
    assert rows["b"].similar_past_queries[0].sql == "S" and rows["b"].knowledge_chunks == 0


def turns(spark, n=9, session="s", start=NOW):
    return [(session, i, "user" if i % 2 == 0 else "assistant", f"t{i}",
             start + dt.timedelta(seconds=i)) for i in range(n)]


TURNS = "session_id string, turn long, role string, content string, ts timestamp_ntz"


def test_newest_turns(spark):
    df = spark.createDataFrame(turns(spark) + turns(spark, 2, "u"), TURNS)
    kept = sessions.get_history(df)
    assert sorted(r.turn for r in kept.filter("session_id = 's'").collect()) == list(range(1, 9))
    row = {r.session_id: r.turns for r in sessions.context_turns(df).collect()}
    assert [t.turn for t in row["s"]] == [5, 6, 7, 8] and len(row["u"]) == 2


def test_idle_sessions(spark):
    rows = turns(spark, 1, "old", NOW - dt.timedelta(seconds=3601)) + turns(
        spark, 1, "edge", NOW - dt.timedelta(seconds=3600))
    df = spark.createDataFrame(rows, TURNS)
    assert [r.session_id for r in sessions.idle_sessions(df, now()).collect()] == ["old"]
    assert [r.session_id for r in sessions.evict_idle(df, now()).collect()] == ["edge"]


def test_bad_vectors_are_told_and_do_not_stop_a_search(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [nan, 1.0]), ("c", [inf, 1.0]), ("d", [1.0]), ("e", None),
            ("f", [None, 1.0]), ("g", [0.0, 1.0])]
    docs = spark.createDataFrame(
        [(i, i, {}, v, None) for i, v in rows], COLLECTION)
    found = retrieval.search(docs, {"q": [1.0, 0.0]}, 5).collect()
    assert [r.id for r in sorted(found, key=lambda r: r["rank"])] == ["a", "g"]
    told = {r.id: r.reason for r in retrieval.rejected_vectors(docs, 2).collect()}
    assert told == {"b": "not finite", "c": "not finite", "d": "length", "e": "null", "f": "null"}


def test_questions_as_a_table_in_blocks(spark, monkeypatch):
    """Blocks, running best rows over many batches, ties by id, and questions that can't be asked."""
    monkeypatch.setattr(retrieval, "QUESTIONS_PER_PASS", 4)
    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, size=(300, 3)).astype(float)
    docs = collection(spark, [doc(i, v.tolist()) for i, v in enumerate(vectors)], 5)
    asked = {f"q{i}": vectors[i].tolist() for i in range(0, 40, 3)}
    rows = [*asked.items(), ("null", None), ("hole", [None, 1.0, 0.0]), ("nan", [float("nan")] * 3),
            ("short", [1.0])]
    table = spark.createDataFrame(rows, "question_id string, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = retrieval.search(docs, table, 6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = retrieval.search(docs, asked, 6).collect()
    key = lambda r: (r.question_id, r["rank"], r.id, r.similarity)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 6 * len(asked)
    unit = lambda v: v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-30)
    for name, q in asked.items():
        s = np.round(unit(vectors) @ unit(np.array(q)), 9)
        best = sorted(range(300), key=lambda i: (-s[i], str(i)))[:6]
        assert [r[2] for r in sorted(map(key, got)) if r[0] == name] == [str(i) for i in best]


def test_bundle_of_a_question_table_scores_once(spark):
    docs = collection(spark, [doc(1, [1.0, 0.0], table="T"), doc(2, [0.0, 1.0])])
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("none", None)],
                                  "question_id string, embedding array<double>")
    bundle = retrieval.context_bundle(asked, docs, docs, docs)
    rows = {r.question_id: r for r in bundle.collect()}
    assert (rows["a"].knowledge_chunks, rows["a"].query_examples) == (1, 1)
    assert rows["none"].domain_knowledge == [] and rows["none"].schema_chunks == 0
    plan = bundle._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
