"""Neighbours in blocks, logical links, batches of records, imports: small fixtures with nulls, ties, repeats and empty tables."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import inference, lifecycle, nearest, records
from palimpsest.sources import transfer


def test_nearest_equals_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    r = np.random.default_rng(3)
    x = r.standard_normal((150, 8)).round(1)
    x[10] = x[11] = x[12]
    rows = [(f"i{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)] + [("zero", [0.0] * 8), ("short", [1.0]), ("none", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {}
    for row in nearest.nearest(df.filter("id < 'i020'"), df, 4, 8).collect():
        got.setdefault(row.query, {})[row.rank] = row.id
    y = x.astype(np.float32).astype(np.float64)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    for i in range(20):
        want = np.lexsort((np.arange(150), -s[i]))[:4]
        assert [got[f"i{i:03d}"][k] for k in range(1, 5)] == [f"i{j:03d}" for j in want]
    assert nearest.nearest(df.limit(0), df, 3, 8).count() == 0
    assert nearest.nearest(df, df.limit(0), 3, 8).count() == 0


def test_logical_links_of_papers(spark):
    meta = lambda **k: json.dumps(k)
    rows = [
        ("p1", "Paper", meta(category="nlp", domain="ai")), ("p2", "paper", meta(category="nlp")), ("p3", "Paper", meta(category="cv", domain="ai")), ("c1", "Venue", meta(parent_id="p1")),
        ("a1", "Person", meta(category="cv")), ("n1", None, None),
    ]
    e = spark.createDataFrame(rows, "id string, type string, metadata string")
    edges = spark.createDataFrame([("p1", "a1", 1.0)], "src string, dst string, weight double")
    start = spark.createDataFrame([("p1",)], "id string")
    got = {(r.to_id, r.relation_type): r.confidence for r in inference.logical_links(e, edges, start).collect()}
    assert got == {
        ("p2", "same_category"): 0.8, ("p2", "same_type"): 0.7, ("p3", "same_type"): 0.7, ("p3", "contextual"): 0.75, ("c1", "hierarchical"): 0.9, ("p3", "transitive_logical"): 0.6,
    }
    assert inference.logical_links(e, edges, start.limit(0)).count() == 0


def test_logical_link_counts_are_those_of_the_edges(spark):
    pick = random.Random(5)
    some = lambda *values: pick.choice([*values, None])
    rows = []
    for i in range(60):
        data = {"category": some("a", "b", "c"), "domain": some("x", "y"), "parent_id": some(f"n{pick.randrange(60)}", f"n{i}")}
        rows.append((f"n{i}", some("Note", "note", "Person", "Task"), json.dumps({k: v for k, v in data.items() if v})))
    e = spark.createDataFrame(rows, "id string, type string, metadata string")
    ends = [(f"n{pick.randrange(60)}", f"n{pick.randrange(63)}") for _ in range(150)] + [("n1", "n1")]
    edges = spark.createDataFrame(sorted(set(ends)), "src string, dst string")
    start = e.filter("id < 'n4'").select("id")
    n = Counter((r.from_id, r.relation_type, r.confidence) for r in inference.logical_links(e, edges, start).collect())
    got = inference.logical_link_counts(e, edges, start).collect()
    assert {(r.from_id, r.relation_type, r.confidence): r.n_edges for r in got} == dict(n)
    assert len(got) == len(n)


def test_names_of_any_length_co_occur(spark):
    e = spark.createDataFrame([("x", "Al"), ("y", "One Two Three Four Five Six"), ("z", " "), ("w", None), ("v", "two three")], "id string, name string")
    o = spark.createDataFrame([("1", "a", "With AL and one two three four five six."), ("2", "x", "al two. three"), ("3", None, "al"), ("4", "b", None)], "id string, entity_id string, text string")
    got = {(r.from_id, r.to_id) for r in inference.co_occurrence(e, o).collect()}
    assert got == {("a", "x"), ("a", "y"), ("a", "v"), ("x", "v")}


@pytest.fixture
def log(spark):
    rows = [("e1", "2024-01-01", True, "Ann Lee", "Person", "{}"), ("e2", "2024-01-01", True, "Acme", "Firm", None), ("e3", "2024-01-01", True, "Gone", "Firm", None), ("e3", "2024-02-01", False, "Gone", "Firm", None)]
    df = spark.createDataFrame(rows, "id string, valid_from string, asserted boolean, name string, type string, metadata string")
    return df.withColumn("valid_from", F.col("valid_from").cast("timestamp"))


def test_new_entities_are_checked(spark, log):
    rows = [
        ("n1", " ann lee ", "Person", None), ("n2", "Bo", "Person", None), ("n3", "BO", "Person", None), ("n4", " ", "x", None), ("n5", None, "x", None), ("n6", "Cy", None, None),
        ("n7", "Di", "x", '{"active":true,"archived":true}'), ("n8", "Gone", "Firm", None),
    ]
    b = spark.createDataFrame(rows, "id string, name string, type string, metadata string")
    got = {r.id: (r.outcome, r.entity_id) for r in records.create_entities(log, b).collect()}
    assert got == {
        "n1": ("exists", "e1"), "n2": ("created", "n2"), "n3": ("exists", "n2"), "n4": ("blank", None), "n5": ("blank", None), "n6": ("blank", None), "n7": ("conflict", None), "n8": ("created", "n8"),
    }
    after = records.accepted(log, b, records.create_entities(log, b), ["id"], ["created"], "2024-03-01")
    assert after.count() == log.count() + 2
    assert records.create_entities(log, b.limit(0)).count() == 0


def test_new_notes_are_checked(spark, log):
    o = spark.createDataFrame([("o1", "e1", "hello"), ("o2", "e2", "hello")], "id string, entity_id string, text string")
    o = o.withColumn("valid_from", F.lit("2024-01-01").cast("timestamp")).withColumn("asserted", F.lit(True))
    rows = [("b1", "e1", None, "hello"), ("b2", None, "ANN LEE", "new"), ("b3", None, "ann lee", "new"), ("b4", None, "Nobody", "x"), ("b5", "e3", None, "x"), ("b6", "e2", None, "  "), ("b7", None, None, None)]
    b = spark.createDataFrame(rows, "id string, entity_id string, entity_name string, text string")
    got = {r.id: (r.outcome, r.same_as) for r in records.add_notes(log, o, b).collect()}
    assert got == {
        "b1": ("duplicate", "o1"), "b2": ("added", None), "b3": ("duplicate", "b2"), "b4": ("new_entity", None), "b5": ("no_entity", None), "b6": ("blank", None), "b7": ("no_entity", None),
    }


def test_new_relations_are_checked(spark, log):
    r = spark.createDataFrame([("e1", "e2", "knows")], "from_id string, to_id string, relation_type string").withColumn("valid_from", F.lit("2024-01-01").cast("timestamp")).withColumn("asserted", F.lit(True))
    b = spark.createDataFrame([("e1", "e1", "k"), ("e1", "e2", "knows"), ("e2", "e1", "knows"), ("e2", "e1", "knows"), ("e1", "e3", "k"), (None, "e1", "k")], "from_id string, to_id string, relation_type string")
    got = {(x.from_id, x.to_id): x.outcome for x in records.create_relations(log, r, b).collect()}
    assert got == {("e1", "e1"): "self_loop", ("e1", "e2"): "new_version", ("e2", "e1"): "created", ("e1", "e3"): "no_entity", (None, "e1"): "no_entity"}


def test_imports_of_other_memories(spark):
    lines = ['{"user_id":"u","memory":"likes tea"}', '{"user_id":"u","memory":"likes tea"}', '{"memory":"x","metadata":{"a":1}}', "not json", '{"user_id":"v"}', None]
    df = spark.createDataFrame([(x,) for x in lines], "record string")
    got = {(r.kind, r.name or r.entity_name, r.text) for r in transfer.user_memories(df).collect()}
    assert got == {("entity", "u", None), ("entity", "Imported User", None), ("observation", "u", "likes tea"), ("observation", "Imported User", "x")}
    agent = json.dumps({"agent_name": "a", "archival_memory": [{"content": "one"}, {"text": "two"}, "three"], "recall_memory": ["four"]})
    found = transfer.agent_memory(spark.createDataFrame([(agent,), ("{}",)], "record string"))
    assert {r.text for r in found.filter("kind = 'observation'").collect()} == {"one", "two", "three", "four"}
    assert {r.name for r in found.filter("kind = 'entity'").collect()} == {"a", "Agent"}


def test_export_comes_back(spark):
    e = spark.createDataFrame([("1", 'A "quoted"\nname', "T", '{"k":1}'), ("2", None, None, None)], "id string, name string, type string, metadata string").withColumn("valid_from", F.lit("2024-01-02 03:04:05.000006").cast("timestamp"))
    lines = transfer.export_records({"entity": e})
    back = transfer.import_records(lines, "entity", e.limit(0), ["id"])
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in e.select(back.columns).collect()}
    assert transfer.import_records(lines, "entity", e.limit(1), ["id"]).count() == 1
    with pytest.raises(ValueError, match="strategy"):
        transfer.import_records(lines, "entity", e, ["id"], "other")


@pytest.mark.parametrize(("text", "score"), [("The weather is nice today", 0.6), ("CRITICAL: Never forget", 1.0), ("Interesting discovery", 0.78), ("Note: The meeting", 0.4), ("nothing at all", 0.0), ("", 0.0)])
def test_salience(spark, text, score):
    df = spark.createDataFrame([("a", text)], "id string, text string")
    assert lifecycle.salience(df).first().salience == pytest.approx(score)


def test_tags_are_read_from_texts(spark):
    df = spark.createDataFrame([("#Tea and topic: Leaves",), ("#tea",), (None,), ("no tag",)], "text string")
    assert {r.tag: r.n for r in lifecycle.tags(df).collect()} == {"#tea": 2, "topic:leaves": 1}


def test_co_occurrence_lets_only_likely_sequences_leave_the_notes(spark):
    e = spark.createDataFrame([(f"e{i}", f"common word {i}") for i in range(300)] + [("long", " ".join(["common word"] * 20))], "id string, name string")
    names = e.select("id", inference.tx.words(F.col("name")).alias("w"))
    bloom = inference.Bloom(names.select(F.array_join("w", " ").alias("phrase"), F.size("w").alias("k"), inference._hashes("w").alias("h")))
    o = spark.createDataFrame([(f"o{i}", "x", f"a common word {i} of a common word and another") for i in range(2000)], "id string, entity_id string, text string")
    notes = o.select("entity_id", inference.tx.words(F.col("text")).alias("w")).select("entity_id", "w", inference._hashes("w").alias("h"))
    out = {r.phrase for r in notes.mapInArrow(bloom.sequences, "from_id string, phrase string").collect()}
    assert {f"common word {i}" for i in range(300)} <= out and len(out) < 340
    assert {(r.from_id, r.to_id) for r in inference.co_occurrence(e, o).collect()} == {("x", f"e{i}") for i in range(300)}


def test_nearest_of_a_least_similarity_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((40, 8)), 5, axis=0) + 0.4 * rng.standard_normal((200, 8))
    x[7] = x[3]
    rows = spark.createDataFrame([(f"n{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(0, 200, 3):
        s = np.round(u @ u[i], 6)
        best = sorted((-s[j], f"n{j:03}") for j in range(200) if j != i and s[j] >= 0.7)[:5]
        want |= {(f"n{i:03}", name, rank) for rank, (_, name) in enumerate(best, 1)}
    some = rows.filter(F.substring("id", 2, 3).cast("int") % 3 == 0)
    assert {(r.query, r.id, r["rank"]) for r in nearest.nearest(some, rows, 5, 8, least=0.7).collect()} == want
