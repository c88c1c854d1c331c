"""Pairs of notes of one entity and islands: brute force on small fixtures with nulls, ties, repeats, a hot entity and empty tables."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import nearest, versioned, within
from palimpsest.operators.components import connected_components

SCHEMA = "id string, valid_from timestamp, entity_id string, text string, embedding array<float>"
START = datetime(2025, 1, 1)


@pytest.fixture
def notes(spark):
    r = np.random.default_rng(5)
    says = ["The job is running", "It stopped and was closed", "updated: now confirmed", "denied", "plain words", None, "", "grew, then fell", "latest revised as of today"]
    rows = []
    for i in range(60):
        v = r.standard_normal(4).round(1)
        rows.append((f"n{i:02d}", START + timedelta(days=int(r.integers(0, 500))), "hot" if i % 3 else f"e{i % 5}", says[i % len(says)], [float(x) for x in v]))
    rows += [("z1", START, "hot", "running", None), ("z2", START, "hot", "stopped", [0.0] * 4), ("z3", START, None, "stopped", [1.0] * 4), ("z4", START, " ", "running", [1.0] * 3), ("z5", START, "hot", "stopped", [1.0, None, 2.0, 3.0])]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, asked):
    """Conflicts, one pair after the other."""
    found = {}
    for a in rows:
        for b in rows:
            if not (a.entity_id and a.entity_id.strip()) or a.entity_id != b.entity_id or (a.valid_from, a.id) >= (b.valid_from, b.id) or not (a.id in asked or b.id in asked):
                continue
            if b.valid_from - a.valid_from > timedelta(days=365):
                continue
            good = [x.embedding and len(x.embedding) == 4 and None not in x.embedding and any(x.embedding) for x in (a, b)]
            s = 0.0
            if all(good):
                u, v = (np.array(x.embedding, float) for x in (a, b))
                s = round(float(u @ v / np.linalg.norm(u) / np.linalg.norm(v)), 6)
            p, n = (a.text or "").lower(), (b.text or "").lower()
            marks = [[any(w in t for w in g) for t in (p, n) for g in both] for both in within.CONTRARY]
            said = sum(any(m) for m in marks)
            share = sum((m[0] and m[3]) or (m[1] and m[2]) for m in marks) / said if said else 0
            new = min(sum(w in n for w in within.REPLACING) / 3, 1)
            if s >= 0.85:
                found[a.id, b.id] = ("temporal_redundancy", s)
            elif share > 0.25:
                found[a.id, b.id] = ("semantic_contradiction", round(share, 6))
            elif 0.4 < s < 0.85 and new > 0.6:
                found[a.id, b.id] = ("superseded_fact", round(new, 6))
    return found


def test_conflicts_equal_brute_force_over_blocks(notes, monkeypatch):
    monkeypatch.setattr(within, "BLOCK", 7)
    asked = {f"n{i:02d}" for i in range(0, 60, 4)} | {"z1", "z4"}
    got = within.conflicts(notes, F.col("id").isin(*asked), 4).collect()
    want = brute(notes.collect(), asked)
    assert len(got) == len(want)
    assert {(r.older_id, r.newer_id): (r.conflict_type, pytest.approx(r.confidence, abs=1e-6)) for r in got} == want
    assert {r.conflict_type for r in got} == {"temporal_redundancy", "semantic_contradiction", "superseded_fact"}
    assert all(r.level == ("high" if r.confidence >= 0.8 else "medium" if r.confidence >= 0.5 else "low") for r in got)
    assert within.conflicts(notes, F.lit(False), 4).count() == 0
    assert within.conflicts(notes.limit(0), F.lit(True), 4).count() == 0


def test_resolved_conflicts_leave_the_newer_note_and_a_trace(spark):
    rows = [("a", START, "e", "Job running", [1.0, 0.0]), ("b", START + timedelta(days=1), "e", "Job stopped", [0.0, 1.0]), ("c", START, "f", "Job running", [1.0, 0.0])]
    notes = spark.createDataFrame(rows, SCHEMA)
    found = within.conflicts(notes, F.lit(True), 2)
    log = notes.withColumn("asserted", F.lit(True)).withColumn("metadata", F.lit(None).cast("string"))
    left = versioned.current(within.resolved(log, found, F.lit(START + timedelta(days=9))), ["id"]).collect()
    assert {r.id for r in left if r.id in "abc"} == {"b", "c"}
    (trace,) = [r for r in left if r.id not in "abc"]
    assert trace.entity_id == "e" and trace.text == "[CONFLICT RESOLVED] semantic_contradiction: Observation superseded by newer information (confidence: 100.0%)"
    assert '"superseded_by":"b"' in trace.metadata and '"original_observation":"a"' in trace.metadata


def test_series_at_even_intervals(spark, monkeypatch):
    monkeypatch.setattr(within, "BLOCK", 3)
    rows = [(f"w{i}", START + timedelta(days=7 * i), "e", "weekly", [1.0, 0.05 * i]) for i in range(8)]
    rows += [("x", START + timedelta(days=3), "e", "other", [0.0, 1.0]), ("y", START + timedelta(days=5), "f", "weekly", [1.0, 0.0]), ("old", START - timedelta(days=900), "e", "weekly", [1.0, 0.0])]
    got = within.recurring_series(spark.createDataFrame(rows, SCHEMA), F.col("id").isin("w0", "x", "y", "old"), 2, F.lit(START - timedelta(days=30))).collect()
    assert [(r.id, r.frequency, r.interval_days, r.confidence) for r in got] == [("w0", 8, 7.0, 1.0)]


def test_texts_noted_close_to_each_other(spark, monkeypatch):
    monkeypatch.setattr(within, "BLOCK", 3)
    rows = []
    for i in range(5):
        day = START + timedelta(days=10 * i)
        rows += [(f"a{i}", day, "e", "deploy", [1.0, 0.0]), (f"b{i}", day + timedelta(days=2), "e", "restart", [0.0, 1.0]), (f"c{i}", day + timedelta(days=3), "e", "far", [0.0, 1.0]), (f"d{i}", day, "e", "alike", [1.0, 0.1])]
    rows += [("n", START, "e", None, [0.0, 1.0])]
    got = within.correlated_notes(spark.createDataFrame(rows, SCHEMA), F.col("text") == "deploy", 2, F.lit(START)).collect()
    names = spark.range(1).select(F.md5(F.lit("deploy")).alias("a"), F.md5(F.lit("restart")).alias("b")).first()
    assert [(r.entity_id, {r.text_a, r.text_b}, r.frequency, r.confidence) for r in got] == [("e", {names.a, names.b}, 5, 0.833333)]


def test_islands_are_tied_to_the_rest(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("s", None)]
    of = connected_components(spark.createDataFrame(edges, "src string, dst string"))
    vectors = {"a": [1.0, 0.0], "b": [0.9, 0.1], "x": [1.0, 0.02], "y": [1.0, 0.01], "p": [-1.0, 0.3], "q": None}
    e = spark.createDataFrame(list(vectors.items()), "id string, embedding array<float>")
    got = nearest.island_bridges(of, e, F.lit(True), 2).collect()
    assert [(r.component, r.from_id, r.to_id) for r in got] == [("x", "y", "a")]
    assert nearest.island_bridges(of.limit(0), e, F.lit(True), 2).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(3000).selectExpr("id AS src", "id + 1 AS dst")
    got = connected_components(edges)
    assert got.count() == 3001 and got.filter("component <> 0").count() == 0
