"""Versioned relations: as-of reads, ties, retraction, merge, references."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import integrity, versioned

LOG = "id string, valid_from timestamp, asserted boolean, name string, extra string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def test_assert_then_retract(spark):
    log = spark.createDataFrame([("a", at(1000), True, "A", None), ("a", at(2000), False, "A", None)], LOG)
    assert versioned.as_of(log, ["id"], at(1500)).count() == 1
    assert versioned.as_of(log, ["id"], at(2500)).count() == 0
    assert versioned.current(log, ["id"]).count() == 0
    assert versioned.history(log, ["id"]).count() == 2


def test_retraction_wins_at_equal_times_and_repeats_count_once(spark):
    log = spark.createDataFrame([("a", at(1), True, "A", None), ("a", at(1), False, "A", None), ("b", at(1), True, "B", "x"), ("b", at(1), True, "B", "x"), ("c", None, True, "C", None)], LOG)
    assert [r.id for r in versioned.current(log, ["id"]).collect()] == ["b"]
    assert versioned.history(log, ["id"]).count() == 4


def test_empty_table(spark):
    log = spark.createDataFrame([], LOG)
    assert versioned.current(log, ["id"]).count() == 0
    assert versioned.retract(log, ["id"], log, F.lit(at(5))).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5), st.booleans()), max_size=12), when=st.integers(0, 6))
def test_as_of_equals_brute_force(spark, rows, when):
    log = spark.createDataFrame([(i, at(t), a, "n", None) for i, t, a in rows], LOG)
    want = set()
    for key in {i for i, *_ in rows}:
        seen = sorted((t, not a) for i, t, a in rows if i == key and t <= when)
        if seen and not seen[-1][1]:
            want.add(key)
    assert {r.id for r in versioned.as_of(log, ["id"], at(when)).collect()} == want


@pytest.mark.parametrize(("text", "want"), [(None, None), ("NOW", None), ("1704067200000", dt.datetime(2024, 1, 1)), ("1704067200000000", dt.datetime(2024, 1, 1)), ("2024-01-01T00:00:00Z", dt.datetime(2024, 1, 1))])
def test_parse_as_of(text, want):
    assert versioned.parse_as_of(text) == want


def test_parse_as_of_refuses_nonsense():
    with pytest.raises(ValueError, match="as_of"):
        versioned.parse_as_of("yesterday")


def test_merge_metadata(spark):
    df = spark.createDataFrame([('{"version":"1","a":"x"}', '{"version":"2","b":"y"}'), (None, '{"b":"y"}'), (None, None)], "old string, new string")
    got = [r[0] for r in df.select(F.to_json(F.from_json(versioned.merge_metadata(F.col("old"), F.col("new")), "version string, a string, b string"))).collect()]
    assert got == ['{"version":"2","a":"x","b":"y"}', '{"b":"y"}', "{}"]


def test_entity_references_kinds_and_spellings(spark):
    e = spark.createDataFrame([("Live", at(10), True), ("gone", at(1), True), ("gone", at(5), False), ("late", at(100), True)], "id string, valid_from timestamp, asserted boolean")
    o = spark.createDataFrame(
        [("o1", at(20), True, " LIVE "), ("o2", at(20), True, "Gone"), ("o3", at(20), True, "late"), ("o4", at(20), True, "never"), ("o5", at(20), True, None), ("o6", at(20), True, "  "), ("o7", at(20), True, "never"), ("o7", at(20), True, "never")],
        "id string, valid_from timestamp, asserted boolean, entity_id string",
    )
    r = spark.createDataFrame([("live", "never", "knows", at(30), True)], "from_id string, to_id string, relation_type string, valid_from timestamp, asserted boolean")
    got = {(x.src_key, x.ref_field, x.kind) for x in integrity.memory_orphans(e, o, r).collect()}
    assert got == {("o2", "entity_id", "deleted"), ("o3", "entity_id", "late"), ("o4", "entity_id", "missing"), ("o7", "entity_id", "missing"), ("live|never|knows", "to_id", "missing")}
    assert integrity.memory_orphans(e.limit(0), o.limit(0), r.limit(0)).count() == 0


def cascade(tables, keys, **more):
    """``orphan_cascade`` over tables (key, columns) without versions."""
    children = {t: df.withColumn("valid_from", F.lit(at(20))) for t, df in tables.items()}
    return integrity.orphan_cascade(children, {t: integrity.plain_state(df, "key") for t, df in tables.items()}, keys, **more)


def test_orphan_cascade_direct_inherited_and_cyclic(spark):
    a = spark.createDataFrame([("a1", "b1"), ("a2", "b9"), ("a3", None)], "key string, b string")
    b = spark.createDataFrame([("b1", "c9"), ("b2", "c1")], "key string, c string")
    c = spark.createDataFrame([("c1", "c2"), ("c2", "c1")], "key string, next string")
    fk = integrity.ForeignKey
    got = {(r.src_table, r.src_key, r.depth, r.how, r.kind) for r in cascade({"a": a, "b": b, "c": c}, [fk("a", "b", "b"), fk("b", "c", "c"), fk("c", "next", "c")]).collect()}
    assert got == {("a", "a2", 0, "direct", "missing"), ("b", "b1", 0, "direct", "missing"), ("a", "a1", 1, "inherited", "inherited")}


def test_hot_parent_passes_its_orphanhood_on(spark):
    b = spark.createDataFrame([("hot", "nowhere"), ("good", None)], "key string, up string")
    a = spark.range(900).select(F.concat(F.lit("a"), "id").alias("key"), F.when(F.col("id") % 3 == 0, " HOT ").otherwise("good").alias("b"))
    found = cascade({"a": a, "b": b}, [integrity.ForeignKey("a", "b", "b"), integrity.ForeignKey("b", "up", "b")])
    got = {(r.src_table, r.how, r.ref_month): r.n for r in found.groupBy("src_table", "how", "ref_month").agg(F.count("*").alias("n")).collect()}
    month = at(20).strftime("%Y-%m")
    assert got == {("b", "direct", month): 1, ("a", "inherited", month): 300}


def test_hot_reference_is_found_whole(spark):
    e = spark.createDataFrame([("hot", at(50), True)], "id string, valid_from timestamp, asserted boolean")
    o = spark.range(3000).select(F.concat(F.lit("o"), "id").alias("id"), F.lit(at(20)).alias("valid_from"), F.lit(True).alias("asserted"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), "id")).alias("entity_id"))
    r = spark.createDataFrame([], "from_id string, to_id string, relation_type string, valid_from timestamp, asserted boolean")
    got = {x.kind: x.n for x in integrity.memory_orphans(e, o, r).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"late": 1000, "missing": 2000}
