"""The orphan cascade to its end, and from both ends of relationships."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from palimpsest.operators.integrity import ForeignKey, orphan_cascade, plain_state
from palimpsest.queries.core_integrity import p2_found, p2_orphans


def test_long_chain_reaches_its_end(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else "gone") for i in range(54)], "key string, parent string").coalesce(1)
    states = {"node": plain_state(chain, "key")}
    chain = chain.withColumn("valid_from", F.lit(dt.datetime(2024, 1, 1)))
    keys = [ForeignKey("node", "parent", "node")]
    got = {r.src_key: (r.depth, r.how) for r in orphan_cascade({"node": chain}, states, keys).collect()}
    assert got == {f"n{i}": (i, "inherited" if i else "direct") for i in range(54)}
    with pytest.raises(RuntimeError):
        orphan_cascade({"node": chain}, states, keys, max_rounds=3)


def test_relationships_are_in_the_cascade(spark, tmp_path):
    day = [dt.datetime(2024, 1, d) for d in range(1, 10)]
    tables = {
        "entity": ([("a", day[1], True), ("b", day[5], True)], "id string, valid_from timestamp, asserted boolean"),
        "relationship": (
            [("a", "x", "r", day[2], True), ("y", "a", "r", day[2], True), ("a", "b", "r", day[2], True), ("a", "b", "s", day[6], True)],
            "from_id string, to_id string, relation_type string, valid_from timestamp, asserted boolean",
        ),
        "observation": (
            [("o1", day[2], True, "x", None, None), ("o2", day[2], True, "a", "s1", "t1"), ("o3", day[2], True, "a", "s1", None)],
            "id string, valid_from timestamp, asserted boolean, entity_id string, session_id string, task_id string",
        ),
        "session_state": ([("s1",)], "session_id string"),
        "task_state": ([("t1", "s9")], "task_id string, session_id string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.src_table, r.src_key, r.depth, r.how) for r in p2_orphans(spark, str(tmp_path)).collect()}
    direct = {("relationship", k, 0, "direct") for k in ("a|x|r", "y|a|r", "a|b|r")} | {("observation", "o1", 0, "direct"), ("task", "t1", 0, "direct")}
    assert got == direct | {("observation", "o2", 1, "inherited")}
    assert {(r.src_table, r.src_key) for r in p2_found(spark, str(tmp_path)).collect()} <= {x[:2] for x in direct}
