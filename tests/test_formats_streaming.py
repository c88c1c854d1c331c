"""Sources, sinks and the streaming ingest."""

import datetime as dt

from pyspark.sql import functions as F

from palimpsest.operators.versioned import current
from palimpsest.plans import pipeline, policy
from palimpsest.sources import formats
from palimpsest.streaming import versions


def test_paragraphs_and_markdown(spark):
    df = spark.createDataFrame([(1, "one\r\n\r\ntwo\n \n\nthree"), (2, None), (3, ""), (4, "# T\n## Head\n- a\n- b\nplain\n## Other\n- c")], "k int, text string")
    assert [(r.k, r.chunk_no, r.chunk) for r in formats.paragraphs(df.filter("k < 4"), "k").collect()] == [(1, 0, "one"), (1, 1, "two"), (1, 2, "three")]
    assert [(r.name, r.note) for r in formats.markdown_entities(df, "k").collect()] == [("Head", "a"), ("Head", "b"), ("Other", "c")]


def test_json_notes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"observations": [{"text": "x", "metadata": {"k": 1}}, {"text": "y"}]}')
    got = sorted((r.text, r.metadata) for r in formats.read_json_notes(spark, str(tmp_path)).collect())
    assert got == [("x", '{"k":1}'), ("y", "{}")]


def test_import_strategies(spark):
    log = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), True, "A", '{"x":"1"}')], "id string, valid_from timestamp, asserted boolean, name string, metadata string")
    rows = spark.createDataFrame([("a", "A2", '{"y":"2"}'), ("b", "B", "{}")], "id string, name string, metadata string")
    at = F.lit(dt.datetime(2024, 2, 1))
    got = {s: {r.id: (r.name, r.metadata) for r in current(formats.import_entities(log, rows, at, s), ["id"]).collect()} for s in ("skip", "overwrite", "merge")}
    assert got["skip"] == {"a": ("A", '{"x":"1"}'), "b": ("B", "{}")}
    assert got["overwrite"]["a"] == ("A2", '{"y":"2"}')
    assert got["merge"]["a"] == ("A2", '{"x":"1","y":"2"}')


def test_stream_appends_each_version_once(spark, tmp_path):
    row = ("a", dt.datetime(2024, 1, 1), True, dt.datetime(2024, 1, 1, 1))
    df = spark.createDataFrame([row, row, ("b", dt.datetime(2024, 1, 1), True, dt.datetime(2024, 1, 1, 2))], "id string, valid_from timestamp, asserted boolean, ingested_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = versions.deduplicated(versions.version_stream(spark, str(tmp_path / "in"), df.schema), ["id"])
    versions.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_policy_and_pipeline(spark):
    df = spark.createDataFrame([("explain why the index is slow",), (None,), ("",)], "q string")
    got = [tuple(r[0]) for r in df.select(policy.classify(F.col("q"))).collect()]
    assert got == [("explainer", 1.0, "moderate"), ("finder", 0.5, "simple"), ("finder", 0.5, "simple")]
    hits = spark.createDataFrame([("1", "x", 0.5), ("2", "x", 0.9), ("3", None, 0.1)], "id string, g string, score double")
    assert [r.id for r in pipeline.run(hits, [pipeline.at_least(0.2), pipeline.once_per("g"), (False, pipeline.best(0))]).collect()] == ["2"]
