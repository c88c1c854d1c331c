"""Sources and sinks of other formats: files of text, Markdown and JSON, imports, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.versioned import assert_rows, current, merge_metadata


def paragraphs(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chunk_no, chunk): paragraphs of each text, cut at blank lines, numbered from 0; blank ones left out."""
    clean = F.regexp_replace(text, r"\r\n?", "\n")
    parts = F.filter(F.transform(F.split(clean, r"\n[ \t]*\n+"), lambda p: F.trim(F.regexp_replace(p, r"^\n+|\n+$", ""))), lambda p: p != "")
    return documents.filter(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("chunk_no", "chunk"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json_notes(spark: SparkSession, path: str) -> DataFrame:
    """(text, metadata) of files that hold an array of notes, or an object with a list ``observations``; a note is a string or an object with ``text``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    items = F.coalesce(F.from_json(F.get_json_object("v", "$.observations"), "array<string>"), F.from_json("v", "array<string>"))
    one = raw.select(F.explode(items).alias("x"))
    return one.select(F.coalesce(F.get_json_object("x", "$.text"), "x").alias("text"), F.coalesce(F.get_json_object("x", "$.metadata"), F.lit("{}")).alias("metadata"))


def markdown_entities(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, name, note) of Markdown: ``## `` heads name entities, ``- `` lines below them are their notes."""
    sections = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, r"\r\n?", "\n")), r"\n##[ \t]+")
    s = documents.filter(F.col(text).isNotNull()).select(key, F.posexplode(sections).alias("no", "body")).filter("no > 0")
    lines = F.split("body", "\n")
    notes = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.startswith("- "))
    return s.select(key, F.trim(lines[0]).alias("name"), F.explode(notes).alias("n")).select(key, "name", F.trim(F.substring("n", 3, 1_000_000)).alias("note"))


def import_entities(log: DataFrame, rows: DataFrame, at: Column, strategy: str = "skip") -> DataFrame:
    """The log with imported entities (id, name, type, metadata): ``skip`` known ids, ``overwrite`` them, or ``merge`` their metadata."""
    known = current(log, ["id"]).select("id", F.col("metadata").alias("_old"))
    if strategy == "skip":
        return assert_rows(log, rows.join(known, "id", "left_anti"), at)
    if strategy == "overwrite":
        return assert_rows(log, rows, at)
    if strategy != "merge":
        raise ValueError(f"unknown strategy {strategy}")
    merged = rows.join(known, "id", "left").withColumn("metadata", merge_metadata(F.col("_old"), F.col("metadata"))).drop("_old")
    return assert_rows(log, merged, at)


def export_json(entity: DataFrame, observation: DataFrame) -> DataFrame:
    """(record) one JSON object per line: entities and their notes, each with its kind."""
    e = entity.select(F.to_json(F.struct(F.lit("entity").alias("kind"), "id", "name", "type", "metadata")).alias("record"))
    o = observation.select(F.to_json(F.struct(F.lit("observation").alias("kind"), "id", "entity_id", "text", "metadata")).alias("record"))
    return e.unionByName(o)


def export_markdown(entity: DataFrame, relationship: DataFrame) -> DataFrame:
    """(id, line_no, line): Markdown of each entity as lines: a head, its type, and a wiki link per relation, in order.

    Lines stay rows (written partitioned by id), so an entity with very many
    relations is not gathered into one value.
    """
    named = entity.select("id", "name", "type")
    head = named.select("id", F.lit(0).alias("block"), F.lit("").alias("k"), F.concat(F.lit("# "), F.coalesce("name", "id")).alias("line"))
    kind = named.select("id", F.lit(1).alias("block"), F.lit("").alias("k"), F.concat(F.lit("Type: "), F.coalesce("type", F.lit("unknown"))).alias("line"))
    to = named.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    r = relationship.join(named.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(to, "to_id")
    links = r.select(F.col("from_id").alias("id"), F.lit(2).alias("block"), F.concat_ws("|", "relation_type", "to_id").alias("k"), F.concat(F.lit("- "), "relation_type", F.lit(" [["), F.coalesce("to_name", "to_id"), F.lit("]]")).alias("line"))
    return head.unionByName(kind).unionByName(links)
