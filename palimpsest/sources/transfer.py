"""Imports from other memories' JSON, full exports, and notes as Markdown files with links.

Every format is read and written as rows; texts are parsed inside the JVM.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _new_id(*parts: Column) -> Column:
    """A stable id of what an imported row says."""
    return F.md5(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])))


def user_memories(records: DataFrame, column: str = "record", default_type: str = "Person") -> DataFrame:
    """(kind, id, name, type, entity_name, text, metadata) of JSON records {user_id, memory, metadata}: an entity per user and a note per record.

    A missing user is "Imported User"; records without a memory and invalid
    JSON give nothing. Repeated records count once.
    """
    field = lambda name: F.get_json_object(column, f"$.{name}")
    r = records.select(F.coalesce(field("user_id"), F.lit("Imported User")).alias("user"), field("memory").alias("text"), F.coalesce(field("metadata"), F.lit("{}")).alias("metadata"))
    r = r.filter("text IS NOT NULL")
    e = r.groupBy("user").agg(F.min("metadata").alias("metadata"))
    return _entities(e, F.col("user"), default_type).unionByName(_notes(r, F.col("user"), "text", "metadata"))


def agent_memory(records: DataFrame, column: str = "record") -> DataFrame:
    """The same of JSON objects {agent_name, archival_memory: [...], recall_memory: [...]}: an Agent and a note per item.

    Items are strings or objects with ``content`` or ``text`` and ``timestamp``;
    the note's metadata name the list it comes from.
    """
    name = F.coalesce(F.get_json_object(column, "$.agent_name"), F.lit("Agent"))
    parts = []
    for kind in ("archival", "recall"):
        items = F.from_json(F.get_json_object(column, f"$.{kind}_memory"), "array<string>")
        parts.append(records.select(name.alias("agent"), F.explode(items).alias("x"), F.lit(kind).alias("kind")))
    r = parts[0].unionByName(parts[1])
    is_object = F.col("x").startswith("{")
    text = F.when(is_object, F.coalesce(F.get_json_object("x", "$.content"), F.get_json_object("x", "$.text"))).otherwise(F.col("x"))
    meta = F.to_json(F.struct(F.col("kind").alias("type"), F.when(is_object, F.get_json_object("x", "$.timestamp")).alias("timestamp")))
    r = r.select("agent", text.alias("text"), meta.alias("metadata")).filter("text IS NOT NULL")
    agents = records.select(name.alias("agent")).distinct().withColumn("metadata", F.lit('{"source":"agent memory"}'))
    return _entities(agents, F.col("agent"), "Agent").unionByName(_notes(r, F.col("agent"), "text", "metadata"))


def _entities(e: DataFrame, name: Column, kind: str) -> DataFrame:
    null = F.lit(None).cast("string")
    return e.select(F.lit("entity").alias("kind"), _new_id(F.lit("entity"), name).alias("id"), name.alias("name"), F.lit(kind).alias("type"), null.alias("entity_name"), null.alias("text"), "metadata")


def _notes(r: DataFrame, name: Column, text: str, metadata: str) -> DataFrame:
    null = F.lit(None).cast("string")
    out = r.select(F.lit("observation").alias("kind"), _new_id(F.lit("note"), name, F.col(text), F.col(metadata)).alias("id"), null.alias("name"), null.alias("type"), name.alias("entity_name"), F.col(text).alias("text"), F.col(metadata).alias("metadata"))
    return out.distinct()


#: Fields of a record of the native format, by kind.
FIELDS = {
    "entity": ["id", "name", "type", "metadata"],
    "observation": ["id", "entity_id", "text", "metadata"],
    "relationship": ["from_id", "to_id", "relation_type", "strength", "metadata"],
}


def export_records(tables: dict[str, DataFrame], types: list[str] | None = None, since: str | None = None, metadata: bool = True) -> DataFrame:
    """(record): a JSON object per line with ``kind``, all fields and ``valid_from``, of the current records of each kind.

    ``types`` limits entities to some types, ``since`` every kind to records from
    that time on; ``metadata`` may be left out.
    """
    parts = []
    for kind, df in tables.items():
        if types and kind == "entity":
            df = df.filter(F.col("type").isin(types))
        if since:
            df = df.filter(F.col("valid_from") >= F.lit(since).cast("timestamp"))
        fields = [f for f in FIELDS[kind] if metadata or f != "metadata"]
        at = F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("valid_from")
        parts.append(df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *fields, at)).alias("record")))
    return functools.reduce(DataFrame.unionByName, parts)


def import_records(lines: DataFrame, kind: str, known: DataFrame, keys: list[str], strategy: str = "skip") -> DataFrame:
    """Rows of one kind from exported lines (record): those whose keys are not ``known``, or all with ``overwrite`` and ``merge``.

    Original times are kept; invalid lines give nothing; repeated lines count once.
    """
    if strategy not in ("skip", "overwrite", "merge"):
        raise ValueError(f"unknown strategy {strategy}")
    rows = lines.filter(F.get_json_object("record", "$.kind") == kind)
    fields = [F.get_json_object("record", f"$.{f}").alias(f) for f in FIELDS[kind]]
    rows = rows.select(*fields, F.to_timestamp(F.get_json_object("record", "$.valid_from"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("valid_from")).distinct()
    if "strength" in rows.columns:
        rows = rows.withColumn("strength", F.col("strength").cast("double"))
    return rows.join(known.select(*keys).distinct(), keys, "left_anti") if strategy == "skip" else rows


def file_name(name: Column) -> Column:
    """A name as a file's: signs that files may not have become hyphens, white space single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "-"), r"\s+", " "))


def linked_notes(entity: DataFrame, observation: DataFrame, relationship: DataFrame) -> DataFrame:
    """(id, file, block, k, line): a Markdown note per entity, as lines in order of block and k.

    Block 0 is the front matter (id, type, created, metadata by key), 1 the head,
    2 the notes, 3 links to other notes and 4 links from them; entities without a
    name are named by their id. Lines stay rows (to be written partitioned by
    file), so an entity may have any number of notes and links.
    """
    e = entity.withColumn("title", F.coalesce("name", "id"))
    names = e.select("id", file_name(F.col("title")).alias("file"))

    def lines(df: DataFrame, block: int, k: Column, line: Column) -> DataFrame:
        return df.select("id", "file", F.lit(block).alias("block"), k.cast("string").alias("k"), line.alias("line"))

    e = e.withColumn("file", file_name(F.col("title")))
    front = F.array(
        F.struct(F.lit("0").alias("k"), F.concat(F.lit("id: "), "id").alias("l")),
        F.struct(F.lit("1").alias("k"), F.concat(F.lit("type: "), F.coalesce("type", F.lit(""))).alias("l")),
        F.struct(F.lit("2").alias("k"), F.concat(F.lit("created: "), F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss")).alias("l")),
    )
    parts = [lines(e.select("id", "file", F.explode(front).alias("f")), 0, F.col("f.k"), F.col("f.l"))]
    meta = e.select("id", "file", F.explode(F.from_json("metadata", "map<string,string>")).alias("key", "value"))
    parts.append(lines(meta, 0, F.concat(F.lit("3"), "key"), F.concat(F.col("key"), F.lit(": "), F.coalesce("value", F.lit("null")))))
    parts.append(lines(e, 1, F.lit(""), F.concat(F.lit("# "), "title")))
    o = observation.filter("text IS NOT NULL").select(F.col("id").alias("k"), F.col("entity_id").alias("id"), "text").join(names, "id")
    parts.append(lines(o, 2, F.col("k"), F.concat(F.lit("- "), "text")))
    for block, own, other, line in ((3, "from_id", "to_id", ("- **", "**: [[", "]]")), (4, "to_id", "from_id", ("- [[", "]] (**", "**)"))):
        r = relationship.select(F.col(own).alias("id"), F.col(other).alias("o"), "relation_type").join(names, "id").join(names.select(F.col("id").alias("o"), F.col("file").alias("of")), "o")
        first, second = ("relation_type", "of") if block == 3 else ("of", "relation_type")
        parts.append(lines(r, block, F.concat_ws("|", "relation_type", "o"), F.concat(F.lit(line[0]), first, F.lit(line[1]), second, F.lit(line[2]))))
    return functools.reduce(DataFrame.unionByName, parts)
