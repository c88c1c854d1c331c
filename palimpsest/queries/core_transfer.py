"""Queries on imports and exports: contents, not counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.queries.base import E, O, R, now
from palimpsest.sources import transfer

SINCE = "2024-06-01 00:00:00"
TYPES = ["Person", "Organization", "Project"]


def _tables(spark, sf):
    return {
        "entity": now(spark, sf, "entity", ["name", "type", "metadata"]),
        "observation": now(spark, sf, "observation", ["entity_id", "text", "metadata"]),
        "relationship": now(spark, sf, "relationship", ["strength", "metadata"]),
    }


def _fields(lines, *names):
    return lines.select(*[F.get_json_object("record", f"$.{n}").alias(n) for n in names])


def export_records(spark, sf):
    """Every field of the full export: entities of three types, notes and relations since an instant."""
    names = ["kind", "id", "name", "type", "entity_id", "text", "from_id", "to_id", "relation_type", "strength", "metadata", "valid_from"]
    return _fields(transfer.export_records(_tables(spark, sf), TYPES, SINCE), *names)


def import_skip(spark, sf):
    """What an import of the whole export would add where only entities of three types are known, by kind and type."""
    t = _tables(spark, sf)
    lines = transfer.export_records(t)
    known = {"entity": t["entity"].filter(F.col("type").isin(TYPES)), "observation": t["observation"].limit(0), "relationship": t["relationship"]}
    e = transfer.import_records(lines, "entity", known["entity"], ["id"])
    o = transfer.import_records(lines, "observation", known["observation"], ["id"])
    r = transfer.import_records(lines, "relationship", known["relationship"], ["from_id", "to_id", "relation_type"])
    out = e.groupBy("type").agg(F.count("*").alias("n"), F.min("valid_from").alias("first")).select(F.lit("entity").alias("kind"), "type", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("since"))
    more = [
        df.groupBy().agg(F.count("*").alias("n"), F.min("valid_from").alias("first")).filter("n > 0").select(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("type"), "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("since"))
        for k, df in (("observation", o), ("relationship", r))
    ]
    return out.unionByName(more[0]).unionByName(more[1])


def import_user_memories(spark, sf):
    """Notes as another memory's records, imported: entities and notes by user and text."""
    o = now(spark, sf, "observation", ["entity_id", "text", "metadata"])
    records = o.select(F.to_json(F.struct(F.col("entity_id").alias("user_id"), F.col("text").alias("memory"))).alias("record"))
    return transfer.user_memories(records).select("kind", "name", "type", "entity_name", "text").distinct()


def import_agent_memory(spark, sf):
    """Each session's notes as an agent's memory, imported: notes by agent and list."""
    o = now(spark, sf, "observation", ["session_id", "text"]).filter("session_id IS NOT NULL AND text IS NOT NULL")
    item = F.to_json(F.struct(F.col("text").alias("content"), F.date_format("valid_from", "yyyy-MM-dd").alias("timestamp")))
    array = lambda name: F.concat(F.lit("["), item, F.lit("]")).alias(name)
    record = F.concat(F.lit('{"agent_name":'), F.to_json(F.array("session_id")).substr(F.lit(2), F.length(F.to_json(F.array("session_id"))) - 2), F.lit(',"archival_memory":'), array("a"), F.lit(',"recall_memory":["plain item"]}'))
    found = transfer.agent_memory(o.select(record.alias("record")))
    return found.groupBy("kind", F.coalesce("entity_name", "name").alias("agent"), F.get_json_object("metadata", "$.type").alias("memory")).agg(F.count("*").alias("n"), F.max("text").alias("last_text"))


def linked_notes(spark, sf):
    """Lines of the Markdown notes of all entities with front matter, notes and links in both directions."""
    t = _tables(spark, sf)
    return transfer.linked_notes(t["entity"], t["observation"], t["relationship"])


QUERIES = {f.__name__: f for f in (export_records, import_skip, import_user_memories, import_agent_memory, linked_notes)}

_AT = "strftime(valid_from, '%Y-%m-%d %H:%M:%S.%f')"
_TYPES = ", ".join(f"'{t}'" for t in TYPES)
_FILE = """trim(regexp_replace(regexp_replace(coalesce(name, id), '[<>:"/\\\\|?*]', '-', 'g'), '\\s+', ' ', 'g'))"""
SQL = {
    "export_records": f"""
WITH {E}, {O}, {R}
SELECT 'entity' AS kind, id, name, type, NULL AS entity_id, NULL AS text, NULL AS from_id, NULL AS to_id, NULL AS relation_type, NULL AS strength, metadata, {_AT} AS valid_from
FROM e WHERE type IN ({_TYPES}) AND valid_from >= '{SINCE}'
UNION ALL SELECT 'observation', id, NULL, NULL, entity_id, text, NULL, NULL, NULL, NULL, metadata, {_AT} FROM o WHERE valid_from >= '{SINCE}'
UNION ALL SELECT 'relationship', NULL, NULL, NULL, NULL, NULL, from_id, to_id, relation_type, strength::VARCHAR, metadata, {_AT} FROM r WHERE valid_from >= '{SINCE}'""",
    "import_skip": f"""
WITH {E}, {O}
SELECT 'entity' AS kind, type, count(*) AS n, strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') AS since FROM e WHERE type NOT IN ({_TYPES}) OR type IS NULL GROUP BY type
UNION ALL SELECT 'observation', NULL, count(*), strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') FROM o""",
    "import_user_memories": f"""
WITH {O}, x AS (SELECT coalesce(entity_id, 'Imported User') AS u, text FROM o WHERE text IS NOT NULL)
SELECT DISTINCT 'entity' AS kind, u AS name, 'Person' AS type, NULL AS entity_name, NULL AS text FROM x UNION ALL SELECT DISTINCT 'observation', NULL, NULL, u, text FROM x""",
    "import_agent_memory": f"""
WITH {O}, x AS (SELECT session_id AS agent, text, strftime(valid_from, '%Y-%m-%d') AS day FROM o WHERE session_id IS NOT NULL AND text IS NOT NULL)
SELECT 'entity' AS kind, agent, NULL AS memory, 1::BIGINT AS n, NULL AS last_text FROM (SELECT DISTINCT agent FROM x)
UNION ALL SELECT 'observation', agent, 'archival', count(*), max(text) FROM (SELECT DISTINCT agent, text, day FROM x) GROUP BY agent
UNION ALL SELECT 'observation', agent, 'recall', 1, 'plain item' FROM (SELECT DISTINCT agent FROM x)""",
    "linked_notes": f"""
WITH {E}, {O}, {R}, n AS (SELECT *, {_FILE} AS file FROM e), m AS (SELECT id, file, unnest(json_keys(metadata)) AS key, metadata FROM n WHERE metadata IS NOT NULL)
SELECT id, file, 0 AS block, '0' AS k, 'id: ' || id AS line FROM n
UNION ALL SELECT id, file, 0, '1', 'type: ' || coalesce(type, '') FROM n
UNION ALL SELECT id, file, 0, '2', 'created: ' || strftime(valid_from, '%Y-%m-%dT%H:%M:%S') FROM n
UNION ALL SELECT id, file, 0, '3' || key, key || ': ' || coalesce(json_extract_string(metadata, '$.' || key), 'null') FROM m
UNION ALL SELECT id, file, 1, '', '# ' || coalesce(name, id) FROM n
UNION ALL SELECT n.id, file, 2, o.id, '- ' || text FROM o JOIN n ON n.id = o.entity_id WHERE text IS NOT NULL
UNION ALL SELECT a.id, a.file, 3, relation_type || '|' || b.id, '- **' || relation_type || '**: [[' || b.file || ']]' FROM r JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id
UNION ALL SELECT a.id, a.file, 4, relation_type || '|' || b.id, '- [[' || b.file || ']] (**' || relation_type || '**)' FROM r JOIN n a ON a.id = to_id JOIN n b ON b.id = from_id""",
}
