"""Queries on composed searches and on batches of new records."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import composed, fusion, graph, records, search, traverse
from palimpsest.plans import policy
from palimpsest.queries.base import COSINE, E, NOW, O, R, USABLE, VECTOR, now, query_vector
from palimpsest.queries.core_search import _PATHS, KEYWORDS
from palimpsest.tables import load

QUESTION = "compare the project migration with the glossary"


def _entities(spark, sf):
    return now(spark, sf, "entity", ["name", "type", "embedding", "name_embedding", "metadata"])


def _relations(spark, sf):
    return now(spark, sf, "relationship", ["strength"])


def _advanced(spark, sf, limit=20):
    e = _entities(spark, sf)
    return composed.advanced_search(e, _relations(spark, sf), query_vector(e), NOW, limit, types=["Person", "Project", "Organization"], relations=["works_on"], hours=24 * 600)


def advanced_search(spark, sf):
    """The twenty most similar entities of three types with a relation of work, no older than 600 days, faded by age."""
    return _advanced(spark, sf)


def target_search(spark, sf):
    """The ten most similar entities from one source that have a relation to the user's profile."""
    e = _entities(spark, sf)
    return composed.advanced_search(e, _relations(spark, sf), query_vector(e), NOW, metadata={"source": "chat"}, targets=["global_user_profile"], least=-1.0)


def short_query_names(spark, sf):
    """The ten entities whose name vector is nearest, as for a query of three words."""
    e = _entities(spark, sf)
    column = composed.vector_column("quarterly budget review")
    first = e.filter((F.size(column) == 96) & F.exists(column, lambda x: x != 0)).orderBy("id").limit(1).select(F.col(column).alias("embedding"))
    vector = query_vector(first.withColumn("id", F.lit("")))
    return search.top(search.vector_scores(e, vector, column), 10).select("id", "score")


def recent_notes(spark, sf):
    """The twenty notes nearest to the query vector among those of the last year."""
    e, o = _entities(spark, sf), now(spark, sf, "observation", ["embedding"])
    age = F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))
    return search.top(search.vector_scores(o.filter(age < 365 * 86_400_000_000), query_vector(e)), 20).select("id", "score")


def level_search(spark, sf):
    """The ten notes of level 0 or 1 nearest to the query vector."""
    o = now(spark, sf, "observation", ["entity_id", "embedding", "metadata"])
    return composed.by_level(o, query_vector(_entities(spark, sf)), levels=[0, 1])


def graph_path(spark, sf):
    """Entities within two directed relations of the five nearest, by nearness."""
    e = _entities(spark, sf)
    seeds = search.top(search.vector_scores(e, query_vector(e)), 5).select(F.col("id").alias("node"))
    return composed.graph_path(traverse.edges(_relations(spark, sf)), e, seeds)


def dynamic_fusion(spark, sf):
    """Four paths fused by rank with the weights that the question's intent and complexity ask for."""
    e = _entities(spark, sf)
    near = search.top(search.vector_scores(e, query_vector(e)), 20)
    named = search.full_text_scores(e, KEYWORDS, "name")
    paths = fusion.stack({"vector": near, "sparse": search.top(search.keyword_scores(e, KEYWORDS, least=0.01), 20), "fts": search.top(named, 20), "graph": graph_path(spark, sf)})
    return fusion.rrf(paths, policy.path_weights(spark, QUESTION))


def keyword_fusion(spark, sf):
    """Unweighted fusion by rank of the vector and the full-text list, ranks from 1."""
    e = _entities(spark, sf)
    near = search.top(search.vector_scores(e, query_vector(e)), 20)
    paths = fusion.stack({"vector": near, "fts": search.top(search.full_text_scores(e, KEYWORDS, "name"), 20)})
    return fusion.rrf(paths, {"vector": 1.0, "fts": 1.0}, k=60)


def retrieval_strategies(spark, sf):
    """What each of the retrieval strategies finds."""
    e, edges = _entities(spark, sf), traverse.edges(_relations(spark, sf))
    scores = search.vector_scores(e, query_vector(e)).select("id", "score")
    return composed.strategies(scores, search.full_text_scores(e, KEYWORDS, "name"), edges, graph.label_propagation(edges, 2))


def search_context(spark, sf):
    """The found entities with their connections, inferred relations and status conflicts."""
    o = now(spark, sf, "observation", ["entity_id", "text"])
    return composed.context(_advanced(spark, sf), _entities(spark, sf), _relations(spark, sf), o)


def create_entities(spark, sf):
    """Outcome of creating an entity for every version's name in capitals and for every user of the events."""
    log = load(spark, sf, "entity").select("id", "valid_from", "asserted", "name", "type", "metadata")
    seen = log.select(F.concat_ws("/", F.lit("new"), "id", F.unix_micros(F.col("valid_from").cast("timestamp")).cast("string")).alias("id"), F.upper("name").alias("name"), "type", "metadata").dropDuplicates(["id"])
    users = load(spark, sf, "events").select(F.concat(F.lit("new/user/"), "event_id").alias("id"), F.concat(F.lit("User "), "user_id").alias("name"), F.lit("User").alias("type"), F.lit(None).cast("string").alias("metadata"))
    return records.create_entities(log, seen.unionByName(users)).groupBy("outcome").agg(F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"))


def add_notes(spark, sf):
    """Outcome of adding every document as a note on its source, and every current note once more, by outcome."""
    e = load(spark, sf, "entity").select("id", "valid_from", "asserted", "name")
    log = load(spark, sf, "observation").select("id", "valid_from", "asserted", "entity_id", "text")
    docs = load(spark, sf, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("id"), F.lit(None).cast("string").alias("entity_id"), F.col("source").alias("entity_name"), "text")
    again = now(spark, sf, "observation", ["entity_id", "text"]).select(F.concat(F.lit("again/"), "id").alias("id"), "entity_id", F.lit(None).cast("string").alias("entity_name"), "text")
    return records.add_notes(e, log, docs.unionByName(again)).groupBy("outcome").agg(F.count("*").alias("n_notes"), F.countDistinct("same_as").alias("n_same"))


def create_relations(spark, sf):
    """Outcome of relating the ends of every current relation the other way round, by type."""
    e, log = (load(spark, sf, t) for t in ("entity", "relationship"))
    turned = _relations(spark, sf).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "relation_type")
    return records.create_relations(e, log, turned).groupBy("relation_type", "outcome").agg(F.count("*").alias("n_relations"))


def session_status(spark, sf):
    """Status of sessions after each event's user stopped the session of the same number in order, by status."""
    s = load(spark, sf, "session_state").select("session_id", "status")
    t = load(spark, sf, "task_state").select("session_id", F.lit("2025-06-01").cast("timestamp").alias("at"), F.when(F.lower("status") == "completed", "closed").otherwise("active").alias("status")).filter("session_id <> ''")
    return records.change_status(s, t, "session_id").groupBy("status").agg(F.count("*").alias("n_sessions"))


QUERIES = {
    f.__name__: f
    for f in (
        advanced_search, target_search, short_query_names, recent_notes, level_search, graph_path, dynamic_fusion, keyword_fusion, retrieval_strategies, search_context,
        create_entities, add_notes, create_relations, session_status,
    )
}

_AGE_H = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(valid_from)) / 3.6e9"
_G = "g AS (SELECT from_id AS src, to_id AS dst, max(coalesce(strength, 0)) AS weight FROM r WHERE from_id <> to_id GROUP BY ALL)"
_ADVANCED = f"""
adv AS (
  SELECT id, name, type, round(score * pow(0.5, {_AGE_H} / 2160), 6) AS score FROM (
    SELECT id, name, type, valid_from, {COSINE} AS score FROM e x WHERE {USABLE} AND type IN ('Person', 'Project', 'Organization') AND {_AGE_H} < 14400
    AND id IN (SELECT from_id FROM r WHERE relation_type = 'works_on' AND from_id IS NOT NULL UNION SELECT to_id FROM r WHERE relation_type = 'works_on' AND to_id IS NOT NULL)
    ORDER BY score DESC, id LIMIT 20))"""
_SEEDS = f"m AS (SELECT id, {COSINE} AS score FROM e x WHERE {USABLE})"
_REACH = """
d0 AS (SELECT id AS node FROM m ORDER BY score DESC, id LIMIT 5),
d1 AS (SELECT DISTINCT dst AS node FROM d0 JOIN g ON src = node WHERE dst NOT IN (FROM d0)),
d2 AS (SELECT DISTINCT dst AS node FROM d1 JOIN g ON src = node WHERE dst NOT IN (FROM d0) AND dst NOT IN (FROM d1)),
gp AS (SELECT node AS id, score FROM (SELECT node, 1.0::DOUBLE AS score FROM d1 UNION ALL SELECT node, 0.5 FROM d2) WHERE node IN (SELECT id FROM e) ORDER BY score DESC, id LIMIT 20)"""
_LABELS = """
h AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g) GROUP BY ALL),
c0 AS (SELECT DISTINCT src AS node, src AS community FROM h),
v0 AS (SELECT dst, community, round(sum(weight), 6) AS w FROM h JOIN c0 ON src = node GROUP BY ALL),
c1 AS (SELECT dst AS node, min(community) AS community FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS m FROM v0) WHERE w = m GROUP BY 1),
v1 AS (SELECT dst, community, round(sum(weight), 6) AS w FROM h JOIN c1 ON src = node GROUP BY ALL),
c2 AS (SELECT dst AS node, min(community) AS community FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS m FROM v1) WHERE w = m GROUP BY 1)"""
_STATUS = "x AS (SELECT entity_id, year(valid_from) AS year, max((valid_from, id)) FILTER (WHERE regexp_matches(text, '{a}')) AS a, max((valid_from, id)) FILTER (WHERE regexp_matches(text, '{b}')) AS b FROM o WHERE entity_id <> '' AND text IS NOT NULL GROUP BY ALL)"


def _status() -> str:
    from palimpsest.operators import inference

    return _STATUS.format(a=inference.ACTIVE, b=inference.INACTIVE)


def _weights() -> dict[str, float]:
    return policy.WEIGHTS["evaluator"]["moderate"]


SQL = {
    "advanced_search": f"WITH {E}, {R}, {VECTOR}, {_ADVANCED} SELECT * FROM adv",
    "target_search": f"""
WITH {E}, {R}, {VECTOR} SELECT id, name, type, round(score * pow(0.5, {_AGE_H} / 2160), 6) AS score FROM (
  SELECT id, name, type, valid_from, {COSINE} AS score FROM e x WHERE {USABLE} AND json_extract_string(metadata, '$.source') = 'chat'
  AND id IN (SELECT from_id FROM r WHERE to_id = 'global_user_profile' AND from_id IS NOT NULL UNION SELECT to_id FROM r WHERE from_id = 'global_user_profile' AND to_id IS NOT NULL)
  ORDER BY score DESC, id LIMIT 10)""",
    "short_query_names": f"WITH {E}, " + VECTOR.replace("embedding", "name_embedding") + f" SELECT id, {COSINE.replace('embedding', 'name_embedding')} AS score FROM e x WHERE {USABLE.replace('embedding', 'name_embedding')} ORDER BY score DESC, id LIMIT 10",
    "recent_notes": f"WITH {E}, {O}, {VECTOR} SELECT id, {COSINE} AS score FROM o x WHERE {USABLE} AND {_AGE_H} < 8760 ORDER BY score DESC, id LIMIT 20",
    "level_search": f"WITH {E}, {O}, {VECTOR} SELECT id, entity_id, coalesce(json_extract_string(metadata, '$.memory_level')::INT, 0) AS memory_level, round(1 - {COSINE}, 6) AS distance FROM o x "
    f"WHERE {USABLE} AND coalesce(json_extract_string(metadata, '$.memory_level')::INT, 0) IN (0, 1) ORDER BY distance, id LIMIT 10",
    "graph_path": f"WITH {E}, {R}, {VECTOR}, {_G}, {_SEEDS}, {_REACH} SELECT * FROM gp",
    "dynamic_fusion": _PATHS.rsplit("a AS (FROM d", 1)[0]
    + f"{R}, {_G}, {_SEEDS}, {_REACH}, a AS (FROM d UNION ALL FROM k UNION ALL FROM f UNION ALL SELECT 'graph', id, score FROM gp), "
    + "w AS (SELECT *, CASE path "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _weights().items())
    + " END::DOUBLE AS weight, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) - 1 AS rank FROM a) SELECT id, round(sum(weight / (rank + 61)), 6) AS fused, count(*) AS n_paths FROM w GROUP BY id",
    "keyword_fusion": _PATHS + "SELECT id, round(sum(1.0 / (rank + 61)), 6)::DOUBLE AS fused, count(*) AS n_paths FROM w WHERE path <> 'sparse' GROUP BY id",
    "retrieval_strategies": _PATHS.rsplit("a AS (FROM d", 1)[0]
    + f"{R}, {_G}, {_SEEDS}, {_LABELS}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM m), "
    + """txt AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM fts)
SELECT 'vector_only' AS strategy, id, score FROM top WHERE k <= 10
UNION ALL SELECT DISTINCT 'graph_walk', dst, 0.8::DOUBLE FROM h JOIN top ON src = id WHERE k <= 3
UNION ALL SELECT 'hybrid_fusion', id, round(sum(1.0::DOUBLE / k), 6) FROM (SELECT id, k FROM top WHERE k <= 10 UNION ALL SELECT id, k FROM txt WHERE k <= 10) GROUP BY id
UNION ALL SELECT 'community_expansion', node, 0.7 FROM c2 WHERE community IN (SELECT community FROM c2 JOIN top ON node = id WHERE k <= 2)""",
    "search_context": f"""
WITH {E}, {R}, {O}, {VECTOR}, {_ADVANCED}, {_status()}
SELECT 'entity' AS part, id, type AS kind, score::VARCHAR AS other FROM adv
UNION ALL SELECT DISTINCT 'connection', a.id, relation_type, coalesce(t.name, t.id) FROM adv a JOIN (SELECT from_id AS i, to_id AS j, relation_type FROM r UNION SELECT to_id, from_id, relation_type FROM r) ON i = a.id JOIN e t ON t.id = j
UNION ALL SELECT DISTINCT 'inferred', p.from_id, 'expert_in', q.to_id FROM r p JOIN r q ON p.to_id = q.from_id WHERE p.relation_type = 'works_on' AND q.relation_type = 'uses_tech' AND p.from_id <> q.to_id AND p.from_id IN (SELECT id FROM adv)
UNION ALL SELECT 'conflict', entity_id, year::VARCHAR, a[2] || '|' || b[2] FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND entity_id IN (SELECT id FROM adv)""",
    "create_entities": f"""
WITH {E}, b AS (
  SELECT DISTINCT ON (id) * FROM (SELECT 'new/' || id || '/' || epoch_us(valid_from) AS id, upper(name) AS name, type FROM entity) WHERE id IS NOT NULL
  UNION ALL SELECT 'new/user/' || event_id, 'User ' || user_id, 'User' FROM events),
c AS (SELECT *, lower(trim(name)) AS k, coalesce(trim(name) = '', true) OR coalesce(trim(type) = '', true) AS blank FROM b),
n AS (SELECT lower(trim(name)) AS k, min(id) AS known_id FROM e WHERE trim(name) <> '' GROUP BY 1),
f AS (SELECT k, min(id) AS first_id FROM c WHERE NOT blank GROUP BY 1),
x AS (SELECT c.id, CASE WHEN blank THEN 'blank' WHEN known_id IS NOT NULL OR first_id <> c.id THEN 'exists' ELSE 'created' END AS outcome, CASE WHEN NOT blank THEN coalesce(known_id, first_id) END AS entity_id
  FROM c LEFT JOIN n USING (k) LEFT JOIN f USING (k))
SELECT outcome, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM x GROUP BY 1""",
    "add_notes": f"""
WITH {E}, {O}, b AS (
  SELECT 'doc/' || doc_id AS id, NULL AS entity_id, source AS entity_name, text FROM documents
  UNION ALL SELECT 'again/' || id, entity_id, NULL, text FROM o),
n AS (SELECT lower(trim(name)) AS k, min(id) AS named_id FROM e WHERE trim(name) <> '' GROUP BY 1),
c AS (SELECT b.id, coalesce(e.id, named_id, CASE WHEN trim(entity_name) <> '' THEN 'entity:' || md5(lower(trim(entity_name))) END) AS eid, e.id IS NULL AND named_id IS NULL AS fresh, b.text
  FROM b LEFT JOIN e ON e.id = b.entity_id LEFT JOIN n ON n.k = lower(trim(entity_name))),
d AS (SELECT *, CASE WHEN eid IS NULL THEN 'no_entity' WHEN coalesce(trim(text) = '', true) THEN 'blank' END AS bad FROM c),
h AS (SELECT entity_id, text, min(id) AS had_id FROM o WHERE entity_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
f AS (SELECT eid, text, min(id) AS first_id FROM d WHERE bad IS NULL GROUP BY ALL),
s AS (SELECT d.*, CASE WHEN bad IS NULL THEN coalesce(had_id, CASE WHEN first_id <> d.id THEN first_id END) END AS same_as
  FROM d LEFT JOIN h ON h.entity_id = d.eid AND h.text = d.text LEFT JOIN f ON f.eid = d.eid AND f.text = d.text)
SELECT coalesce(bad, CASE WHEN same_as IS NOT NULL THEN 'duplicate' WHEN fresh THEN 'new_entity' ELSE 'added' END) AS outcome, count(*) AS n_notes, count(DISTINCT same_as) AS n_same FROM s GROUP BY 1""",
    "create_relations": f"""
WITH {E}, {R}, b AS (SELECT DISTINCT to_id AS from_id, from_id AS to_id, relation_type FROM r)
SELECT relation_type, CASE WHEN from_id = to_id THEN 'self_loop' WHEN coalesce(from_id NOT IN (SELECT id FROM e), true) OR coalesce(to_id NOT IN (SELECT id FROM e), true) THEN 'no_entity'
  WHEN EXISTS (SELECT 1 FROM r WHERE r.from_id = b.from_id AND r.to_id = b.to_id AND r.relation_type = b.relation_type) THEN 'new_version' ELSE 'created' END AS outcome, count(*) AS n_relations
FROM b GROUP BY ALL""",
    "session_status": """
WITH s AS (SELECT session_id, max(lower(status)) AS old FROM session_state WHERE trim(session_id) <> '' GROUP BY 1),
t AS (SELECT session_id, max(CASE WHEN lower(status) = 'completed' THEN 'closed' ELSE 'active' END) AS new FROM task_state WHERE session_id <> '' GROUP BY 1)
SELECT coalesce(new, old) AS status, count(*) AS n_sessions FROM s FULL JOIN t USING (session_id) GROUP BY 1""",
}
