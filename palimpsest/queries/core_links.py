"""Queries on semantic neighbours and logical links of a stated set of entities: one in a hundred, against all."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import graph, inference, nearest, traverse
from palimpsest.queries.base import E, R, now

SIZE = 96


def _entities(spark, sf):
    return now(spark, sf, "entity", ["name", "type", "embedding", "metadata"])


def _asked(e):
    return e.filter(nearest.one_in("id"))


def _edges(spark, sf):
    return traverse.edges(now(spark, sf, "relationship", ["strength"]))


def _near(spark, sf, k):
    e = _entities(spark, sf)
    return nearest.nearest(_asked(e), e, k, SIZE)


def entity_neighbours(spark, sf):
    """The ten entities nearest to each entity of the stated set."""
    return _near(spark, sf, 10)


def similarity_edges(spark, sf):
    """Inferred relations to very similar entities among the five nearest."""
    return nearest.similarity_edges(_near(spark, sf, 5))


def vector_suggestions(spark, sf):
    """Suggested connections by rank among the ten nearest."""
    return nearest.rank_decay(_near(spark, sf, 10))


def semantic_walk(spark, sf):
    """Walks of two steps over relations and semantic neighbours."""
    e = _entities(spark, sf)
    return nearest.semantic_walk(_edges(spark, sf), e, _asked(e).select("id"), SIZE)


def neighbour_clusters(spark, sf):
    """Communities of the graph of the five nearest neighbours: size and up to five examples by name."""
    near = _near(spark, sf, 5)
    e = near.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    found = graph.label_propagation(e, 2)
    return graph.examples(found, _entities(spark, sf).select(F.col("id").alias("node"), F.coalesce("name", "id").alias("name")))


def community_examples(spark, sf):
    """Communities of the relation graph: size and up to five examples by name."""
    found = graph.label_propagation(_edges(spark, sf), 2)
    return graph.examples(found, _entities(spark, sf).select(F.col("id").alias("node"), F.coalesce("name", "id").alias("name")))


def inferred_suggestions(spark, sf):
    """Suggested connections by second-hand and symmetric relations, ten for each entity of the stated set."""
    e, r = _entities(spark, sf), now(spark, sf, "relationship", ["strength"])
    return inference.inferred_suggestions(r, _asked(e).select("id"), e.select("id"))


def logical_links(spark, sf):
    """Logical edges of the stated set, counted by entity, type and confidence."""
    e = _entities(spark, sf)
    return inference.logical_link_counts(e, _edges(spark, sf), _asked(e).select("id"))


def materialised_links(spark, sf):
    """The relation log after logical edges of category and parent were written into it, by type."""
    e = _entities(spark, sf)
    found = inference.logical_links(e, _edges(spark, sf), _asked(e).select("id")).filter("relation_type IN ('same_category', 'hierarchical', 'contextual')")
    log = inference.materialise(now(spark, sf, "relationship", ["strength", "metadata"]), found, "2025-12-31 00:00:00")
    return log.groupBy("relation_type", F.coalesce(F.get_json_object("metadata", "$.logical_edge"), F.lit("false")).alias("logical")).agg(F.count("*").alias("n_relations"))


def inferred_relations(spark, sf):
    """All rules at once: similar, second-hand and expert relations of the stated set, the surest per type, with what they say in words."""
    e, r = _entities(spark, sf), now(spark, sf, "relationship", ["strength"])
    asked = _asked(e).select("id")
    some = inference.transitive(traverse.edges(r), asked.withColumnRenamed("id", "node"))
    expert = inference.expertise(r).join(asked.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    every = inference.surest(similarity_edges(spark, sf).unionByName(some).unionByName(expert))
    return inference.in_words(every, e.select("id", "name"))


QUERIES = {
    f.__name__: f
    for f in (
        entity_neighbours, similarity_edges, vector_suggestions, semantic_walk, neighbour_clusters, community_examples,
        inferred_suggestions, logical_links, materialised_links, inferred_relations,
    )
}

ASKED = "('0x' || substr(md5(id), 1, 8))::UBIGINT % 100 = 0"
_GOOD = "len(embedding) = 96 AND list_max(list_transform(embedding, lambda z: abs(z))) > 0"
_G = "g AS (SELECT from_id AS src, to_id AS dst, max(coalesce(strength, 0)) AS weight FROM r WHERE from_id <> to_id GROUP BY ALL)"
_NEAR = f"""
u AS (SELECT id, embedding::DOUBLE[] AS v FROM e WHERE {_GOOD}),
s AS (SELECT a.id AS query, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.id <> b.id WHERE {ASKED.replace('md5(id)', 'md5(a.id)')}),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)"""
_LABELS = """
c0 AS (SELECT src AS node, src AS community FROM h UNION SELECT dst, dst FROM h),
v0 AS (SELECT dst, community, round(sum(weight), 6) AS w FROM h JOIN c0 ON src = node GROUP BY ALL),
c1 AS (SELECT dst AS node, min(community) AS community FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS m FROM v0) WHERE w = m GROUP BY 1),
v1 AS (SELECT dst, community, round(sum(weight), 6) AS w FROM h JOIN c1 ON src = node GROUP BY ALL),
c2 AS (SELECT dst AS node, min(community) AS community FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS m FROM v1) WHERE w = m GROUP BY 1),
x AS (SELECT community, node, coalesce(name, id) AS name, row_number() OVER (PARTITION BY community ORDER BY coalesce(name, id), node) AS k FROM c2 LEFT JOIN e ON id = node)
SELECT community, count(*) AS size, string_agg(name, ' | ' ORDER BY k) FILTER (WHERE k <= 5 AND name IS NOT NULL) AS examples FROM x GROUP BY 1"""
_BOTH = "h AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g) GROUP BY ALL)"
_LOGICAL = f"""
x AS (SELECT id, json_extract_string(metadata, '$.category') AS c, lower(type) AS k, json_extract_string(metadata, '$.parent_id') AS p, json_extract_string(metadata, '$.domain') AS d FROM e),
s AS (SELECT * FROM x WHERE {ASKED}),
m AS (SELECT DISTINCT s.id AS s, x.id AS mid, x.c, x.k FROM s JOIN g ON g.src = s.id JOIN x ON x.id = g.dst),
l0 AS (
  SELECT s.id AS from_id, x.id AS to_id, 'same_category' AS relation_type, 0.8::DOUBLE AS confidence FROM s JOIN x ON x.c = s.c
  UNION ALL SELECT s.id, x.id, 'same_type', 0.7 FROM s JOIN x ON x.k = s.k
  UNION ALL SELECT s.id, x.id, 'hierarchical', 0.9 FROM s JOIN x ON x.id = s.p OR x.p = s.id
  UNION ALL SELECT s.id, x.id, 'contextual', 0.75 FROM s JOIN x ON x.d = s.d
  UNION ALL SELECT m.s, x.id, 'transitive_logical', 0.6 FROM m JOIN x ON x.c = m.c WHERE x.id <> m.mid
  UNION ALL SELECT m.s, x.id, 'transitive_logical', 0.55 FROM m JOIN x ON x.k = m.k WHERE x.id <> m.mid),
l AS (SELECT from_id, to_id, relation_type, max(confidence) AS confidence FROM l0 WHERE from_id <> to_id GROUP BY ALL)"""
_SAY = "coalesce(a.name, from_id) || ' --[' || relation_type || ']--> ' || coalesce(b.name, to_id) || CASE WHEN confidence >= 0.8 THEN ' (likely)' WHEN confidence >= 0.6 THEN ' (possible)' ELSE ' (uncertain)' END"
SQL = {
    "entity_neighbours": f"WITH {E}, {_NEAR} SELECT query, id, score, rank FROM n WHERE rank <= 10",
    "similarity_edges": f"WITH {E}, {_NEAR} SELECT query AS from_id, id AS to_id, 'similar_to' AS relation_type, round(0.9 * score, 6) AS confidence FROM n WHERE rank <= 5 AND score > 0.8",
    "vector_suggestions": f"WITH {E}, {_NEAR} SELECT query, id, round(greatest(0.5, 1 - 0.1 * (rank - 1)), 6)::DOUBLE AS confidence FROM n WHERE rank <= 10",
    "semantic_walk": f"""
WITH {E}, {R}, {_G}, u AS (SELECT id, embedding::DOUBLE[] AS v FROM e WHERE {_GOOD}),
t AS (SELECT a.id AS node, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM u a JOIN u b ON a.id <> b.id),
n AS (SELECT * FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY node ORDER BY sim DESC, dst) <= 5) WHERE sim >= 0.7),
l0 AS (SELECT id AS start, id AS node, 1.0::DOUBLE AS score, 'start' AS kind FROM e WHERE {ASKED}),
l1 AS (SELECT start, node, kind, max(score) AS score FROM (
  SELECT start, dst AS node, 'explicit' AS kind, score * weight AS score FROM l0 JOIN g ON src = node
  UNION ALL SELECT start, dst, 'semantic', score * sim * 0.8 FROM l0 JOIN n USING (node)) GROUP BY ALL),
l2 AS (SELECT start, node, kind, max(score) AS score FROM (
  SELECT start, dst AS node, CASE WHEN kind = 'explicit' THEN kind ELSE 'mixed' END AS kind, score * weight AS score FROM l1 JOIN g ON src = node
  UNION ALL SELECT start, dst, CASE WHEN kind = 'semantic' THEN kind ELSE 'mixed' END, score * sim * 0.8 FROM l1 JOIN n USING (node)) GROUP BY ALL),
a AS (SELECT start, node, 1 AS distance, round(score, 6) AS path_score, kind AS path_type FROM l1 UNION ALL SELECT start, node, 2, round(score, 6), kind FROM l2),
b AS (SELECT * FROM a WHERE start <> node QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY path_score DESC, distance, path_type) = 1)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY start ORDER BY path_score DESC, node) <= 100""",
    "neighbour_clusters": f"WITH {E}, {_NEAR}, g AS (SELECT query AS src, id AS dst, 1.0::DOUBLE AS weight FROM n WHERE rank <= 5), {_BOTH}, {_LABELS}",
    "community_examples": f"WITH {E}, {R}, {_G}, {_BOTH}, {_LABELS}",
    "inferred_suggestions": f"""
WITH {E}, {R}, q AS (SELECT * FROM r WHERE from_id IN (SELECT id FROM e WHERE {ASKED}) AND to_id IS NOT NULL),
a AS (
  SELECT q.from_id, b.to_id, q.relation_type || '_via_' || b.relation_type AS relation_type, 0.7 * coalesce(q.strength, 0) * coalesce(b.strength, 0) AS confidence
  FROM q JOIN r b ON b.from_id = q.to_id WHERE b.to_id <> q.from_id
  UNION ALL SELECT from_id, to_id, relation_type, 0.8 * coalesce(strength, 0) FROM q WHERE relation_type IN ('colleague_of', 'related_to', 'similar_to', 'connected_to') AND from_id <> to_id),
b AS (SELECT from_id, to_id, relation_type, round(max(confidence), 6) AS confidence FROM a WHERE to_id IN (SELECT id FROM e) GROUP BY ALL)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY confidence DESC, to_id, relation_type) <= 10""",
    "logical_links": f"WITH {E}, {R}, {_G}, {_LOGICAL} SELECT from_id, relation_type, confidence, count(*) AS n_edges FROM l GROUP BY ALL",
    "materialised_links": f"WITH {E}, {R}, {_G}, {_LOGICAL} SELECT relation_type, logical, count(*) AS n_relations FROM (SELECT relation_type, 'false' AS logical FROM r "
    "UNION ALL SELECT relation_type, 'true' FROM l WHERE relation_type IN ('same_category', 'hierarchical', 'contextual')) GROUP BY ALL",
    "inferred_relations": f"""
WITH {E}, {R}, {_G}, {_NEAR}, q AS (SELECT id FROM e WHERE {ASKED}),
a AS (
  SELECT query AS from_id, id AS to_id, 'similar_to' AS relation_type, round(0.9 * score, 6)::DOUBLE AS confidence FROM n WHERE rank <= 5 AND score > 0.8
  UNION ALL SELECT DISTINCT a.src, b.dst, 'potentially_related', 0.5 FROM g a JOIN g b ON a.dst = b.src WHERE a.src IN (SELECT id FROM q) AND b.dst <> a.src AND (a.src, b.dst) NOT IN (SELECT (src, dst) FROM g)
  UNION ALL SELECT DISTINCT a.from_id, b.to_id, 'expert_in', 0.7 FROM r a JOIN r b ON a.to_id = b.from_id
  WHERE a.relation_type = 'works_on' AND b.relation_type = 'uses_tech' AND a.from_id <> b.to_id AND a.from_id IN (SELECT id FROM q))
SELECT from_id, to_id, relation_type, confidence, {_SAY} AS says FROM a LEFT JOIN e a ON a.id = from_id LEFT JOIN e b ON b.id = to_id""".replace("FROM a LEFT JOIN e a", "FROM a x LEFT JOIN e a"),
}
