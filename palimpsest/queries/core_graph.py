"""Queries on the relation graph: algorithms, inference, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import graph, inference, traverse
from palimpsest.operators.components import connected_components
from palimpsest.queries.base import E, O, R, START, now

ROUNDS = 3


def _r(spark, sf):
    return now(spark, sf, "relationship", ["strength"])


def _e(spark, sf):
    return traverse.edges(_r(spark, sf))


def _start(spark):
    return spark.createDataFrame([(START,)], "node string")


def degree(spark, sf):
    """In- and out-degree of every node."""
    return graph.degree(_e(spark, sf))


def hits_one_step(spark, sf):
    """One unnormalised step of hubs and authorities."""
    return graph.hits_one_step(_e(spark, sf))


def hits_iterated(spark, sf):
    """Hubs and authorities after three rounds."""
    h = graph.hits(_e(spark, sf), ROUNDS)
    return h.select("node", F.round("authority", 6).alias("authority"), F.round("hub", 6).alias("hub"))


def pagerank(spark, sf):
    """Weighted PageRank after three rounds."""
    return graph.pagerank(_e(spark, sf), ROUNDS).select("node", F.round("pagerank", 8).alias("pagerank"))


def label_propagation(spark, sf):
    """Communities by label propagation, two rounds."""
    return graph.label_propagation(_e(spark, sf), 2)


def components(spark, sf):
    """Weakly connected components."""
    return connected_components(_e(spark, sf).select("src", "dst")).select("node", "component")


def island_sizes(spark, sf):
    """Number of components by size."""
    sizes = components(spark, sf).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_components"))


def bridge_entities(spark, sf):
    """Nodes whose neighbours belong to several communities."""
    e = _e(spark, sf)
    return graph.bridges(e, graph.label_propagation(e, 2))


def bfs_hops(spark, sf):
    """Directed hops from the user's profile, up to three."""
    return traverse.hops(_e(spark, sf), _start(spark), 3)


def explore_names(spark, sf):
    """Nodes within two directed hops with their names, a placeholder where the entity is missing."""
    near = traverse.hops(_e(spark, sf), _start(spark), 2)
    e = now(spark, sf, "entity", ["name"]).select(F.col("id").alias("node"), "name")
    return near.join(e, "node", "left").select("node", "hops", F.coalesce("name", F.lit("Unknown")).alias("name"))


def shortest_path(spark, sf):
    """Cheapest ways from the user's profile of at most three edges, strength being length."""
    found = traverse.shortest_paths(_e(spark, sf), _start(spark), 3)
    return found.select("node", F.round("cost", 4).alias("cost"))


def cycle_paths(spark, sf):
    """Cycles of two or three edges through the user's profile, by length."""
    return traverse.cycles_through(_e(spark, sf), START, 3).groupBy("length").agg(F.count("*").alias("n_cycles"))


def betweenness(spark, sf):
    """Betweenness over paths of at most three edges that begin at the user's profile or a target of it."""
    e = _e(spark, sf)
    return graph.betweenness(e, traverse.hops(e, _start(spark), 1), 3).select("node", F.round("betweenness", 6).alias("betweenness"))


def co_occurrence(spark, sf):
    """Entities named in notes of other entities."""
    return inference.co_occurrence(now(spark, sf, "entity", ["name"]), now(spark, sf, "observation", ["entity_id", "text"]))


def transitive_relations(spark, sf):
    """Second-hand relations of the user's profile."""
    return inference.transitive(_e(spark, sf), _start(spark))


def expertise_rule(spark, sf):
    """Who is expert in which technology."""
    return inference.expertise(_r(spark, sf))


def custom_rule(spark, sf):
    """A registered rule: who manages somebody who works somewhere is linked to that place."""
    rule = (
        "SELECT a.from_id, b.to_id, 'oversees' AS relation_type, cast(0.6 AS double) AS confidence, 'manages a member' AS reason FROM r a JOIN r b ON a.to_id = b.from_id "
        "WHERE a.relation_type = :first AND b.relation_type = :second"
    )
    return inference.custom_rule(spark, {"r": _r(spark, sf)}, rule, first="manages", second="works_at").distinct()


def logical_edges(spark, sf):
    """Logical edges by category, type and parent of the first entity that has a category."""
    e = now(spark, sf, "entity", ["type", "metadata"])
    first = e.filter(F.get_json_object("metadata", "$.category").isNotNull()).orderBy("id").limit(1).select("id")
    return inference.logical_links(e, _e(spark, sf), first).filter("relation_type IN ('same_category', 'same_type', 'hierarchical')")


def common_neighbors(spark, sf):
    """Nodes that share neighbours with the user's profile."""
    return inference.common_neighbours(traverse.both_ways(_e(spark, sf)), _start(spark))


def graph_proximity(spark, sf):
    """Nodes two or three undirected hops from the user's profile."""
    return inference.proximity(traverse.hops(traverse.both_ways(_e(spark, sf)), _start(spark), 3))


def suggestions_merge(spark, sf):
    """The ten best suggested connections of the user's profile from both lists."""
    two = traverse.both_ways(_e(spark, sf))
    return inference.merge_suggestions([(inference.common_neighbours(two, _start(spark)), 0.8), (inference.proximity(traverse.hops(two, _start(spark), 3)), 0.6)])


def status_conflicts(spark, sf):
    """Entities that notes of one year call active and inactive."""
    return inference.status_conflicts(now(spark, sf, "observation", ["entity_id", "text"]))


def orphan_entities(spark, sf):
    """Entities without a note and without a relation, by type."""
    e, o = now(spark, sf, "entity", ["type"]), now(spark, sf, "observation", ["entity_id"])
    lone = e.join(o.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti").join(graph.relation_ends(_r(spark, sf)).withColumnRenamed("node", "id"), "id", "left_anti")
    return lone.groupBy("type").agg(F.count("*").alias("n_entities"))


_G = f"WITH {R}, g AS (SELECT from_id AS src, to_id AS dst, max(coalesce(strength, 0)) AS weight FROM r WHERE from_id <> to_id GROUP BY ALL)"
_H = _G + ", h AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g) GROUP BY ALL), n AS (SELECT src AS node FROM g UNION SELECT dst FROM g)"


def _rank_sql() -> str:
    out = _H + ", t AS (SELECT src, sum(weight) AS total FROM g GROUP BY 1 HAVING sum(weight) > 0), l AS (SELECT src, dst, weight / total AS share FROM g JOIN t USING (src) WHERE weight > 0), p0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS p FROM n)"
    for i in range(ROUNDS):
        out += f", x{i} AS (SELECT dst AS node, sum(share * p) AS got FROM l JOIN p{i} ON src = node GROUP BY 1), p{i + 1} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(got, 0) + coalesce((SELECT sum(p) FROM p{i} WHERE node NOT IN (SELECT src FROM t)), 0) / (SELECT count(*) FROM n)) AS p FROM n LEFT JOIN x{i} USING (node))"
    return out + f" SELECT node, round(p, 8) AS pagerank FROM p{ROUNDS}"


def _hits_sql() -> str:
    out = _H + ", b0 AS (SELECT node, 1.0::DOUBLE AS hub FROM n)"
    for i in range(ROUNDS):
        out += f", a{i} AS (SELECT dst AS node, sum(hub) / (SELECT sum(hub) FROM g JOIN b{i} ON src = node) AS authority FROM g JOIN b{i} ON src = node GROUP BY 1), b{i + 1} AS (SELECT src AS node, sum(authority) / (SELECT sum(authority) FROM g JOIN a{i} ON dst = node) AS hub FROM g JOIN a{i} ON dst = node GROUP BY 1)"
    return out + f" SELECT node, round(coalesce(authority, 0), 6) AS authority, round(coalesce(hub, 0), 6) AS hub FROM a{ROUNDS - 1} FULL JOIN b{ROUNDS} USING (node)"


_LABELS = _H + ", c0 AS (SELECT node, node AS community FROM n)"
for _i in range(2):
    _LABELS += f", v{_i} AS (SELECT dst, community, round(sum(weight), 6) AS w FROM h JOIN c{_i} ON src = node GROUP BY ALL), c{_i + 1} AS (SELECT dst AS node, min(community) AS community FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS m FROM v{_i}) WHERE w = m GROUP BY 1)"


def _hops(table: str, depth: int, head: str = _H) -> str:
    out = head + f", d0 AS (SELECT '{START}' AS node, 0 AS hops)"
    for i in range(depth):
        seen = " UNION ALL ".join(f"SELECT node FROM d{j}" for j in range(i + 1))
        out += f", d{i + 1} AS (SELECT DISTINCT dst AS node, {i + 1} AS hops FROM d{i} JOIN {table} ON src = node WHERE dst NOT IN ({seen}))"
    return out + ", d AS (" + " UNION ALL ".join(f"FROM d{j}" for j in range(depth + 1)) + ")"


_COMPONENTS = _H.replace("WITH ", "WITH RECURSIVE ", 1) + ", c(node, root) AS (SELECT node, node FROM n UNION SELECT h.dst, c.root FROM c JOIN h ON h.src = c.node), k AS (SELECT node, min(root) AS component FROM c GROUP BY 1)"
_NEAR = f", near AS (SELECT dst AS mid FROM h WHERE src = '{START}'), cn AS (SELECT dst AS node, count(DISTINCT mid) AS n_common FROM h JOIN near ON src = mid WHERE dst <> '{START}' AND dst NOT IN (SELECT mid FROM near) GROUP BY 1), cs AS (SELECT node, n_common, round(least(0.95, 0.5 + 0.15 * n_common), 6)::DOUBLE AS confidence FROM cn)"
_PROX = ", px AS (SELECT node, greatest(0.5, 1 - 0.25 * hops)::DOUBLE AS confidence FROM d WHERE hops BETWEEN 2 AND 3)"

QUERIES = {
    f.__name__: f
    for f in (
        degree, hits_one_step, hits_iterated, pagerank, label_propagation, components, island_sizes, bridge_entities, bfs_hops, explore_names, shortest_path, cycle_paths, betweenness, co_occurrence,
        transitive_relations, expertise_rule, custom_rule, logical_edges, common_neighbors, graph_proximity, suggestions_merge, status_conflicts, orphan_entities,
    )
}
SQL = {
    "degree": _G + " SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, count(*) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM g UNION ALL SELECT dst, 1, 0 FROM g) GROUP BY 1",
    "hits_one_step": _G + ", a AS (SELECT dst AS node, count(*) AS authority FROM g GROUP BY 1) SELECT a.node, a.authority, hub FROM a JOIN (SELECT src AS node, sum(authority)::BIGINT AS hub FROM g JOIN a ON dst = node GROUP BY 1) USING (node)",
    "hits_iterated": _hits_sql(),
    "pagerank": _rank_sql(),
    "label_propagation": _LABELS + " SELECT * FROM c2",
    "components": _COMPONENTS + " SELECT * FROM k",
    "island_sizes": _COMPONENTS + " SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM k GROUP BY 1) GROUP BY 1",
    "bridge_entities": _LABELS + " SELECT src AS node, count(DISTINCT community) AS n_communities FROM h JOIN c2 ON dst = node GROUP BY 1 HAVING count(DISTINCT community) > 1",
    "bfs_hops": _hops("g", 3) + " SELECT * FROM d",
    "explore_names": _hops("g", 2).replace("WITH ", f"WITH {E}, ", 1) + " SELECT node, hops, coalesce(name, 'Unknown') AS name FROM d LEFT JOIN e ON id = node",
    "shortest_path": _G + f", s0 AS (SELECT '{START}' AS node, 0.0::DOUBLE AS cost), " + ", ".join(f"s{i + 1} AS (SELECT node, min(cost) AS cost FROM (FROM s{i} UNION ALL SELECT dst, round(cost + weight, 6) FROM s{i} JOIN g ON src = node) GROUP BY 1)" for i in range(3)) + " SELECT node, round(cost, 4) AS cost FROM s3",
    "cycle_paths": _G + f" SELECT * FROM (SELECT 2 AS length, count(*) AS n_cycles FROM g a JOIN g b ON a.dst = b.src AND b.dst = '{START}' WHERE a.src = '{START}' UNION ALL SELECT 3, count(*) FROM g a JOIN g b ON a.dst = b.src JOIN g c ON b.dst = c.src AND c.dst = '{START}' WHERE a.src = '{START}' AND b.dst <> '{START}') WHERE n_cycles > 0",
    "co_occurrence": f"WITH {E}, {O}, x AS (SELECT id, array_to_string(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'), ' ') AS p, len(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')) AS k FROM e WHERE name IS NOT NULL), "
    "y AS (SELECT entity_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM o WHERE entity_id IS NOT NULL AND text IS NOT NULL) "
    "SELECT DISTINCT entity_id AS from_id, id AS to_id, 'related_to' AS relation_type, 0.7::DOUBLE AS confidence FROM y JOIN x ON contains(t, ' ' || p || ' ') WHERE k > 0 AND entity_id <> id",
    "transitive_relations": _G + f" SELECT DISTINCT a.src AS from_id, b.dst AS to_id, 'potentially_related' AS relation_type, 0.5::DOUBLE AS confidence FROM g a JOIN g b ON a.dst = b.src WHERE a.src = '{START}' AND b.dst <> a.src AND b.dst NOT IN (SELECT dst FROM g WHERE src = '{START}')",
    "expertise_rule": f"WITH {R} SELECT DISTINCT a.from_id, b.to_id, 'expert_in' AS relation_type, 0.7::DOUBLE AS confidence FROM r a JOIN r b ON a.to_id = b.from_id WHERE a.relation_type = 'works_on' AND b.relation_type = 'uses_tech' AND a.from_id <> b.to_id",
    "custom_rule": f"WITH {R} SELECT DISTINCT a.from_id, b.to_id, 'oversees' AS relation_type, 0.6::DOUBLE AS confidence, 'manages a member' AS reason FROM r a JOIN r b ON a.to_id = b.from_id WHERE a.relation_type = 'manages' AND b.relation_type = 'works_at' AND a.from_id <> b.to_id",
    "logical_edges": f"""
WITH {E}, x AS (SELECT id, json_extract_string(metadata, '$.category') AS c, lower(type) AS k FROM e), s AS (SELECT * FROM x WHERE c IS NOT NULL ORDER BY id LIMIT 1)
SELECT s.id AS from_id, x.id AS to_id, 'same_category' AS relation_type, 0.8::DOUBLE AS confidence FROM x JOIN s ON x.c = s.c WHERE x.id <> s.id
UNION ALL SELECT s.id, x.id, 'same_type', 0.7 FROM x JOIN s ON x.k = s.k WHERE x.id <> s.id""",
    "betweenness": _H + f""",
src AS (SELECT '{START}' AS s UNION SELECT dst FROM g WHERE src = '{START}'),
b0 AS (SELECT s, s AS node, 1.0::DOUBLE AS sigma FROM src),
b1 AS (SELECT s, dst AS node, sum(sigma) AS sigma FROM b0 JOIN g ON node = src GROUP BY ALL),
b2 AS (SELECT a.s, dst AS node, sum(sigma) AS sigma FROM b1 a JOIN g ON node = src WHERE (a.s, dst) NOT IN (SELECT (s, node) FROM b0 UNION ALL SELECT (s, node) FROM b1) GROUP BY ALL),
b3 AS (SELECT a.s, dst AS node, sum(sigma) AS sigma FROM b2 a JOIN g ON node = src
  WHERE (a.s, dst) NOT IN (SELECT (s, node) FROM b0 UNION ALL SELECT (s, node) FROM b1 UNION ALL SELECT (s, node) FROM b2) GROUP BY ALL),
t2 AS (SELECT a.s, a.node, a.sigma, coalesce(sum(a.sigma / w.sigma) FILTER (WHERE w.sigma IS NOT NULL), 0) AS delta FROM b2 a LEFT JOIN g ON a.node = src LEFT JOIN b3 w ON w.s = a.s AND w.node = dst GROUP BY ALL),
t1 AS (SELECT a.s, a.node, a.sigma, coalesce(sum(a.sigma / w.sigma * (1 + w.delta)) FILTER (WHERE w.sigma IS NOT NULL), 0) AS delta FROM b1 a LEFT JOIN g ON a.node = src LEFT JOIN t2 w ON w.s = a.s AND w.node = dst GROUP BY ALL)
SELECT node, round(sum(delta), 6) AS betweenness FROM (FROM t2 UNION ALL FROM t1) GROUP BY 1""",
    "common_neighbors": _H + _NEAR + " SELECT * FROM cs",
    "graph_proximity": _hops("h", 3) + _PROX + " SELECT * FROM px",
    "suggestions_merge": _hops("h", 3) + _PROX + _NEAR + ", a AS (SELECT node, round(greatest(coalesce(cs.confidence, px.confidence), CASE WHEN cs.node IS NOT NULL THEN coalesce(px.confidence * 0.6, 0) ELSE 0 END), 6)::DOUBLE AS confidence FROM cs FULL JOIN px USING (node)) "
    "SELECT node, confidence, CASE WHEN confidence >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM a WHERE confidence >= 0.5 ORDER BY confidence DESC, node LIMIT 10",
    "status_conflicts": f"""
WITH {O}, x AS (SELECT entity_id, year(valid_from) AS year,
  max((valid_from, id)) FILTER (WHERE regexp_matches(text, '{inference.ACTIVE}')) AS a,
  max((valid_from, id)) FILTER (WHERE regexp_matches(text, '{inference.INACTIVE}')) AS b
FROM o WHERE entity_id <> '' AND text IS NOT NULL GROUP BY ALL)
SELECT entity_id, year, a[2] AS active_id, b[2] AS inactive_id FROM x WHERE a IS NOT NULL AND b IS NOT NULL""",
    "orphan_entities": f"WITH {E}, {O}, {R} SELECT type, count(*) AS n_entities FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE entity_id = e.id) AND NOT EXISTS (SELECT 1 FROM r WHERE from_id = e.id OR to_id = e.id) GROUP BY 1",
}
