"""Queries on retrieval: vector, keyword and full-text search, fusion, refinements, walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import fusion, search, traverse
from palimpsest.queries.base import COSINE, E, NOW, O, R, USABLE, VECTOR, WORDS, now, query_vector

KEYWORDS = "project migration note glossary"
WEIGHTS = {"vector": 0.4, "sparse": 0.25, "fts": 0.35}


def _entities(spark, sf):
    return now(spark, sf, "entity", ["name", "type", "embedding", "metadata"])


def _dense(e, k=20):
    return search.top(search.vector_scores(e, query_vector(e)), k)


def vector_topk(spark, sf):
    """The ten entities nearest to the query vector."""
    return _dense(_entities(spark, sf), 10).select("id", "name", "score")


def vector_filtered_topk(spark, sf):
    """The ten nearest of one type (filtered before the top-k)."""
    e = _entities(spark, sf)
    rows = e.filter(F.lower("type").isin("person", "human", "contact"))
    return search.top(search.vector_scores(rows, query_vector(e)), 10).select("id", "score")


def note_vector_topk(spark, sf):
    """The ten notes nearest to the query vector."""
    o = now(spark, sf, "observation", ["embedding"])
    return search.top(search.vector_scores(o, query_vector(_entities(spark, sf))), 10).select("id", "score")


def time_decay(spark, sf):
    """The twenty nearest entities with scores halved every 90 days."""
    e = _dense(_entities(spark, sf))
    return e.select("id", F.round(search.time_decay(F.col("score"), F.col("valid_from"), F.lit(NOW)), 6).alias("decayed"))


def context_boost(spark, sf):
    """Notes scored by full text, boosted for the task and session of the best note."""
    o = now(spark, sf, "observation", ["text", "task_id", "session_id"])
    hits = o.join(search.full_text_scores(o, WORDS), "id")
    best = hits.orderBy(F.col("score").desc(), "id").limit(1).select(F.col("task_id").alias("t"), F.col("session_id").alias("s"))
    rows = hits.join(F.broadcast(best))  # one row
    score = search.context_boost(F.col("score") / 100, F.col("task_id") == F.col("t"), F.col("session_id") == F.col("s"))
    return rows.select("id", F.round(score, 6).alias("boosted"))


def fts_tfidf(spark, sf):
    """The twenty best notes by full text."""
    return search.top(search.full_text_scores(now(spark, sf, "observation", ["text"]), WORDS), 20)


def sparse_keyword(spark, sf):
    """The twenty best entity names by keywords."""
    return search.top(search.keyword_scores(_entities(spark, sf), KEYWORDS, least=0.01), 20).select("id", "score")


def _paths(spark, sf):
    e = _entities(spark, sf)
    named = search.full_text_scores(e, KEYWORDS, "name")
    return fusion.stack({"vector": _dense(e), "sparse": search.top(search.keyword_scores(e, KEYWORDS, least=0.01), 20), "fts": search.top(named, 20)})


def rrf_fusion(spark, sf):
    """Reciprocal rank fusion of three paths."""
    return fusion.rrf(_paths(spark, sf), WEIGHTS)


def weighted_fusion(spark, sf):
    """Weighted sum of three paths."""
    return fusion.weighted_sum(_paths(spark, sf), WEIGHTS)


def max_fusion(spark, sf):
    """Largest weighted score of three paths."""
    return fusion.maximum(_paths(spark, sf), WEIGHTS)


def minmax_normalize(spark, sf):
    """Full-text scores scaled to [0, 1]."""
    hits = search.full_text_scores(now(spark, sf, "observation", ["text"]), WORDS)
    return search.min_max(hits, "score", "scaled").select("id", F.round("scaled", 6).alias("scaled"))


def metadata_json_filter(spark, sf):
    """Entities whose metadata name a source, per category."""
    e = now(spark, sf, "entity", ["metadata"]).filter(F.get_json_object("metadata", "$.source") == "chat")
    return e.groupBy(F.coalesce(F.get_json_object("metadata", "$.category"), F.lit("none")).alias("category")).agg(F.count("*").alias("n_entities"))


def required_relation_semi(spark, sf):
    """Entities with a relation of a required type in either direction."""
    e, r = now(spark, sf, "entity", ["type"]), now(spark, sf, "relationship", [])
    return search.has_relation(e, r, types=["manages", "part_of"]).groupBy("type").agg(F.count("*").alias("n_entities"))


def target_relation(spark, sf):
    """Entities linked to the user's profile."""
    e, r = now(spark, sf, "entity", ["name"]), now(spark, sf, "relationship", [])
    return search.has_relation(e, r, targets=["global_user_profile"]).select("id", "name")


def rank_default_left_join(spark, sf):
    """In-degree share of every entity as its rank, 0 where nothing points to it."""
    e, r = now(spark, sf, "entity", []), now(spark, sf, "relationship", [])
    rank = r.groupBy(F.col("to_id").alias("entity_id")).agg((F.count("*") / 1000.0).alias("pagerank"))
    return search.with_rank(e, rank).select("id", F.round("pagerank", 6).alias("pagerank"))


def graph_rag_score(spark, sf):
    """Walks of at most two steps from the ten nearest entities, 20 % less per step; the twenty best."""
    e = _entities(spark, sf)
    seeds = _dense(e, 10).select(F.col("id").alias("node"), "score")
    found = traverse.walk_scores(traverse.edges(now(spark, sf, "relationship", ["strength"])), seeds, 2)
    return search.top(found.select("node", F.round("score", 6).alias("score")), 20, key="node")


def graph_walk(spark, sf):
    """Semantic walk of at most three steps from the nearest entity."""
    e = _entities(spark, sf)
    sim = search.vector_scores(e, query_vector(e)).select(F.col("id").alias("node"), F.col("score").alias("sim"))
    start = search.top(sim.withColumnRenamed("sim", "score"), 3, key="node")
    found = traverse.semantic_walk(traverse.edges(now(spark, sf, "relationship", ["strength"])), sim, start, 3, 0.0)
    return found.select("node", F.round("score", 6).alias("score"))


def flow_diffusion(spark, sf):
    """Query-aware flow from the five nearest entities, two steps."""
    e = _entities(spark, sf)
    sim = search.vector_scores(e, query_vector(e)).select(F.col("id").alias("node"), F.col("score").alias("sim"))
    seeds = search.top(sim.withColumnRenamed("sim", "score"), 5, key="node").select("node", F.lit(0.2).alias("flow"))
    found = traverse.flow(traverse.edges(now(spark, sf, "relationship", ["strength"])), sim, seeds, 2, least=0.001)
    return found.select("node", F.round("flow", 6).alias("flow"), "hops")


def hierarchical_levels(spark, sf):
    """Notes per memory level of their metadata (0 where there is none), filtered before the top-k; the ten newest per level."""
    o = now(spark, sf, "observation", ["metadata"])
    level = F.coalesce(F.get_json_object("metadata", "$.memory_level").cast("int"), F.lit(0))
    return o.groupBy(level.alias("level")).agg(F.count("*").alias("n_notes"), F.date_format(F.max("valid_from"), "yyyy-MM-dd").alias("newest"))


_FTS = """
p AS (SELECT id, unnest(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {src} WHERE {col} IS NOT NULL),
s AS (SELECT id, regexp_replace(w, '^([\\p{{L}}]{{4,}}?)(?:ings|ing|ed|es|s)$', '\\1') AS w FROM p),
tf AS (SELECT id, w, count(*) AS tf FROM s WHERE w IN ({terms}) GROUP BY ALL),
idf AS (SELECT w, ln(1 + (SELECT count(*) FROM {src} WHERE {col} IS NOT NULL)::DOUBLE / count(*)) AS idf FROM tf GROUP BY w),
fts AS (SELECT id, round(sum(tf * idf), 6) AS score FROM tf JOIN idf USING (w) GROUP BY id)"""


def _terms(words: str) -> str:
    from palimpsest.functions.text import STOP

    return ", ".join(f"regexp_replace('{w}', '^([\\p{{L}}]{{4,}}?)(?:ings|ing|ed|es|s)$', '\\1')" for w in sorted({w for w in words.split() if w not in STOP}))


_NOTES = _FTS.format(col="text", src="o", terms=_terms(WORDS))
_SPARSE = " + ".join(f"CASE WHEN contains(lower(name), '{w}') THEN 1 ELSE 0 END" for w in sorted(set(KEYWORDS.split())))
_PATHS = (
    f"WITH {E}, {VECTOR}, d AS (SELECT 'vector' AS path, id, {COSINE} AS score FROM e x WHERE {USABLE} ORDER BY score DESC, id LIMIT 20), "
    f"k AS (SELECT 'sparse' AS path, id, round(({_SPARSE})::DOUBLE / length(name), 6) AS score FROM e WHERE length(name) > 0 AND round(({_SPARSE})::DOUBLE / length(name), 6) >= 0.01 ORDER BY score DESC, id LIMIT 20), "
    + _FTS.format(col="name", src="e", terms=_terms(KEYWORDS))
    + ", f AS (SELECT 'fts' AS path, id, score FROM fts ORDER BY score DESC, id LIMIT 20), a AS (FROM d UNION ALL FROM k UNION ALL FROM f), "
    "w AS (SELECT *, CASE path WHEN 'vector' THEN 0.4 WHEN 'sparse' THEN 0.25 ELSE 0.35 END::DOUBLE AS weight, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) - 1 AS rank FROM a) "
)
_EDGES = "g AS (SELECT from_id AS src, to_id AS dst, max(coalesce(strength, 0)) AS weight FROM r WHERE from_id <> to_id GROUP BY ALL)"
_TWO = "h AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"
_SIM = f"m AS (SELECT id AS node, {COSINE} AS sim FROM e x WHERE {USABLE})"

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_filtered_topk, note_vector_topk, time_decay, context_boost, fts_tfidf, sparse_keyword, rrf_fusion, weighted_fusion, max_fusion, minmax_normalize, metadata_json_filter,
        required_relation_semi, target_relation, rank_default_left_join, graph_rag_score, graph_walk, flow_diffusion, hierarchical_levels,
    )
}
SQL = {
    "vector_topk": f"WITH {E}, {VECTOR} SELECT id, name, {COSINE} AS score FROM e x WHERE {USABLE} ORDER BY score DESC, id LIMIT 10",
    "vector_filtered_topk": f"WITH {E}, {VECTOR} SELECT id, {COSINE} AS score FROM e x WHERE lower(type) IN ('person', 'human', 'contact') AND {USABLE} ORDER BY score DESC, id LIMIT 10",
    "note_vector_topk": f"WITH {E}, {O}, {VECTOR} SELECT id, {COSINE} AS score FROM o x WHERE {USABLE} ORDER BY score DESC, id LIMIT 10",
    "time_decay": f"WITH {E}, {VECTOR}, d AS (SELECT id, valid_from, {COSINE} AS score FROM e x WHERE {USABLE} ORDER BY score DESC, id LIMIT 20) "
    f"SELECT id, round(score * pow(0.5, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(valid_from)) / 3.6e9 / 2160), 6) AS decayed FROM d",
    "context_boost": f"WITH {O}, {_NOTES}, hits AS (SELECT o.*, score FROM o JOIN fts USING (id)), b AS (SELECT task_id AS t, session_id AS s FROM hits ORDER BY score DESC, id LIMIT 1) "
    "SELECT id, round(least(1.0, score / 100 * (1 + CASE WHEN task_id = t THEN 0.5 ELSE 0 END + CASE WHEN session_id = s THEN 0.3 ELSE 0 END)), 6) AS boosted FROM hits, b",
    "fts_tfidf": f"WITH {O}, {_NOTES} SELECT id, score FROM fts ORDER BY score DESC, id LIMIT 20",
    "sparse_keyword": _PATHS + "SELECT id, score FROM k",
    "rrf_fusion": _PATHS + "SELECT id, round(sum(weight / (rank + 61)), 6) AS fused, count(*) AS n_paths FROM w GROUP BY id",
    "weighted_fusion": _PATHS + "SELECT id, round(sum(weight * score), 6) AS fused, count(*) AS n_paths FROM w GROUP BY id",
    "max_fusion": _PATHS + "SELECT id, round(max(weight * score), 6) AS fused, count(*) AS n_paths FROM w GROUP BY id",
    "minmax_normalize": f"WITH {O}, {_NOTES}, x AS (SELECT min(score) AS a, max(score) AS b FROM fts) SELECT id, round(CASE WHEN b > a THEN (score - a) / (b - a) ELSE 1.0 END, 6) AS scaled FROM fts, x",
    "metadata_json_filter": f"WITH {E} SELECT coalesce(json_extract_string(metadata, '$.category'), 'none') AS category, count(*) AS n_entities FROM e WHERE json_extract_string(metadata, '$.source') = 'chat' GROUP BY 1",
    "required_relation_semi": f"WITH {E}, {R}, x AS (SELECT from_id AS id FROM r WHERE relation_type IN ('manages', 'part_of') UNION SELECT to_id FROM r WHERE relation_type IN ('manages', 'part_of')) "
    "SELECT type, count(*) AS n_entities FROM e WHERE id IN (SELECT id FROM x WHERE id IS NOT NULL) GROUP BY type",
    "target_relation": f"WITH {E}, {R} SELECT id, name FROM e WHERE id IN (SELECT from_id FROM r WHERE to_id = 'global_user_profile' AND from_id IS NOT NULL UNION SELECT to_id FROM r WHERE from_id = 'global_user_profile' AND to_id IS NOT NULL)",
    "rank_default_left_join": f"WITH {E}, {R}, x AS (SELECT to_id, count(*) / 1000.0 AS n FROM r GROUP BY 1) SELECT id, round(coalesce(n, 0.0), 6)::DOUBLE AS pagerank FROM e LEFT JOIN x ON to_id = id",
    "graph_rag_score": f"WITH {E}, {R}, {VECTOR}, {_EDGES}, {_TWO}, {_SIM}, l0 AS (SELECT node, sim AS s FROM m ORDER BY sim DESC, node LIMIT 10), l1 AS (SELECT dst AS node, max(s) AS s FROM l0 JOIN h ON node = src GROUP BY 1), "
    "l2 AS (SELECT dst AS node, max(s) AS s FROM l1 JOIN h ON node = src GROUP BY 1), a AS (SELECT node, s FROM l0 UNION ALL SELECT node, s * 0.8 FROM l1 UNION ALL SELECT node, s * 0.6 FROM l2) "
    "SELECT node, round(max(s), 6) AS score FROM a GROUP BY 1 ORDER BY score DESC, node LIMIT 20",
    "graph_walk": f"WITH {E}, {R}, {VECTOR}, {_EDGES}, {_TWO}, {_SIM}, st AS (SELECT src, dst, sim FROM h JOIN m ON dst = node WHERE sim > 0), l0 AS (SELECT node, sim AS s FROM m ORDER BY sim DESC, node LIMIT 3), "
    "l1 AS (SELECT dst AS node, max(s * sim * 0.9) AS s FROM l0 JOIN st ON node = src GROUP BY 1), l2 AS (SELECT dst AS node, max(s * sim * 0.8) AS s FROM l1 JOIN st ON node = src GROUP BY 1), "
    "l3 AS (SELECT dst AS node, max(s * sim * 0.7) AS s FROM l2 JOIN st ON node = src GROUP BY 1) SELECT node, round(max(s), 6) AS score FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) GROUP BY 1",
    "flow_diffusion": f"WITH {E}, {R}, {VECTOR}, {_EDGES}, {_SIM}, st AS (SELECT src, dst, sim FROM g JOIN m ON dst = node), l0 AS (SELECT node, 0.2::DOUBLE AS f, 0 AS hop FROM (SELECT * FROM m ORDER BY sim DESC, node LIMIT 5)), "
    "l1 AS (SELECT DISTINCT dst AS node, round(f * sim * 0.85, 9) AS f, 1 AS hop FROM l0 JOIN st ON node = src WHERE round(f * sim * 0.85, 9) >= 0.001), "
    "l2 AS (SELECT DISTINCT dst AS node, round(f * sim * 0.85, 9) AS f, 2 AS hop FROM l1 JOIN st ON node = src WHERE round(f * sim * 0.85, 9) >= 0.001) "
    "SELECT node, round(sum(f), 6) AS flow, min(hop) AS hops FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2) GROUP BY 1",
    "hierarchical_levels": f"WITH {O} SELECT coalesce(json_extract_string(metadata, '$.memory_level')::INT, 0) AS level, count(*) AS n_notes, strftime(max(valid_from), '%Y-%m-%d') AS newest FROM o GROUP BY 1",
}
