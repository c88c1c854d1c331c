"""Queries on spreading activation, triple hybrid search, multi-hop pivots and temporal embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import graph, nearest, search, spreading, traverse
from palimpsest.queries.base import COSINE, E, NOW, O, R, USABLE, VECTOR, now, query_vector


def _similar(spark, sf):
    e = now(spark, sf, "entity", ["embedding"])
    return search.vector_scores(e, query_vector(e)).select(F.col("id").alias("node"), F.col("score"))


def _active(spark, sf):
    seeds = search.top(_similar(spark, sf), 5, key="node").select("node", F.col("score").alias("activation"))
    return spreading.spread(spreading.faded(now(spark, sf, "relationship", ["strength"]), NOW), seeds)


def spreading_activation(spark, sf):
    """Activation after three steps from the five nearest entities."""
    return _active(spark, sf).select("node", F.round("activation", 6).alias("activation"), "hops")


def triple_hybrid(spark, sf):
    """The thirty best entities by similarity, activation and rank."""
    rank = graph.pagerank(traverse.edges(now(spark, sf, "relationship", ["strength"])), 3)
    return spreading.triple_hybrid(_similar(spark, sf), _active(spark, sf).select("node", F.col("activation").alias("score")), rank.select("node", F.col("pagerank").alias("score")))


def multi_hop(spark, sf):
    """Nodes on walks of two steps from the five nearest entities."""
    e = traverse.edges(now(spark, sf, "relationship", ["strength"]))
    sim = _similar(spark, sf)
    rank = e.groupBy(F.col("dst").alias("node")).agg((F.count("*") / 100.0).alias("pagerank"))
    return spreading.multi_hop(e, sim.withColumnRenamed("score", "sim"), rank, search.top(sim, 5, key="node").select("node"), 2, 0.05)


def history_embedding(spark, sf):
    """Faded mean of each entity's note vectors, as its similarity to the query vector."""
    v = query_vector(now(spark, sf, "entity", ["embedding"]))
    h = spreading.history_embedding(now(spark, sf, "observation", ["entity_id", "embedding"]), NOW, len(v))
    return search.vector_scores(h, v).select("entity_id", "n_notes", "score")


def related_notes(spark, sf):
    """Up to five notes related to each note of the stated set: similarity 0.7 or more among its ten nearest, by shared words or meaning."""
    o = now(spark, sf, "observation", ["embedding", "text"])
    return spreading.related_notes(o, o.filter(nearest.one_in("id")), 96)


QUERIES = {f.__name__: f for f in (spreading_activation, triple_hybrid, multi_hop, history_embedding, related_notes)}
_G = "g AS (SELECT from_id AS src, to_id AS dst, max(coalesce(strength, 0)) AS weight FROM r WHERE from_id <> to_id GROUP BY ALL)"
_SIM = f"m AS (SELECT id AS node, {COSINE} AS sim FROM e x WHERE {USABLE})"
SQL = {
    "multi_hop": f"WITH {E}, {R}, {VECTOR}, {_G}, {_SIM}, pr AS (SELECT dst AS node, least(1.0, count(*) / 100.0)::DOUBLE AS pr FROM g GROUP BY 1), "
    "st AS (SELECT src, dst, 0.4::DOUBLE * coalesce(sim, 0) + 0.3::DOUBLE * least(1.0, weight) + 0.3::DOUBLE * coalesce(pr, 0) AS c FROM g LEFT JOIN m ON m.node = dst LEFT JOIN pr ON pr.node = dst), p AS (SELECT node FROM m ORDER BY sim DESC, node LIMIT 5), "
    "l1 AS (SELECT dst AS node, c * 0.81 AS s, 1 AS d FROM p JOIN st ON p.node = src WHERE c * 0.81 >= 0.05), l2 AS (SELECT dst AS node, c * 0.729 AS s, 2 AS d FROM l1 JOIN st ON l1.node = src WHERE c * 0.729 >= 0.05) "
    "SELECT node, count(*) AS occurrences, round(avg(s), 6) AS avg_score, min(d) AS min_depth FROM (FROM l1 UNION ALL FROM l2) GROUP BY 1",
    "history_embedding": f"WITH {E}, {O}, {VECTOR}, x AS (SELECT entity_id, exp(-greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(valid_from)) / 86400e6, 0) / 30) AS w, embedding, generate_subscripts(embedding, 1) AS i FROM o WHERE len(embedding) = 96 AND entity_id IS NOT NULL), "
    "y AS (SELECT entity_id, i, sum(w * embedding[i]::DOUBLE) AS v, count(*) AS n FROM x GROUP BY ALL), z AS (SELECT entity_id, max(n) AS n_notes, list(v ORDER BY i) AS v FROM y GROUP BY 1) "
    "SELECT entity_id, n_notes, round(list_cosine_similarity(v, (SELECT v FROM q)), 6) AS score FROM z WHERE list_max(v) <> 0 OR list_min(v) <> 0",
    "related_notes": f"""
WITH {O}, u AS (SELECT id, text, embedding::DOUBLE[] AS v FROM o WHERE len(embedding) = 96 AND list_max(list_transform(embedding, lambda z: abs(z))) > 0),
t AS (SELECT a.id AS note_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score, a.text AS ta, b.text AS tb FROM u a JOIN u b ON a.id <> b.id WHERE ('0x' || substr(md5(a.id), 1, 8))::UBIGINT % 100 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, id) AS rank FROM t) WHERE rank <= 5 AND score >= 0.7)
SELECT note_id, id, score, CASE WHEN len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(coalesce(ta, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4)),
  list_distinct(list_filter(regexp_extract_all(lower(coalesce(tb, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4)))) >= 2 THEN 'keyword' ELSE 'semantic' END AS kind FROM n""",
}


def _spread_sql() -> str:
    """Three steps of spreading activation as common table expressions, up to w3 (node, a, hops)."""
    out = (
        f"WITH {E}, {R}, {VECTOR}, {_SIM}, f AS (SELECT from_id AS src, to_id AS dst, max(coalesce(strength, 0) * exp(-0.01::DOUBLE * greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(valid_from)) / 86400e6, 0))) AS weight "
        "FROM r WHERE from_id <> to_id GROUP BY ALL), k AS (SELECT src, dst, weight / count(*) OVER (PARTITION BY src) AS share FROM f), "
        "w0 AS (SELECT node, sim AS a, 0 AS hops FROM m ORDER BY sim DESC, node LIMIT 5)"
    )
    for i in range(3):
        out += (
            f", r{i} AS (SELECT node, sum(a) AS a, min(hops) AS hops FROM (SELECT node, a * 0.5::DOUBLE AS a, hops FROM w{i} UNION ALL SELECT dst, 0.8::DOUBLE * share * a, {i + 1} FROM w{i} JOIN k ON node = src) GROUP BY 1), "
            f"q{i} AS (SELECT list(a) AS t FROM (SELECT a FROM r{i} ORDER BY a DESC, node LIMIT 7)), "
            f"w{i + 1} AS (SELECT * FROM (SELECT node, 1 / (1 + exp(-5 * (greatest(a - 0.15::DOUBLE * list_sum(list_transform((SELECT t FROM q{i}), lambda x: greatest(x - a, 0))), 0) - 0.5))) AS a, hops FROM r{i}) WHERE a >= 0.01)"
        )
    return out


def _triple_sql() -> str:
    from palimpsest.queries import core_graph

    rank = core_graph._rank_sql()
    head = rank[: rank.rindex(" SELECT node, round(p, 8)")].split("AS (", 1)
    tail = head[1].split("), g AS (", 1)[1]  # after the view of relations
    return (
        _spread_sql().replace("VECTOR", "VECTOR") + ", g AS (" + tail + f""", z AS (
  SELECT node, 0.5 * sim AS part FROM m UNION ALL SELECT node, 0.3 * a FROM w3 UNION ALL SELECT node, 0.2 * p FROM p3)
SELECT node, round(sum(part), 6) AS score FROM z GROUP BY 1 ORDER BY score DESC, node LIMIT 30"""
    )


SQL["spreading_activation"] = _spread_sql() + " SELECT node, round(a, 6) AS activation, hops FROM w3"
SQL["triple_hybrid"] = _triple_sql()
