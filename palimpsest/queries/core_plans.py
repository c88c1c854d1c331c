"""Queries on composed plans: classification, strategies, pipelines, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.plans import pipeline, policy
from palimpsest.queries.base import E, O, R, WORDS, now
from palimpsest.tables import load


def query_intents(spark, sf):
    """Notes classified as if they were queries, by intent and complexity."""
    o = now(spark, sf, "observation", ["text"]).filter("text IS NOT NULL")
    c = o.select(policy.classify(F.col("text")).alias("c"))
    return c.groupBy("c.intent", "c.complexity").agg(F.count("*").alias("n_notes"))


def strategy_scores(spark, sf):
    """Scores of event types as strategies: errors are failures, values are costs."""
    e = load(spark, sf, "events").select(F.col("event_type").alias("strategy"), (F.col("value") > 50).alias("success"), F.lit(1.0).alias("cost"), F.col("ts").cast("timestamp").alias("at"))
    return policy.strategy_scores(e, "2024-02-01 00:00:00")


def search_pipeline(spark, sf):
    """Best note per entity by full text, ten of them."""
    o = now(spark, sf, "observation", ["text", "entity_id"])
    hits = o.select("id", "entity_id").join(search.full_text_scores(o, WORDS), "id").filter("entity_id IS NOT NULL")
    return pipeline.run(hits, [pipeline.at_least(1.0), pipeline.once_per("entity_id"), (True, pipeline.best(10))]).select("id", "entity_id", "score")


def relation_paths(spark, sf):
    """Path texts of relations of type manages."""
    r = now(spark, sf, "relationship", ["strength"]).filter("relation_type = 'manages' AND from_id IS NOT NULL AND to_id IS NOT NULL")
    return pipeline.path_text(r, now(spark, sf, "entity", ["name"])).select("from_id", "to_id", "path")


QUERIES = {f.__name__: f for f in (query_intents, strategy_scores, search_pipeline, relation_paths)}


def _intents_sql() -> str:
    p = "' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' '"
    hits = ", ".join("(" + " + ".join(f"CASE WHEN contains(p, ' {w} ') THEN 1 ELSE 0 END" for w in ws) + f") AS {k}" for k, ws in policy.INTENTS.items())
    pick = " ".join(f"WHEN t > 0 AND {k} = t THEN '{k}'" for k in policy.INTENTS)
    return (
        f"WITH {O}, a AS (SELECT {p} AS p FROM o WHERE text IS NOT NULL), b AS (SELECT *, {hits}, len(list_filter(string_split(p, ' '), lambda w: w <> '')) AS n FROM a), c AS (SELECT *, greatest({', '.join(policy.INTENTS)}) AS t FROM b) "
        f"SELECT CASE {pick} ELSE 'finder' END AS intent, CASE WHEN n <= 4 THEN 'simple' WHEN n <= 12 THEN 'moderate' ELSE 'complex' END AS complexity, count(*) AS n_notes FROM c GROUP BY ALL"
    )


def _pipeline_sql() -> str:
    from palimpsest.queries.core_search import _NOTES

    return (
        f"WITH {O}, {_NOTES}, h AS (SELECT o.id, entity_id, score FROM o JOIN fts USING (id) WHERE entity_id IS NOT NULL AND score >= 1.0) "
        "SELECT * FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, id DESC) = 1) ORDER BY score DESC, id LIMIT 10"
    )


SQL = {
    "query_intents": _intents_sql(),
    "strategy_scores": "SELECT event_type AS strategy, count(*) AS n_runs, round(0.6 * avg(CASE WHEN value > 50 THEN 1 ELSE 0 END) + 0.15 + CASE WHEN max(ts) >= TIMESTAMP '2024-01-31 00:00:00' THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM events GROUP BY 1",
    "search_pipeline": _pipeline_sql(),
    "relation_paths": f"WITH {E}, {R} SELECT from_id, to_id, printf('%s --[%s:%.3f]--> %s', coalesce(a.name, from_id), relation_type, coalesce(strength, 0.0), coalesce(b.name, to_id)) AS path "
    "FROM r LEFT JOIN e a ON a.id = from_id LEFT JOIN e b ON b.id = to_id WHERE relation_type = 'manages' AND from_id IS NOT NULL AND to_id IS NOT NULL",
}
