"""Searches composed of the single operators: filtered search, graph path, level search, strategies, context.

Filters come before the exact top-k, so nothing has to be fetched in excess.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import inference, search, traverse

#: Words up to which a query without a type is compared with names instead of whole entities.
SHORT_QUERY = 3


def vector_column(query: str, types: list[str] | None = None) -> str:
    """The column a query's vector is compared with: ``name_embedding`` for short queries without a wanted type."""
    return "name_embedding" if len(query.split()) <= SHORT_QUERY and not types else "embedding"


def advanced_search(
    entity: DataFrame, relationship: DataFrame, vector: list[float], now: str, limit: int = 10, column: str = "embedding", types: list[str] | None = None,
    metadata: dict[str, str] | None = None, least: float | None = None, relations: list[str] | None = None, targets: list[str] | None = None,
    hours: float | None = None, task_id: str | None = None, session_id: str | None = None,
) -> DataFrame:
    """(id, name, type, score): the ``limit`` most similar entities that pass all filters, faded by age and boosted by context.

    ``types`` as spelled; ``metadata``: values that must be equal; ``relations``:
    types of which each must be there, in either direction; ``targets``: ids to
    one of which there is a relation, in either direction; ``hours``: no older
    than that; ``least``: similarity before fading. A limit of zero or less means 10.
    """
    e = entity
    if types:
        e = e.filter(F.col("type").isin(types))
    for key, value in (metadata or {}).items():
        e = e.filter(F.get_json_object("metadata", f"$.{key}") == value)
    if hours is not None:
        age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))
        e = e.filter(age < int(hours * 3_600_000_000))
    e = search.vector_scores(e, vector, column)
    if least is not None:
        e = e.filter(F.col("score") >= least)
    for kind in relations or []:
        e = search.has_relation(e, relationship, types=[kind])
    if targets:
        e = search.has_relation(e, relationship, targets=targets)
    best = search.top(e, limit)
    score = search.time_decay(F.col("score"), F.col("valid_from"), F.lit(now))
    if task_id or session_id:
        same = lambda key, value: F.coalesce(F.get_json_object("metadata", f"$.{key}") == value, F.lit(False)) if value else F.lit(False)
        score = search.context_boost(score, same("task_id", task_id), same("session_id", session_id))
    return best.select("id", "name", "type", F.round(score, 6).alias("score"))


def graph_path(e: DataFrame, entity: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 20, types: list[str] | None = None) -> DataFrame:
    """(id, score): entities within ``depth`` directed relations of the seeds (column node), 1 / depth each, the nearest ``limit``."""
    near = traverse.hops(e, seeds, depth).filter("hops > 0").select(F.col("node").alias("id"), F.round(F.try_divide(F.lit(1.0), F.col("hops")), 6).alias("score"))
    some = entity.filter(F.col("type").isin(types)) if types else entity
    return search.top(near.join(some.select("id"), "id", "left_semi"), limit)


def by_level(observation: DataFrame, vector: list[float], levels: list[int] | None = None, entity_id: str | None = None, limit: int = 10) -> DataFrame:
    """(id, entity_id, memory_level, distance): the notes of the given levels (and entity) nearest to a vector, filtered first; no level counts as 0."""
    level = F.coalesce(F.get_json_object("metadata", "$.memory_level").cast("int"), F.lit(0))
    o = observation.withColumn("memory_level", level)
    if levels:
        o = o.filter(F.col("memory_level").isin(levels))
    if entity_id is not None:
        o = o.filter(F.col("entity_id") == entity_id)
    best = search.top(search.vector_scores(o, vector), limit)
    return best.select("id", "entity_id", "memory_level", F.round(1 - F.col("score"), 6).alias("distance"))


def strategies(scores: DataFrame, full_text: DataFrame, e: DataFrame, community: DataFrame) -> DataFrame:
    """(strategy, id, score) of five ways to retrieve, from vector scores and full-text scores (id, score).

    vector_only: the ten nearest; graph_walk: neighbours in either direction of
    the three nearest, 0.8; hybrid_fusion: sum of 1 / (rank + 1) in both lists
    of ten, ranks from 0; community_expansion: members of the communities
    (node, community) of the two nearest, 0.7.
    """
    ranked = search.top(scores, 10).select("id", "score")
    two = traverse.both_ways(e)

    def seeds(n: int) -> DataFrame:
        return search.top(scores, n).select(F.col("id").alias("src"))

    walk = two.join(F.broadcast(seeds(3)), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("score", F.lit(0.8))
    order = Window.partitionBy("path").orderBy(F.col("score").desc(), "id")
    lists = ranked.withColumn("path", F.lit("v")).unionByName(search.top(full_text, 10).select("id", "score", F.lit("t").alias("path")))
    fused = lists.withColumn("rank", F.row_number().over(order)).groupBy("id").agg(F.round(F.sum(1 / F.col("rank")), 6).alias("score"))
    of = community.join(F.broadcast(seeds(2).withColumnRenamed("src", "node")), "node", "left_semi").select("community").distinct()
    members = community.join(of, "community", "left_semi").select(F.col("node").alias("id"), F.lit(0.7).alias("score"))
    parts = {"vector_only": ranked, "graph_walk": walk, "hybrid_fusion": fused, "community_expansion": members}
    return functools.reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("strategy"), "id", "score") for name, df in parts.items()])


def context(found: DataFrame, entity: DataFrame, relationship: DataFrame, observation: DataFrame) -> DataFrame:
    """(part, id, kind, other): all that belongs to the found entities (id, name, type, score).

    ``entity``: the hits with their score; ``connection``: relations in either
    direction to existing entities; ``inferred``: expert relations; ``conflict``:
    years in which notes call them both active and not.
    """
    ids = F.broadcast(found.select("id"))  # at most the search's limit of rows
    names = entity.select(F.col("id").alias("other"), F.coalesce("name", "id").alias("kind_name"))

    def rows(df: DataFrame, part: str, kind: Column, other: Column) -> DataFrame:
        return df.select(F.lit(part).alias("part"), "id", kind.cast("string").alias("kind"), other.cast("string").alias("other"))

    ends = [relationship.select(F.col(a).alias("id"), F.col(b).alias("other"), "relation_type").join(ids, "id", "left_semi") for a, b in (("from_id", "to_id"), ("to_id", "from_id"))]
    linked = ends[0].unionByName(ends[1]).distinct().join(names, "other")
    expert = inference.expertise(relationship).withColumnRenamed("from_id", "id").join(ids, "id", "left_semi")
    clash = inference.status_conflicts(observation.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")).withColumnRenamed("entity_id", "id")
    parts = [
        rows(found, "entity", F.col("type"), F.col("score")), rows(linked, "connection", F.col("relation_type"), F.col("kind_name")),
        rows(expert, "inferred", F.col("relation_type"), F.col("to_id")), rows(clash, "conflict", F.col("year"), F.concat_ws("|", "active_id", "inactive_id")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)
