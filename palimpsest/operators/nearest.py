"""Exact nearest neighbours of a stated set of queries among all rows, in blocks, and the edges they make.

Queries and rows are gathered into blocks of bounded size; each pair of blocks
is one matrix product in a task and leaves k hits per query, which a window with
a group limit merges. The work is queries times rows, so the set of queries must
be stated (a share of all rows, a frontier), never all rows of a large table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import stored

#: Vectors of a block.
BLOCK = 2000
#: More than the error of a similarity in single precision.
ROUGH = 1e-4


def one_in(key: str, share: int = 100) -> Column:
    """The stated set of queries: ids whose number (the first 32 bits of their MD5) is divisible by ``share``."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % share == 0


def usable(column: str, size: int) -> Column:
    """Is the vector there, of this length, without nulls and not all zero?"""
    return (F.size(column) == size) & F.forall(column, lambda x: x.isNotNull()) & F.exists(column, lambda x: x != 0)


def blocks(df: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """(<prefix>_ids, <prefix>_data): rows gathered into blocks of about BLOCK vectors by a hash of their key."""
    n = max(1, math.ceil(df.count() / BLOCK))
    g = df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias("rows"))
    return g.select(F.col("rows.id").alias(f"{prefix}_ids"), F.flatten(F.col("rows.v")).alias(f"{prefix}_data"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, size: int, vector: str = "embedding", least: float = -1.0) -> DataFrame:
    """(query, id, score, rank): the ``k`` rows most similar to each query but itself, of similarity ``least`` or more, rank from 1.

    Both have a unique string ``id`` and the vector column. Cosine in double
    precision, rounded to 6 digits; equal ones rank by smaller id. Rows without
    a usable vector take no part; an empty side gives an empty result.
    """
    some = stored(queries.filter(usable(vector, size)).select("id", vector).dropDuplicates(["id"]), "queries")
    every = stored(rows.filter(usable(vector, size)).select("id", vector), "vectors")
    pairs = blocks(some, "id", vector, "q").crossJoin(blocks(every, "id", vector, "r"))  # of blocks, not of rows

    def unit(flat) -> np.ndarray:
        x = np.asarray(flat, np.float64).reshape(-1, size)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pair in pdf.itertuples():
                q, r = unit(pair.q_data), unit(pair.r_data)
                q_ids, r_ids = np.asarray(pair.q_ids, object), np.asarray(pair.r_ids, object)
                order, at = np.argsort(r_ids), np.argsort(np.argsort(r_ids))
                rough = q.astype(np.float32) @ r.astype(np.float32).T
                own = np.minimum(np.searchsorted(r_ids[order], q_ids), len(r) - 1)
                same = np.flatnonzero(r_ids[order[own]] == q_ids)
                rough[same, order[own[same]]] = -2
                # what may be among the first k, then exactly
                worst = np.full(len(q), least) if least > 0.3 or len(r) <= k else np.maximum(np.partition(rough, -k, axis=1)[:, -k], least)
                row, col = np.nonzero(rough >= np.maximum(worst - ROUGH, -1.5)[:, None].astype(np.float32))
                s = np.round(np.einsum("ij,ij->i", q[row], r[col]), 6)
                best = np.lexsort((at[col], -s, row))
                row, col, s = row[best], col[best], s[best]
                keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (s >= least)
                if keep.any():
                    yield pd.DataFrame({"query": q_ids[row[keep]], "id": r_ids[col[keep]], "score": s[keep]})

    hits = pairs.mapInPandas(compare, "query string, id string, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def similarity_edges(near: DataFrame, least: float = 0.8) -> DataFrame:
    """Inferred relations ``similar_to`` of neighbours more similar than ``least``: 0.9 times the similarity."""
    sure = F.round(0.9 * F.col("score"), 6).alias("confidence")
    return near.filter(F.col("score") > least).select(F.col("query").alias("from_id"), F.col("id").alias("to_id"), F.lit("similar_to").alias("relation_type"), sure)


def island_bridges(component: DataFrame, entity: DataFrame, asked: Column, size: int, most: int = 3, least: float = 0.7) -> DataFrame:
    """(component, from_id, to_id, relation_type, strength): one relation that ties a small island to the rest.

    ``component``: (node, component). Of components of at most ``most`` nodes for
    which ``asked`` holds, the entity that is most similar to one outside the
    island, if at least ``least``; ties by the smaller ids. An island of ``most``
    nodes leaves at least one outside among its ``most`` nearest. Islands
    without a usable vector get none.
    """
    small = component.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= most).filter(asked).select("component")
    node = stored(component.join(small, "component", "left_semi").select("node", "component"), "islands")
    some = entity.join(node.select(F.col("node").alias("id")), "id", "left_semi")
    near = nearest(some, entity, most, size).filter(F.col("score") >= least)
    near = near.join(node.select(F.col("node").alias("query"), "component"), "query")
    out = near.join(node.select(F.col("node").alias("id"), "component"), ["id", "component"], "left_anti")
    best = Window.partitionBy("component").orderBy(F.col("score").desc(), "query", "id")
    out = out.withColumn("no", F.row_number().over(best)).filter("no = 1")
    return out.select("component", F.col("query").alias("from_id"), F.col("id").alias("to_id"), F.lit("semantically_related").alias("relation_type"), F.col("score").alias("strength"))


def rank_decay(near: DataFrame) -> DataFrame:
    """(query, id, confidence) by rank among the neighbours: max(0.5, 1 - 0.1 per place)."""
    return near.select("query", "id", F.round(F.greatest(F.lit(0.5), 1 - 0.1 * (F.col("rank") - 1)), 6).alias("confidence"))


def semantic_walk(edges: DataFrame, entity: DataFrame, start: DataFrame, size: int, depth: int = 2, k: int = 5, least: float = 0.7, limit: int = 100) -> DataFrame:
    """(start, node, distance, path_score, path_type): best paths over relations and semantic neighbours.

    A relation multiplies the score by its weight, one of the ``k`` nearest with
    similarity ``least`` or more by 0.8 times the similarity. ``path_type`` is
    explicit, semantic or mixed. Of several paths to a node the best stays (then
    the shorter, then by type); the ``limit`` best nodes of each start. Per step
    only the best path of each (start, node, type) goes on.
    """
    level = start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(1.0).alias("score"), F.lit("start").alias("kind"))
    found = None
    for d in range(1, depth + 1):
        level = stored(level, "walk")
        frontier = entity.join(level.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        near = nearest(frontier, entity, k, size).filter(F.col("score") >= least).select(F.col("query").alias("node"), F.col("id").alias("dst"), F.col("score").alias("sim"))

        def then(kind: str) -> Column:
            return F.when(F.col("kind").isin("start", kind), kind).otherwise("mixed").alias("kind")

        a = level.join(edges.select(F.col("src").alias("node"), "dst", "weight"), "node").select("start", "dst", (F.col("score") * F.col("weight")).alias("score"), then("explicit"))
        b = level.join(near, "node").select("start", "dst", (F.col("score") * F.col("sim") * 0.8).alias("score"), then("semantic"))
        level = a.unionByName(b).groupBy("start", F.col("dst").alias("node"), "kind").agg(F.max("score").alias("score"))
        one = level.select("start", "node", F.lit(d).alias("distance"), F.round("score", 6).alias("path_score"), F.col("kind").alias("path_type"))
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("start", "node").orderBy(F.col("path_score").desc(), "distance", "path_type")
    best = found.filter("start <> node").withColumn("no", F.row_number().over(order)).filter("no = 1").drop("no")
    top = Window.partitionBy("start").orderBy(F.col("path_score").desc(), "node")
    return best.withColumn("no", F.row_number().over(top)).filter(F.col("no") <= limit).drop("no")
