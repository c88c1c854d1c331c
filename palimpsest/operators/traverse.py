"""Bounded traversal of the relation graph: reach, walks, flows, paths, cycles.

Depths are small (at most 5, cycles 10), so levels are unrolled lazily or looped
with one stored frontier per level; each level is made distinct, which gives the
set semantics of a recursive rule. Frontiers start from a few given nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import stored


def edges(relationship: DataFrame) -> DataFrame:
    """Distinct (src, dst, weight): the strongest current relation of each ordered pair; null ends and self-loops left out."""
    r = relationship.filter("from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id")
    return r.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.max(F.coalesce(F.col("strength"), F.lit(0.0))).alias("weight"))


def both_ways(e: DataFrame) -> DataFrame:
    """Edges in both directions, the stronger of two."""
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return e.unionByName(back).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def hops(e: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): fewest hops from any of ``start`` (column node), up to ``depth``; visited nodes are not entered again."""
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = stored(new.join(seen, "node", "left_anti").withColumn("hops", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def walk_scores(e: DataFrame, seeds: DataFrame, depth: int, fall: float = 0.2) -> DataFrame:
    """(node, score): best seed score times (1 - fall * depth) over undirected walks from the seeds (node, score)."""
    found = seeds.select("node", "score", F.lit(0).alias("depth"))
    level = found
    two = both_ways(e).select("src", "dst")
    for d in range(1, depth + 1):
        level = level.join(two, level["node"] == two["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("score").alias("score")).withColumn("depth", F.lit(d))
        found = found.unionByName(level)
    return found.groupBy("node").agg(F.max(F.col("score") * (1 - fall * F.col("depth"))).alias("score"))


def semantic_walk(e: DataFrame, similarity: DataFrame, start: DataFrame, depth: int = 3, least: float = 0.5) -> DataFrame:
    """(node, score): best product of similarities along undirected walks, each step times (1 - 0.1 d) and only to nodes more similar than ``least``.

    ``similarity``: (node, sim) to the query.
    """
    good = similarity.filter(F.col("sim") > least).select(F.col("node").alias("dst"), "sim")
    steps = both_ways(e).select("src", "dst").join(good, "dst")
    level = start.select("node", "score")
    found = level
    for d in range(1, depth + 1):
        level = level.join(steps, level["node"] == steps["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") * F.col("sim") * (1 - 0.1 * d)).alias("score"))
        found = found.unionByName(level)
    return found.groupBy("node").agg(F.max("score").alias("score"))


def flow(e: DataFrame, affinity: DataFrame, seeds: DataFrame, depth: int = 3, damping: float = 0.85, least: float = 0.1) -> DataFrame:
    """Query-aware flow: (node, flow, hops). A step passes damping * flow * affinity of the target; weaker flows than ``least`` end.

    ``affinity``: (node, sim) to the query, ``seeds``: (node, flow). Distinct
    (node, flow, hop) rows count once; the result sums them per node.
    """
    level = seeds.select("node", "flow", F.lit(0).alias("hop"))
    found = level
    to = affinity.select(F.col("node").alias("dst"), "sim")
    steps = e.select("src", "dst").join(to, "dst")
    for d in range(1, depth + 1):
        level = level.join(steps, level["node"] == steps["src"]).select(F.col("dst").alias("node"), F.round(F.col("flow") * F.col("sim") * damping, 9).alias("flow"), F.lit(d).alias("hop"))
        level = level.filter(F.col("flow") >= least).distinct()
        found = found.unionByName(level)
    return found.groupBy("node").agg(F.sum("flow").alias("flow"), F.min("hop").alias("hops"))


def shortest_paths(e: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """(node, cost, path): cheapest directed path of at most ``depth`` edges, strength being an edge's length; ties by path."""
    best = start.select("node", F.lit(0.0).alias("cost"), F.array("node").alias("path"))
    level = best
    for _ in range(depth):
        step = level.join(e, level["node"] == e["src"]).filter(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("node"), F.round(F.col("cost") + F.col("weight"), 6).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        # only the best way to each node goes on, and only where it beats what is known
        step = step.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("b")).select("node", "b.cost", "b.path")
        known = best.select("node", F.col("cost").alias("known"))
        level = stored(step.join(known, "node", "left").filter(F.col("known").isNull() | (F.col("cost") < F.col("known"))).drop("known"), "paths")
        best = best.unionByName(level).groupBy("node").agg(F.min(F.struct("cost", "path")).alias("b")).select("node", "b.cost", "b.path")
    return best


def cycles_through(e: DataFrame, start: str, most: int = 4) -> DataFrame:
    """Simple directed cycles (path, length) of at most ``most`` edges through a node."""
    level = e.filter(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("node"))
    found = None
    for n in range(2, most + 1):
        step = level.join(e, level["node"] == e["src"])
        closed = step.filter(F.col("dst") == start).select("path", F.lit(n).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        level = step.filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"))
    return found


