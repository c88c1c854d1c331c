"""Graph algorithms on the relation graph as joins and aggregations, a fixed number of rounds where they iterate.

``e`` is always (src, dst, weight) as from ``traverse.edges``. Every round is
stored in the shared folder, which cuts the lineage. An empty graph gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.traverse import both_ways
from palimpsest.session import stored


def nodes(e: DataFrame) -> DataFrame:
    """All ends of edges."""
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degree(e: DataFrame) -> DataFrame:
    """(node, n_in, n_out, degree)."""
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"), F.count("*").alias("degree"))


def hits_one_step(e: DataFrame) -> DataFrame:
    """(node, authority, hub): authority is the in-degree, hub the sum of its targets' authorities; nodes that have both."""
    authority = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("authority"))
    hub = e.join(authority, e["dst"] == authority["node"]).groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("hub"))
    return authority.join(hub, "node")


def hits(e: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, authority, hub) after some rounds, each scaled to a sum of 1."""
    hub = nodes(e).withColumn("hub", F.lit(1.0))
    for _ in range(rounds):
        a = e.join(hub, e["src"] == hub["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("x"))
        a = a.join(F.broadcast(a.agg(F.sum("x").alias("s")))).select("node", (F.col("x") / F.col("s")).alias("authority"))
        h = e.join(a, e["dst"] == a["node"]).groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("x"))
        hub = stored(h.join(F.broadcast(h.agg(F.sum("x").alias("s")))).select("node", (F.col("x") / F.col("s")).alias("hub")), "hubs")
    return a.join(hub, "node", "full").select("node", F.coalesce("authority", F.lit(0.0)).alias("authority"), F.coalesce("hub", F.lit(0.0)).alias("hub"))


def pagerank(e: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(node, pagerank) weighted by strength; nodes without outgoing weight give theirs to all alike."""
    out = e.groupBy("src").agg(F.sum("weight").alias("total")).filter("total > 0")
    links = stored(e.join(out, "src").filter("weight > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
    every = nodes(e)
    sinks = every.join(out.select(F.col("src").alias("node")), "node", "left_anti").withColumn("sink", F.lit(True))
    every = stored(every.join(sinks, "node", "left").select("node", F.coalesce("sink", F.lit(False)).alias("sink")), "nodes")
    n = every.count()
    rank = every.select("node", F.lit(1.0 / max(n, 1)).alias("pagerank"))
    for _ in range(rounds):
        lost = rank.join(every.filter("sink"), "node", "left_semi").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("lost"))
        given = links.join(rank, links["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("pagerank")).alias("got"))
        new = every.select("node").join(given, "node", "left").join(F.broadcast(lost))
        rank = stored(new.select("node", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("pagerank")), "ranks")
    return rank


def label_propagation(e: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, community): each round a node takes the label with the largest sum of edge weights around it, ties by smallest label."""
    two = stored(both_ways(e), "both")
    label = nodes(e).select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = two.join(label, two["src"] == label["node"]).groupBy("dst", "community").agg(F.round(F.sum("weight"), 6).alias("w"))
        # the struct's maximum picks the weight; ties are settled by the smallest label in a second pass
        top = votes.groupBy("dst").agg(F.max("w").alias("top"))
        label = stored(votes.join(top, "dst").filter("w = top").groupBy(F.col("dst").alias("node")).agg(F.min("community").alias("community")), "labels")
    return label


def bridges(e: DataFrame, community: DataFrame) -> DataFrame:
    """(node, n_communities) of nodes whose neighbours belong to two communities or more."""
    two = both_ways(e).select("src", "dst")
    around = two.join(community, two["dst"] == community["node"]).select(F.col("src").alias("node"), "community").distinct()
    return around.groupBy("node").agg(F.count("*").alias("n_communities")).filter("n_communities > 1")


def betweenness(e: DataFrame, sources: DataFrame, depth: int = 5) -> DataFrame:
    """(node, betweenness) over shortest directed unweighted paths of at most ``depth`` edges from the given sources (column node).

    Brandes' two passes, run for all sources at once: levels with path counts
    forward, dependencies backward, each level one join.
    """
    start = sources.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("sigma"))
    levels = [stored(start, "level")]
    seen = levels[0].select("s", "node")
    for d in range(1, depth + 1):
        new = levels[-1].join(e, levels[-1]["node"] == e["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = stored(new.join(seen, ["s", "node"], "left_anti").select("s", "node", F.lit(d).alias("d"), "sigma"), "level")
        levels.append(new)
        seen = seen.unionByName(new.select("s", "node"))
    total = None
    delta = levels[-1].select("s", "node", "sigma", F.lit(0.0).alias("delta"))
    for level in levels[-2:0:-1]:
        below = delta.select("s", F.col("node").alias("dst"), F.col("sigma").alias("sigma_w"), F.col("delta").alias("delta_w"))
        part = level.join(e, level["node"] == e["src"]).join(below, ["s", "dst"])
        part = part.groupBy("s", "node").agg(F.sum(F.col("sigma") / F.col("sigma_w") * (1 + F.col("delta_w"))).alias("delta"))
        delta = stored(level.join(part, ["s", "node"], "left").select("s", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta")
        total = delta if total is None else total.unionByName(delta)
    if total is None:
        total = delta
    return total.groupBy("node").agg(F.sum("delta").alias("betweenness"))


def relation_ends(relationship: DataFrame) -> DataFrame:
    """(node) of every end of every relation, as stored."""
    return relationship.select(F.explode(F.array("from_id", "to_id")).alias("node")).filter("node IS NOT NULL").distinct()


def examples(community: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(community, size, examples) of (node, community): the first ``most`` names (node, name) in order, joined by " | ".

    Only the kept names are gathered, so a community may have any size; nodes
    without a name are counted and give none.
    """
    named = community.join(names, "node", "left")
    size = community.groupBy("community").agg(F.count("*").alias("size"))
    order = Window.partitionBy("community").orderBy(F.col("name").asc_nulls_last(), "node")
    first = named.withColumn("k", F.row_number().over(order)).filter((F.col("k") <= most) & F.col("name").isNotNull())
    listed = first.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), " | ").alias("examples"))
    return size.join(listed, "community", "left").select("community", "size", "examples")
