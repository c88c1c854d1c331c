"""Connected components of an undirected graph of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import dropped, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): ``component`` is the smallest node of the component.

    ``edges``: (src, dst) of one orderable type; direction, repeated edges,
    self-loops and null ends do not matter; a node with only a self-loop is a
    component of its own.

    Alternates the large-star and the small-star step: every node's larger
    neighbours, then its smaller ones, are linked to the smallest. That takes a
    number of rounds logarithmic in the size of the largest component. Minima
    are aggregated before the shuffle, nothing is collected per node; each
    round is stored in the shared folder, which cuts the lineage, and the round
    before is deleted. Rounds go on until nothing changes.
    """
    known = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    ends = stored(known.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    loops = ends.filter("u = v").select("u")
    links = ends.filter("u <> v")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(linked.select("u", F.col("m").alias("v")))
        links, before = stored(small.distinct(), "stars"), links
        dropped(before)
        # the links of two rounds agree if their number and the sum of their hashes do
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    lone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    out = links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return out.unionByName(lone.join(out.select("node"), "node", "left_anti"))
