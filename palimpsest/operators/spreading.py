"""Spreading activation and the searches built on it: activation, triple hybrid, multi-hop pivots, temporal embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.operators.nearest import nearest
from palimpsest.session import stored


def spread(
    edges: DataFrame, seeds: DataFrame, steps: int = 3, spreading: float = 0.8, keep: float = 0.5, beta: float = 0.15, stronger: int = 7, gamma: float = 5.0, theta: float = 0.5, least: float = 0.01
) -> DataFrame:
    """(node, activation, hops) after some steps from seeds (node, activation).

    ``edges``: (src, dst, weight) with weights faded by age already. A step gives
    spreading * weight * activation / fan-out to each target and keeps a share
    of what a node has; nodes are inhibited by those of the ``stronger`` most
    active ones that exceed them (a broadcast of that many rows), go through a
    sigmoid, and end below ``least``. ``hops`` is the smallest step in which a
    node was reached. Each step is stored in the shared folder.
    """
    fan = edges.groupBy("src").agg(F.count("*").alias("fan"))
    out = stored(edges.join(fan, "src").select("src", "dst", (F.col("weight") / F.col("fan")).alias("share")), "fan")
    now = seeds.select("node", F.col("activation").cast("double").alias("a"), F.lit(0).alias("hops"))
    for step in range(1, steps + 1):
        given = now.join(out, now["node"] == out["src"]).select(F.col("dst").alias("node"), (F.lit(spreading) * F.col("share") * F.col("a")).alias("a"), F.lit(step).alias("hops"))
        raw = now.select("node", (F.col("a") * (1 - keep)).alias("a"), "hops").unionByName(given).groupBy("node").agg(F.sum("a").alias("a"), F.min("hops").alias("hops"))
        raw = stored(raw, "raw")
        top = raw.orderBy(F.col("a").desc(), "node").limit(stronger).agg(F.collect_list("a").alias("top"))  # at most ``stronger`` numbers
        less = F.aggregate(F.transform("top", lambda t: F.greatest(t - F.col("a"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        calm = raw.join(F.broadcast(top)).withColumn("b", F.greatest(F.col("a") - beta * less, F.lit(0.0)))
        now = stored(calm.select("node", (1 / (1 + F.exp(-gamma * (F.col("b") - theta)))).alias("a"), "hops").filter(F.col("a") >= least), "active")
    return now.select("node", F.col("a").alias("activation"), "hops")


def faded(edges: DataFrame, now: str, per_day: float = 0.01) -> DataFrame:
    """Edges (src, dst, weight) of relations (from_id, to_id, strength, valid_from): strength * exp(-0.01 days), the largest per pair."""
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))) / F.lit(86_400e6)
    w = F.coalesce("strength", F.lit(0.0)) * F.exp(-per_day * F.greatest(days, F.lit(0.0)))
    r = edges.filter("from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id")
    return r.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.max(w).alias("weight"))


def triple_hybrid(semantic: DataFrame, activation: DataFrame, rank: DataFrame, limit: int = 30) -> DataFrame:
    """(node, score): 0.5 semantic + 0.3 activation + 0.2 pagerank over the union of three score lists, each (node, score); the best ``limit``."""
    parts = None
    for df, weight in ((semantic, 0.5), (activation, 0.3), (rank, 0.2)):
        one = df.select("node", (F.col("score") * weight).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("node").agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.col("score").desc(), "node").limit(limit)


def multi_hop(edges: DataFrame, similarity: DataFrame, rank: DataFrame, pivots: DataFrame, depth: int = 2, cut: float = 0.3) -> DataFrame:
    """(node, occurrences, avg_score, min_depth) of nodes met on walks from the pivots (column node).

    A step's confidence is 0.4 similarity + 0.3 strength + 0.3 min(1, pagerank)
    of the target, falling by 0.9 a step; steps below ``cut`` end. Walks to a
    node at one depth are aggregated (count, sum) before they go on.
    """
    sim = similarity.select(F.col("node").alias("dst"), "sim")
    pr = rank.select(F.col("node").alias("dst"), F.least(F.lit(1.0), "pagerank").alias("pr"))
    step = edges.join(sim, "dst", "left").join(pr, "dst", "left")
    base = 0.4 * F.coalesce("sim", F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), "weight") + 0.3 * F.coalesce("pr", F.lit(0.0))
    step = stored(step.select("src", "dst", base.alias("c")), "confidence")
    level = pivots.select("node", F.lit(1).cast("long").alias("n"))
    found = None
    for d in range(1, depth + 1):
        score = F.col("c") * 0.9 ** (d + 1)
        level = level.join(step, level["node"] == step["src"]).withColumn("s", score).filter(F.col("s") >= cut)
        level = level.groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("total"))
        one = level.select("node", "n", "total", F.lit(d).alias("depth"))
        found = one if found is None else found.unionByName(one)
        level = level.select("node", "n")
    g = found.groupBy("node").agg(F.sum("n").alias("occurrences"), F.sum("total").alias("t"), F.min("depth").alias("min_depth"))
    return g.select("node", "occurrences", F.round(F.col("t") / F.col("occurrences"), 6).alias("avg_score"), "min_depth")


def time_vector(at: Column, size: int = 64) -> Column:
    """Periodic encoding of a time: sine and cosine of its days at geometric frequencies."""
    days = F.unix_micros(at.cast("timestamp")) / F.lit(86_400e6)
    waves = [f(days / F.lit(10_000.0 ** (2 * i / size))) for i in range(size // 2) for f in (F.sin, F.cos)]
    return F.array(*waves)


def history_embedding(observation: DataFrame, now: str, size: int, fade_days: float = 30.0) -> DataFrame:
    """(entity_id, n_notes, embedding): mean of an entity's note vectors weighted by exp(-age / 30 days), to unit length.

    Components are summed by position with map-side aggregation: an entity with
    very many notes costs one row per task and position.
    """
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))) / F.lit(86_400e6)
    usable = observation.filter((F.size("embedding") == size) & F.col("entity_id").isNotNull())
    parts = usable.select("entity_id", F.exp(-F.greatest(age, F.lit(0.0)) / fade_days).alias("w"), F.posexplode("embedding").alias("i", "x"))
    sums = parts.groupBy("entity_id", "i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    v = sums.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.max("n").alias("n_notes"))  # ``size`` items each
    values = F.transform("v", lambda s: s["x"])
    v = v.select("entity_id", "n_notes", values.alias("e"))
    return v.select("entity_id", "n_notes", F.when(vx.norm(F.col("e")) > 0, F.transform("e", lambda x: x / vx.norm(F.col("e")))).alias("embedding"))


def related_notes(observation: DataFrame, notes: DataFrame, size: int, least: float = 0.7, limit: int = 5) -> DataFrame:
    """(note_id, id, score, kind): up to ``limit`` notes related to each given one: its nearest, with similarity ``least`` or more.

    ``kind`` is keyword where both texts share two words of four letters, else semantic.
    """
    near = stored(nearest(notes, observation, limit, size, least=least), "near")
    words = lambda c: F.array_distinct(F.filter(tx.words(F.coalesce(c, F.lit(""))), lambda w: F.length(w) >= 4))
    # only texts that are met are cut into words
    text = lambda df, key: stored(df.select("id", "text").join(near.select(F.col(key).alias("id")).distinct(), "id", "left_semi"), "texts")
    a = text(notes, "query").select(F.col("id").alias("query"), words(F.col("text")).alias("_a"))
    b = text(observation, "id").select("id", words(F.col("text")).alias("_b"))
    kind = F.when(F.size(F.array_intersect("_a", "_b")) >= 2, "keyword").otherwise("semantic")
    return near.join(a, "query").join(b, "id").select(F.col("query").alias("note_id"), "id", "score", kind.alias("kind"))
