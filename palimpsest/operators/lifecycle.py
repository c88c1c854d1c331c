"""Upkeep of a memory: activation, salience, importance, keywords, compaction, cleanup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx

#: Words that make a note salient, and their weight, by category.
SALIENT = {
    "critical": (1.0, ["critical", "crucial", "vital", "essential", "must", "never forget", "always remember", "extremely important", "life-changing", "breakthrough", "emergency", "urgent", "immediate", "asap", "priority one"]),
    "important": (0.8, ["important", "significant", "key", "major", "primary", "fundamental", "noteworthy", "remarkable", "substantial", "considerable", "priority", "high priority", "top priority", "remember this", "don't forget"]),
    "emotional": (0.7, ["surprising", "unexpected", "shocking", "amazing", "incredible", "exciting", "thrilling", "alarming", "concerning", "worrying", "breakthrough", "discovery", "revelation", "game-changer"]),
    "temporal": (0.6, ["deadline", "due", "expires", "time-sensitive", "limited time", "soon", "quickly", "immediately", "now", "today", "this week", "before", "until", "by"]),
    "negative": (0.5, ["problem", "issue", "bug", "error", "failure", "risk", "danger", "warning", "alert", "caution", "concern", "threat", "vulnerability", "critical bug", "security issue", "data loss"]),
    "positive": (0.5, ["success", "achievement", "milestone", "completed", "solved", "accomplished", "victory", "win", "breakthrough", "innovation", "excellent", "outstanding", "exceptional"]),
    "moderate": (0.4, ["notable", "relevant", "useful", "helpful", "valuable", "worth noting", "interesting", "attention", "note", "reminder", "tip", "advice"]),
}


def salient_words() -> list[tuple[str, float]]:
    """(words, weight) of every category; signs inside count as blanks."""
    return [(re.sub(r"[^a-z]+", " ", w), weight) for weight, words in SALIENT.values() for w in words]


def age_days(at: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400e6)


def activation(observation: DataFrame, now: str, decay: float = 0.0, least: float = 0.15) -> DataFrame:
    """(id, activation, retain): exp(-t (1 - decay) / S) with S = min(20, 1 + accesses); t in days since the last access.

    Accesses and the last access are in the metadata (``access_count``,
    ``last_accessed_at``); without them none and the record's own time count.
    """
    count = F.coalesce(F.get_json_object("metadata", "$.access_count").cast("double"), F.lit(0.0))
    last = F.coalesce(F.to_timestamp(F.get_json_object("metadata", "$.last_accessed_at")), F.col("valid_from").cast("timestamp"))
    t = F.greatest(age_days(last, now), F.lit(0.0))
    r = F.round(F.exp(-t * (1 - decay) / F.least(F.lit(20.0), 1 + count)), 6)
    return observation.select("id", r.alias("activation")).withColumn("retain", F.col("activation") >= least)


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(band, n): number of rows with value in [edge i, edge i + 1), the last open to the top; below the first edge: band -1."""
    band = F.lit(-1)
    for i, low in enumerate(edges):
        band = F.when(F.col(column) >= low, i).otherwise(band) if i == 0 else F.when(F.col(column) >= low, F.lit(i)).otherwise(band)
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def salience(observation: DataFrame) -> DataFrame:
    """(id, salience, band): whole-word matches of salient words; min(1, largest + 0.2 (sum - largest)); high from 0.7, medium 0.4, low 0.3."""
    plain = tx.plain(F.col("text"))
    values = F.array(*[F.when(plain.contains(f" {w} "), F.lit(float(v))).otherwise(0.0) for w, v in salient_words()])
    o = observation.filter("text IS NOT NULL").select("id", values.alias("v"))
    top, total = F.array_max("v"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    o = o.select("id", F.round(F.least(F.lit(1.0), top + (total - top) * 0.2), 6).alias("salience"))
    return o.withColumn("band", F.when(F.col("salience") >= 0.7, "high").when(F.col("salience") >= 0.4, "medium").when(F.col("salience") >= 0.3, "low").otherwise("neutral"))


def keywords(observation: DataFrame, limit: int = 10) -> DataFrame:
    """(entity_id, keyword, n): the most frequent words of an entity's notes: four letters or more, no stop words or numbers, at least twice."""
    w = observation.filter("entity_id IS NOT NULL").select("entity_id", F.explode(tx.words(F.col("text"))).alias("keyword"))
    w = w.filter((F.length("keyword") >= 4) & ~F.col("keyword").rlike(r"^\d+$") & ~F.col("keyword").isin(tx.STOP))
    n = w.groupBy("entity_id", "keyword").agg(F.count("*").alias("n")).filter("n >= 2")
    order = Window.partitionBy("entity_id").orderBy(F.col("n").desc(), "keyword")
    return n.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= limit).drop("no")


def tags(observation: DataFrame) -> DataFrame:
    """(tag, n): tags in notes, ``#word`` or ``category:``, ``type:``, ``topic:``, ``subject:`` and a word, in lower case."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"(#[\p{L}\p{N}_]+|\b(?:category|type|topic|subject):\s*[\p{L}\p{N}_]+)"), 1)
    return observation.select(F.explode(found).alias("tag")).groupBy(F.regexp_replace("tag", r"\s+", "").alias("tag")).agg(F.count("*").alias("n"))


def importance(observation: DataFrame, rank: DataFrame, now: str) -> DataFrame:
    """(id, importance): 0.4 pagerank + 0.3 * 0.5^(hours / 720) + 0.3 min(1, accesses / 100)."""
    count = F.coalesce(F.get_json_object("metadata", "$.access_count").cast("double"), F.lit(0.0))
    o = observation.join(rank.select(F.col("node").alias("entity_id"), "pagerank"), "entity_id", "left")
    score = 0.4 * F.coalesce("pagerank", F.lit(0.0)) + 0.3 * F.pow(F.lit(0.5), age_days(F.col("valid_from"), now) * 24 / 720) + 0.3 * F.least(F.lit(1.0), count / 100)
    return o.select("id", F.round(score, 6).alias("importance"))


def compaction(observation: DataFrame, threshold: int = 20) -> DataFrame:
    """(id, entity_id): notes to compact: of entities with more than ``threshold`` notes all but the newest threshold // 2."""
    o = observation.filter("entity_id IS NOT NULL").select("id", "entity_id", "valid_from")
    many = o.groupBy("entity_id").count().filter(F.col("count") > threshold).select("entity_id")
    # what stays is a short list per entity, found by a top-k that is cut before the shuffle
    order = Window.partitionBy("entity_id").orderBy(F.col("valid_from").desc(), F.col("id").desc())
    stay = o.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= threshold // 2).select("id")
    return o.join(many, "entity_id", "left_semi").join(stay, "id", "left_anti").select("id", "entity_id")


def cleanup_notes(observation: DataFrame, degree: DataFrame, now: str, days: int = 30, most_degree: int = 2) -> DataFrame:
    """The notes older than ``days`` of entities with a degree below ``most_degree``."""
    d = degree.select(F.col("node").alias("entity_id"), "degree")
    old = observation.filter("entity_id IS NOT NULL").filter(age_days(F.col("valid_from"), now) > days)
    return old.join(d, "entity_id", "left").filter(F.coalesce("degree", F.lit(0)) < most_degree)


def cleanup(observation: DataFrame, degree: DataFrame, now: str, days: int = 30, most_degree: int = 2) -> DataFrame:
    """(entity_id, n_notes, level): such notes by entity, to be summarised one level up."""
    level = F.coalesce(F.get_json_object("metadata", "$.memory_level").cast("int"), F.lit(0))
    o = cleanup_notes(observation, degree, now, days, most_degree)
    return o.groupBy("entity_id").agg(F.count("*").alias("n_notes"), (F.max(level) + 1).alias("level"))


def inactive_sessions(session: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """(session_id, idle_minutes): sessions that are active or open and silent for ``minutes``; epoch seconds and milliseconds are told apart by size."""
    at = F.when(F.col("last_active") > 100_000_000_000, F.col("last_active") / 1000).otherwise(F.col("last_active").cast("double"))
    s = session.filter("session_id IS NOT NULL AND session_id <> ''").groupBy("session_id").agg(F.max(at).alias("at"), F.max(F.lower("status").isin("active", "open")).alias("live"))
    idle = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.col("at")) / 60)
    return s.filter("live").select("session_id", idle.cast("long").alias("idle_minutes")).filter(F.col("idle_minutes") >= minutes)


def percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the element at floor(n * share) of the sorted values, exactly.

    Values are counted first; running counts over the distinct values come from
    range-partitioned partial sums, so nothing is sorted in one task.
    """
    from palimpsest.session import stored

    c = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    parts = stored(c.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "counts")
    sums = parts.groupBy("p").agg(F.sum("n").alias("s"))
    before = sums.alias("a").join(sums.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy(F.col("a.p").alias("p")).agg(F.coalesce(F.sum("b.s"), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = parts.join(F.broadcast(before), "p").withColumn("upto", upto)  # as many rows as partitions
    total = sums.agg(F.sum("s").alias("total"))
    wanted = df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double").join(F.broadcast(total)).withColumn("at", F.floor(F.col("total") * F.col("share")))
    return run.join(F.broadcast(wanted), (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select("share", F.col("v").alias("value"))


def promotion(observation: DataFrame, importance: DataFrame, now: str, least_notes: int = 10, cut: float = 0.5) -> DataFrame:
    """(id, entity_id, memory_level, action) of notes that are due for compression.

    A note of level 0, 1 or 2 is due when it is older than its level is kept (1,
    7 or 30 days) and its entity has ``least_notes`` due notes of that level. It
    is promoted to the next level if its importance is ``cut`` or more, deleted
    otherwise; the summary's text is not written here.
    """
    level = F.coalesce(F.get_json_object("metadata", "$.memory_level").cast("int"), F.lit(0))
    keep = F.when(F.col("memory_level") == 0, 1.0).when(F.col("memory_level") == 1, 7.0).when(F.col("memory_level") == 2, 30.0)
    o = observation.filter("entity_id IS NOT NULL").withColumn("memory_level", level).filter(age_days(F.col("valid_from"), now) > keep)
    many = o.groupBy("entity_id", "memory_level").count().filter(F.col("count") >= least_notes).select("entity_id", "memory_level")
    due = o.join(many, ["entity_id", "memory_level"], "left_semi").join(importance.select("id", "importance"), "id", "left")
    return due.select("id", "entity_id", "memory_level", F.when(F.coalesce("importance", F.lit(0.0)) >= cut, "promote").otherwise("delete").alias("action"))


def reflect(observation: DataFrame, limit: int = 5, least: int = 2) -> DataFrame:
    """(entity_id, n_notes): the ``limit`` entities with the most notes, ``least`` or more, of which a summary would be written."""
    n = observation.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("n_notes")).filter(F.col("n_notes") >= least)
    return n.orderBy(F.col("n_notes").desc(), "entity_id").limit(limit)
