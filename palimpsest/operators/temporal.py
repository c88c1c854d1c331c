"""Patterns over time: recurring, seasonal and trending notes, correlated relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx

DAY = 86_400_000_000  # microseconds


def _days(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(float(DAY))


def recurring(observation: DataFrame, least: int = 3, most_cv: float = 0.3, least_confidence: float = 0.6) -> DataFrame:
    """(entity_id, pattern, frequency, interval_days, confidence): notes of one wording that come back at even intervals.

    Notes of an entity whose words are the same but for numbers form a series;
    the coefficient of variation of its gaps (population) must be below
    ``most_cv``; confidence is 1 - cv. One pass over sorted series, no group is
    collected.
    """
    words = F.filter(tx.words(F.col("text")), lambda w: ~w.rlike(r"\d"))
    o = observation.filter("text IS NOT NULL AND entity_id IS NOT NULL").select("entity_id", F.md5(F.array_join(words, " ")).alias("pattern"), "id", _days("valid_from").alias("day"))
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("entity_id", "pattern").orderBy("day", "id"))
    g = o.withColumn("gap", gap).groupBy("entity_id", "pattern").agg(F.count("*").alias("frequency"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    g = g.filter((F.col("frequency") >= least) & (F.col("mean") > 0)).withColumn("confidence", F.round(1 - F.col("sd") / F.col("mean"), 6))
    return g.filter((F.col("confidence") > 1 - most_cv) & (F.col("confidence") >= least_confidence)).select("entity_id", "pattern", "frequency", F.round("mean", 6).alias("interval_days"), "confidence")


def interarrival(observation: DataFrame) -> DataFrame:
    """(entity_id, n_notes, mean_gap, sd_gap) in days, for entities with two notes or more.

    The mean needs only the first and last note; the deviation sums squares of
    gaps over notes ordered per entity and month, whose borders are joined from
    pre-aggregated firsts and lasts, so a hot entity is spread over its months.
    """
    o = observation.filter("entity_id IS NOT NULL").select("entity_id", "id", _days("valid_from").alias("day"), F.date_format("valid_from", "yyyy-MM").alias("month"))
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("entity_id", "month").orderBy("day", "id"))
    inner = o.withColumn("gap", gap).groupBy("entity_id", "month").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.sum(F.col("gap") * F.col("gap")).alias("sq"))
    jump = F.col("first") - F.lag("last").over(Window.partitionBy("entity_id").orderBy("month"))
    g = inner.withColumn("jump", jump).groupBy("entity_id").agg(
        F.sum("n").alias("n"), F.min("first").alias("a"), F.max("last").alias("b"), (F.sum(F.coalesce("sq", F.lit(0.0))) + F.sum(F.coalesce(F.col("jump") * F.col("jump"), F.lit(0.0)))).alias("sq")
    )
    g = g.filter("n > 1").withColumn("mean", (F.col("b") - F.col("a")) / (F.col("n") - 1))
    sd = F.sqrt(F.greatest(F.col("sq") / (F.col("n") - 1) - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return g.select("entity_id", F.col("n").alias("n_notes"), F.round("mean", 4).alias("mean_gap"), F.round(sd, 4).alias("sd_gap"))


def trending(observation: DataFrame, least: int = 3, most_gap: float = 7.0) -> DataFrame:
    """(entity_id, n_notes, mean_gap): entities with at least ``least`` notes less than ``most_gap`` days apart on average."""
    o = observation.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("n_notes"), F.min(_days("valid_from")).alias("a"), F.max(_days("valid_from")).alias("b"))
    gap = F.round((F.col("b") - F.col("a")) / (F.col("n_notes") - 1), 6)
    return o.filter(F.col("n_notes") >= least).withColumn("mean_gap", gap).filter(F.col("mean_gap") < most_gap).select("entity_id", "n_notes", "mean_gap")


def seasonal(observation: DataFrame, least: int = 3, least_ratio: float = 2.0) -> DataFrame:
    """(entity_id, month, n_notes, confidence): calendar months (UTC) with at least twice an entity's monthly average."""
    by = observation.filter("entity_id IS NOT NULL").groupBy("entity_id", F.month("valid_from").alias("month")).agg(F.count("*").alias("n_notes"))
    total = by.groupBy("entity_id").agg(F.sum("n_notes").alias("total"))  # at most twelve rows an entity
    ratio = F.col("n_notes") * 12 / F.col("total")
    out = by.join(total, "entity_id").withColumn("ratio", ratio).filter((F.col("ratio") >= least_ratio) & (F.col("n_notes") >= least))
    return out.select("entity_id", "month", "n_notes", F.round(F.least(F.lit(1.0), F.col("ratio") / 3), 6).alias("confidence"))


def correlated(relationship: DataFrame, days: int = 2, least: int = 3) -> DataFrame:
    """(type_a, type_b, n_pairs, confidence): types of relations of one entity that begin within ``days`` days of each other.

    Interval join by day: counts per entity, day and type are aggregated first
    and joined with those of the following days, so the work per entity is
    bounded by its days and types, however many relations it has.
    """
    day = F.floor(_days("valid_from")).cast("int").alias("day")
    c = relationship.filter("from_id IS NOT NULL").groupBy("from_id", "relation_type", day).agg(F.count("*").alias("n"))
    b = c.select("from_id", F.col("relation_type").alias("type_b"), F.col("n").alias("n_b"), F.explode(F.sequence(F.col("day") - days, F.col("day") + days)).alias("day"))
    pairs = c.join(b, ["from_id", "day"]).filter("relation_type < type_b")
    g = pairs.groupBy(F.col("relation_type").alias("type_a"), "type_b").agg(F.sum(F.col("n") * F.col("n_b")).alias("n_pairs")).filter(F.col("n_pairs") >= least)
    return g.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n_pairs") / 6), 6))
