"""Ranked retrieval: vectors, keywords, full text, and the scores that refine them.

Every ranking ends with a total order (score descending, then id), so results
are the same on every run and every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx


def positive(limit: int, default: int = 10) -> int:
    """A limit; zero and less mean the default."""
    return limit if limit and limit > 0 else default


def vector_scores(df: DataFrame, query: list[float], column: str = "embedding", out: str = "score") -> DataFrame:
    """Cosine similarity of each row's vector to the query, rounded to 6 digits; rows without a usable vector are left out."""
    return df.withColumn(out, F.round(vx.cosine_to(F.col(column), query), 6)).filter(F.col(out).isNotNull())


def top(df: DataFrame, limit: int, score: str = "score", key: str = "id") -> DataFrame:
    """The ``limit`` best rows: a distributed top-k, no full sort."""
    return df.orderBy(F.col(score).desc(), F.col(key)).limit(positive(limit))


def keyword_scores(df: DataFrame, query: str, column: str = "name", least: float = 0.1) -> DataFrame:
    """Sparse path: number of query words (longer than two letters) in the text over the text's length."""
    terms = sorted({w for w in query.lower().split() if len(w) > 2})
    score = F.round(tx.contains_any(F.col(column), terms) / F.length(column), 6)
    return df.filter(F.length(column) > 0).withColumn("score", score).filter(F.col("score") >= least)


def full_text_scores(df: DataFrame, query: str, column: str = "text", key: str = "id") -> DataFrame:
    """(key, score) of the rows that hold a query word: sum of tf * ln(1 + N / df) over stemmed words.

    One pass builds postings of the query's words only; N and the document
    frequencies are counted over all rows. Null texts hold nothing.
    """
    terms = F.array(*[tx.stem(F.lit(w)) for w in sorted({w for w in query.lower().split() if w not in tx.STOP})])
    rows = df.filter(F.col(column).isNotNull())
    post = rows.select(key, F.explode(tx.words(F.col(column))).alias("w")).withColumn("w", tx.stem(F.col("w"))).filter(F.array_contains(terms, F.col("w")))
    tf = post.groupBy(key, "w").agg(F.count("*").alias("tf"))
    df_ = tf.groupBy("w").agg(F.count("*").alias("df"))
    n = rows.agg(F.count("*").alias("n"))
    weights = df_.join(F.broadcast(n)).select("w", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # one row per query word
    return tf.join(F.broadcast(weights), "w").groupBy(key).agg(F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("score"))


def time_decay(score: Column, at: Column, now: Column, half_life_hours: float = 24 * 90) -> Column:
    """Score halved every ``half_life_hours`` of age."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3.6e9)
    return score * F.pow(F.lit(0.5), age / half_life_hours)


def context_boost(score: Column, same_task: Column, same_session: Column) -> Column:
    """Score times 1 + 0.5 (same task) + 0.3 (same session), at most 1; null flags count as false."""
    yes = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.least(F.lit(1.0), score * (1 + yes(same_task, 0.5) + yes(same_session, 0.3)))


def min_max(df: DataFrame, score: str, out: str) -> DataFrame:
    """Score scaled to [0, 1] over the result set; 1 where all are equal. The extremes are aggregated, not windowed."""
    ends = df.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    width = F.col("_high") - F.col("_low")
    return df.join(F.broadcast(ends)).withColumn(out, F.when(width > 0, (F.col(score) - F.col("_low")) / width).otherwise(1.0)).drop("_low", "_high")


def has_relation(df: DataFrame, relationship: DataFrame, types: list[str] | None = None, targets: list[str] | None = None, key: str = "id") -> DataFrame:
    """Rows whose entity has a relation, in either direction, of one of the types and to one of the targets (where given)."""
    r = relationship.filter(F.col("relation_type").isin(types)) if types else relationship
    ends = r.select(F.col("from_id").alias(key), F.col("to_id").alias("_other")).unionByName(r.select(F.col("to_id").alias(key), F.col("from_id").alias("_other")))
    if targets:
        ends = ends.filter(F.col("_other").isin(targets))
    return df.join(ends.select(key).distinct(), key, "left_semi")


def with_rank(df: DataFrame, rank: DataFrame, key: str = "id") -> DataFrame:
    """``pagerank`` of each row's entity, 0 where there is none."""
    return df.join(rank.select(F.col("entity_id").alias(key), "pagerank"), key, "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
