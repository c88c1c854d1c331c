"""Which retrieval a query gets: classification of its text, weights of the paths, choice of a strategy from a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that show what a query wants.
INTENTS = {
    "finder": ["what", "when", "where", "who", "how many", "specific", "find", "search", "look for", "get", "retrieve", "latest", "recent", "current", "today", "news"],
    "evaluator": ["compare", "difference", "versus", "vs", "better", "evaluate", "assess", "analyze", "review", "rate", "pros", "cons", "advantages", "disadvantages"],
    "explainer": ["why", "how", "explain", "understand", "about", "describe", "tell me", "what is", "concept", "meaning", "definition", "work", "process"],
    "generator": ["create", "generate", "write", "make", "build", "suggest", "recommend", "example", "template", "code", "script", "plan", "strategy"],
}
PATHS = ["vector", "sparse", "fts", "graph"]
#: Weights of the paths by intent and complexity.
WEIGHTS = {
    intent: {level: dict(zip(PATHS, row, strict=True)) for level, row in zip(("simple", "moderate", "complex", "exploratory"), rows, strict=True)}
    for intent, rows in {
        "finder": [(0.4, 0.5, 0.1, 0.0), (0.45, 0.35, 0.15, 0.05), (0.5, 0.25, 0.15, 0.1), (0.4, 0.2, 0.2, 0.2)],
        "evaluator": [(0.5, 0.3, 0.1, 0.1), (0.5, 0.2, 0.1, 0.2), (0.45, 0.15, 0.1, 0.3), (0.4, 0.1, 0.1, 0.4)],
        "explainer": [(0.6, 0.2, 0.1, 0.1), (0.55, 0.15, 0.1, 0.2), (0.5, 0.1, 0.1, 0.3), (0.45, 0.1, 0.1, 0.35)],
        "generator": [(0.5, 0.3, 0.1, 0.1), (0.45, 0.25, 0.15, 0.15), (0.4, 0.2, 0.2, 0.2), (0.35, 0.15, 0.2, 0.3)],
    }.items()
}


def path_weights(spark: SparkSession, query: str) -> dict[str, float]:
    """The weights of the paths for a query's intent and complexity."""
    c = spark.range(1).select(classify(F.lit(query)).alias("c")).first()["c"]
    return WEIGHTS[c["intent"]][c["complexity"]]


def classify(text: Column) -> Column:
    """struct(intent, confidence, complexity) of a query's text, as an expression; null and blank texts are finders with 0.5."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    hits = {k: sum((F.when(plain.contains(f" {w} "), 1).otherwise(0) for w in ws), F.lit(0)) for k, ws in INTENTS.items()}
    total = sum(hits.values(), F.lit(0))
    top = F.greatest(*hits.values())
    intent = F.coalesce(*[F.when((top > 0) & (h == top), k) for k, h in hits.items()], F.lit("finder"))
    words = F.size(F.filter(F.split(plain, " "), lambda w: w != ""))
    complexity = F.when(words <= 4, "simple").when(words <= 12, "moderate").otherwise("complex")
    return F.struct(intent.alias("intent"), F.when(total > 0, F.round(top / total, 6)).otherwise(0.5).alias("confidence"), complexity.alias("complexity"))


def strategy_scores(log: DataFrame, now: str) -> DataFrame:
    """(strategy, n_runs, score) of a log (strategy, success boolean, cost double, at): 0.6 success + 0.3 / (1 + mean cost) + 0.1 if used within a day."""
    g = log.filter("strategy IS NOT NULL").groupBy("strategy").agg(
        F.count("*").alias("n_runs"), F.avg(F.coalesce(F.col("success").cast("int"), F.lit(0))).alias("success"), F.avg(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.max("at").alias("last")
    )
    recent = F.when(F.col("last") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 DAY"), 0.1).otherwise(0.0)
    return g.select("strategy", "n_runs", F.round(0.6 * F.col("success") + 0.3 / (1 + F.col("cost")) + recent, 6).alias("score"))
