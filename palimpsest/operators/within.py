"""Pairs of notes of one entity: a stated set of notes against all notes of their entities, in blocks.

Notes are gathered into blocks of bounded size within their entity; a block of
stated notes meets the blocks of its entity in one matrix product each, and only
pairs that a rule wants leave the task. An entity with very many notes has many
blocks, which are spread over tasks by their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.nearest import usable
from palimpsest.operators.skew import HOT_SHARE, hot_keys, semi_join_hot
from palimpsest.session import stored

#: Notes of a block.
BLOCK = 1000
DAY = 86_400_000_000  # microseconds

#: A rule gets the columns of two blocks (arrays by name) and their similarities, and returns which pairs it wants and more columns of theirs (matrices).
Rule = Callable[[dict, dict, np.ndarray], tuple[np.ndarray, dict]]


def prepared(observation: DataFrame, size: int, **more: Column) -> DataFrame:
    """(id, entity_id, at, vec and ``more``) of notes of an entity: ``at`` in microseconds, ``vec`` a unit vector, zeros without a usable one."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: x.cast("double") / norm)
    vec = F.when(usable("embedding", size), unit).otherwise(F.array_repeat(F.lit(0.0), size))
    o = observation.filter("trim(entity_id) <> ''")
    return o.select("id", "entity_id", F.unix_micros(F.col("valid_from").cast("timestamp")).alias("at"), vec.alias("vec"), *[c.alias(n) for n, c in more.items()])


def _chunked(df: DataFrame) -> DataFrame:
    """``df`` with ``parts`` (blocks of the note's entity) and ``chunk`` (this note's block). Counts of entities above one block are joined, the hottest broadcast."""
    n = stored(df.groupBy("entity_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK), "large")  # at most rows / BLOCK entities
    hot = F.broadcast(n.join(hot_keys(df, "entity_id"), "entity_id", "left_semi"))  # at most 1 / HOT_SHARE entities
    often = df.join(hot, "entity_id")
    rest = df.join(hot, "entity_id", "left_anti").join(n, "entity_id", "left")
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / BLOCK).cast("int")
    return often.unionByName(rest).withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("_n")


def _gathered(df: DataFrame, keys: list[str], columns: list[str], prefix: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("rows"))  # about BLOCK rows
    return g.select(*keys, *[(F.flatten(F.col(f"rows.{c}")) if c == "vec" else F.col(f"rows.{c}")).alias(f"{prefix}_{c}") for c in columns])


def pairs(asked: DataFrame, rows: DataFrame, size: int, rule: Rule, more: str) -> DataFrame:
    """(entity_id, query, id, score and ``more``): pairs of a stated note and another note of its entity that ``rule`` wants.

    Both come from ``prepared``; ids are unique. ``score`` is the cosine in
    double precision rounded to 6 digits, 0 if a vector is not usable. The work
    is stated notes times notes of their entities, in blocks; an empty side
    gives an empty result.
    """
    asked = _chunked(stored(asked, "asked"))
    rows = stored(rows, "rows")
    wanted = asked.select("entity_id").distinct()
    rows = stored(_chunked(semi_join_hot(rows, wanted, ["entity_id"], "left_semi", hot_keys(rows, "entity_id"))), "chunks")
    columns = [c for c in rows.columns if c not in ("entity_id", "parts", "chunk")]
    q = _gathered(asked, ["entity_id", "chunk"], columns, "q").drop("chunk")
    blocks = rows.select("entity_id", "chunk").distinct()
    # each block of stated notes visits every block of its entity
    q = q.join(blocks, "entity_id")
    met = q.join(_gathered(rows, ["entity_id", "chunk"], columns, "r"), ["entity_id", "chunk"])
    extra = [c.split()[0] for c in more.split(", ")] if more else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for one in pdf.to_dict("records"):
                a, b = ({c: np.asarray(one[f"{p}_{c}"]) for c in columns} for p in "qr")
                s = np.round(a["vec"].reshape(-1, size) @ b["vec"].reshape(-1, size).T, 6)
                keep, values = rule(a, b, s)
                i, j = np.nonzero(keep & (a["id"][:, None] != b["id"][None, :]))
                if len(i):
                    yield pd.DataFrame({"entity_id": one["entity_id"], "query": a["id"][i], "id": b["id"][j], "score": s[i, j]} | {c: values[c][i, j] for c in extra})

    return met.mapInPandas(run, "entity_id string, query string, id string, score double" + (f", {more}" if more else ""))


#: Words that say a thing is so, and words that say it is not, in four respects.
CONTRARY = [
    (["active", "running", "ongoing", "operational", "continued"],
     ["inactive", "discontinued", "cancelled", "stopped", "shut down", "closed", "deprecated", "archived", "ended", "abandoned"]),
    (["yes", "true", "confirmed", "approved", "accepted", "enabled"], ["no", "false", "denied", "rejected", "refused", "disabled"]),
    (["exists", "present", "available", "found", "located"], ["missing", "absent", "unavailable", "not found", "removed", "deleted"]),
    (["increased", "grew", "rose", "higher", "more", "expanded"], ["decreased", "fell", "dropped", "lower", "less", "reduced", "shrunk"]),
]
#: Words of a note that replaces an older one.
REPLACING = [
    "updated", "revised", "changed", "modified", "corrected", "now", "currently", "as of", "latest", "recent",
    "replaced", "superseded", "obsolete", "outdated",
]


def conflicts(observation: DataFrame, asked: Column, size: int, redundant: float = 0.85, contrary: float = 0.25, days: float = 365) -> DataFrame:
    """(older_id, newer_id, entity_id, conflict_type, confidence, level): notes of one entity that contradict or repeat each other.

    Pairs with at least one note for which ``asked`` holds, no more than ``days``
    apart; of notes of one time the smaller id counts as older. In this order:
    temporal_redundancy (similarity ``redundant`` or more, which is the
    confidence), semantic_contradiction (in more than the share ``contrary`` of
    the respects that either note mentions, one says it is so and the other that
    it is not; words are found anywhere in the lower-cased text),
    superseded_fact (similarity between 0.4 and 0.85, and the newer note holds
    two or more words of replacing; a third each, at most 1). Null texts hold no
    word, notes without an entity are no case.
    """
    low = F.lower("text")

    def says(group: list[str]) -> Column:
        return F.coalesce(F.greatest(*[low.contains(w).cast("int") for w in group]), F.lit(0))

    flags = {f"{s}{i}": says(group) for i, both in enumerate(CONTRARY) for s, group in zip("pn", both, strict=True)}
    n_new = F.coalesce(sum(low.contains(w).cast("int") for w in REPLACING), F.lit(0))
    notes = prepared(observation, size, n_new=n_new, **flags)

    def rule(a: dict, b: dict, s: np.ndarray):
        gap = a["at"][:, None] - b["at"][None, :]
        older = (gap < 0) | ((gap == 0) & (a["id"][:, None] < b["id"][None, :]))
        said, against = np.zeros(s.shape), np.zeros(s.shape)
        for i in range(len(CONTRARY)):
            pa, na, pb, nb = (x > 0 for x in (a[f"p{i}"][:, None], a[f"n{i}"][:, None], b[f"p{i}"][None, :], b[f"n{i}"][None, :]))
            said += pa | na | pb | nb
            against += (pa & nb) | (na & pb)
        share = against / np.maximum(said, 1)
        replaced = np.minimum(np.where(older, b["n_new"][None, :], a["n_new"][:, None]) / 3, 1.0)
        repeats, opposes = s >= redundant, share > contrary
        updates = (s > 0.4) & (s < 0.85) & (replaced > 0.6)
        kind = np.where(repeats, 0, np.where(opposes, 1, 2))
        sure = np.where(repeats, s, np.where(opposes, share, replaced))
        return (repeats | opposes | updates) & (np.abs(gap) <= days * DAY), {"older": older, "kind": kind, "confidence": sure}

    some = notes.join(observation.filter(asked).select("id"), "id", "left_semi")
    found = pairs(some, notes, size, rule, "older boolean, kind int, confidence double")
    names = F.array(*map(F.lit, ("temporal_redundancy", "semantic_contradiction", "superseded_fact")))
    level = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    out = found.select(
        F.when(F.col("older"), F.col("query")).otherwise(F.col("id")).alias("older_id"), F.when(F.col("older"), F.col("id")).otherwise(F.col("query")).alias("newer_id"),
        "entity_id", names[F.col("kind")].alias("conflict_type"), F.round("confidence", 6).alias("confidence"), level.alias("level"),
    )
    return out.dropDuplicates(["older_id", "newer_id"])  # a pair of two stated notes is found from both


def resolved(log: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The note log with the older note of each conflict retracted at ``at`` and a note for each conflict that says so.

    The new notes hang on the same entity; their metadata name both notes, the
    type and the confidence. Their id is the MD5 of what they are about.
    """
    from palimpsest.operators.versioned import assert_rows, retract

    said = F.concat(F.lit("[CONFLICT RESOLVED] "), "conflict_type", F.format_string(": Observation superseded by newer information (confidence: %.1f%%)", 100 * F.col("confidence")))
    about = F.struct(
        F.lit(True).alias("conflict_resolution"), "conflict_type", F.col("newer_id").alias("superseded_by"), F.col("older_id").alias("original_observation"), "confidence",
    )
    notes = found.select(F.md5(F.concat_ws("|", "older_id", "newer_id", "conflict_type")).alias("id"), "entity_id", said.alias("text"), F.to_json(about).alias("metadata"))
    return assert_rows(retract(log, ["id"], found.select(F.col("older_id").alias("id")), at), notes, at)


def recurring_series(observation: DataFrame, asked: Column, size: int, since: Column, least: int = 3, similar: float = 0.75, most_cv: float = 0.3, least_confidence: float = 0.6) -> DataFrame:
    """(id, entity_id, frequency, interval_days, confidence): series of notes like a stated one that come back at even intervals.

    The series of a stated note are the notes of its entity from ``since`` on
    that are at least ``similar`` to it, itself included; a note need not lead
    only one series, so nothing depends on the order of notes. At least
    ``least`` notes; the coefficient of variation of their gaps (population)
    below ``most_cv``, confidence 1 - cv.
    """
    notes = prepared(observation.filter(F.col("valid_from") >= since), size)
    some = notes.join(observation.filter(asked).select("id"), "id", "left_semi")

    def rule(a: dict, b: dict, s: np.ndarray):
        return s >= similar, {"day": np.broadcast_to(b["at"][None, :] / DAY, s.shape)}

    member = pairs(some, notes, size, rule, "day double").select("entity_id", "query", "id", "day")
    own = some.select("entity_id", F.col("id").alias("query"), "id", (F.col("at") / F.lit(float(DAY))).alias("day"))
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("query").orderBy("day", "id"))
    g = member.unionByName(own).withColumn("gap", gap).groupBy("entity_id", "query").agg(F.count("*").alias("frequency"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    g = g.filter((F.col("frequency") >= least) & (F.col("mean") > 0)).withColumn("cv", F.round(F.col("sd") / F.col("mean"), 6))
    g = g.filter(F.col("cv") < most_cv).select(F.col("query").alias("id"), "entity_id", "frequency", F.round("mean", 4).alias("interval_days"), F.round(1 - F.col("cv"), 6).alias("confidence"))
    return g.filter(F.col("confidence") >= least_confidence)


def correlated_notes(observation: DataFrame, asked: Column, size: int, since: Column, days: float = 2, below: float = 0.5, least: int = 3, least_confidence: float = 0.6) -> DataFrame:
    """(entity_id, text_a, text_b, frequency, confidence): texts of one entity noted again and again within ``days`` days of each other.

    Pairs of notes from ``since`` on, less than ``below`` similar, of which one
    has a stated text (``asked`` must depend on ``text`` alone, so that all
    notes of the text take part), counted by their two texts (MD5, the smaller
    first). Confidence is a ``2 least``-th each, at most 1.
    """
    recent = observation.filter((F.col("valid_from") >= since) & F.col("text").isNotNull())
    notes = prepared(recent, size, said=F.md5("text"))
    some = notes.join(recent.filter(asked).select("id"), "id", "left_semi")

    def rule(a: dict, b: dict, s: np.ndarray):
        near = np.abs(a["at"][:, None] - b["at"][None, :]) <= days * DAY
        return near & (s < below), {"said_a": np.broadcast_to(a["said"][:, None], s.shape), "said_b": np.broadcast_to(b["said"][None, :], s.shape)}

    found = pairs(some, notes, size, rule, "said_a string, said_b string")
    two = found.select("entity_id", F.least("query", "id").alias("x"), F.greatest("query", "id").alias("y"), F.least("said_a", "said_b").alias("text_a"), F.greatest("said_a", "said_b").alias("text_b"))
    g = two.distinct().groupBy("entity_id", "text_a", "text_b").agg(F.count("*").alias("frequency"))
    g = g.filter(F.col("frequency") >= least).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("frequency") / (2 * least)), 6))
    return g.filter(F.col("confidence") >= least_confidence)
