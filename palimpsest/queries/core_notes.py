"""Queries on pairs of notes of one entity, for a stated set of notes or texts (one in a hundred, against all), and on islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import nearest, traverse, within
from palimpsest.operators.components import connected_components
from palimpsest.operators.versioned import current
from palimpsest.queries.base import NOW, E, O, R, now
from palimpsest.tables import load

SIZE = 96
#: The instant at which conflicts are resolved, and the first of the 365 days that patterns look at.
RESOLVED, SINCE = "2025-12-31 00:00:00", "2024-07-01 00:00:00"
COLUMNS = ["id", "valid_from", "asserted", "entity_id", "text", "metadata", "embedding"]


def _notes(spark, sf):
    return now(spark, sf, "observation", ["entity_id", "text", "embedding"])


def _since():
    return F.lit(SINCE).cast("timestamp")


def note_conflicts(spark, sf):
    """Conflicts of each note of the stated set with the notes of its entity."""
    return within.conflicts(_notes(spark, sf), nearest.one_in("id"), SIZE)


def conflicts_resolved(spark, sf):
    """Notes that are left, and notes about resolutions, per entity after the conflicts of the stated set were resolved."""
    log = load(spark, sf, "observation").select(*COLUMNS)
    left = current(within.resolved(log, note_conflicts(spark, sf), F.lit(RESOLVED).cast("timestamp")), ["id"])
    audit = F.coalesce(F.get_json_object("metadata", "$.conflict_resolution"), F.lit("false"))
    return left.groupBy("entity_id", audit.alias("audit")).agg(F.count("*").alias("n_notes"))


def recurring_series(spark, sf):
    """Series like the notes of the stated set that come back at even intervals."""
    return within.recurring_series(_notes(spark, sf), nearest.one_in("id"), SIZE, _since())


def correlated_notes(spark, sf):
    """Texts of the stated set that are noted again and again close to another text of the entity."""
    return within.correlated_notes(_notes(spark, sf), nearest.one_in("text"), SIZE, _since())


def island_bridges(spark, sf):
    """A relation for each small island of the stated set that ties it to the rest."""
    of = connected_components(traverse.edges(now(spark, sf, "relationship", ["strength"])).select("src", "dst"))
    return nearest.island_bridges(of, now(spark, sf, "entity", ["embedding"]), nearest.one_in("component"), SIZE)


QUERIES = {f.__name__: f for f in (note_conflicts, conflicts_resolved, recurring_series, correlated_notes, island_bridges)}


def _asked(column: str) -> str:
    return f"('0x' || substr(md5({column}), 1, 8))::UBIGINT % 100 = 0"


def _says(words: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"contains(w, '{x}')" for x in words) + ", false)"


_GOOD = "len(embedding) = 96 AND list_max(list_transform(embedding, lambda z: abs(z))) > 0"
_NOTES = f"n AS (SELECT id, entity_id, text, valid_from, epoch_us(valid_from) AS t, lower(text) AS w, coalesce({_GOOD}, false) AS ok, CASE WHEN ok THEN embedding::DOUBLE[] ELSE list_resize([1.0::DOUBLE], 96, 1.0::DOUBLE) END AS v FROM o WHERE trim(entity_id) <> '')"
_SIM = "CASE WHEN a.ok AND b.ok THEN round(list_cosine_similarity(a.v, b.v), 6) ELSE 0 END"
_SAID = [f"((a.p{i} OR a.n{i} OR b.p{i} OR b.n{i})::INT)" for i in range(len(within.CONTRARY))]
_AGAINST = [f"(((a.p{i} AND b.n{i}) OR (a.n{i} AND b.p{i}))::INT)" for i in range(len(within.CONTRARY))]
_CONFLICTS = f"""
WITH {O}, {_NOTES},
f AS (SELECT *, {_asked("id")} AS asked, {", ".join(f"{_says(p)} AS p{i}, {_says(n)} AS n{i}" for i, (p, n) in enumerate(within.CONTRARY))},
  {" + ".join(f"coalesce(contains(w, '{x}'), false)::INT" for x in within.REPLACING)} AS n_new FROM n),
x AS (
  SELECT a.id AS older_id, b.id AS newer_id, a.entity_id, {_SIM} AS s, ({" + ".join(_AGAINST)}) / greatest(1, {" + ".join(_SAID)}) AS share, least(b.n_new / 3, 1.0) AS updates
  FROM f a JOIN f b ON a.entity_id = b.entity_id AND (a.t < b.t OR (a.t = b.t AND a.id < b.id)) AND b.t - a.t <= 365 * 86400000000 WHERE a.asked OR b.asked),
y AS (SELECT *, CASE WHEN s >= 0.85 THEN 'temporal_redundancy' WHEN share > 0.25 THEN 'semantic_contradiction' WHEN s > 0.4 AND s < 0.85 AND updates > 0.6 THEN 'superseded_fact' END AS conflict_type FROM x),
c AS (SELECT older_id, newer_id, entity_id, conflict_type, round(CASE WHEN s >= 0.85 THEN s WHEN share > 0.25 THEN share ELSE updates END, 6)::DOUBLE AS confidence FROM y WHERE conflict_type IS NOT NULL)"""
SQL = {
    "note_conflicts": _CONFLICTS + " SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM c",
    "conflicts_resolved": _CONFLICTS + """ SELECT entity_id, audit, count(*) AS n_notes FROM (
  SELECT entity_id, 'false' AS audit FROM o WHERE id NOT IN (SELECT older_id FROM c) UNION ALL SELECT entity_id, 'true' FROM c) GROUP BY ALL""",
    "recurring_series": f"""
WITH {O}, {_NOTES}, m AS (SELECT * FROM n WHERE valid_from >= TIMESTAMP '{SINCE}'),
x AS (SELECT a.id, a.entity_id, b.id AS other, b.t / 86400e6 AS day FROM m a JOIN m b ON a.entity_id = b.entity_id WHERE {_asked("a.id")} AND (a.id = b.id OR {_SIM} >= 0.75)),
y AS (SELECT *, day - lag(day) OVER (PARTITION BY id ORDER BY day, other) AS gap FROM x),
g AS (SELECT id, entity_id, count(*) AS frequency, avg(gap) AS mean, round(stddev_pop(gap) / avg(gap), 6) AS cv FROM y GROUP BY ALL HAVING count(*) >= 3 AND avg(gap) > 0)
SELECT id, entity_id, frequency, round(mean, 4) AS interval_days, round(1 - cv, 6) AS confidence FROM g WHERE cv < 0.3 AND round(1 - cv, 6) >= 0.6""",
    "correlated_notes": f"""
WITH {O}, {_NOTES}, m AS (SELECT *, md5(text) AS said, {_asked("text")} AS asked FROM n WHERE valid_from >= TIMESTAMP '{SINCE}' AND text IS NOT NULL),
x AS (SELECT a.entity_id, least(a.said, b.said) AS text_a, greatest(a.said, b.said) AS text_b FROM m a JOIN m b ON a.entity_id = b.entity_id AND a.id < b.id AND abs(a.t - b.t) <= 2 * 86400000000
  WHERE (a.asked OR b.asked) AND {_SIM} < 0.5)
SELECT entity_id, text_a, text_b, count(*) AS frequency, round(least(1, count(*) / 6), 6)::DOUBLE AS confidence FROM x GROUP BY ALL HAVING count(*) >= 3 AND round(least(1, count(*) / 6), 6) >= 0.6""",
    "island_bridges": f"""
WITH RECURSIVE {E}, {R}, g AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM r WHERE from_id <> to_id), h AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
c(node, root) AS (SELECT src, src FROM h UNION SELECT h.dst, c.root FROM c JOIN h ON h.src = c.node), k AS (SELECT node, min(root) AS component FROM c GROUP BY 1),
i AS (SELECT * FROM k WHERE component IN (SELECT component FROM k GROUP BY 1 HAVING count(*) <= 3) AND {_asked("component")}),
u AS (SELECT id, embedding::DOUBLE[] AS v FROM e WHERE {_GOOD}),
s AS (SELECT component, a.id AS from_id, b.id AS to_id, round(list_cosine_similarity(a.v, b.v), 6) AS strength FROM i JOIN u a ON a.id = node JOIN u b ON a.id <> b.id)
SELECT component, from_id, to_id, 'semantically_related' AS relation_type, strength FROM s WHERE strength >= 0.7 AND (component, to_id) NOT IN (SELECT (component, node) FROM i)
QUALIFY row_number() OVER (PARTITION BY component ORDER BY strength DESC, from_id, to_id) = 1""",
}
