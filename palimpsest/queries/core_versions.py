"""Queries on versions: as-of reads, history, retraction, evolution, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import versioned
from palimpsest.queries.base import E, O, R, now
from palimpsest.tables import KEYS, load

AT, LATER = "2024-07-01 00:00:00", "2025-01-01 00:00:00"


def as_of_latest(spark, sf):
    """Entities as they were at an instant."""
    e = load(spark, sf, "entity").select("id", "valid_from", "asserted", "name", "type")
    return versioned.as_of(e, KEYS["entity"], versioned.parse_as_of(AT)).select("id", "name", "type", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("since"))


def entity_details_as_of(spark, sf):
    """Entities at an instant with the number of their notes and outgoing relations at the same instant."""
    at = versioned.parse_as_of(AT)
    e, o, r = (versioned.as_of(load(spark, sf, t).select(*KEYS[t], "valid_from", "asserted", *c), KEYS[t], at) for t, c in (("entity", ["name"]), ("observation", ["entity_id"]), ("relationship", [])))
    notes = o.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n_notes"))
    links = r.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_links"))
    out = e.select("id", "name").join(notes, "id", "left").join(links, "id", "left")
    return out.select("id", "name", F.coalesce("n_notes", F.lit(0)).cast("long").alias("n_notes"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def history_log(spark, sf):
    """Every version of every entity with its number."""
    e = load(spark, sf, "entity").select("id", "valid_from", "asserted", "name")
    return versioned.history(e, KEYS["entity"]).select("id", "version_no", "asserted", "name", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("at"))


def retraction_hidden(spark, sf):
    """Keys whose latest version is a retraction, per relation."""
    parts = []
    for t, keys in KEYS.items():
        log = load(spark, sf, t).select(*keys, "valid_from", "asserted")
        latest = log.groupBy(*keys).agg(F.max(F.struct("valid_from", (~F.col("asserted")).alias("gone"))).alias("last"))
        parts.append(latest.agg(F.sum(F.col("last.gone").cast("long")).alias("n_hidden")).select(F.lit(t).alias("relation"), "n_hidden"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def relation_evolution(spark, sf):
    """Version log of relations between two instants, added and removed per type and month."""
    log = versioned.evolution(load(spark, sf, "relationship").select(*KEYS["relationship"], "valid_from", "asserted"), KEYS["relationship"], AT, LATER)
    return log.groupBy("relation_type", F.date_format("valid_from", "yyyy-MM").alias("month")).agg(
        F.sum((F.col("op") == "ASSERTED").cast("long")).alias("n_added"), F.sum((F.col("op") == "RETRACTED").cast("long")).alias("n_removed")
    )


def _counts(spark, sf, at):
    parts = []
    for t, keys in KEYS.items():
        live = versioned.as_of(load(spark, sf, t).select(*keys, "valid_from", "asserted"), keys, at)
        parts.append(live.agg(F.count("*").alias("n")).select(F.lit(t).alias("relation"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def snapshot_counts(spark, sf):
    """Number of current records per relation."""
    return _counts(spark, sf, None)


def snapshot_diff(spark, sf):
    """How the numbers of records changed between two instants."""
    a, b = _counts(spark, sf, AT).withColumnRenamed("n", "n_before"), _counts(spark, sf, LATER).withColumnRenamed("n", "n_after")
    return a.join(b, "relation").withColumn("delta", F.col("n_after") - F.col("n_before"))


def retract_and_merge(spark, sf):
    """The log after retracting what has no type and merging a mark into the metadata of the rest."""
    log = load(spark, sf, "entity").select("id", "valid_from", "asserted", "name", "type", "metadata")
    live = versioned.current(log, ["id"])
    at = F.lit("2025-12-31").cast(dict(log.dtypes)["valid_from"])
    log = versioned.retract(log, ["id"], live.filter("type IS NULL"), at)
    marked = live.filter("type IS NOT NULL").withColumn("metadata", versioned.merge_metadata(F.col("metadata"), F.lit('{"reviewed":"yes"}')))
    after = versioned.current(versioned.assert_rows(log, marked.select("id", "name", "type", "metadata"), at), ["id"])
    return after.select("id", F.get_json_object("metadata", "$.category").alias("category"), F.get_json_object("metadata", "$.reviewed").alias("reviewed"))


def delete_cascade(spark, sf):
    """What is left of each relation once all entities of type Task and all that hangs on them are removed."""
    gone = now(spark, sf, "entity", ["type"]).filter("lower(type) = 'task'")
    e, o, r = (load(spark, sf, t) for t in KEYS)
    left = {
        "entity": versioned.purge(e.select("id"), gone, {"id": "id"}),
        "observation": versioned.purge(o.select("entity_id"), gone, {"entity_id": "id"}),
        "relationship": versioned.purge(versioned.purge(r.select("from_id", "to_id"), gone, {"from_id": "id"}), gone, {"to_id": "id"}),
    }
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("relation"), "n_rows") for t, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _at(table: str, name: str, at: str) -> str:
    keys = ", ".join(KEYS[table])
    return f"{name} AS (SELECT * FROM (SELECT * FROM {table} WHERE valid_from <= '{at}' QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY valid_from DESC, asserted) = 1) WHERE asserted)"


_THREE = "SELECT 'entity' AS relation, (SELECT count(*) FROM {0}) AS n UNION ALL SELECT 'observation', (SELECT count(*) FROM {1}) UNION ALL SELECT 'relationship', (SELECT count(*) FROM {2})"
QUERIES = {
    f.__name__: f
    for f in (as_of_latest, entity_details_as_of, history_log, retraction_hidden, relation_evolution, snapshot_counts, snapshot_diff, retract_and_merge, delete_cascade)
}
SQL = {
    "as_of_latest": f"WITH {_at('entity', 'x', AT)} SELECT id, name, type, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS since FROM x",
    "entity_details_as_of": f"WITH {_at('entity', 'x', AT)}, {_at('observation', 'y', AT)}, {_at('relationship', 'z', AT)} "
    "SELECT id, name, (SELECT count(*) FROM y WHERE y.entity_id = x.id) AS n_notes, (SELECT count(*) FROM z WHERE z.from_id = x.id) AS n_links FROM x",
    "history_log": "SELECT id, row_number() OVER (PARTITION BY id ORDER BY valid_from, asserted DESC) AS version_no, asserted, name, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS at "
    "FROM (SELECT DISTINCT id, valid_from, asserted, name FROM entity)",
    "retraction_hidden": " UNION ALL ".join(
        f"SELECT '{t}' AS relation, count(*) FILTER (WHERE NOT asserted) AS n_hidden FROM (SELECT asserted FROM {t} QUALIFY row_number() OVER (PARTITION BY {', '.join(k)} ORDER BY valid_from DESC, asserted) = 1)"
        for t, k in KEYS.items()
    ),
    "relation_evolution": f"SELECT relation_type, strftime(valid_from, '%Y-%m') AS month, count(*) FILTER (WHERE asserted) AS n_added, count(*) FILTER (WHERE NOT asserted) AS n_removed "
    f"FROM (SELECT DISTINCT from_id, to_id, relation_type, valid_from, asserted FROM relationship) WHERE valid_from BETWEEN '{AT}' AND '{LATER}' GROUP BY ALL",
    "snapshot_counts": f"WITH {E}, {O}, {R} " + _THREE.format("e", "o", "r"),
    "snapshot_diff": "WITH " + ", ".join(_at(t, n + s, a) for s, a in (("1", AT), ("2", LATER)) for t, n in (("entity", "x"), ("observation", "y"), ("relationship", "z")))
    + f", a AS ({_THREE.format('x1', 'y1', 'z1')}), b AS ({_THREE.format('x2', 'y2', 'z2')}) SELECT a.relation, a.n AS n_before, b.n AS n_after, b.n - a.n AS delta FROM a JOIN b USING (relation)",
    "retract_and_merge": f"WITH {E} SELECT id, json_extract_string(metadata, '$.category') AS category, 'yes' AS reviewed FROM e WHERE type IS NOT NULL",
    "delete_cascade": f"WITH {E}, g AS (SELECT id FROM e WHERE lower(type) = 'task') SELECT 'entity' AS relation, (SELECT count(*) FROM entity x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = x.id)) AS n_rows "
    "UNION ALL SELECT 'observation', (SELECT count(*) FROM observation x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = x.entity_id)) "
    "UNION ALL SELECT 'relationship', (SELECT count(*) FROM relationship x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = x.from_id) AND NOT EXISTS (SELECT 1 FROM g WHERE g.id = x.to_id))",
}
