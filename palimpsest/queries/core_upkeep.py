"""Queries on time patterns, upkeep, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import graph, inference, lifecycle, records, temporal, traverse
from palimpsest.queries.base import E, NOW, O, R, now
from palimpsest.sources import formats
from palimpsest.tables import load


def _o(spark, sf, *columns):
    return now(spark, sf, "observation", ["entity_id", *columns])


def interarrival_cv(spark, sf):
    """Mean and deviation of the gaps between an entity's notes."""
    return temporal.interarrival(_o(spark, sf))


def trending(spark, sf):
    """Entities with dense notes."""
    return temporal.trending(_o(spark, sf))


def seasonal_trend(spark, sf):
    """Months in which an entity has unusually many notes."""
    return temporal.seasonal(_o(spark, sf))


def temporal_correlation(spark, sf):
    """Types of relations of one entity that begin within two days of each other."""
    return temporal.correlated(now(spark, sf, "relationship", []))


def recurring_events(spark, sf):
    """Notes of one wording that come back at even intervals."""
    return temporal.recurring(_o(spark, sf, "text"), least_confidence=0.0, most_cv=1.0)


def activation_score(spark, sf):
    """Activation of every note and whether it is retained."""
    return lifecycle.activation(_o(spark, sf, "metadata"), NOW, decay=0.99)


def activation_histogram(spark, sf):
    """Notes by band of activation."""
    return lifecycle.histogram(activation_score(spark, sf), "activation", [0.0, 0.2, 0.4, 0.6, 0.8])


def salience_score(spark, sf):
    """Salience of every note."""
    return lifecycle.salience(_o(spark, sf, "text"))


def keyword_extract(spark, sf):
    """The ten most frequent words of each entity's notes."""
    return lifecycle.keywords(_o(spark, sf, "text"))


def tag_extract(spark, sf):
    """Tags in the texts of notes."""
    return lifecycle.tags(_o(spark, sf, "text"))


def importance_score(spark, sf):
    """Importance of every note."""
    rank = graph.pagerank(traverse.edges(now(spark, sf, "relationship", ["strength"])), 2)
    return lifecycle.importance(_o(spark, sf, "metadata"), rank, NOW)


def level_promotion(spark, sf):
    """Notes due for compression by entity, level and what becomes of them."""
    due = lifecycle.promotion(_o(spark, sf, "metadata"), importance_score(spark, sf), NOW)
    return due.groupBy("entity_id", "memory_level", "action").agg(F.count("*").alias("n_notes"))


def reflect_candidates(spark, sf):
    """The five entities with the most notes."""
    return lifecycle.reflect(_o(spark, sf))


def discovered_relations(spark, sf):
    """Inferred expert relations that are not there yet, by technology."""
    r = now(spark, sf, "relationship", [])
    new = inference.expertise(r).join(r.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    return new.groupBy(F.col("to_id").alias("technology")).agg(F.count("*").alias("n_experts"))


def oldest_to_clean(spark, sf):
    """The twenty oldest notes among those of weakly linked entities, thirty days old or more."""
    old = lifecycle.cleanup_notes(_o(spark, sf), graph.degree(traverse.edges(now(spark, sf, "relationship", ["strength"]))), NOW)
    return old.orderBy("valid_from", "id").limit(20).select("id", "entity_id", F.date_format("valid_from", "yyyy-MM-dd").alias("day"))


def memory_accesses(spark, sf):
    """Access counts of notes after every event of a user counted as an access to the user's newest-numbered notes, by count."""
    o = _o(spark, sf, "metadata")
    e = load(spark, sf, "events").select(F.col("user_id").cast("long").alias("u"), F.col("ts").cast("timestamp").alias("at"))
    mine = o.select("id", (F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 150).alias("u")).join(e, "u").select("id", "at")
    found = records.touched(o, mine)
    return found.groupBy("access_count").agg(F.count("*").alias("n_notes"), F.date_format(F.max("last_accessed_at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def weak_memories(spark, sf):
    """How many notes pruning would remove and keep, by entity of ten notes or more."""
    o = _o(spark, sf, "metadata")
    a = lifecycle.activation(o, NOW).join(o.select("id", "entity_id"), "id").filter("entity_id IS NOT NULL")
    g = a.groupBy("entity_id").agg(F.sum((~F.col("retain")).cast("long")).alias("n_pruned"), F.sum(F.col("retain").cast("long")).alias("n_kept"))
    return g.filter("n_pruned + n_kept >= 10")


def compaction_candidates(spark, sf):
    """Notes that compaction would replace."""
    return lifecycle.compaction(_o(spark, sf))


def cleanup_candidates(spark, sf):
    """Old notes of weakly linked entities, by entity."""
    return lifecycle.cleanup(_o(spark, sf, "metadata"), graph.degree(traverse.edges(now(spark, sf, "relationship", ["strength"]))), NOW, 200, 3)


def inactive_sessions(spark, sf):
    """Sessions that are active and silent."""
    return lifecycle.inactive_sessions(load(spark, sf, "session_state"), NOW)


def having_counts(spark, sf):
    """Entities with more than twenty notes."""
    return _o(spark, sf).filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("n_notes")).filter("n_notes > 20")


def percentile_latency(spark, sf):
    """Percentiles of the delay between an event and its arrival, in whole milliseconds."""
    delay = F.floor((F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))) / 1000).alias("delay")
    return lifecycle.percentiles(load(spark, sf, "observation").select(delay), "delay", [0.5, 0.95, 0.99])


def session_windows(spark, sf):
    """Sessions of each user's events with gaps below 30 minutes, counted by number of events."""
    e = load(spark, sf, "events").select("user_id", "ts")
    s = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes")).agg(F.count("*").alias("n_events"))
    return s.groupBy("n_events").agg(F.count("*").alias("n_sessions"))


def paragraph_chunks(spark, sf):
    """Paragraphs of documents: number and length per source."""
    c = formats.paragraphs(load(spark, sf, "documents"), "doc_id")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"))


def markdown_import(spark, sf):
    """Heads and notes of Markdown documents, per head."""
    m = formats.markdown_entities(load(spark, sf, "documents"), "doc_id")
    return m.groupBy("name").agg(F.count("*").alias("n_notes"), F.countDistinct("doc_id").alias("n_documents"))


def import_merge(spark, sf):
    """Current entities after an import of events' users with skip of what is known."""
    log = load(spark, sf, "entity").select("id", "valid_from", "asserted", "name", "type", "metadata")
    new = load(spark, sf, "events").select(F.concat(F.lit("user:"), "user_id").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("User").alias("type"), F.lit("{}").alias("metadata"))
    after = formats.import_entities(log, new, F.lit(NOW).cast(dict(log.dtypes)["valid_from"]))
    from palimpsest.operators.versioned import current

    return current(after, ["id"]).groupBy("type").agg(F.count("*").alias("n_entities"))


def export_markdown(spark, sf):
    """Markdown lines of entities."""
    return formats.export_markdown(now(spark, sf, "entity", ["name", "type"]), now(spark, sf, "relationship", [])).select("id", "block", "k", "line")


def export_json(spark, sf):
    """Size of the JSON export: records by kind."""
    j = formats.export_json(now(spark, sf, "entity", ["name", "type", "metadata"]), _o(spark, sf, "text", "metadata"))
    return j.groupBy(F.get_json_object("record", "$.kind").alias("kind")).agg(F.count("*").alias("n_records"))


def _salience_sql() -> str:
    t = "' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' '"
    v = ", ".join(f"CASE WHEN contains(t, ' {w} ') THEN {float(x)} ELSE 0.0 END" for w, x in lifecycle.salient_words())
    return (
        f"WITH {O}, a AS (SELECT id, {t} AS t FROM o WHERE text IS NOT NULL), b AS (SELECT id, [{v}]::DOUBLE[] AS v FROM a), c AS (SELECT id, round(least(1.0, list_max(v) + (list_sum(v) - list_max(v)) * 0.2), 6)::DOUBLE AS salience FROM b) "
        "SELECT id, salience, CASE WHEN salience >= 0.7 THEN 'high' WHEN salience >= 0.4 THEN 'medium' WHEN salience >= 0.3 THEN 'low' ELSE 'neutral' END AS band FROM c"
    )


_AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(valid_from)) / 86400e6"
_ACT = f"a AS (SELECT id, round(exp(-greatest({_AGE}, 0) * 0.01::DOUBLE / least(20.0, 1 + coalesce(json_extract_string(metadata, '$.access_count')::DOUBLE, 0))), 6) AS activation FROM o)"
_G = "g AS (SELECT from_id AS src, to_id AS dst, max(coalesce(strength, 0)) AS weight FROM r WHERE from_id <> to_id GROUP BY ALL)"


def _importance_sql() -> str:
    from palimpsest.queries import core_graph

    rank = core_graph._rank_sql()
    head, _, _ = rank.rpartition(f", x{core_graph.ROUNDS - 1} AS")
    return head.replace("WITH ", f"WITH {O}, ", 1) + f" SELECT id, round(0.4 * coalesce(p, 0) + 0.3 * pow(0.5, {_AGE} * 24 / 720) + 0.3 * least(1.0, coalesce(json_extract_string(metadata, '$.access_count')::DOUBLE, 0) / 100), 6) AS importance FROM o LEFT JOIN p{core_graph.ROUNDS - 1} ON node = entity_id"


QUERIES = {
    f.__name__: f
    for f in (
        interarrival_cv, trending, seasonal_trend, temporal_correlation, recurring_events, activation_score, activation_histogram, salience_score, keyword_extract, tag_extract, importance_score,
        level_promotion, reflect_candidates, discovered_relations, oldest_to_clean, memory_accesses, weak_memories, compaction_candidates, cleanup_candidates, inactive_sessions, having_counts, percentile_latency, session_windows, paragraph_chunks, markdown_import, import_merge, export_markdown, export_json,
    )
}
_STOPS = "'" + "', '".join(__import__("palimpsest.functions.text", fromlist=["STOP"]).STOP) + "'"
SQL = {
    "interarrival_cv": f"WITH {O}, x AS (SELECT entity_id, epoch_us(valid_from) / 86400e6 - lag(epoch_us(valid_from)) OVER (PARTITION BY entity_id ORDER BY valid_from, id) / 86400e6 AS gap FROM o WHERE entity_id IS NOT NULL) "
    "SELECT entity_id, count(*) AS n_notes, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap), 4) AS sd_gap FROM x GROUP BY 1 HAVING count(*) > 1",
    "trending": f"WITH {O}, x AS (SELECT entity_id, count(*) AS n_notes, round((epoch_us(max(valid_from)) / 86400e6 - epoch_us(min(valid_from)) / 86400e6) / (count(*) - 1), 6) AS mean_gap FROM o WHERE entity_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) SELECT * FROM x WHERE mean_gap < 7",
    "seasonal_trend": f"WITH {O}, x AS (SELECT entity_id, month(valid_from) AS month, count(*) AS n_notes FROM o WHERE entity_id IS NOT NULL GROUP BY ALL), y AS (SELECT *, n_notes * 12.0 / sum(n_notes) OVER (PARTITION BY entity_id) AS ratio FROM x) "
    "SELECT entity_id, month, n_notes, round(least(1.0, ratio / 3), 6)::DOUBLE AS confidence FROM y WHERE ratio >= 2 AND n_notes >= 3",
    "temporal_correlation": f"WITH {R}, x AS (SELECT from_id, relation_type, floor(epoch_us(valid_from) / 86400e6)::INT AS day FROM r WHERE from_id IS NOT NULL) "
    "SELECT a.relation_type AS type_a, b.relation_type AS type_b, count(*) AS n_pairs, round(least(1.0, count(*) / 6.0), 6)::DOUBLE AS confidence FROM x a JOIN x b ON a.from_id = b.from_id AND abs(a.day - b.day) <= 2 AND a.relation_type < b.relation_type GROUP BY ALL HAVING count(*) >= 3",
    "recurring_events": f"WITH {O}, x AS (SELECT entity_id, md5(array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT regexp_matches(w, '[0-9]')), ' ')) AS pattern, id, epoch_us(valid_from) / 86400e6 AS day FROM o WHERE text IS NOT NULL AND entity_id IS NOT NULL), "
    "y AS (SELECT *, day - lag(day) OVER (PARTITION BY entity_id, pattern ORDER BY day, id) AS gap FROM x), z AS (SELECT entity_id, pattern, count(*) AS frequency, avg(gap) AS m, stddev_pop(gap) AS s FROM y GROUP BY ALL HAVING count(*) >= 3) "
    "SELECT entity_id, pattern, frequency, round(m, 6) AS interval_days, round(1 - s / m, 6) AS confidence FROM z WHERE m > 0 AND round(1 - s / m, 6) > 0",
    "activation_score": f"WITH {O}, {_ACT} SELECT id, activation, activation >= 0.15 AS retain FROM a",
    "activation_histogram": f"WITH {O}, {_ACT} SELECT CASE WHEN activation >= 0.8 THEN 4 WHEN activation >= 0.6 THEN 3 WHEN activation >= 0.4 THEN 2 WHEN activation >= 0.2 THEN 1 ELSE 0 END AS band, count(*) AS n FROM a GROUP BY 1",
    "salience_score": _salience_sql(),
    "keyword_extract": f"WITH {O}, x AS (SELECT entity_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS keyword FROM o WHERE entity_id IS NOT NULL), y AS (SELECT entity_id, keyword, count(*) AS n FROM x WHERE length(keyword) >= 4 AND NOT regexp_full_match(keyword, '[0-9]+') "
    f"AND keyword NOT IN ({_STOPS}) GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, keyword) <= 10",
    "tag_extract": f"""
WITH {O}, x AS (SELECT unnest(regexp_extract_all(lower(text), '(#[\\p{{L}}\\p{{N}}_]+|\\b(?:category|type|topic|subject):\\s*[\\p{{L}}\\p{{N}}_]+)')) AS tag FROM o)
SELECT regexp_replace(tag, '\\s+', '', 'g') AS tag, count(*) AS n FROM x GROUP BY 1""",
    "paragraph_chunks": "WITH x AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n[ \\t]*\\n+')) AS p FROM documents), y AS (SELECT doc_id, trim(regexp_replace(p, '^\\n+|\\n+$', '', 'g'), ' ') AS c FROM x) SELECT doc_id, count(*) AS n_chunks, sum(length(c))::BIGINT AS n_chars FROM y WHERE c <> '' GROUP BY 1",
    "importance_score": _importance_sql(),
    "level_promotion": f"""
WITH x AS ({_importance_sql()}), {O}, a AS (SELECT id, entity_id, coalesce(json_extract_string(metadata, '$.memory_level')::INT, 0) AS memory_level, {_AGE} AS age FROM o WHERE entity_id IS NOT NULL),
b AS (SELECT * FROM a WHERE age > CASE memory_level WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 30 END QUALIFY count(*) OVER (PARTITION BY entity_id, memory_level) >= 10)
SELECT entity_id, memory_level, CASE WHEN coalesce(importance, 0) >= 0.5 THEN 'promote' ELSE 'delete' END AS action, count(*) AS n_notes FROM b LEFT JOIN x USING (id) GROUP BY ALL""",
    "reflect_candidates": f"WITH {O} SELECT entity_id, count(*) AS n_notes FROM o WHERE entity_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY n_notes DESC, entity_id LIMIT 5",
    "discovered_relations": f"""
WITH {R}, x AS (SELECT DISTINCT a.from_id, b.to_id FROM r a JOIN r b ON a.to_id = b.from_id WHERE a.relation_type = 'works_on' AND b.relation_type = 'uses_tech' AND a.from_id <> b.to_id)
SELECT to_id AS technology, count(*) AS n_experts FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.from_id = x.from_id AND r.to_id = x.to_id) GROUP BY 1""",
    "oldest_to_clean": f"""
WITH {O}, {R}, {_G}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY 1)
SELECT id, entity_id, strftime(valid_from, '%Y-%m-%d') AS day FROM o LEFT JOIN d ON node = entity_id
WHERE entity_id IS NOT NULL AND {_AGE} > 30 AND coalesce(degree, 0) < 2 ORDER BY valid_from, id LIMIT 20""",
    "memory_accesses": f"""
WITH {O}, x AS (SELECT id, count(*) AS n, max(ts) AS last FROM (SELECT id, ('0x' || substr(md5(id), 1, 6))::BIGINT % 150 AS u FROM o) JOIN events ON user_id = u GROUP BY 1)
SELECT coalesce(json_extract_string(metadata, '$.access_count')::BIGINT, 0) + n AS access_count, count(*) AS n_notes, strftime(max(last), '%Y-%m-%d %H:%M:%S') AS last FROM o JOIN x USING (id) GROUP BY 1""",
    "weak_memories": f"""
WITH {O}, a AS (SELECT entity_id, round(exp(-greatest({_AGE}, 0) / least(20.0, 1 + coalesce(json_extract_string(metadata, '$.access_count')::DOUBLE, 0))), 6) >= 0.15 AS retain FROM o WHERE entity_id IS NOT NULL)
SELECT entity_id, count(*) FILTER (WHERE NOT retain) AS n_pruned, count(*) FILTER (WHERE retain) AS n_kept FROM a GROUP BY 1 HAVING count(*) >= 10""",
    "compaction_candidates": f"WITH {O}, x AS (SELECT id, entity_id, count(*) OVER (PARTITION BY entity_id) AS n, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, id DESC) AS k FROM o WHERE entity_id IS NOT NULL) SELECT id, entity_id FROM x WHERE n > 20 AND k > 10",
    "cleanup_candidates": f"WITH {O}, {R}, {_G}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) GROUP BY 1) SELECT entity_id, count(*) AS n_notes, max(coalesce(json_extract_string(metadata, '$.memory_level')::INT, 0)) + 1 AS level "
    f"FROM o LEFT JOIN d ON node = entity_id WHERE entity_id IS NOT NULL AND {_AGE} > 200 AND coalesce(degree, 0) < 3 GROUP BY 1",
    "inactive_sessions": f"WITH x AS (SELECT session_id, max(CASE WHEN last_active > 100000000000 THEN last_active / 1000 ELSE last_active END) AS last_at, bool_or(lower(status) IN ('active', 'open')) AS live FROM session_state WHERE session_id <> '' GROUP BY 1) "
    f"SELECT session_id, floor((epoch(TIMESTAMP '{NOW}') - last_at) / 60)::BIGINT AS idle_minutes FROM x WHERE live AND floor((epoch(TIMESTAMP '{NOW}') - last_at) / 60) >= 30",
    "having_counts": f"WITH {O} SELECT entity_id, count(*) AS n_notes FROM o WHERE entity_id IS NOT NULL GROUP BY 1 HAVING count(*) > 20",
    "percentile_latency": "WITH x AS (SELECT floor((epoch_us(ingested_at) - epoch_us(valid_from)) / 1000)::BIGINT AS v FROM observation), y AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM x WHERE v IS NOT NULL), s AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share) "
    "SELECT share, v AS value FROM s JOIN y ON k = floor(n * share)",
    "session_windows": "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), y AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x), z AS (SELECT user_id, s, count(*) AS n_events FROM y GROUP BY ALL) SELECT n_events, count(*) AS n_sessions FROM z GROUP BY 1",
    "markdown_import": """
WITH x AS (SELECT doc_id, string_split_regex(chr(10) || regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n##[ \\t]+') AS parts FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, string_split(unnest(parts[2:]), chr(10)) AS lines FROM x),
n AS (SELECT doc_id, trim(lines[1]) AS name, unnest(list_filter(lines[2:], lambda l: starts_with(l, '- '))) AS note FROM s)
SELECT name, count(*) AS n_notes, count(DISTINCT doc_id) AS n_documents FROM n GROUP BY 1""",
    "import_merge": f"WITH {E} SELECT type, count(*) AS n_entities FROM (SELECT type FROM e UNION ALL SELECT 'User' FROM (SELECT DISTINCT user_id FROM events)) GROUP BY 1",
    "export_markdown": f"WITH {E}, {R} SELECT id, 0 AS block, '' AS k, '# ' || coalesce(name, id) AS line FROM e UNION ALL SELECT id, 1, '', 'Type: ' || coalesce(type, 'unknown') FROM e UNION ALL "
    "SELECT from_id, 2, relation_type || '|' || to_id, '- ' || relation_type || ' [[' || coalesce(t.name, t.id) || ']]' FROM r JOIN e f ON f.id = from_id JOIN e t ON t.id = to_id",
    "export_json": f"WITH {E}, {O} SELECT 'entity' AS kind, count(*) AS n_records FROM e UNION ALL SELECT 'observation', count(*) FROM o",
}
