"""Registered queries of the numbered problems that belong to training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import languages, names, packing, pii, similar_vectors, tokens
from palimpsest.llm.near_duplicates import NearDuplicates
from palimpsest.operators.versioned import current
from palimpsest.session import stored
from palimpsest.tables import KEYS, load


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(load(spark, sf_dir, "observation").select("id", "valid_from", "asserted", "text"), KEYS["observation"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of current observations with similarity 0.7 or more."""
    return NearDuplicates(_texts(spark, sf_dir), 0.7).id_pairs()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and group of every current observation that has words, with the entity it hangs on."""
    o = current(load(spark, sf_dir, "observation").select("id", "valid_from", "asserted", "text", "entity_id"), KEYS["observation"])
    return NearDuplicates(o.select("id", "text"), 0.7).groups().join(o.select("id", "entity_id"), "id")


#: Fields of the vector search, in the order of their numbers.
VECTOR_FIELDS = ["observation.embedding", "entity.embedding", "entity.name_embedding"]


def _vectors(spark: SparkSession, sf_dir: str):
    """Current usable vectors of all fields, 16 bits a component before anything is shuffled; and a way to the given vectors of some ids."""

    def field(number: int):
        table, column = VECTOR_FIELDS[number].split(".")
        return table, load(spark, sf_dir, table).select("id", "valid_from", "asserted", F.col(column).alias("vector"))

    parts = []
    for number in range(len(VECTOR_FIELDS)):
        table, rows = field(number)
        small = similar_vectors.quantised(rows, VECTOR_SIZE, ["id", "valid_from", "asserted"])
        parts.append(current(small, KEYS[table]).filter("vec IS NOT NULL").select(F.lit(number).alias("field"), "id", "vec"))

    def exact(ids: DataFrame) -> DataFrame:
        out = []
        for number in range(len(VECTOR_FIELDS)):
            table, rows = field(number)
            some = rows.join(ids.filter(F.col("field") == number).select("id"), "id", "left_semi")
            out.append(current(some, KEYS[table]).select(F.lit(number).alias("field"), "id", "vector"))
        return out[0].unionByName(out[1]).unionByName(out[2])

    return parts[0].unionByName(parts[1]).unionByName(parts[2]), exact


#: Numbers of a usable vector.
VECTOR_SIZE = 96


def _field_name():
    return F.element_at(F.array(*map(F.lit, VECTOR_FIELDS)), F.col("field") + 1).alias("vec_field")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the ten most similar of the other, similarity 0.8 or more."""
    vectors, exact = _vectors(spark, sf_dir)
    return similar_vectors.Neighbours(vectors, VECTOR_SIZE, exact, least=0.8).pairs().select(_field_name(), "id_a", "id_b")


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors found for every vector with their similarity, whatever it is."""
    vectors, exact = _vectors(spark, sf_dir)
    found = similar_vectors.Neighbours(vectors, VECTOR_SIZE, exact, rerank_all=True)
    return found.rows().select(_field_name(), "id", "rank", "neighbour_id", "similarity")


#: Spellings of the types of people and of organisations.
PEOPLE = ["person", "human", "contact"]
FIRMS = ["organization", "organisation", "org", "company"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of current entities that stand for the same person or organisation, whatever their type says."""
    e = current(load(spark, sf_dir, "entity").select("id", "valid_from", "asserted", "name", "type"), KEYS["entity"])
    kind = F.lower(F.trim("type"))
    kind = F.when(kind.isin(PEOPLE), "person").when(kind.isin(FIRMS), "firm").when(kind.isNull() | (kind == ""), None).otherwise("other")
    return names.link(e.select("id", "name", kind.alias("kind")), load(spark, sf_dir, "name_alias"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current observations and entities, tagged: (src_table, src_id, person, clean, found); ``person``: the type says person or firm."""
    o = _texts(spark, sf_dir).select(F.lit("observation").alias("src_table"), F.col("id").alias("src_id"), F.lit(False).alias("person"), "text")
    e = current(load(spark, sf_dir, "entity").select("id", "valid_from", "asserted", "name", "type"), KEYS["entity"])
    person = F.coalesce(F.lower(F.trim("type")).isin(PEOPLE + FIRMS), F.lit(False))
    e = e.select(F.lit("entity").alias("src_table"), F.col("id").alias("src_id"), person.alias("person"), F.col("name").alias("text"))
    rows = o.unionByName(e)
    # tagging costs time by the character: tasks of like length, as many as the texts of all versions need
    size = [load(spark, sf_dir, t).agg(F.sum(F.length(c)).alias("n")) for t, c in (("observation", "text"), ("entity", "name"))]
    total = size[0].unionByName(size[1]).agg(F.sum("n")).first()[0] or 0
    return pii.tag(rows.repartition(1 + int(total // pii.TASK), "src_id"), ["src_table", "src_id", "person"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of personal data in a current observation or entity name.

    A name in an entity that stands for a person is no case: its type says
    person or firm, or nothing is left of the entity's name but the items in it.
    """
    hit = F.explode("found").alias("hit")
    value = F.regexp_replace(F.lower("hit.passage"), r"[^\p{L}\p{N}]", "").alias("pii_value")
    rest = F.regexp_replace(F.regexp_replace("clean", r"\[[A-Z_]+\]", " "), pii.TITLES_SQL, " ")
    alone = (F.col("src_table") == "entity") & ~rest.rlike(r"[\p{L}\p{N}]")
    own = (F.col("person") | alone).alias("own")
    found = _personal(spark, sf_dir).select("src_table", "src_id", own, hit).filter("NOT (own AND hit.pii_type = 'name')")
    return found.select("src_table", "src_id", "hit.pii_type", value).distinct()


def p5_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with placeholders in the place of personal data, for records that hold any."""
    return _personal(spark, sf_dir).filter(F.size("found") > 0).select("src_table", "src_id", "clean")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k, without special tokens."""
    return tokens.encode(load(spark, sf_dir, "documents"), ["doc_id"])


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and position of every document, or piece of a long one, for each row of context_window."""
    sizes = stored(tokens.count(load(spark, sf_dir, "documents"), ["doc_id"]), "sizes")
    out = packing.pack(sizes.limit(0), 1).withColumn("window_name", F.lit(""))  # what is left where no window is given
    for window in load(spark, sf_dir, "context_window").dropna().distinct().orderBy("window_name").collect():
        packed = packing.pack(sizes, window["capacity"]).withColumn("window_name", F.lit(window["window_name"]))
        out = out.unionByName(packed)
    return out.select("window_name", "container", "position", "doc_id", "piece_no", "start", "length")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    room = load(spark, sf_dir, "context_window").dropna().distinct()
    used = p7_packed(spark, sf_dir).groupBy("window_name").agg(F.sum("length").alias("n_tokens"), F.countDistinct("container").alias("n_containers"))
    fill = F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))
    return used.join(F.broadcast(room), "window_name").select("window_name", "n_tokens", "n_containers", F.round(fill, 4).alias("fill"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    codes = {x.lower(): r["code"] for r in load(spark, sf_dir, "lang_code").dropna().collect() for x in (r["code"], r["english_name"])}
    found = languages.detect(docs, ["doc_id", "lang"], languages.trained(docs, codes))
    return found.withColumn("label", languages.label_code(F.col("lang"), codes))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label (seg_no 0), and every line of those that mix languages."""
    found = _languages(spark, sf_dir).filter("language IS NOT NULL")
    wrong = F.when(F.col("label").isNull() | (F.col("label") != F.col("language")), F.array(F.struct(F.lit(0).cast("long").alias("seg_no"), F.col("language").alias("lang"))))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).cast("long").alias("seg_no"), x["lang"].alias("lang")))
    mixed = F.when(F.size(F.array_distinct(F.transform("lines", lambda x: x["lang"]))) > 1, each)
    none = F.array().cast("array<struct<seg_no:bigint,lang:string>>")
    rows = F.explode(F.concat(F.coalesce(wrong, none), F.coalesce(mixed, none)))
    return found.select("doc_id", rows.alias("row")).select("doc_id", "row.seg_no", "row.lang")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document, and of each line where languages are mixed (seg_no from 1)."""
    found = _languages(spark, sf_dir)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("seg_no"), F.col("language").alias("lang"), F.round("confidence", 4).alias("confidence")))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).cast("long").alias("seg_no"), x["lang"].alias("lang"), F.round(x["confidence"], 4).alias("confidence")))
    mixed = F.size(F.array_distinct(F.transform("lines", lambda x: x["lang"]))) > 1
    return found.select("doc_id", F.explode(F.when(mixed, F.concat(whole, each)).otherwise(whole)).alias("row")).select("doc_id", "row.*")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p3_found, p3_neighbours, p4_found, p5_found, p5_replaced, p6_ids, p7_packed, p7_fill, p8_found, p8_languages,
    )
}


def _now(table: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY id ORDER BY valid_from DESC, asserted) = 1) WHERE asserted)"


_SETS = f"""
{_now("observation", "o")},
x AS (SELECT id, entity_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS ws FROM o WHERE text IS NOT NULL),
s AS (SELECT * FROM x WHERE len(ws) > 0)"""


def _similar(rows: str) -> str:
    """Pairs of ``rows`` (id, ws) with similarity 0.7 or more."""
    return f"""
y AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM {rows}),
c AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS k FROM y a JOIN y b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) >= 0.69 * greatest(a.n, b.n) GROUP BY ALL),
p AS (SELECT id_a, id_b FROM c WHERE k::DOUBLE / (na + nb - k) >= 0.7)"""


def _vector_sql() -> str:
    parts = []
    for field in VECTOR_FIELDS:
        table, column = field.split(".")
        parts.append(f"SELECT '{field}' AS vec_field, id, {column}::DOUBLE[] AS v FROM {table[0]} WHERE len({column}) = {VECTOR_SIZE} AND list_max(list_transform({column}, lambda z: abs(z))) > 0")
    every = " UNION ALL ".join(parts)
    return f"""
WITH {_now("entity", "e")}, {_now("observation", "o")}, u AS ({every}),
t AS (SELECT a.vec_field, a.id, b.id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.vec_field = b.vec_field AND a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_field, id ORDER BY similarity DESC, neighbour_id) AS rank FROM t)
"""


SQL: dict[str, str] = {
    "p1_found": f"WITH {_SETS}, {_similar('s')} SELECT * FROM p",
    "p1_groups": f"""
WITH RECURSIVE {_SETS}, k AS (SELECT ws, min(id) AS class_id, count(*) - 1 AS n_copies FROM s GROUP BY 1), reps AS (SELECT class_id AS id, ws FROM k), {_similar('reps')},
l AS (SELECT id_a AS a, id_b AS b FROM p UNION ALL SELECT id_b, id_a FROM p),
cc(a, b) AS (SELECT class_id, class_id FROM k UNION SELECT cc.a, l.b FROM cc JOIN l ON l.a = cc.b),
g AS (SELECT a AS class_id, min(b) AS group_id FROM cc GROUP BY 1), d AS (SELECT a AS class_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT s.id, class_id, group_id, n_copies, coalesce(n_links, 0) AS n_links, entity_id FROM s JOIN k USING (ws) JOIN g USING (class_id) LEFT JOIN d USING (class_id)""",
    # equal where the windows of the search see all vectors, as in small tables; larger ones are compared in the tests
    "p3_found": _vector_sql() + "SELECT DISTINCT vec_field, least(id, neighbour_id) AS id_a, greatest(id, neighbour_id) AS id_b FROM n WHERE rank <= 10 AND similarity >= 0.8",
}
