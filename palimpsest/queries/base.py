"""What the registered queries share: current views, their SQL, and fixed parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.versioned import current
from palimpsest.tables import KEYS, USER_PROFILE, load

#: The instant that stands for now in ages and decays.
NOW = "2025-07-01 00:00:00"
#: Words searched for.
WORDS = "retention policy review of the archived sessions"
START = USER_PROFILE

QUERIES: dict = {}
SQL: dict = {}


def now(spark: SparkSession, sf_dir: str, table: str, columns: list[str]) -> DataFrame:
    """Current records of a relation with the named columns besides its keys and valid_from."""
    keys = KEYS[table]
    names = list(dict.fromkeys([*keys, "valid_from", "asserted", *columns]))
    return current(load(spark, sf_dir, table).select(*names), keys).drop("asserted")


def view(table: str, name: str) -> str:
    """SQL of the same, as a common table expression called ``name``."""
    keys = ", ".join(KEYS[table])
    return f"{name} AS (SELECT * FROM (SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY valid_from DESC, asserted) = 1) WHERE asserted)"


E, O, R = view("entity", "e"), view("observation", "o"), view("relationship", "r")  # noqa: E741


def query_vector(entity: DataFrame) -> list[float]:
    """The vector searched for: that of the first current entity that has a usable one."""
    first = entity.filter((F.size("embedding") == 96) & F.exists("embedding", lambda x: x != 0)).orderBy("id").select("embedding").first()
    return [float(x) for x in first[0]]


VECTOR = "q AS (SELECT embedding::DOUBLE[] AS v FROM e WHERE len(embedding) = 96 AND list_max(embedding) <> 0 ORDER BY id LIMIT 1)"
COSINE = "round(list_cosine_similarity(x.embedding::DOUBLE[], (SELECT v FROM q)), 6)"
USABLE = "len(x.embedding) = 96 AND list_aggregate(list_transform(x.embedding, lambda z: abs(z)), 'max') > 0"
